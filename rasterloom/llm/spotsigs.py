"""SpotSigs fingerprints with DataFrame functions only.

A signature is a common word, the anchor, with the chain of content words that follow it. The set of
a text's signatures is its fingerprint; two fingerprints are as alike as their Jaccard index. Sets
whose lengths differ too much can't reach a threshold, so they are partitioned by length before
signatures are compared.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import BLANK, checkpointed
from rasterloom.llm.quality import COMMON

#: Content words of a chain.
CHAIN = 3
#: Rows of a range of ids, and ranges at most.
RANGE, RANGES = 2048, 16_000


def signed(rows: DataFrame, texts: dict[str, str], chain: int = CHAIN) -> DataFrame:
    """``rows`` with a sorted set of signature hashes ``out`` for each ``out: column`` of ``texts``.

    A text without a signature has one of all its words, so that it is like its equals only. The
    k-th anchor at place a has a - k content words before it, which finds its chain in the list of
    content words without a search.
    """
    for out, column in texts.items():
        rows = rows.withColumn(f"_w_{out}", F.array_remove(F.split(F.lower(F.coalesce(column, F.lit(""))), BLANK), ""))
    steps: dict[str, Column] = {}
    for out in texts:
        words = f"_w_{out}"
        steps[f"_a_{out}"] = F.filter(F.transform(words, lambda w, i: F.when(w.isin(COMMON), i)), lambda i: i.isNotNull())
        steps[f"_c_{out}"] = F.filter(words, lambda w: ~w.isin(COMMON))
    rows = rows.withColumns(steps)

    def spots(words: str, at: str, content: str) -> Column:
        def one(a: Column, k: Column) -> Column:
            chained = [F.get(content, a - k + n) for n in range(chain)]
            return F.when(a - k + chain <= F.size(content), F.xxhash64(F.get(words, a), *chained))

        return F.transform(at, one)

    sets = {f"_s_{out}": F.array_sort(F.array_distinct(F.array_compact(spots(f"_w_{out}", f"_a_{out}", f"_c_{out}")))) for out in texts}
    rows = rows.withColumns(sets)
    whole = {out: F.when(F.size(f"_s_{out}") > 0, F.col(f"_s_{out}")).otherwise(F.array(F.xxhash64(F.array_join(f"_w_{out}", " ")))) for out in texts}
    return rows.withColumns(whole).drop(*[f"_{k}_{out}" for out in texts for k in "wacs"])


def likeness(a: str, b: str) -> Column:
    """The Jaccard index of two sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def shown(signatures: str) -> Column:
    """A fingerprint as text: how many signatures, and a digest of them."""
    return F.concat_ws(":", F.size(signatures).cast("string"), F.sha2(F.array_join(F.transform(signatures, lambda s: F.hex(s)), ","), 256))


def in_order(docs: DataFrame) -> Column:
    """A number that grows with the id, or stays: numbers as they are, strings by their first seven bytes, times by the clock."""
    kind, own = dict(docs.dtypes)["doc_id"], F.col("doc_id")
    if kind == "string":
        return F.conv(F.rpad(F.substring(F.hex(own.cast("binary")), 1, 14), 14, "0"), 16, 10).cast("long")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_timestamp(own.cast("timestamp"))
    return own if re.match("(tiny|small|big)?int|float|double|decimal", kind) else F.when(own.isNotNull(), 0)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, following``: the text that comes next by descending id, after the last the first.

    Null texts are empty, null ids come last, and rows that share an id are ordered by text. Ids, of
    any type that can be ordered, are cut into ranges of about equal size, each ordered by itself; a
    range's last row gets the first of the next range. The driver reads the bounds of at most
    ``RANGES`` ranges.
    """
    own = in_order(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.select("doc_id").count()
    cuts = min(RANGES, n // RANGE)
    bounds = sorted(set(docs.agg(F.percentile_approx(own, [k / (cuts + 1) for k in range(1, cuts + 1)], max(10_000, 4 * cuts))).first()[0] or [])) if cuts else []
    if bounds:
        table, steps = F.array(*[F.lit(b) for b in bounds]), [1 << k for k in reversed(range(len(bounds).bit_length()))]
        found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(table, at + s - 1) <= own, F.lit(False)), at + s).otherwise(at))
    else:
        found = F.lit(0)
    found = F.when(F.col("doc_id").isNull(), -1).otherwise(found)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    heads = checkpointed(docs.select("doc_id", found.alias("range")).groupBy("range").agg(F.max("doc_id").alias("head")))
    by_range = Window.orderBy(F.col("range").desc())
    after = heads.select("range", F.coalesce(F.lead("range").over(by_range), F.max("range").over(Window.partitionBy())).alias("after"))
    first = rows.join(F.broadcast(heads.select(F.col("range").alias("_range"), "head")), F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy(F.col("_range").alias("after")).agg(F.min("text").alias("first_text"))
    first = checkpointed(after.join(first, "after").select("range", "first_text"))
    ranged = rows.withColumn("range", found).withColumn("following", F.lead("text").over(Window.partitionBy("range").orderBy(*order)))
    return ranged.join(first, "range", "left").select("doc_id", "text", F.coalesce("following", "first_text").alias("following"))


def report(docs: DataFrame) -> DataFrame:
    """Each document against its edited text, whose last half is the next one's beginning, and against the next one."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("following", F.lit(1), half))
    rows = signed(rows.withColumn("edited", edited), {"own": "text", "other": "edited", "next": "following"})
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("own").alias("fingerprint"),
        shown("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``a, b, likeness`` of the fingerprints that are alike by ``least`` or more, ``a < b``, as their least ids.

    Equal fingerprints are gathered to the least id first. Of each the rarest signatures are posted,
    as many as two such sets must share one of; postings are partitioned by the classes of lengths
    that a partner can have.
    """
    sets = signed(docs.select("doc_id", "text"), {"sigs": "text"}).groupBy("sigs").agg(F.min("doc_id").alias("id"))
    sets = checkpointed(sets.select("id", "sigs", F.size("sigs").alias("n")))
    each = sets.select("id", "n", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").count().where("count > 1")
    ranked = each.join(often, "sig", "left").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("count", F.lit(1)), "sig")))
    posted = ranked.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least) + 1) & F.col("count").isNotNull())
    step = -math.log(least)
    of = F.floor(F.log(F.col("n")) / step).cast("int")
    left = posted.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "sig", of.alias("class"))
    right = posted.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "sig", F.explode(F.array(of - 1, of, of + 1)).alias("class"))
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    pairs = left.join(right, ["sig", "class"]).where(fits).select("a", "b").distinct()
    x, y = sets.select(F.col("id").alias("a"), F.col("sigs").alias("x")), sets.select(F.col("id").alias("b"), F.col("sigs").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", likeness("x", "y").alias("likeness")).where(F.col("likeness") >= least)
