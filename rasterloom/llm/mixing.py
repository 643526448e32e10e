"""Mixing sources to target weights with DataFrame functions only: temperature, budgets, block permutations.

The weight of a source is its share of the tokens to the power of an exponent, normalised. The
exponent is bisected in 0 to 1: the largest at which the weights' entropy reaches a target, raised
where a source would else be repeated more often than a limit. Budgets are set so that the source
that is repeated least is taken once whole, and no document is lost. What a budget has beyond whole
copies is a prefix of a permutation of the source's blocks, and inside the last of these, of a
permutation of its documents; so no task needs a source in one piece.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import BLANK, checkpointed, free

#: Documents of a block, if all were of one source.
BLOCK = 2000
#: How often a source is repeated at most, and the entropy that is looked for, as a share of the largest.
REPEATS, ENTROPY = 2.0, 0.995
#: Exponents tried by each pass over the sources, and passes: together 2 ** 40 steps.
TRIED, PASSES = 31, 8


def key(columns: list[str], salt: str, seed: int) -> Column:
    """A number below 2 ** 60 that is drawn from the columns by hash."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts, F.lit(f"{salt}{seed}"))), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` of each row; tokens are words, and a null text has none. Without a column ``source`` all are of the null source."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source")
    return docs.select("doc_id", source, F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BLANK), "")).cast("long").alias("n_tokens"))


def exponent(totals: DataFrame, max_repeats: float, entropy: float | None) -> float:
    """The exponent for sources with ``tokens``; the driver reads sums and extremes only.

    ``entropy`` is a share of the largest possible one. Without it the target is the limit itself:
    the flattest weights that repeat no source more than ``max_repeats`` times.
    """
    some = totals.where("tokens > 0")
    n, least, most, total = some.agg(F.count("*"), F.min("tokens"), F.max("tokens"), F.sum("tokens")).first()
    if not n or least == most:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = [low + (high - low) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
        repeats_fit = [(most / least) ** (1 - a) <= max_repeats for a in tried]
        if entropy is None:
            fits = repeats_fit  # true from the exponent that is looked for on
        else:
            share = F.col("tokens") / F.lit(float(total))
            sums = some.agg(*[f for a in tried for f in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]).first()
            held = [math.log(sums[2 * k]) - a * sums[2 * k + 1] / sums[2 * k] for k, a in enumerate(tried)]
            fits = [r and h < entropy * math.log(n) for r, h in zip(repeats_fit, held)]
        first = next((k for k, x in enumerate(fits) if x), TRIED)
        low, high = tried[first - 1] if first else low, tried[first] if first < TRIED else high
    return high


def mixed(docs: DataFrame, max_repeats: float = REPEATS, entropy: float | None = ENTROPY, seed: int = 1) -> DataFrame:
    """``doc_id, source, n_tokens, block, copies`` of each row: how often it is taken, once at least.

    Null is a source of its own. A source without any token is taken once. Rows that repeat count
    each; ties in the permutation go by tokens. An empty table gives none.
    """
    rows = checkpointed(sized(docs))
    n_blocks = max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("block", F.pmod(key(["doc_id"], "block", seed), F.lit(n_blocks)))
    blocks = checkpointed(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")))
    totals = checkpointed(blocks.groupBy("source").agg(F.sum("block_tokens").alias("tokens")))
    alpha = exponent(totals, max_repeats, entropy)
    most = totals.agg(F.max("tokens")).first()[0] or 0
    budget = F.floor(F.lit(float(most)) * F.pow(F.col("tokens") / F.lit(float(max(most, 1))), F.lit(alpha)) + 1e-6)
    planned = totals.where("tokens > 0").select(F.col("source").alias("of"), F.greatest(F.lit(1), F.floor(budget / F.col("tokens"))).cast("int").alias("whole"), F.pmod(budget, F.col("tokens")).cast("long").alias("rest"))
    before = Window.partitionBy("source").orderBy(key(["source", "block"], "order", seed), "block").rowsBetween(Window.unboundedPreceding, -1)
    dealt = blocks.join(planned, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("left", F.col("rest") - F.coalesce(F.sum("block_tokens").over(before), F.lit(0)))
    dealt = dealt.select(F.col("source").alias("of"), F.col("block").alias("of_block"), F.coalesce("whole", F.lit(1)).alias("whole"), F.coalesce("left", F.lit(0)).alias("left"))
    inside = Window.partitionBy("source", "block").orderBy(key(["doc_id"], "inside", seed), "n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(dealt, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    taken = F.col("whole") + F.when((F.col("n_tokens") > 0) & (F.sum("n_tokens").over(inside) <= F.col("left")), 1).otherwise(0)
    return out.select("doc_id", "source", "n_tokens", "block", taken.alias("copies"))


def realised(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, source, n_tokens, block, copy, place``: a row for each time that a document is taken.

    ``place`` orders the mix: copies come one after the other, each with its documents permuted.
    """
    rows = mixed(docs, **how).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return rows.withColumn("place", key(["doc_id", "copy"], "place", how.get("seed", 1))).drop("copies")


def repeated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows that share an id are taken alike."""
    own, copies, copy = (free(docs, name) for name in ("_mix_id", "_mix_copies", "_mix_copy"))
    taken = mixed(docs, **how).groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(copies))
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(own)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)


def sql(max_repeats: float = REPEATS, entropy: float = ENTROPY, seed: int = 1) -> str:
    """DuckDB SQL for the rows of ``realised``, for ids that don't repeat."""
    drawn = lambda salt, *columns: "('0x' || substr(md5(concat_ws('/', " + ", ".join(f"coalesce({c}::VARCHAR, '')" for c in columns) + f", '{salt}{seed}')), 1, 15))::BIGINT"
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
        k AS (SELECT greatest(1, (count(*) + {BLOCK} - 1) // {BLOCK}) AS blocks FROM d),
        r AS (SELECT d.*, {drawn("block", "doc_id")} % (SELECT blocks FROM k) AS block FROM d),
        b AS (SELECT source, block, sum(n_tokens)::BIGINT AS block_tokens FROM r GROUP BY source, block),
        t AS (SELECT source, sum(block_tokens)::BIGINT AS tokens FROM b GROUP BY source),
        a AS (SELECT max(tokens)::DOUBLE AS most, min(tokens)::DOUBLE AS least, ln(count(*)) AS even, list(tokens) AS each, sum(tokens)::DOUBLE AS total FROM t WHERE tokens > 0),
        s AS (SELECT *, list_transform(each, lambda x: x / total) AS shares FROM a),
        x AS (SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
            UNION ALL SELECT step + 1, CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END
            FROM (SELECT step, low, high, mid, pow(most / least, 1 - mid) <= {max_repeats}
                    AND ln(list_sum(list_transform(shares, lambda p: pow(p, mid)))) - mid * list_sum(list_transform(shares, lambda p: pow(p, mid) * ln(p))) / list_sum(list_transform(shares, lambda p: pow(p, mid))) < {entropy} * even AS fits
                FROM (SELECT step, low, high, (low + high) / 2 AS mid FROM x WHERE step < 40), s)),
        e AS (SELECT CASE WHEN most = least THEN 1.0 ELSE (SELECT high FROM x ORDER BY step DESC LIMIT 1) END AS alpha, most FROM s),
        w AS (SELECT source, tokens, floor(most * pow(tokens / most, alpha) + 1e-6)::BIGINT AS budget FROM t, e WHERE tokens > 0),
        l AS (SELECT b.source, b.block, coalesce(greatest(1, budget // tokens), 1) AS whole,
                coalesce(budget % tokens - coalesce(sum(block_tokens) OVER (PARTITION BY b.source ORDER BY {drawn("order", "b.source", "b.block")}, b.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS spare
            FROM b LEFT JOIN w ON w.source IS NOT DISTINCT FROM b.source),
        c AS (SELECT r.*, whole + CASE WHEN n_tokens > 0 AND sum(n_tokens) OVER (PARTITION BY r.source, r.block ORDER BY {drawn("inside", "doc_id")}, n_tokens, doc_id ROWS UNBOUNDED PRECEDING) <= spare THEN 1 ELSE 0 END AS copies
            FROM r JOIN l ON l.source IS NOT DISTINCT FROM r.source AND l.block = r.block),
        o AS (SELECT doc_id, source, n_tokens, block, unnest(range(copies))::INT AS copy FROM c)
        SELECT *, {drawn("place", "doc_id", "copy")} AS place FROM o"""
