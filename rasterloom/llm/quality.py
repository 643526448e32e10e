"""Quality rules with DataFrame functions only: base counts, and divergence from language references.

A document's histograms of character classes and of common words are compared with those of its
language by Jensen-Shannon distance. The references are pooled from all documents of the language
that pass the base rules, so they need no tuning to a corpus. Short documents, whose histograms say
little, are not judged by them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import BLANK, checkpointed

#: Common words of English, French, German and Spanish.
COMMON = sorted(set(
    "the of and to in is that for with on "
    "le la de et les des un une que dans "
    "der die das und den von zu mit ist nicht "
    "el los del y las por con para una se".split()
))
#: Characters of each class, besides white space, characters beyond ASCII, and the rest (small letters and controls).
CLASSES = {"upper": "A-Z", "digit": "0-9", "symbol": "#*$%&|<>", "mark": r"!\"'()+,./:;=?@\[\\\]^_`{}~-"}
SPACE = r"\x20\x09-\x0D"
#: Base rules: fewest words, and largest share in percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Distances beyond which a document diverges, and the characters and words it has at least to be judged by them.
MOST_CHARS, MOST_WORDS, JUDGED_CHARS, JUDGED_WORDS = 0.25, 0.25, 200, 100

#: Languages whose references are broadcast.
LANGUAGES = 10_000


def kept_chars(text: str, chars: str) -> Column:
    """How many characters of the class ``chars`` a text has."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def base(docs: DataFrame) -> DataFrame:
    """``doc_id, lang``, the base counts, and the histograms ``chars`` and ``commons`` of each row.

    A null text has no words; an empty one neither. Counts are of whole texts. Repeated windows are
    found by sorting the hashes of a document's windows inside its row; documents whose hashes are
    all different skip that.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = rows.select(
        "doc_id", "lang",
        F.array_remove(F.split("text", BLANK), "").alias("words"),
        lines.alias("lines"),
        F.char_length("text").cast("long").alias("n_chars"),
        kept_chars("text", SPACE).alias("n_space"),
        F.char_length(F.regexp_replace("text", r"[\x00-\x7F]+", "")).cast("long").alias("n_wide"),
        *[kept_chars("text", c).alias(f"n_{k}") for k, c in CLASSES.items()],
    )
    n = F.size("words")
    word = lambda k: F.get("words", k)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumns({"hashes": hashes, "found": F.filter("words", lambda w: w.isin(COMMON))})
    some = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.col("hashes")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("ordered", F.array_sort(F.transform(some, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    beside = lambda e, k: F.coalesce(F.get("ordered", k)["h"] == e["h"], F.lit(False))
    rows = rows.withColumn("at", F.array_sort(F.transform(F.filter("ordered", lambda e, k: beside(e, k - 1) | beside(e, k + 1)), lambda e: e["i"])))
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    counts = {
        "n_words": n.cast("long"),
        "word_chars": F.col("n_chars") - F.col("n_space"),
        "n_symbols": F.col("n_symbol"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }
    classes = [F.col(f"n_{k}") for k in ("space", "wide", *CLASSES)]
    rest = F.col("n_chars") - reduce(Column.__add__, classes)
    times = [(F.size("found") - F.size(F.array_remove("found", w))).cast("long") for w in COMMON]
    out = rows.select("doc_id", "lang", *[c.alias(k) for k, c in counts.items()], F.array(*classes, rest).alias("chars"), F.array(*times, (n - F.size("found")).cast("long")).alias("commons"))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def pooled(rows: DataFrame) -> DataFrame:
    """Sums of the histograms by language; null is a language of its own."""
    one = rows.where("not base_failed")
    n_chars, n_words = len(CLASSES) + 3, len(COMMON) + 1
    sums = one.groupBy("lang").agg(*[F.sum(F.col("chars")[k]).alias(f"c{k}") for k in range(n_chars)], *[F.sum(F.col("commons")[k]).alias(f"w{k}") for k in range(n_words)])
    return sums.select("lang", F.array(*[f"c{k}" for k in range(n_chars)]).alias("ref_chars"), F.array(*[f"w{k}" for k in range(n_words)]).alias("ref_commons"))


def js_distance(a: str, b: str) -> Column:
    """The Jensen-Shannon distance (0 to 1) of two histograms of counts; 0 if one has no counts."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v).cast("double")
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    both = F.zip_with(a, b, lambda x, y: part(x / total(F.col(a)), y / total(F.col(b))) + part(y / total(F.col(b)), x / total(F.col(a))))
    value = F.aggregate(both, F.lit(0.0), lambda s, v: s + v)
    return F.when((total(F.col(a)) > 0) & (total(F.col(b)) > 0), F.sqrt(F.greatest(F.lit(0.0), value / 2))).otherwise(0.0)


def judged(docs: DataFrame, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS) -> DataFrame:
    """Base counts, ``char_js`` and ``word_js`` to the language's reference, and ``kept`` of each row.

    A language of which no document passes the base rules has no reference; its documents are judged
    by the base rules alone. The counts are written out once, since both the references and the
    verdicts need them. References of up to ``LANGUAGES`` languages, some 4 MB, are broadcast, so that
    rows stay where they are; more are joined by language, and a common one is split by the join.
    """
    rows = checkpointed(base(docs))
    refs = checkpointed(pooled(rows).withColumnRenamed("lang", "ref_lang"))
    refs = F.broadcast(refs) if refs.count() <= LANGUAGES else refs
    rows = rows.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").withColumns({"char_js": js_distance("chars", "ref_chars"), "word_js": js_distance("commons", "ref_commons")})
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda s, v: s + v)
    far = ((n_chars >= JUDGED_CHARS) & (F.coalesce("char_js", F.lit(0.0)) > most_chars)) | ((F.col("n_words") >= JUDGED_WORDS) & (F.coalesce("word_js", F.lit(0.0)) > most_words))
    return rows.withColumn("kept", ~F.col("base_failed") & ~far)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept`` of each row."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql() -> str:
    """DuckDB SQL for the rows of ``report``."""
    quote = lambda x: x.replace("'", "''")
    count = lambda c: f"length(regexp_replace(text, '[^{quote(c)}]+', '', 'g'))"
    classes = {"space": count(SPACE), "wide": r"length(regexp_replace(text, '[\x00-\x7F]+', '', 'g'))"} | {k: count(c) for k, c in CLASSES.items()}
    times = ", ".join(f"len(list_filter(words, lambda x: x = '{w}'))" for w in COMMON)

    def js(hist: str, name: str) -> str:
        return f"""
        {name}_h AS (SELECT doc_id, lang, base_failed, unnest(range(len({hist}))) AS k, unnest({hist}) AS v FROM h),
        {name}_r AS (SELECT lang, k, sum(v) AS r FROM {name}_h WHERE NOT base_failed GROUP BY ALL),
        {name}_s AS (SELECT lang, sum(r) AS n FROM {name}_r GROUP BY lang),
        {name}_p AS (SELECT x.doc_id, v / nullif(sum(v) OVER (PARTITION BY x.doc_id), 0)::double AS p, r / nullif(n, 0)::double AS q
            FROM {name}_h x JOIN {name}_r y ON x.lang IS NOT DISTINCT FROM y.lang AND x.k = y.k JOIN {name}_s z ON x.lang IS NOT DISTINCT FROM z.lang),
        {name} AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
            FROM {name}_p GROUP BY doc_id)"""

    return f"""
        WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text,
                list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') AS words,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM documents),
        i AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM i),
        r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
        b AS (SELECT w.*, len(words) AS n_words, {", ".join(f"{c} AS n_{k}" for k, c in classes.items())},
                len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
        h AS (SELECT doc_id, lang, n_words, length(text) AS n_chars, length(text) - n_space AS word_chars, n_symbol AS n_symbols, n_dup_lines, n_repeat_words,
                n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
                [{", ".join(f"n_{k}" for k in classes)}, length(text) - {" - ".join(f"n_{k}" for k in classes)}] AS chars,
                list_concat([{times}], [n_words - list_sum([{times}])]) AS commons FROM b),
        {js("chars", "c")}, {js("commons", "o")}
        SELECT h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT (n_chars >= {JUDGED_CHARS} AND coalesce(c.d, 0) > {MOST_CHARS}) AND NOT (n_words >= {JUDGED_WORDS} AND coalesce(o.d, 0) > {MOST_WORDS}) AS kept
        FROM h LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)"""
