"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import hashlib
import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rasterloom.llm import secrets, simhash, toxicity
from rasterloom.llm.common import table
from rasterloom.llm.queries import vocabulary
from tests.llm.test_operators import ROWS, plain_components, plain_fingerprint, plain_spans, prose, tokens, toxic_set

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    machine = toxicity.train(docs, table(spark, SF, "labels"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "bpe"]
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert name == "bpe" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([r.asDict() for r in docs.collect()])
    clean, single, hidden, mixed, coded = kept
    if machine is not None:
        score = dict(zip(before, machine.score(machine.best([r.text for r in before.values()], {})).tolist()))
        assert {r["doc_id"] for r in clean} == {k for k, v in score.items() if v < 0.5}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in clean}
    roots = plain_components(sorted(set(fps.values())))
    least = {}
    for k, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], k), k)
    assert {r["doc_id"] for r in single} == set(least.values()) and len(single) == len(least)
    path = vocabulary("byte_bpe_50k.tiktoken")
    texts = {r["doc_id"]: r["text"] for r in hidden}
    assert set(texts) == {r["doc_id"] for r in single}
    for r in single:
        found = secrets.spans(r["text"], path, 2.0)
        assert (texts[r["doc_id"]] == r["text"]) == (not found)
        assert all(r["text"][a:b] not in texts[r["doc_id"]] for a, _, b in found)
    assert {r["doc_id"] for r in mixed} == set(texts) and all(texts[r["doc_id"]] == r["text"] for r in mixed)
    shares = {}
    for r in mixed:
        shares[r["source"]] = shares.get(r["source"], 0) + len(tokens(r["text"]))
    assert min(shares.values()) > 0
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {k: hashlib.sha256(",".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for k, t in texts.items()}
    assert len(coded) == len(mixed) and all(r["ids_sha256"] == want[r["doc_id"]] for r in coded)
    assert simhash.BITS == 4


def test_pipeline_is_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run and (corpus_pipeline.ORACLE_SQL is None) == ("pipeline" not in entry.oracle_sql())


def test_pipeline_keeps_documents_without_an_id(spark):
    rows = [(None, "one text that has no id at all"), (None, "one text that has no id at all"), (None, "and quite another of them here"), (1, "a text with its own id there"), (1, "different words under the same id"), (2, "a text with its own id there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.without_copies(spark, docs, "").collect()
    assert sorted(r.text for r in got) == sorted({t for _, t in rows}) and [r.doc_id for r in got].count(None) == 2


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_accounts_for_each_row(spark, tmp_path):
    """From rows with nulls, copies, secrets, insults and clashing columns, against plain versions of all five stages."""
    import base64

    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    labelled = toxic_set()
    r = random.Random(4)
    key = "".join(r.choices("ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789", k=44))
    more = [(k, t) for k, t, *_ in ROWS] + [(None, None), (None, "no id"), (901, f"see {key} and token = abcdefghijkl0123 there"), (902, "an idiot and a moron scumbag"), (903, prose(300, 77)), (904, prose(300, 77)), (905, prose(300, 77) + "\n")]
    rows = [(k, t, f"s{n % 3}" if n % 7 else None, "en", n) for n, (k, t) in enumerate([(k, t) for k, t, _ in labelled] + [(2000 + k if k is not None else None, t) for k, t in more])]
    docs = spark.createDataFrame([(*x, 1.0, "b", [2]) for x in rows], "doc_id long, text string, source string, lang string, n_chars long, _toxicity_score double, _own string, fp array<int>").repartition(3)
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([(k, y) for k, _, y in labelled], "doc_id long, toxic int").write.parquet(f"{tmp_path}/sf/labels.parquet")

    machine = toxicity.train(docs, table(spark, f"{tmp_path}/sf", "labels"))
    score = lambda t: float(machine.score(machine.best([t or ""], {}))[0])
    clean = [x for x in rows if score(x[1]) < 0.5]
    assert sum(y for *_, y in labelled) <= len(rows) - len(clean) <= sum(y for *_, y in labelled) + 3
    groups = plain_components(sorted({plain_fingerprint(x[1]) for x in clean}))
    of, held = {}, {}
    for x in clean:
        of.setdefault(groups[plain_fingerprint(x[1])], []).append(x)
    for root, group in of.items():
        held[root] = min(group, key=lambda x: (x[0] is None, x[0] or 0))

    def hidden(text):
        out, at = [], 0
        for a, _, b in plain_spans(text or "", ranks):
            if a >= at:
                out += [text[at:a], "[secret]"]
            at = max(at, b)
        return "".join([*out, (text or "")[at:]])

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = set()
    for x in held.values():
        ids = library.encode(hidden(x[1]), add_special_tokens=False).ids
        want.add((x[0], len(ids), digest(",".join(map(str, ids))), digest(hidden(x[1]))))
    got = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()
    assert {(g.doc_id, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got} == want
    assert len(got) >= len(held) and {g.source for g in got} == {x[2] for x in held.values()}

    none = docs.where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, f"{tmp_path}/sf")
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)
        if name != "bpe":
            assert stage(spark, docs, f"{tmp_path}/sf").schema.names == docs.columns


def test_pipeline_workers_get_small_batches(spark):
    """24 texts of a million letters were one batch; rows longer than the limit stay whole, and a lower limit stays."""
    from rasterloom.llm import bpe, common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def run(batches):
        for batch in batches:
            yield batch.from_pydict({"rows": [batch.num_rows], "n": [batch.nbytes]})

    docs = spark.createDataFrame([(k, "", "a") for k in range(24)], "doc_id long, text string, source string").coalesce(1)
    docs = docs.selectExpr("doc_id", "repeat('x', if(doc_id = 5, 9, 1) * 1000000) AS text", "source")
    try:
        corpus_pipeline.without_secrets(spark, docs, SF)
        got = docs.mapInArrow(run, "rows long, n long").collect()
        assert sum(r.rows for r in got) == 24
        assert max(r.n for r in got if r.rows > 1) <= common.BATCH + 9_100_000 and max(r.rows for r in got) <= 5
        spark.conf.set(name, "1m")
        common.small_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
    few = docs.limit(0).union(spark.createDataFrame([(1, "one two", "a"), (2, None, "b")], "doc_id long, text string, source string"))
    path = vocabulary("byte_bpe_50k.json")
    assert bpe.round_trip(few, path, keep=["source"], forget=True).collect() == bpe.round_trip(few, path, keep=["source"]).collect()
