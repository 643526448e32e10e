"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Two 64-bit fingerprints that differ in at most ``bits`` bits are equal in at least ``8 - bits`` of
their 8 bytes: the guaranteed number of matches. Fingerprints are dealt out by three positional bytes
at a time; a covering of the byte positions by such triples lets every four equal positions contain
one of them, so that no pair is missed. Those that meet are posted by each of their positional bytes.
A fingerprint's lists are tallied: members that reach the guaranteed number are candidates, and only
these are verified by the bits that differ.

A group yields the links of a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from xxhash import xxh64_intdigest

from rasterloom.llm.common import checkpointed, free, texts
from rasterloom.llm.components import components

SEED, SHINGLE, BITS = 42, 4, 4
#: Fingerprints that one task compares at once; larger groups are dealt out by pairs of parts.
PART = 4096
#: Groups up to so many are tallied pair by pair in shifted columns, larger ones by postings, from member to member.
FEW = 8


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.array([xxh64_intdigest(b" ".join(run), SEED) for run in runs], "<u8")
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

    return texts(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def covering(positions: int = 8) -> list[tuple[int, ...]]:
    """Triples of byte positions of which every four positions contain one: three groups in a ring, with the triples inside a group and those of two of a group and one of the next."""
    group = [k % 3 for k in range(positions)]
    out = []
    for triple in combinations(range(positions), 3):
        kinds = sorted(group[k] for k in triple)
        twice = next((k for k in kinds if kinds.count(k) == 2), None)
        if len(set(kinds)) == 1 or twice is not None and (twice + 1) % 3 in kinds:
            out.append(triple)
    return out


def positional(fps: np.ndarray) -> np.ndarray:
    """The eight bytes of fingerprints, by position."""
    return np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)


def tallied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes the pairs of fingerprints share."""
    return (positional(a) == positional(b)).sum(1)


def verified(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which pairs share enough positional bytes, and of these differ in few enough bits."""
    enough = tallied(a, b) >= 8 - bits
    enough[enough] = np.bitwise_count(a[enough] ^ b[enough]) <= bits
    return enough


class Postings:
    """Lists of fingerprints by positional byte."""

    def __init__(self, fps: np.ndarray):
        self.size, self.bytes = len(fps), positional(fps)
        self.order = np.argsort(self.bytes, axis=0, kind="stable")
        self.starts = [np.searchsorted(self.bytes[self.order[:, k], k], np.arange(257)) for k in range(8)]

    def candidates(self, k: int, least: int) -> np.ndarray:
        """Members that share ``least`` positional bytes or more with member ``k``, itself included, by a tally over its lists."""
        lists = [self.order[self.starts[p][v] : self.starts[p][v + 1], p] for p, v in enumerate(self.bytes[k].tolist())]
        return np.flatnonzero(np.bincount(np.concatenate(lists), minlength=self.size) >= least)


def forest(fps: np.ndarray, bits: int = BITS) -> Iterator[tuple[int, int]]:
    """A link from each fingerprint to the least that it is connected with, among ``fps``; each is looked up once."""
    fps = np.unique(fps)
    postings, rest = Postings(fps), np.ones(len(fps), bool)
    for first in range(len(fps)):
        if not rest[first]:
            continue
        rest[first] = False
        front = [first]
        while front:
            k = front.pop()
            found = postings.candidates(k, 8 - bits)
            found = found[rest[found]]
            found = found[np.bitwise_count(fps[found] ^ fps[k]) <= bits]
            rest[found] = False
            front += found.tolist()
            yield from ((x, int(fps[first])) for x in fps[found].tolist())


def links_of(key: np.ndarray, fps: np.ndarray, bits: int = BITS) -> tuple[list[int], list[int]]:
    """Links between the fingerprints of each run of equal keys."""
    a: list[int] = []
    b: list[int] = []
    ends = np.flatnonzero(np.r_[(key[1:] != key[:-1]).any(1), True]) + 1
    starts = np.r_[0, ends[:-1]]
    sizes = ends - starts
    few = np.repeat(sizes <= FEW, sizes)
    for step in range(1, min(FEW, len(fps))):
        at = np.flatnonzero((key[step:] == key[:-step]).all(1) & few[:-step])
        x, y = fps[at], fps[at + step]
        on = verified(x, y, bits)
        a += x[on].view(np.int64).tolist()
        b += y[on].view(np.int64).tolist()
    for k in np.flatnonzero(sizes > FEW):
        found = np.array([*forest(fps[starts[k] : ends[k]], bits)], np.uint64).reshape(-1, 2).view(np.int64)
        a += found[:, 0].tolist()
        b += found[:, 1].tolist()
    return a, b


def links(fps: DataFrame, bits: int = BITS, part: int = PART) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fp``, which connect all that are within ``bits`` bits of another.

    A group with more than ``part`` fingerprints is cut into parts by hash, and each pair of parts
    is compared for itself, in tasks of about twice ``part`` fingerprints.
    """
    masks = [sum(0xFF << 8 * k for k in t) for t in covering()]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(n).cast("int").alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("held")) for n, m in enumerate(signed)])).alias("k")).select("fp", "k.n", "k.held")
    large = keyed.groupBy("n", "held").count().where(F.col("count") > part).select("n", "held", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    ways = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(own, k) * F.col("parts") + F.greatest(own, k))
    dealt = keyed.join(large, ["n", "held"], "left").select("fp", "n", "held", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(ways)).alias("way"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last key so far, which may go on
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            if not len(rows):
                continue
            other = np.flatnonzero((rows[:, 1:] != rows[-1, 1:]).any(1))
            if len(other):
                yield _batch(np.concatenate([*held, rows[: other[-1] + 1]]))
                held = []
            elif held and (held[-1][-1, 1:] != rows[-1, 1:]).any():
                yield _batch(np.concatenate(held))
                held = []
            held.append(rows[other[-1] + 1 :] if len(other) else rows)
        if held:
            yield _batch(np.concatenate(held))

    def _batch(rows: np.ndarray) -> pa.RecordBatch:
        a, b = links_of(rows[:, 1:], np.ascontiguousarray(rows[:, 0]).view(np.uint64), bits)
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.repartition("n", "held", "way").sortWithinPartitions("n", "held", "way").mapInArrow(run, "a long, b long")


def rooted(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` of each row, and ``fp, root`` of each fingerprint: the least of its component by id, nulls last, as ``none, head, fp``."""
    fps = checkpointed(fingerprints(docs, shingle))
    heads = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("head")))
    named = heads.select("fp", F.struct(F.col("head").isNull().alias("none"), "head", "fp").alias("node"))
    edges = links(heads, bits)
    for end in ("a", "b"):
        edges = edges.join(named.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")), end)
    roots = components(edges.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return fps, named.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of each row; the last is the least ``doc_id`` that links lead to.

    A null text counts as empty, and texts without a word have fingerprint 0, linked as any other.
    Equal rows have equal components. A component whose ids are all null has a null id. Copies are
    gathered to one fingerprint first, so a large group of them costs as much as one.
    """
    fps, own = rooted(docs, bits, shingle)
    return fps.join(own.select("fp", F.col("root.head").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``, the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of its least id, nulls last, the least fingerprint.

    Components without an id, and those whose least id another row has too, keep a row as well; for
    them rows are told by id and fingerprint, which are only made again if there are any.
    """
    fps, own = rooted(docs)
    kept = checkpointed(own.where(F.col("fp") == F.col("root.fp")).select(F.col("root.head").alias("head"), "fp"))
    often = fps.join(kept.select(F.col("head").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").count().where("count > 1")
    head, held = free(docs, "_head"), free(docs, "_fp")
    named = kept.select(F.col("head").alias(head), F.col("fp").alias(held))
    if kept.where("head IS NULL").isEmpty() and often.isEmpty():
        return docs.join(named, F.col("doc_id") == F.col(head), "left_semi")
    schema, mark = docs.schema, free(docs, "_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "") for t in batch.column(schema.names.index("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*schema.names, mark])

    marked = docs.mapInArrow(run, StructType([*schema.fields]).add(mark, LongType()))
    found = marked.join(named, (F.col(mark) == F.col(held)) & F.col("doc_id").eqNullSafe(F.col(head)), "left_semi")
    return found.dropDuplicates(["doc_id", mark]).drop(mark)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``representatives`` that have an id, one of each; those that share an id count as one document."""
    return representatives(docs).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
