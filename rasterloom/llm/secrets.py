"""Secret scans: patterns of credentials, and strings that a tokenizer spends many tokens on.

Random strings have few characters per token of a vocabulary made from prose. A run of credential
letters, or what the patterns leave of it, is a secret if it has fewer than ``max_ratio`` characters
per token, unless it is a known digest or identifier.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import texts

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Hexadecimal digits of MD5 and SHA-1, SHA-224 to SHA-512.
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
ONE_CASE_HEX = re.compile("[0-9a-f]+|[0-9A-F]+")
IDENTIFIER = re.compile("[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9+/_=-]+|sha(?:256|384|512)-[A-Za-z0-9+/]+=*")
#: A run beyond this length is judged by pieces, which bounds the tokenizer's work on a word.
PIECE = 512
#: Characters of a run, and of the least remainder of a random run, that are judged.
WHOLE, REST = 20, 4

CODERS: dict[str, object] = {}


def coder(path: str):
    """The tiktoken vocabulary at ``path``, read once by each worker."""
    if path not in CODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        CODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return CODERS[path]


def known(run: str) -> bool:
    """Whether a run is a digest, a UUID, a number or a subresource hash."""
    return bool(ONE_CASE_HEX.fullmatch(run)) and len(run) in DIGEST_CHARS or bool(IDENTIFIER.fullmatch(run))


def spans(text: str, vocab_path: str, max_ratio: float) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of each secret, sorted; ``kind`` is a place in ``KINDS``."""
    found = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b in found)

    def random(run: str) -> bool:
        return not known(run) and len(run) < max_ratio * sum(len(coder(vocab_path).encode_ordinary(run[k : k + PIECE])) for k in range(0, len(run), PIECE))

    first = 0
    for m in RUN.finditer(text):
        while first < len(base) and base[first][1] <= m.start():
            first += 1
        parts, at, k, whole = [], m.start(), first, None
        while k < len(base) and base[k][0] < m.end():
            if base[k][0] > at:
                parts.append((at, base[k][0]))
            at = max(at, base[k][1])
            k += 1
        if at < m.end():
            parts.append((at, m.end()))
        for a, b in parts:
            if REST <= b - a < WHOLE and whole is None:
                whole = random(m[0])  # once for all that is left of the run
            if (b - a >= WHOLE or b - a >= REST and whole) and random(text[a:b]):
                found.append((a, 3, b))
    return sorted(found)


def scan(docs: DataFrame, vocab_path: str, max_ratio: float = 2.0) -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end; code points, end exclusive) of each document.

    A null or empty text has no spans. Rows that repeat have a row each. Columns besides ``doc_id``
    and ``text`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t.as_py(), vocab_path, max_ratio)] for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "spans": pa.array(out, kind)})

    return texts(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, vocab_path: str, max_ratio: float = 2.0, mark: str = "[secret]") -> DataFrame:
    """``docs`` with ``mark`` in place of each secret, and ``n_chars`` as it is then; other columns as they were.

    A document without a secret stays as it is, a null text stays null. Spans that overlap become one mark.
    """

    def clean(text: str | None) -> str | None:
        parts, at = [], 0
        for a, _, b in spans(text, vocab_path, max_ratio) if text else ():
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join([*parts, text[at:]]) if parts else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array([clean(t.as_py()) for t in batch.column(k)], batch.schema.field(k).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def report(docs: DataFrame, vocab_path: str, max_ratio: float = 2.0) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` from the spans that ``scan`` finds."""

    def line(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return scan(docs, vocab_path, max_ratio).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("random").alias("n_random"),
    )
