"""Byte-pair encoding with a contiguous rank array per word, and decoding.

A word is held as part boundaries with the rank of each pair of adjacent parts. The least rank is
looked for, the boundary it spans is deleted, and the two neighbouring ranks are looked up again.
Words longer than ``SHORT`` bytes, where repeated scans would be quadratic, take the same merges
from a heap. Many words of one length go through the scan together, as the rows of a rank matrix:
each round deletes one boundary of every row that still has a pair to merge.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import texts

#: Bytes of a word up to which the rank array is scanned.
SHORT = 160
#: Characters of the longest word that is remembered, and how many are before a worker starts anew.
KEPT, MOST_KEPT = 64, 120_000
NONE = 1 << 60
#: Over any id.
WIDE = 1 << 24
#: Characters of the texts that are encoded together.
TOGETHER = 500_000
BEYOND_LATIN = re.compile("[^\\x00-\u024f]")
TWO_SPACES = re.compile(r"\s\s")
AT_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def latin(pattern: str, end: int = 0x250) -> str:
    """``pattern`` for the faster ``re``, right for texts whose characters are all below ``end``."""
    low = [chr(c) for c in range(end)]
    kinds = {k: "".join(re.escape(c) for c in low if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    return pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(kinds.values())}]").replace(r"\S", f"[^{kinds[r'\s']}]").replace(r"\s", f"[{kinds[r'\s']}]").replace(r"\p{L}", f"[{kinds[r'\p{L}']}]").replace(r"\p{N}", f"[{kinds[r'\p{N}']}]")


class RankArrayBPE:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    #: Fixed value: the byte-level split pattern.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *added.values()])
        self.token_bytes = [b""] * size
        for token, k in vocab.items():
            self.token_bytes[k] = bytes(byte_of[c] for c in token)
        for token, k in added.items():
            self.token_bytes[k] = token.encode()
        self.digits = [str(k) for k in range(size)]
        self.added = added
        self.at_added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.find_any = regex.compile(self.PATTERN).findall
        self.find_latin = re.compile(latin(self.PATTERN)).findall
        keys = np.array([a * WIDE + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        ranked = np.array([*self.pairs.values()], np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = keys[order], ranked[order, 0]
        self.merged = np.zeros(1 + ranked[:, 0].max(initial=0), np.int32)
        self.merged[ranked[:, 0]] = ranked[:, 1]
        self.of_byte = np.array(self.byte_ids, np.int32)
        every = self.of_byte.astype(np.int64)
        self.byte_ranks = self._ranks(np.repeat(every, 256), np.tile(every, 256))
        self.words: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str, tuple[int, ...]] = {}

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.byte_ids[b] for b in word]
        return self._by_heap(ids) if len(ids) > SHORT else self._by_scan(ids)

    def _by_scan(self, ids: list[int]) -> list[int]:
        """``ids`` has an entry for each boundary where a part begins, ``ranks`` one for each that a merge may delete."""
        pairs, nothing = self.pairs, (NONE, 0)
        ranks = [pairs.get(p, nothing)[0] for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            k = ranks.index(least)
            ids[k] = pairs[ids[k], ids[k + 1]][1]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = pairs.get((ids[k - 1], ids[k]), nothing)[0]
            if k < len(ranks):
                ranks[k] = pairs.get((ids[k], ids[k + 1]), nothing)[0]
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * WIDE + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def _by_scans(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``_by_scan`` of words that have the same length, row by row of a matrix."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1).astype(np.int64)
        ids, rows, out = self.of_byte[raw], np.arange(len(words)), [()] * len(words)
        ranks = self.byte_ranks[raw[:, :-1] * 256 + raw[:, 1:]]
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            all_rows = np.arange(len(rows))
            least = ranks[all_rows, at] if ranks.shape[1] else np.full(len(rows), NONE)
            on = least != NONE
            for row, done in zip(rows[~on].tolist(), ids[~on].tolist()):
                out[row] = tuple(done)
            if not on.all():
                ids, ranks, rows, at, least = ids[on], ranks[on], rows[on], at[on], least[on]
                all_rows = all_rows[: len(rows)]
            if not len(rows):
                break
            ids[all_rows, at] = self.merged[least]
            n = ids.shape[1]
            ids = ids[np.arange(n) != (at + 1)[:, None]].reshape(len(rows), n - 1)
            ranks = ranks[np.arange(n - 1) != at[:, None]].reshape(len(rows), n - 2)
            for has, k in ((at > 0, at - 1), (at < n - 2, at)):
                r, k = all_rows[has], k[has]
                ranks[r, k] = self._ranks(ids[r, k], ids[r, k + 1])
        return out

    def find_words(self, text: str) -> list[str]:
        """The words that a text is split into."""
        return (self.find_any if BEYOND_LATIN.search(text) else self.find_latin)(text)

    def encode_words(self, words: Iterable[str]) -> None:
        """Remember the ids of words."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            by_length.setdefault(len(raw), []).append((word, raw))
        for n, group in by_length.items():
            if n > SHORT:
                self.words.update((w, tuple(self.encode_word(raw))) for w, raw in group)
            else:
                for lo in range(0, len(group), 8192):
                    part = group[lo : lo + 8192]
                    self.words.update(zip((w for w, _ in part), self._by_scans([raw for _, raw in part])))

    def _by_heap(self, ids: list[int]) -> list[int]:
        """The same merges, lowest rank and then leftmost first, in n log n."""
        pairs, n = self.pairs, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(pairs[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != left or nxt < 0 or ids[nxt] != right:
                continue  # a neighbour has merged meanwhile
            ids[k] = pairs[left, right][1]
            ids[nxt] = -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (found := pairs.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, ids[a], ids[b]))
        return [k for k in ids if k >= 0]

    def _runs(self, text: str) -> list[str]:
        """Parts of a text that can be split alone: a single space between two other characters begins a word."""
        if "\x00" in text:
            return [text]
        return (AT_SPACE.sub("\x00 ", text) if TWO_SPACES.search(text) else text.replace(" ", "\x00 ")).split("\x00")

    def _parts(self, text: str) -> list[list[str] | int]:
        """Runs of what is between added tokens, and the ids of these."""
        if self.at_added is None or not self.at_added.search(text):
            return [self._runs(text)]
        parts, start = [], 0
        for m in self.at_added.finditer(text):
            parts += [self._runs(text[start : m.start()]), self.added[m[0]]]
            start = m.end()
        return [*parts, self._runs(text[start:])]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; the strings of added tokens become those tokens."""
        for kept in (self.words, self.runs):
            if len(kept) > MOST_KEPT:
                kept.clear()
        parts = [self._parts(t) for t in texts]
        new = set(chain.from_iterable(p for ps in parts for p in ps if not isinstance(p, int))).difference(self.runs)
        split = {run: self.find_words(run) for run in new}
        self.encode_words(set(chain.from_iterable(split.values())).difference(self.words))
        of_word, of_run = self.words.__getitem__, self.runs.__getitem__
        self.runs.update((run, tuple(chain.from_iterable(map(of_word, words)))) for run, words in split.items())
        out = []
        for ps in parts:
            ids: list[int] = []
            for p in ps:
                if isinstance(p, int):
                    ids.append(p)
                else:
                    ids += chain.from_iterable(map(of_run, p))
            out.append(ids)
        for run in [x for x in new if len(x) > KEPT]:
            del self.runs[run]
            for word in split[run]:
                if len(word) > KEPT:
                    self.words.pop(word, None)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


LOADED: dict[str, RankArrayBPE] = {}


def loaded(path: str) -> RankArrayBPE:
    """The vocabulary at ``path``, read once by each worker, which then looks for garbage among newer objects only."""
    if path not in LOADED:
        LOADED[path] = RankArrayBPE(path)
        gc.collect()
        gc.freeze()
        gc.set_threshold(100_000, 20, 20)
    return LOADED[path]


def blocks(batch: pa.RecordBatch, most: int = TOGETHER) -> Iterator[tuple[pa.Array, list[str]]]:
    """The two columns of a batch, keys and texts, by blocks of about ``most`` characters."""
    start, held, size = 0, [], 0
    for k, value in enumerate(batch.column(1)):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= most or k == batch.num_rows - 1:
            yield batch.column(0).slice(start, len(held)), held
            start, held, size = k + 1, [], 0


def encode(docs: DataFrame, vocab_path: str, text: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (and the decoded ``text``) of each document.

    A null or empty text has no ids. Rows that repeat are encoded each; columns besides ``doc_id``
    and ``text`` are not read. ``vocab_path`` must be there on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocab_path)
        for batch in batches:
            for keys, values in blocks(batch):
                ids = bpe.encode_many(values)
                out = {"doc_id": keys, "ids": pa.array(ids, pa.list_(pa.int32()))}
                if text:
                    out["text"] = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return texts(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>" + ", text string" * text)


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``ids``; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocab_path)
        for batch in batches:
            text = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(text, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, vocab_path: str, keep: list[str] | None = None, forget: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document, and the columns ``keep`` as they were.

    Digests are of the decimal ids joined by commas, and of the text decoded from these ids. They
    are made where the ids are, so that no id leaves its worker. With ``forget`` a worker remembers
    words until its task ends only, for those that have other work afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocab_path)
        digits = bpe.digits.__getitem__
        for batch in batches:
            start = 0
            for keys, values in blocks(batch):
                n, of_ids, of_text = [], [], []
                for ids in bpe.encode_many(values):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                kept = {c: batch.column(2 + k).slice(start, len(values)) for k, c in enumerate(keep or [])}
                start += len(values)
                yield pa.RecordBatch.from_pydict({"doc_id": keys, **kept, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())})
        if forget:
            bpe.words.clear()
            bpe.runs.clear()

    kinds = dict(docs.dtypes)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep or [])
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, " + "".join(f"`{c}` {kinds[c]}, " for c in keep or []) + "n_tokens long, ids_sha256 string, decoded_sha256 string")
