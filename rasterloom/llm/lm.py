"""Masked pseudo-likelihood: a window network that predicts every word from both sides.

Tokens are words. Frequent ones have a number of their own, in the order of how often they occur;
all others share numbers by hash. A small network in numpy reads the ``SIDE`` words on each side of a
masked one and gives the log-probability of its number, as that of its class of numbers and of the
member in the class. Which of the words of a shared number it is has the probability of its spelling,
from counts of neighbouring bytes. The sum over a document's words is its score.

Counts of words and of neighbouring bytes are of the whole corpus. Training passes over every window
of the corpus once: in each round each task takes a part of its documents where they are read and
trains a copy of the network, and the copies are averaged by a shuffle. No text is moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import checkpointed, texts

#: Words seen on each side, classes and members of a class, numbers that are shared, sizes of the layers.
SIDE, CLASSES, MEMBERS, SHARED, EMBED, HIDDEN = 3, 40, 50, 256, 12, 24
#: Numbers: 0 is what is beyond the text, then frequent words, then the shared ones.
NUMBERS = CLASSES * MEMBERS
FREQUENT = NUMBERS - SHARED - 1
#: Rounds of averaging, windows of a step at most and at least, steps that a round is cut to if it has few windows.
ROUNDS, STEP, LEAST_STEP, STEPS = 4, 8192, 256, 48
#: Windows that are drawn from in random order, and handled at once when texts are scored.
SHUFFLED, SCORED = 1 << 17, 1 << 15
#: Bytes of texts that are handled together; distinct words that a task counts before it passes them on.
TOGETHER, HELD = 1 << 22, 300_000
#: Windows whose layers are made together, so that they stay in a core's cache.
CACHED = 1024
#: Logits that are all this close take one shift, and none if they are this close to zero, as no exponential of them then vanishes.
NEAR = 60.0
Weights = dict[str, np.ndarray]


def blocks(column: pa.Array) -> Iterator[pa.ListArray]:
    """The words of each text, which are what ASCII white space leaves, by blocks of about ``TOGETHER`` bytes."""
    ends, lo = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(column):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOGETHER)) + 1
        yield words_of(column.slice(lo, hi - lo))
        lo = hi


def words_of(column: pa.Array) -> pa.ListArray:
    """The words of each text, as the bytes that they are."""
    parts = pc.ascii_split_whitespace(column)
    starts, words = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten()
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end of a text leaves an empty part
    if not there.all():
        words, starts = words.filter(pa.array(there)), np.r_[0, np.cumsum(there)][starts]
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words.cast(pa.binary()))


def counted(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each word occurs in the corpus. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for block in chain.from_iterable(blocks(batch.column(0)) for batch in batches):
            held.append(pa.Table.from_arrays(block.flatten().value_counts().flatten(), ["word", "n"]))
            size += len(held[-1])
            if size > HELD:
                held = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                if len(held[0]) > HELD:
                    yield from held.pop().to_batches()
                size = sum(map(len, held))
        for table in held:
            yield from table.to_batches()

    return texts(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Numbers of frequent words, how often each number occurs, and log-probabilities of a byte after another (256 is a word's start and end)."""

    numbers: dict[bytes, int]
    counts: np.ndarray
    spelling: np.ndarray

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """The log-probability of the spelling of words that share numbers."""
        table, space = self.spelling[:256, :256].copy(), 0x20  # no word has a space, which stands for its start and end
        table[space], table[:, space] = self.spelling[256, :256], self.spelling[:256, 256]
        raw = np.frombuffer(b" ".join([b"", *words, b""]), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        pairs = table.ravel().take(raw[:-1] * np.int64(256) + raw[1:])
        return np.add.reduceat(pairs, np.cumsum(size + 1) - size - 1) + np.log(SHARED)

    def flat(self, block: pa.ListArray | list[list[bytes]], spell: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of texts with ``SIDE`` zeros around each text, and the spelling's log-probability of each word.

        Words are looked up and spelled once in a block, however often they are in it.
        """
        if isinstance(block, list):
            block = pa.array(block, pa.list_(pa.binary()))
        size, words = block.value_lengths().to_numpy(), block.flatten().dictionary_encode()
        at, distinct = words.indices.to_numpy(), words.dictionary
        found = pc.index_in(distinct, value_set=pa.array(list(self.numbers), pa.binary())).fill_null(-1).to_numpy()
        number, own = np.array([*self.numbers.values(), 0], np.int16)[found], np.zeros(len(found))
        rare = np.flatnonzero(number == 0)
        if len(rare):
            others = distinct.take(pa.array(rare)).to_numpy(zero_copy_only=False).tolist()
            number[rare] = 1 + FREQUENT + np.fromiter(map(crc32, others), np.int64, len(others)) % SHARED
            if spell:
                own[rare] = self.spelled(others)
        out = np.zeros(len(at) + SIDE * (len(block) + 1), np.int16)
        out[np.arange(len(at)) + SIDE * (1 + np.repeat(np.arange(len(block)), size))] = number.take(at)
        return out, own.take(at)


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` words that occur most often, ties by the word.

    Words are first counted by steps of their frequency, a few hundred rows, which tell the step that
    the last of them is in; only words from there on are sorted.
    """
    step = F.floor(F.log2("n") * 16)
    need, least = size, -1
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):
        if need <= 0:
            break
        need, least = need - r.words, r.step
    return counts.where(step >= least).orderBy(F.col("n").desc(), "word").limit(size)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """From the counts of all words; the driver gets the frequent words, the shared numbers' sums and the counts of neighbouring bytes."""
    counts = checkpointed(counted(docs))
    often = most_frequent(counts, FREQUENT).collect()
    numbers = {bytes(r.word): k for k, r in enumerate(often, 1)}
    sums = np.zeros(NUMBERS)
    sums[1 : 1 + len(often)] = [r.n for r in often]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, shared = np.zeros(257 * 257), np.zeros(SHARED)
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in numbers]
            if rows:
                raw = np.frombuffer(b"".join(w for w, _ in rows), np.uint8).astype(np.int64)
                size = np.fromiter((len(w) for w, _ in rows), np.int64, len(rows))
                n, ends = np.array([n for _, n in rows], float), np.cumsum(size)
                before = np.r_[256, raw[:-1]]
                before[ends[:-1]] = 256
                pairs += np.bincount(before * 257 + raw, np.repeat(n, size), 257 * 257) + np.bincount(raw[ends - 1] * 257 + 256, n, 257 * 257)
                shared += np.bincount([crc32(w) % SHARED for w, _ in rows], n, SHARED)
        every = np.r_[pairs, shared]
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_pydict({"place": pa.array(at), "n": pa.array(every[at].astype(np.int64))})

    got = counts.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    every = np.zeros(257 * 257 + SHARED)
    every[[r.place for r in got]] = [r.n for r in got]
    sums[1 + FREQUENT : 1 + FREQUENT + SHARED] = every[257 * 257 :]
    pairs = every[: 257 * 257].reshape(257, 257) + 0.02
    return Vocabulary(numbers, sums, np.log(pairs / pairs.sum(1, keepdims=True)))


def fresh(counts: np.ndarray, seed: int = 3) -> Weights:
    """Weights to begin with, which predict numbers by how often they occur."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
    n = (counts + 0.1).reshape(CLASSES, MEMBERS)
    n[0, 0] = 1e-3
    return {
        "e": draw(NUMBERS, EMBED) * np.float32(np.sqrt(NUMBERS) * 0.3), "h": draw(2 * SIDE * EMBED, HIDDEN), "hb": np.zeros(HIDDEN, np.float32),
        "c": draw(HIDDEN, CLASSES) * np.float32(0.1), "cb": np.log(n.sum(1) / n.sum()).astype(np.float32),
        "m": draw(CLASSES, HIDDEN, MEMBERS) * np.float32(0.1), "mb": np.log(n / n.sum(1, keepdims=True)).astype(np.float32),
    }


def around(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers on both sides of places."""
    return flat.take(at[:, None] + np.r_[-SIDE:0, 1 : SIDE + 1])


def shifted(z: np.ndarray) -> None:
    """Shift rows of logits in place so that no exponential overflows and no row's sum vanishes: all alike if they are close, else each by its own maximum."""
    top = z.max(initial=-np.inf)
    z -= top if top - z.min(initial=np.inf) < NEAR else z.max(1, keepdims=True)


def summed(z: np.ndarray) -> np.ndarray:
    """The sums of short rows, as a product with ones."""
    return z @ np.ones(z.shape[1], z.dtype)


def places(z: np.ndarray, masked: np.ndarray) -> np.ndarray:
    """Where one entry of each row is in the flat matrix."""
    return np.arange(0, z.size, z.shape[1]) + masked


def picked(z: np.ndarray, masked: np.ndarray, small: bool = False) -> np.ndarray:
    """The log-probability of one entry of each row of logits, which are overwritten; small ones need no shift."""
    if not small:
        shifted(z)
    own = z.take(places(z, masked))
    return own - np.log(summed(np.exp(z, out=z)))


def excess(z: np.ndarray, masked: np.ndarray, n: int, small: bool = False) -> np.ndarray:
    """The gradient by the logits, which are overwritten, of the loss summed over rows, divided by ``n``; small ones need no shift."""
    if not small:
        shifted(z)
    np.exp(z, out=z)
    z *= (1 / (n * summed(z)))[:, None].astype(z.dtype)
    z.reshape(-1)[places(z, masked)] -= z.dtype.type(1 / n)
    return z


def by_class(masked: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each class of masked numbers that are ordered by it, and the rows of it."""
    ends = np.cumsum(np.bincount(masked // MEMBERS, minlength=CLASSES)).tolist()
    return ((k, slice(lo, hi)) for k, (lo, hi) in enumerate(zip([0, *ends], ends)) if lo < hi)


def joined(w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Layers for a hidden unit more that is always 1, whose weights are the biases of classes and members, and whether all logits are small.

    No hidden unit is beyond 1, so a logit is at most the sum of its weights' sizes.
    """
    h, hb = np.pad(w["h"], ((0, 0), (0, 1))), np.pad(w["hb"], (0, 1))
    c, m = np.concatenate((w["c"], w["cb"][None])), np.concatenate((w["m"], w["mb"][:, None]), 1)
    return h, hb, c, m, bool(max(np.abs(c).sum(0).max(), np.abs(m).sum(1).max()) < NEAR)


def forward(e: np.ndarray, h: np.ndarray, hb: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input and hidden layer, whose last unit is 1."""
    x = e.take(sides.ravel(), 0).reshape(len(sides), -1)
    out = added(x @ h, hb)
    np.tanh(out, out=out)
    out[:, -1] = 1
    return x, out


def added(z: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Rows with a bias added in place."""
    z += bias
    return z


def members(hidden: np.ndarray, m: np.ndarray, runs: list[tuple[int, slice]]) -> np.ndarray:
    """The logits of the members of each row's class."""
    z = np.empty((len(hidden), MEMBERS), hidden.dtype)
    for k, rows in runs:
        np.matmul(hidden[rows], m[k], out=z[rows])
    return z


def log_probs(w: Weights, sides: np.ndarray, masked: np.ndarray) -> np.ndarray:
    """The log-probability of each masked number given the numbers on both sides."""
    h, hb, c, m, small = joined(w)
    order, out = np.argsort(masked, kind="stable"), np.empty(len(masked), h.dtype)
    for lo in range(0, len(order), CACHED):
        at = order[lo : lo + CACHED]
        own, hidden = masked.take(at), forward(w["e"], h, hb, sides.take(at, 0))[1]
        out[at] = picked(hidden @ c, own // MEMBERS, small) + picked(members(hidden, m, [*by_class(own)]), own % MEMBERS, small)
    return out


def gradient(w: Weights, sides: np.ndarray, masked: np.ndarray) -> Weights:
    """The gradient of the mean loss over windows."""
    h, hb, c, m, small = joined(w)
    n, order = len(masked), np.argsort(masked, kind="stable")
    sides, masked = sides.take(order, 0), masked.take(order)
    gh, ghb, gc, gm = map(np.zeros_like, (h, hb, c, m))
    dx = np.empty((n, len(h)), h.dtype)
    for lo in range(0, n, CACHED):
        own = masked[lo : lo + CACHED]
        x, hidden = forward(w["e"], h, hb, sides[lo : lo + CACHED])
        dz = excess(hidden @ c, own // MEMBERS, n, small)
        gc += hidden.T @ dz
        dh, runs = dz @ c.T, [*by_class(own)]
        dz = excess(members(hidden, m, runs), own % MEMBERS, n, small)
        for k, rows in runs:
            gm[k] += hidden[rows].T @ dz[rows]
            dh[rows] += dz[rows] @ m[k].T
        dh *= 1 - hidden * hidden
        np.matmul(dh, h.T, out=dx[lo : lo + CACHED])
        gh += x.T @ dh
        ghb += np.ones(len(dh), dh.dtype) @ dh
    at, dx = sides.ravel().astype(np.intp), dx.reshape(-1, EMBED)
    e = [np.bincount(at, dx[:, k], NUMBERS) for k in range(EMBED)]
    return {"e": np.array(e).T.astype(h.dtype), "h": gh[:, :-1], "hb": ghb[:-1], "c": gc[:-1], "cb": gc[-1], "m": gm[:, :-1], "mb": gm[:, -1]}


class Trainer:
    """Steps of Adam from given weights, over windows that come by blocks of texts."""

    def __init__(self, w: Weights, rate: float, seed: int):
        self.w, self.rate, self.rng = {k: v.copy() for k, v in w.items()}, rate, np.random.default_rng(seed)
        self.one, self.two = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.t = self.n = 0

    def add(self, flat: np.ndarray) -> None:
        """The windows of the texts in ``flat``; many are taken together in random order."""
        every = np.flatnonzero(flat)
        for lo in range(0, len(every), SHUFFLED):
            at = every[lo : lo + SHUFFLED]
            self.held.append((flat[at[0] - SIDE : at[-1] + SIDE + 1], at - at[0] + SIDE))
            self.size += len(at)
            if self.size >= SHUFFLED:
                self.flush()

    def flush(self) -> None:
        """Step over all that is held."""
        if not self.size:
            return
        flat, starts = np.concatenate([x for x, _ in self.held]), np.cumsum([0, *(len(x) for x, _ in self.held)])
        at = np.concatenate([at + start for (_, at), start in zip(self.held, starts)])
        step = STEP if len(at) >= SHUFFLED else min(STEP, max(LEAST_STEP, len(at) // STEPS))
        for part in np.array_split(at[self.rng.permutation(len(at))], -(-len(at) // step)):
            self.t += 1
            self.step(gradient(self.w, around(flat, part), flat.take(part)))
        self.n += len(at)
        self.held, self.size = [], 0

    def step(self, g: Weights) -> None:
        """A step by a gradient."""
        rate, two = np.float32(self.rate / (1 - 0.9**self.t)), np.float32(1 / (1 - 0.98**self.t))
        for k, v in g.items():
            self.one[k] += np.float32(0.1) * (v - self.one[k])
            self.two[k] += np.float32(0.02) * (v * v - self.two[k])
            by = np.sqrt(self.two[k] * two)
            by += np.float32(1e-6)
            np.divide(self.one[k], by, out=by)
            by *= rate
            self.w[k] -= by


def fit(docs: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Train on all windows of the corpus: each round takes the documents that a hash deals to it.

    Each task trains a copy on its own documents; copies are averaged, weighted by their windows. A
    shuffle sums them by layer, and the driver gets one set of weights, of some 0.8 MB, a round.
    """
    w = fresh(known.counts)
    names, dealt = list(w), F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for turn in range(rounds):
        start, rate = w, 0.01 * 0.6**turn

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=rate, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(start, rate, turn)
            for batch in batches:
                for block in blocks(batch.column(0)):
                    trainer.add(known.flat(block, spell=False)[0])
            trainer.flush()
            if trainer.n:
                rows = [(trainer.w[k] * np.float32(trainer.n)).tobytes() for k in names]
                yield pa.RecordBatch.from_pydict({"layer": pa.array(names), "n": pa.array([trainer.n] * len(names), pa.int64()), "sum": pa.array(rows, pa.binary())})

        def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, None
            for table in tables:
                for k, raw in zip(table["n"].to_pylist(), table["sum"].to_pylist()):
                    own = np.frombuffer(raw, np.float32).astype(np.float64)
                    n, total = n + k, own if total is None else total + own
            yield pa.RecordBatch.from_pydict({"layer": pa.array([key[0].as_py()]), "mean": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

        copies = texts(docs).where(dealt == turn).select("text").mapInArrow(run, "layer string, n long, sum binary")
        got = {r.layer: r["mean"] for r in copies.groupBy("layer").applyInArrow(add, "layer string, mean binary").collect()}
        if got:
            w = {k: np.frombuffer(got[k], np.float32).reshape(v.shape) for k, v in start.items()}
    return w


def scored(docs: DataFrame, known: Vocabulary, w: Weights) -> DataFrame:
    """``doc_id, n_tokens, log_prob, bits_per_token`` of each row; a text without words has zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for block in blocks(batch.column(1)):
                flat, own = known.flat(block)
                every = np.flatnonzero(flat)
                for lo in range(0, len(every), SCORED):
                    at = every[lo : lo + SCORED]
                    own[lo : lo + SCORED] += log_probs(w, around(flat, at), flat[at])
                n = block.value_lengths().to_numpy().astype(np.int64)
                sums, ends = np.r_[0.0, np.cumsum(own)], np.cumsum(n)
                total = np.where(n > 0, sums[ends] - sums[ends - n], 0.0)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(start, len(n)), "n_tokens": pa.array(n), "log_prob": pa.array(total), "bits_per_token": pa.array(-total / np.maximum(n, 1) / np.log(2) + 0.0)})
                start += len(n)

    return texts(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, log_prob double, bits_per_token double")


def report(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and score them."""
    known = vocabulary(docs)
    return scored(docs, known, fit(docs, known))
