"""Toxicity by a subsequence string kernel: a support vector machine on Nyström features of words.

The kernel of two words sums over their common subsequences of three letters or word ends, gaps
allowed; each occurrence weighs ``DECAY`` to the power of the letters it spans, so a letter that is
put in or left out lowers the kernel a little only. It is divided by what words of these lengths have
with themselves if no subsequence repeats. Labels are of whole documents. A document is a bag of
words, and a toxic one has words that speak for it: the machine is trained on such witnesses
against the words of clean documents, and witnesses are chosen again with the machine. The score of
a document is a logistic function of its best word's margin, fitted on documents kept out of the
training.

The kernel's feature space (letter triples) is small, so that landmarks and weights collapse into
one weight for each triple: a word's margin is then exactly that of the Nyström machine, at the
cost of the word's own triples.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from xxhash import xxh64_intdigest

from rasterloom.llm.common import free, texts

DECAY = 0.5
#: Letters that a subsequence spans at most.
SPAN = 6
#: Numbers of letters a to z, of others as they are folded, and of a word's start and end.
LETTERS, START, FINISH = 32, 30, 31
#: Letters of the longest word that is taken whole; longer ones are taken by overlapping windows.
WHOLE = 16
#: Labelled documents of each class that training looks at, at most, and landmarks.
TOXIC_DOCS, CLEAN_DOCS, LANDMARKS = 1000, 2000, 256
#: Words of clean documents that training looks at, drawn and again in each round by how toxic they seem, at most.
CLEAN_WORDS, HARD_WORDS = 10_000, 6_000
#: Distinct windows of a labelled document that training looks at, at most; words that are handled together.
DOC_WORDS, BLOCK = 4000, 4096
#: Words that a worker remembers the margin of before it starts anew.
MOST_KEPT = 120_000
FLOOR = -2.0
NOT_LETTERS = re.compile(r"[\W\d_]+")
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")


def words_of(text: str) -> list[str]:
    """What white space leaves of a text in lower case, and words that are spelled letter by letter."""
    lower = text.lower()
    return lower.split() + ["".join(m[0].split()) for m in SPELLED.finditer(lower)]


def windows(word: str) -> list[str]:
    """The letters of a word, by windows if they are many; none if there are fewer than three."""
    letters = NOT_LETTERS.sub("", word)
    if len(letters) <= WHOLE:
        return [letters] if len(letters) >= 3 else []
    return [letters[k : k + WHOLE] for k in range(0, len(letters) - WHOLE // 2, WHOLE // 2)]


def codes(words: list[str]) -> np.ndarray:
    """Numbers of the letters and ends of words that have one length."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.int64)
    letters = np.where((raw >= 97) & (raw <= 122), raw - 97, 26 + raw % (START - 26))
    return np.pad(letters, ((0, 0), (1, 1)), constant_values=((0, 0), (START, FINISH)))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``words`` and their codes, for each length, by blocks."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        for at in np.array_split(np.flatnonzero(lengths == n), 1 + (lengths == n).sum() // BLOCK):
            yield at, codes([words[k] for k in at])


@cache
def places(size: int) -> list[tuple[int, int, int, float]]:
    """Places of the triples of a word with ``size`` letters and ends, and the weight of each in a normalised word."""
    found = [(i, j, k, DECAY ** (k - i + 1)) for i, j, k in combinations(range(size), 3) if k - i < SPAN]
    norm = sum(x[3] ** 2 for x in found) ** 0.5
    return [(i, j, k, weight / norm) for i, j, k, weight in found]


def triples(code: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """Weight and number of each letter triple of words that have one length."""
    for i, j, k, weight in places(code.shape[1]):
        yield weight, (code[:, i] * LETTERS + code[:, j]) * LETTERS + code[:, k]


def kernel(a: str, b: str) -> float:
    """The normalised kernel of two words, by triples; what the rest must equal."""

    def features(word: str) -> Counter:
        out: Counter = Counter()
        for weight, number in triples(codes([word])):
            out[int(number[0])] += weight
        return out

    x, y = features(a), features(b)
    return sum(v * y[k] for k, v in x.items())


@dataclass
class Machine:
    """A trained machine: a weight for each letter triple, how a margin becomes a score, and the landmarks with their factors, which the weights equal."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    landmarks: list[str]
    factors: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        """The margin of each word, which has three letters at least."""
        return self.of(len(words), by_length(words))

    def of(self, size: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The margins of ``size`` words, whose places and codes come by blocks."""
        out = np.zeros(size)
        for at, code in blocks:
            total = np.zeros(len(at))
            for weight, number in triples(code):
                total += weight * self.weights[number]
            out[at] = total
        return out + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))

    def best(self, texts: list[str], kept: dict[str, float]) -> np.ndarray:
        """The best word's margin of each text; ``kept`` has margins by word and is added to."""
        if len(kept) > MOST_KEPT:
            kept.clear()
        bags = [words_of(t) for t in texts]
        new = list(set().union(*bags).difference(kept))
        parts = [windows(w) for w in new]
        flat = list(dict.fromkeys(p for ps in parts for p in ps))
        margin = dict(zip(flat, self.margins(flat).tolist()))
        kept.update((w, max([margin[p] for p in ps], default=FLOOR)) for w, ps in zip(new, parts))
        of = kept.__getitem__
        return np.array([max(FLOOR, max(map(of, bag), default=FLOOR)) for bag in bags])


def squared_hinge(parts: list[tuple[np.ndarray, float, np.ndarray]], ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with squared hinge loss, by Newton steps.

    Each part has rows of features, the class (1 or -1) of all of them, and their costs. Sums are made
    by blocks of rows, so that no copy of the features is held.
    """
    size = parts[0][0].shape[1] + 1
    w, flat = np.zeros(size), ridge * np.eye(size)
    flat[-1, -1] = 1e-6
    for _ in range(25):
        gram, right = flat.copy(), np.zeros(size)
        for x, sign, cost in parts:
            for lo in range(0, len(x), BLOCK):
                z = np.ones((len(x[lo : lo + BLOCK]), size))
                z[:, :-1] = x[lo : lo + BLOCK]
                on = sign * (z @ w) < 1
                z, c = z[on], cost[lo : lo + BLOCK][on]
                gram += (z * c[:, None]).T @ z
                right += sign * (c @ z)
        step = np.linalg.solve(gram, right)
        if np.abs(step - w).max() < 1e-6:
            break
        w = step
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic function, with the targets drawn in a little."""
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    t, c = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), 1 / len(y)
    z, w = np.c_[x, np.ones(len(x))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (c * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        w = w + np.linalg.solve(h, z.T @ (c * (t - p)) - 1e-4 * (w - [1.0, 0.0]))
    return float(max(w[0], 1e-3)), float(w[1])


@dataclass
class Bags:
    """Labelled documents as bags of words: the distinct words, the words' numbers of one document after the other, where each ends, and which are toxic."""

    words: list[str]
    at: np.ndarray
    ends: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, lists: pa.ListArray, toxic: list[int]) -> Bags:
        """From an array that lists the words of each document."""
        held = lists.flatten().dictionary_encode()
        words = np.array(held.dictionary.to_pylist(), object)
        order = np.argsort(words, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        return cls(words[order].tolist(), number[held.indices.to_numpy()], np.cumsum(pc.list_value_length(lists).to_numpy()), np.array(toxic))


def bag(text: str, most: int) -> list[str]:
    """The distinct windows of a text's words; of more than ``most`` those that come first by hash."""
    found = {p for w in set(words_of(text)) for p in windows(w)}
    return sorted(found, key=lambda p: (xxh64_intdigest(p.encode("utf-8", "surrogatepass")), p))[:most] if len(found) > most else sorted(found)


class Coded:
    """The codes of words by number, those of one length as rows of a matrix."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int32, len(words))
        self.row = np.zeros(len(words), np.int32)
        self.codes: dict[int, np.ndarray] = {}
        for n in np.unique(self.length):
            at = np.flatnonzero(self.length == n)
            self.row[at] = np.arange(len(at))
            self.codes[n] = np.concatenate([codes([words[k] for k in part]).astype(np.uint8) for part in np.array_split(at, 1 + len(at) // BLOCK)])

    def blocks(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``chosen``, numbers of words, and their codes, for each length."""
        length = self.length[chosen]
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            for lo in range(0, len(at), BLOCK):
                part = at[lo : lo + BLOCK]
                yield part, self.codes[n][self.row[chosen[part]]].astype(np.int64)


def fit(bags: Bags, rounds: int = 4, seed: int = 7, clean_words: int = CLEAN_WORDS, hard_words: int = HARD_WORDS) -> Machine | None:
    """Train on bags of words and their labels; none if there is no word to tell toxic bags by.

    A quarter of the bags is kept for the logistic function. Toxic bags without a credible witness
    count as wrongly labelled and are left out of the machine, not of the logistic function. Of the
    words of clean bags ``clean_words`` are drawn, and in each round ``hard_words`` at most are added
    of those that seem toxic. Features are held once, in single precision.
    """
    rng = np.random.default_rng(seed)
    n, size = len(bags.toxic), len(bags.words)
    train = rng.random(n) < 0.75
    doc = np.repeat(np.arange(n), np.diff(bags.ends, prepend=0))
    total = [int((train & (bags.toxic == y)).sum()) for y in (0, 1)]
    if not all(total) or not size:
        return None
    on_toxic = bags.at[(train & (bags.toxic == 1))[doc]]
    of_clean = np.bincount(bags.at[(train & (bags.toxic == 0))[doc]], minlength=size)
    of_toxic = np.bincount(on_toxic, minlength=size)
    gain = np.where(of_toxic >= 3, np.log(np.maximum(of_toxic, 1) / total[1] / ((of_clean + 0.5) / (total[0] + 1))), -np.inf)
    bound = max(2.0, np.log(4 * total[0] / total[1] / 3)) if total[0] > total[1] else 2.0
    credible = gain > bound
    every = np.flatnonzero(of_clean)
    if not credible.any() or not len(every):
        return None
    coded = Coded(bags.words)
    clean = every if len(every) <= clean_words else np.sort(rng.choice(every, clean_words, replace=False))
    often = np.flatnonzero(credible)
    often = often[np.argsort(-of_toxic[often], kind="stable")][: LANDMARKS // 2]
    marks = np.r_[often, np.sort(rng.choice(clean, min(LANDMARKS - len(often), len(clean)), replace=False))]
    table = np.zeros((LETTERS**3, len(marks)), np.float32)
    for at, code in coded.blocks(marks):
        for weight, number in triples(code):
            table[number, at] += np.float32(weight)
    value, vector = np.linalg.eigh((table.T @ table).astype(float))
    on = value > 1e-4 * value.max()
    root = (vector[:, on] / np.sqrt(value[on])).astype(np.float32)

    def features(words: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), root.shape[1]), np.float32)
        for at, code in coded.blocks(words):
            held = np.zeros((len(at), len(marks)), np.float32)
            for weight, number in triples(code):
                held += np.float32(weight) * table[number]
            out[at] = held @ root
        return out

    negatives, taken = [features(clean)], credible.copy()
    taken[clean] = True
    witness, spoken = credible, credible | (of_toxic >= 2) & (of_clean == 0)
    machine = None
    for _ in range(rounds):
        tally = np.bincount(on_toxic[witness[on_toxic]], minlength=size)
        positives = np.flatnonzero(tally)
        if not len(positives):
            break
        held = np.sqrt(tally[positives])
        cost = held * 0.2 * sum(map(len, negatives)) / held.sum()
        w = squared_hinge([(features(positives), 1.0, cost), *((x, -1.0, np.ones(len(x))) for x in negatives)])
        factors = root @ w[:-1].astype(np.float32)
        machine = Machine((table @ factors).astype(np.float32), float(w[-1]), 1.0, 0.0, [bags.words[k] for k in marks], factors)
        near = machine.of(size, coded.blocks(np.arange(size)))
        witness = spoken & (near > 0)
        hard = every[np.argsort(-near[every], kind="stable")[:hard_words]]
        hard = hard[(near[hard] > -0.9) & ~taken[hard]]
        taken[hard] = True
        negatives.append(features(hard))
    if machine is None:
        return None
    best = np.full(n, FLOOR)
    np.maximum.at(best, doc, near[bags.at])
    rest = np.flatnonzero(~train)
    if len(set(bags.toxic[rest])) == 2:
        machine.slope, machine.shift = logistic(best[rest], bags.toxic[rest])
    else:
        machine.slope = 4.0
    return machine


def sampled(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, doc_words: int = DOC_WORDS) -> Bags:
    """Bags of words and labels of at most so many documents of each class, none of them held out.

    The ids that come first by hash are taken; null labels and ids are left out. An id with both
    labels counts as toxic, and of rows that share an id the least text is taken. Of a bag with more
    than ``doc_words`` distinct windows those that come first by hash are taken. What is broadcast and
    what the driver gets are bounded by the three numbers.
    """
    named = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)")
    named = named.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    few = [named.where(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, toxic_docs), (0, clean_docs))]
    rows = [(r[0], int(r[1])) for df in few for r in df.collect()]
    if not rows:
        return Bags([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    marked = F.broadcast(docs.sparkSession.createDataFrame(rows, f"_id {dict(labels.dtypes)['doc_id']}, _toxic int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t.as_py(), doc_words) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"words": pa.array(bags, pa.list_(pa.string())), "toxic": batch.column(1), "place": batch.column(2)})

    found = texts(docs).join(marked, F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("_toxic"))
    found = found.select("text", "_toxic", F.xxhash64("_id"))
    got = found.mapInArrow(run, "words array<string>, toxic int, place long").toArrow().sort_by("place").combine_chunks()
    lists = got["words"].chunk(0) if got.num_rows else pa.array([], pa.list_(pa.string()))
    return Bags.of(lists, got["toxic"].to_pylist())


def held_out(doc_id):
    """Whether a document is kept out of all training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """A machine from the labelled documents that aren't held out; none if they can't tell toxic from clean."""
    return fit(sampled(docs, labels))


def scored(docs: DataFrame, machine: Machine | None, out: str = "score") -> DataFrame:
    """``docs`` with ``out`` (double, 0 to 1) and all columns as they were; null texts count as empty.

    Without a machine each score is 0. Equal texts have equal scores. A column that has the name
    ``out`` is replaced.
    """
    docs = docs.drop(out)
    if machine is None:
        return docs.withColumn(out, F.lit(0.0))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(100_000, 20, 20)
        kept: dict[str, float] = {}
        for batch in batches:
            best, held, size = [], [], 0
            for k, value in enumerate(batch.column(place)):
                held.append(value.as_py() or "")
                size += len(held[-1])
                if size > 500_000 or k == batch.num_rows - 1:
                    best.append(machine.best(held, kept))
                    held, size = [], 0
            score = machine.score(np.concatenate(best) if best else np.zeros(0))
            yield batch.append_column(out, pa.array(score, pa.float64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that are predicted toxic; all columns and other rows stay as they were."""
    name = free(docs, "_toxicity_score")
    return scored(docs, train(docs, labels), name).where(F.col(name) < 0.5).drop(name)
