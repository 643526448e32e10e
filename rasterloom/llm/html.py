"""HTML extraction with suffix arrays of hosts.

Pages are cut into blocks; menus, footers, adverts and the like are told by their elements and
attributes. All other blocks, inside an article or not, are the page's token stream and judged by the
host: the streams of its distinct pages are concatenated, and their suffixes put in the order of their
first ``LONG`` tokens, as a hash ranks these. Neighbours of equal rank share a substring of ``LONG``
tokens, and longer repeats are runs of such suffixes. A block that repeats cover is boilerplate: outside of an
article if another page has them, inside if half of the host's pages do. Unique runs and the passages
of an article stay.

No host has to fit a task. Groups of pages sort their own suffixes; the sorted runs are dealt out by
ranges of the order, merged, and each group gets back what is on more than one page.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh64_intdigest

from rasterloom.llm.common import checkpointed

#: Tokens of the shortest boilerplate, and the share of a block that it covers to remove it.
LONG, COVERED = 6, 0.8
#: Tokens from which a block inside an article is a passage, which pages may share; the share of the host's pages, and their number at least, that have what is boilerplate inside an article.
PASSAGE, SHARE, LEAST = 40, 0.5, 3
#: Bytes of a group of pages: the least, the most, and groups from which on they are larger than the least.
SMALL, LARGE, GROUPS = 4 << 20, 64 << 20, 256
#: Equal pages of a group at most, unless they are below one of so many of all pages.
COPIES, OF_ALL = 512, 50_000
#: Suffixes of a range of the order, about, and bits of their rank beyond those that count all suffixes.
RANGE, BITS = 1 << 20, 16
#: Characters that a worker packs together; words whose hashes it remembers.
PACKED, REMEMBERED = 1 << 24, 120_000
#: Odd factors that mix the hashes of a substring's tokens.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: A comment or declaration, or a tag; a quote opens a value only after an equals sign.
MARKUP = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9-]*)(?P<attributes>(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>])*+)>",
    re.S,
)
HINT = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that are dropped with all they hold, of which the first have no markup inside.
RAW = frozenset("script style textarea title iframe noscript".split())
DROPPED = RAW | frozenset("template svg math object select".split())
ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in DROPPED}
#: Elements that end a block, that hold others, that are never text of an article, and that have no end.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDS = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form header label main menu nav ol section span table td ul li p a".split())
NEVER = frozenset("aside button dialog footer form head menu nav".split())
ARTICLE = frozenset(("article", "main"))
#: Words in class, id or role that mark what isn't of the article.
MARKS = frozenset("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies complementary disqus footer login masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())

Page = list[tuple[bool, str]]


def unwanted(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element and all in it aren't of an article."""
    if name in NEVER or name == "header" and not inside:
        return True
    for m in HINT.finditer(attributes):
        words = re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())
        if not MARKS.isdisjoint(words) or "header" in words and not inside:
            return name not in ("html", "body", "article", "main")
    return False


def cut(html: str) -> Page:
    """Whether it is inside an article, and the text, of each block that may be of one; white space as one space.

    Comments, scripts and tags are read in the order of the page. A form that holds an article does
    not hide it. An element that is dropped and has no end is dropped to the page's end if it is raw
    text, else its tag alone.
    """
    found: Page = []
    held: list[str] = []
    open_: list[str] = []
    endless: set[str] = set()
    dead = inside = at = hidden = 0  # depth at which an unwanted element began, open articles, depth of a form around them

    def close() -> None:
        words = unescape("".join(held)).split()
        held.clear()
        if words:
            found.append((inside > 0, " ".join(words)))

    while m := MARKUP.search(html, at):
        if not dead:
            held.append(html[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in DROPPED and not m["end"]:
            if not dead:
                held.append(" ")
            last = None if name in endless else ENDS[name].search(html, at)
            if last:
                at = last.end()
            elif name in RAW:
                at = len(html)
            else:
                endless.add(name)
            continue
        if name in BLOCK and not dead:
            close()
        elif name == "br" and not dead:
            held.append(" ")
        if not m["end"]:
            if name in HOLDS or name in NEVER:
                if name in ("p", "li") and open_ and open_[-1] == name:
                    open_.pop()  # their ends may be left out
                    dead = 0 if dead > len(open_) else dead
                open_.append(name)
                if name in ARTICLE and dead and open_[dead - 1] == "form" and not inside:
                    dead, hidden = 0, dead
                if not dead and unwanted(name, m["attributes"], inside > 0):
                    dead = len(open_)
                if name in ARTICLE and not dead:
                    inside += 1
        elif name in open_:
            while open_:
                last = open_.pop()
                if last in ARTICLE and not dead:
                    inside -= 1
                    if hidden and not inside:
                        dead, hidden = hidden, 0
                if dead > len(open_):
                    dead = 0
                if last == name:
                    break
    if not dead:
        rest = re.search(r"</?[a-zA-Z]", html[at:])  # a tag without an end
        held.append(html[at : at + rest.start()] if rest else html[at:])
        close()
    return found


def blocks(html: str) -> tuple[list[str], list[str]]:
    """The blocks inside articles, and those outside that may or may not be of one."""
    found = cut(html)
    return [b for inside, b in found if inside], [b for inside, b in found if not inside]


HASHES: dict[str, int] = {}


def hashed(words: list[str]) -> np.ndarray:
    """The hashes of words, remembered by a worker."""
    if len(HASHES) > REMEMBERED:
        HASHES.clear()
    for w in set(words).difference(HASHES):
        HASHES[w] = digest(w)
    return np.array([HASHES[w] for w in words], np.uint64)


def digest(text: str) -> int:
    return xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def ranks(tokens: np.ndarray, host: int, long: int = LONG) -> np.ndarray:
    """The rank of each suffix of a stream of token hashes that has ``long`` tokens: a hash of these and of the host."""
    if len(tokens) < long:
        return np.zeros(0, np.uint64)
    key = np.full(len(tokens) - long + 1, host, np.uint64)
    for k in range(long):
        key = key * MIX[0] + tokens[k : len(tokens) - long + 1 + k]
    for shift, factor in ((30, MIX[1]), (27, MIX[2])):
        key = (key ^ (key >> np.uint64(shift))) * factor
    return key ^ (key >> np.uint64(31))


def covers(hit: np.ndarray, size: int, long: int = LONG) -> np.ndarray:
    """Which of ``size`` tokens the substrings that are hit cover, by their first places."""
    edge = np.zeros(size + 1, np.int64)
    edge[: len(hit)] += hit
    edge[long : long + len(hit)] -= hit
    return np.cumsum(edge[:-1]) > 0


def stream_of(page: Page) -> str:
    """A page's token stream; pages with equal streams count as one."""
    return " ".join(text for _, text in page)


def ranked(stream: str, host: str, bits: int) -> tuple[np.ndarray, int]:
    """The ranks of a stream's suffixes, cut to ``bits`` bits, and the rank that stands for the pages of its host."""
    seed = digest(host)
    return ranks(hashed(stream.split()), seed) >> np.uint64(64 - bits), digest(f"{seed} pages") >> (64 - bits)


def array_of(streams: list[tuple[str, str, bool]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of distinct streams, by host: the ranks that occur, ascending, and on how many streams that count."""
    own, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for stream, host, counted in streams:
        found, pages = ranked(stream, host, bits)
        own.append(np.unique(np.append(found, np.uint64(pages))))
        counts.append(np.full(len(own[-1]), int(counted)))
    return merged(np.concatenate(own), np.concatenate(counts))


def merged(rank: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ranks, ascending, and the sums of their ``n``."""
    if not len(rank):
        return rank, n
    order = np.argsort(rank, kind="stable")
    rank, n = rank[order], n[order]
    starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
    return rank[starts], np.add.reduceat(n, starts)


def written(rank: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending ranks by their gaps, and the counts that aren't 1, as bytes."""
    gaps = np.diff(rank, prepend=np.uint64(0))
    odd = np.flatnonzero(n != 1)
    held = (len(rank), gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), odd.astype(np.uint32).tobytes(), n[odd].astype(np.int64).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(held, 5))


def read(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What was ``written``."""
    size, gaps, odd, counts = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
    rank = np.cumsum(np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(8, size).T).view(np.uint64).ravel(), dtype=np.uint64)
    n = np.ones(size, np.int64)
    n[np.frombuffer(odd, np.uint32)] = np.frombuffer(counts, np.int64)
    return rank, n


def judged(page: Page, pages: np.ndarray, of_host: int, covered: float = COVERED, passage: int = PASSAGE, share: float = SHARE, least: int = LEAST) -> list[str]:
    """The blocks kept of a page; all if none would be left.

    ``pages`` has on how many distinct pages of the host the ``LONG`` tokens from each place are, and
    ``of_host`` is the number of these pages.
    """
    size = sum(len(text.split()) for _, text in page)
    some, many = covers(pages >= 2, size), covers(pages >= max(least, share * of_host), size)
    at, kept = 0, []
    for inside, text in page:
        n = len(text.split())
        if inside and n >= passage or (many if inside else some)[at : at + n].mean() < covered:
            kept.append(text)
        at += n
    return kept or [text for _, text in page]


def packed(rows: list[tuple]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(rows, 5))


def unpacked(column: pa.ChunkedArray) -> Iterator[tuple]:
    """Host, blocks, whether it counts, and ids and urls of the pages that have it, of each packed stream."""
    for raw in column:
        yield from pickle.loads(zstandard.ZstdDecompressor().decompress(raw.as_py()))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of each page; the text is empty if nothing is left.

    A null html is empty, and a null or odd url makes a host of its own kind. Pages are dealt to groups
    by a hash of host and stream, so that pages with equal streams meet; only those of a stream with
    more than ``COPIES`` pages, and more than one of ``OF_ALL`` of them all, are dealt to several
    groups, of which the first counts. The driver gets the at most ``OF_ALL`` such streams, and sums.
    Rows that repeat have a row each; columns besides ``page_id``, ``url`` and ``html`` are not read.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    kind = dict(pages.dtypes)["page_id"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, size, tokens = [], [], []
            for h, html in zip(batch.column(0), batch.column(1)):
                stream = stream_of(cut(html.as_py()))
                which.append(digest(f"{h}\n{stream}"))
                size.append(len(stream))
                tokens.append(1 + stream.count(" "))
            yield pa.RecordBatch.from_pydict({"which": np.array(which, np.uint64).view(np.int64), "size": pa.array(size, pa.int64()), "tokens": pa.array(tokens, pa.int64())})

    sizes = rows.select("host", "html").mapInArrow(measured, "which long, size long, tokens long")
    sizes = checkpointed(sizes.groupBy("which").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("tokens").alias("tokens")))
    total, size, tokens = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    most = max(COPIES, total // OF_ALL)
    often = {r.which: -(-r.n // most) for r in sizes.where(F.col("n") > most).select("which", "n").collect()}
    groups = max(1, -(-size // min(LARGE, max(SMALL, size // GROUPS))))
    bits, ranges = min(60, tokens.bit_length() + BITS), max(1, -(-tokens // RANGE))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        chars = turn = 0

        def out() -> pa.RecordBatch:
            by: dict[int, list[tuple]] = {}
            for (part, _), row in held.items():
                by.setdefault(part, []).append(row)
            return pa.RecordBatch.from_pydict({"part": pa.array(list(by), pa.int64()), "held": pa.array([packed(x) for x in by.values()], pa.binary())})

        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for page_id, url, h, html in zip(ids, urls, batch.column(2).to_pylist(), batch.column(3)):
                page = cut(html.as_py())
                which = digest(f"{h}\n{stream_of(page)}")
                ways = often.get(which - (1 << 64) if which >> 63 else which, 1)
                turn += 1
                first, key = (which % groups, which), ((which + turn % ways) % groups, which)
                for k in (first, key):  # the first group of a stream counts it, whether it gets a page of it or not
                    if k not in held:
                        held[k] = (h, page, k == first, [], [])
                        chars += sum(len(text) for _, text in page)
                held[key][3].append(page_id)
                held[key][4].append(url)
                chars += 64
                if chars > PACKED:
                    yield out()
                    held.clear()
                    chars = 0
        if held:
            yield out()

    def sort(group: pa.Table) -> pa.Table:
        streams: dict[tuple[str, str], bool] = {}
        for h, page, counts, *_ in unpacked(group["held"]):
            key = (stream_of(page), h)
            streams[key] = streams.get(key, False) or counts
        rank, n = array_of([(*k, c) for k, c in streams.items()], bits)
        of = (rank >> np.uint64(bits - 32) if bits > 32 else rank << np.uint64(32 - bits)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)] if len(of) else np.zeros(1, np.int64)
        part = group["part"][0].as_py() if group.num_rows else 0
        runs = [written(rank[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"range": pa.array(of[cuts[:-1]].astype(np.int64) if len(of) else [], pa.int64()), "part": pa.array([part] * len(runs), pa.int64()), "run": pa.array(runs, pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        runs = [read(raw.as_py()) for raw in group["run"]]
        rank, n = merged(*(np.concatenate(x) for x in zip(*runs)))
        rank, n = rank[n > 1], n[n > 1]
        back, parts = [], []
        for (own, _), part in zip(runs, group["part"].to_pylist()):
            at = np.minimum(np.searchsorted(rank, own), max(len(rank) - 1, 0))
            on = rank[at] == own if len(rank) else np.zeros(len(own), bool)
            if on.any():
                back.append(written(own[on], n[at[on]]))
                parts.append(part)
        return pa.table({"part": pa.array(parts, pa.int64()), "run": pa.array(back, pa.binary())})

    def judge(group: pa.Table, shared: pa.Table) -> pa.Table:
        runs = [read(raw.as_py()) for raw in shared["run"]]
        rank, n = merged(*(np.concatenate(x) for x in zip(*runs))) if runs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def known(keys: np.ndarray) -> np.ndarray:
            if not len(rank):
                return np.ones(len(keys), np.int64)
            at = np.minimum(np.searchsorted(rank, keys), len(rank) - 1)
            return np.where(rank[at] == keys, n[at], 1)

        ids, urls, texts = [], [], []
        for h, page, _, own, at in unpacked(group["held"]):
            if not own:
                continue
            keys, of_host = ranked(stream_of(page), h, bits)
            text = "\n".join(judged(page, known(keys), int(known(np.array([of_host], np.uint64))[0])))
            ids += own
            urls += at
            texts += [text] * len(own)
        return pa.table({"page_id": pa.array(ids, as_arrow), "url": pa.array(urls, pa.string()), "text": pa.array(texts, pa.string())})

    as_arrow = to_arrow_schema(pages.select("page_id").schema).field(0).type
    streams = rows.mapInArrow(pack, "part long, held binary")
    runs = streams.groupBy("part").applyInArrow(sort, "range long, part long, run binary")
    shared = runs.groupBy("range").applyInArrow(merge, "part long, run binary")
    return streams.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(judge, f"page_id {kind}, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    return extracted(pages).withColumn("n_chars", F.char_length("text").cast("long"))
