"""WARC archives: writing with revisit records, reading back, and resolving revisits.

Headers, without payloads, are shuffled by payload digest to find the response of equal payloads; the
others become revisit records, made from the headers alone. A sketch of these of bounded size tells
most pages that they are a response, and these are written from where they are read; only pages that
the sketch may hold are shuffled to make sure. Each record is a gzip member, so that records can be
reached by their offsets. Spark's own writer writes them, so that any store that it can write to can
hold archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import checkpointed

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of the least payload that a revisit record may stand for.
LEAST = 1000
#: Records of a file at most; a file has no more than a task's share of the pages either, and a reader holds one at once.
RECORDS = 4000
#: Numbers of 64 bits in the sketch of revisits, of some 2 MB.
CELLS = 1 << 17
#: Bytes of a gzip member at most; below it the last byte of a member, of its length, is zero.
MEMBER = (1 << 24) - 1
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, declared_digest string"


def plain(value: Column) -> Column:
    """A header value with its line ends, which would end the line, as a URI has them."""
    return F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")


def exact(value: Column) -> Column:
    """A value that a header may not keep as it is, in base 64; else null."""
    return F.when(value.rlike(r"[^\x21-\x7E]"), F.regexp_replace(F.base64(value.cast("binary")), "[\r\n]", ""))


def record_id(page_id: Column, digest: Column) -> Column:
    """The record's URN, a UUID made from its page and payload."""
    return F.regexp_replace(F.md5(F.concat_ws(" ", page_id.cast("string"), digest)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def with_digests(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, bytes`` of each page; a null html is an empty payload."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    return rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The headers of pages that revisit another, and the ``to, to_url`` of the response that each refers to.

    Of equal payloads of at least ``least`` bytes the one with the largest ``page_id`` is the response;
    rows that repeat that id are responses too. If no page of equal payloads has an id, all are
    responses. A digest that many pages share is one row of the checkpointed side, and the join may
    split the other side.
    """
    headers = with_digests(pages).drop("payload").where(F.col("bytes") >= least)
    first = headers.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = checkpointed(first.select("digest", F.col("first.page_id").alias("to"), F.col("first.url").alias("to_url")))
    return headers.join(first, "digest").where(F.coalesce(F.col("to") != F.col("page_id"), F.col("to").isNotNull()))


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with their payload, digest, and the response that each revisit refers to; payloads of revisits are null."""
    again = checkpointed(revisits(pages, least))
    drawn = F.xxhash64("digest", "page_id")
    cell, bit = F.pmod(drawn, F.lit(CELLS)).cast("int"), F.pmod(F.shiftright(drawn, 32), F.lit(64)).cast("int")
    sketch = again.select(cell.alias("cell"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("cell").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
    rows = with_digests(pages).withColumns({"cell": F.when(F.col("bytes") >= least, cell), "bit": bit})
    rows = rows.join(F.broadcast(sketch), "cell", "left").withColumn("maybe", F.expr("coalesce(shiftrightunsigned(bits, bit) & 1, 0) = 1")).drop("cell", "bit", "bits")
    ids = again.select(F.col("digest").alias("_digest"), F.col("page_id").alias("_id")).distinct()
    own = rows.where("maybe").join(ids, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left_anti")
    columns = ["page_id", "url", "payload", "digest", "bytes"]
    none = {"to": F.lit(None).cast(dict(pages.dtypes)["page_id"]), "to_url": F.lit(None).cast("string"), "again": F.lit(False)}
    responses = rows.where("not maybe").select(columns).union(own.select(columns)).withColumns(none)
    return responses.unionByName(again.withColumns({"payload": F.lit(None).cast("string"), "again": F.lit(True)}))


def records(rows: DataFrame, date: str) -> DataFrame:
    """One text ``record`` for each planned page, with the two line ends that close it."""
    revisit = F.col("again")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    again = F.when(
        revisit,
        F.concat(
            header("WARC-Profile", F.lit(PROFILE)),
            header("WARC-Refers-To", record_id(F.col("to"), F.col("digest"))),
            header("WARC-Refers-To-Target-URI", plain(F.col("to_url"))),
            header("WARC-Refers-To-Date", F.lit(date)),
            header("X-Refers-To-Page", F.col("to").cast("string")),
        ),
    ).otherwise("")
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", plain(F.col("url"))),
        header("X-Target-URI-Base64", exact(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("X-Page", F.col("page_id").cast("string")),
        again,
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", block_bytes.cast("string")),
        F.lit(END),
    )
    return rows.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")), F.lit(END * 2)).alias("record"))


def members(record: bytes) -> bytes:
    """A record as a gzip member of its own, or as several if it is very long; the last byte is zero."""
    return b"".join(gzip.compress(record[lo : lo + MEMBER], 6, mtime=0) for lo in range(0, len(record), MEMBER))


def write(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Write compressed archives of ``pages`` to the folder ``path``, without the payloads of revisits.

    Members are written as lines: the zero that ends each is the line's end.
    """

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                held = [members(r.as_py().encode("utf-8", "surrogatepass"))[:-1] for r in batch.column(0).slice(lo, 64)]
                yield pa.RecordBatch.from_pydict({"member": pa.array(held, pa.binary())})

    lines = records(planned(pages, least), date).mapInArrow(compress, "member binary").select(F.col("member").cast("string"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS).mode("overwrite").text(path)


def parsed(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a compressed or plain archive."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(size := int(headers["content-length"]))
        if len(block) != size:
            raise ValueError("a WARC record ends early")
        yield headers, block


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record of the archives below ``path``; ``payload`` (binary) is null for revisits.

    ``payload_bytes`` and ``payload_digest`` are measured from the payload that was read, and are
    null for revisits until ``resolved`` joins these to their responses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for raw in batch.column(0):
                rows, bodies, size = [], [], 0
                for h, block in parsed(raw.as_py()):
                    body = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                    url = base64.b64decode(h["x-target-uri-base64"]).decode("utf-8", "replace") if "x-target-uri-base64" in h else h.get("warc-target-uri")
                    own = (None, None) if body is None else (len(body), hashlib.sha1(body).hexdigest())
                    rows.append((number(h.get("x-page")), url, h["warc-type"], number(h.get("x-refers-to-page")), *own, h.get("warc-payload-digest", "").removeprefix("sha1:")))
                    bodies.append(body if payload else None)
                    size += len(block)
                    if size > 1 << 24:
                        yield batch_of(rows, bodies, names, kinds)
                        rows, bodies, size = [], [], 0
                if rows:
                    yield batch_of(rows, bodies, names, kinds)

    def batch_of(rows: list, bodies: list, names: list, kinds: list) -> pa.RecordBatch:
        out = {n: pa.array(v, k) for n, k, v in zip(names, kinds, zip(*rows))}
        return pa.RecordBatch.from_pydict(out | ({"payload": pa.array(bodies, pa.binary())} if payload else {}))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, READ + ", payload binary" * payload)


def resolved(read: DataFrame) -> DataFrame:
    """Records of ``read``, in which revisits have taken payload, bytes and digest from the response that they refer to.

    Only revisits, and the responses that they refer to, are shuffled; a response that many revisits
    refer to is one row of the checkpointed side, and the join may split the other side.
    """
    taken = [c for c in ("payload_bytes", "payload_digest", "payload") if c in read.columns]
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    again, keys = read.where(revisit), ["refers_to", "declared_digest"]
    source = read.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest"), *[F.col(c).alias(f"of_{c}") for c in taken])
    source = checkpointed(source.join(again.select(keys).distinct(), keys, "left_semi").groupBy(keys).agg(*[F.first(f"of_{c}").alias(f"of_{c}") for c in taken]))
    joined = again.join(source, keys, "left")
    return read.where(~revisit).unionByName(joined.select(*[F.coalesce(c, f"of_{c}").alias(c) if c in taken else F.col(c) for c in read.columns]))
