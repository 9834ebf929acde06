"""WARC archives written and read as Spark jobs, and their capture index.

Every task writes one archive (gzip) whose records are sorted by URL key, time and id: a sorted capture
run. Reading gives the index entries of each run in that order. The entries are dealt by ranges of (URL
key, time, id), so that a URL with many captures is cut too, and every range merges its pieces of
the runs with a loser tree: ranges and merged entries together are the capture histories in
global order.

Records with equal payloads of ``LEAST_REVISIT`` bytes or more are written in full once, for the largest page_id;
the others become revisits that name it. Rows that repeat that page_id are each a response. Copies with a null
page_id revisit as well; if no copy has an id, all are responses. A null html is an empty payload, a null url
gives a record without target. An empty table gives no archive and no rows.

Payload sizes and digests come from the archives: of a response from its bytes, of a revisit
from its header, which was made from the full payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.session import shared_folder

LEAST_REVISIT = 1_000
#: Capture times of pages that have none: so many seconds after this day as their id says.
FIRST_DAY = "2024-01-01"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the last to the first, then the path; lower-case host, no scheme."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1)), r"^www\.", "")
    rest = F.regexp_replace(bare, r"^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def capture_time(page_id: Column) -> Column:
    seconds = F.coalesce(F.pmod(page_id, F.lit(1_000_000_000)), F.lit(0))
    return F.date_format(
        F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_DAY), "yyyy-MM-dd") + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )


def with_revisits(pages: DataFrame) -> DataFrame:
    """Payload, digest, record type and the response a revisit refers to."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    captured = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20]", "%20").alias("url"),
        body.alias("body"),
        F.sha1(body).alias("digest"),
        F.octet_length(body).cast("long").alias("bytes"),
    )
    heads = (
        captured.where(F.col("bytes") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and head is not null")
        .select(F.col("digest").alias("d"), "head")
    )
    # the pages are the left side: a payload of very many copies is cut by the adaptive skew join
    again = F.col("head").isNotNull() & F.coalesce(F.col("page_id") != F.col("head"), F.lit(True))
    return captured.join(heads, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "digest", "bytes", "body",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("head")).alias("refers_to"),
    )


def record(type_: Column, refers_to: Column) -> Column:
    """A WARC record without its closing blank lines."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    block = F.concat(http, F.when(type_ == "response", F.col("body")).otherwise(""))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    page = lambda number: F.concat(F.lit("<urn:page:"), number.cast("string"), F.lit(">"))
    revisit = F.when(type_ == "revisit", F.lit(PROFILE))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", type_),
        line("WARC-Record-ID", page(F.col("page_id"))),
        line("WARC-Date", F.col("captured_at")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", revisit),
        line("WARC-Refers-To", page(refers_to)),
        line("WARC-URL-Key", F.col("url_key")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """One sorted gzip archive per task below ``path``."""
    captured = (
        with_revisits(pages)
        .withColumn("url_key", url_key(F.col("url")))
        .withColumn("captured_at", capture_time(F.col("page_id")))
        .sortWithinPartitions("url_key", "captured_at", "page_id")
    )
    captured.select(record(F.col("record_type"), F.col("refers_to")).alias("value")).write.option("lineSep", END).option(
        "compression", "gzip"
    ).text(path)


INDEX = (
    "run string, url_key string, captured_at string, page_id bigint, url string, record_type string, "
    "refers_to bigint, payload_bytes bigint, payload_digest string"
)
_COLUMNS = [part.split()[0] for part in INDEX.split(", ")]
_TYPES = [pa.int64() if part.endswith("bigint") else pa.string() for part in INDEX.split(", ")]


def inflated(content: memoryview) -> Iterator[bytes]:
    """Pieces of a gzip file of any number of members; a file that is none is given as it is."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield bytes(content)
        return
    rest = content
    while len(rest):
        member = zlib.decompressobj(31)
        at = 0
        while at < len(rest) and not member.eof:
            piece = member.decompress(rest[at : at + (1 << 16)])
            at += 1 << 16
            if piece:
                yield piece
        left = len(member.unused_data)
        rest = rest[min(at, len(rest)) - left :] if member.eof and left else rest[len(rest) :]


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a stream."""
    held = bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("archive ends inside a record's header")
                return
        lines = held[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        if not fill(end + 4 + size):
            raise ValueError("archive ends inside a record")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        fill(4)
        del held[:4]
        yield headers, block


def _page(value: str | None) -> int | None:
    return None if value is None else int(value.removeprefix("<urn:page:").removesuffix(">"))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            run, out = path.as_py(), []
            for headers, block in records(inflated(memoryview(content.as_buffer()))):
                _, _, payload = block.partition(b"\r\n\r\n")
                http = block[: len(block) - len(payload)]
                kind = headers["warc-type"]
                if kind == "response":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if headers.get("warc-payload-digest") != f"sha1:{digest}":
                        raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
                else:
                    size = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                out.append(
                    (
                        run, headers.get("warc-url-key"), headers["warc-date"], _page(headers.get("warc-record-id")),
                        headers.get("warc-target-uri"), kind, _page(headers.get("warc-refers-to")), size, digest,
                    )
                )
                if len(out) >= 5_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _COLUMNS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``, run by run, in the order of the files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_entries, INDEX)


class LoserTree:
    """Merges sorted lists: each inner node remembers the loser, the winner goes on up."""

    def __init__(self, lists: list[list]):
        self.lists = lists
        self.at = [0] * len(lists)
        size = 1
        while size < len(lists):
            size *= 2
        self.size, self.losers = size, [-1] * size
        self.winner = self._play(1)

    def _head(self, which: int):
        if 0 <= which < len(self.lists) and self.at[which] < len(self.lists[which]):
            return self.lists[which][self.at[which]]
        return None

    def _beats(self, one: int, two: int) -> bool:
        """Ties go to the list of the lower number; an empty list loses."""
        a, b = self._head(one), self._head(two)
        if a is None or b is None:
            return a is not None
        return (a, one) < (b, two)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._play(2 * node), self._play(2 * node + 1)
        if self._beats(left, right):
            self.losers[node] = right
            return left
        self.losers[node] = left
        return right

    def __iter__(self) -> Iterator:
        while (item := self._head(self.winner)) is not None:
            yield item
            self.at[self.winner] += 1
            node, best = (self.winner + self.size) // 2, self.winner
            while node:
                if self._beats(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.winner = best


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for number, (run, key, time, page) in enumerate(zip(*columns[:4])):
            entry = tuple(c[number] for c in columns)
            runs.setdefault(run, []).append((key or "", time, page is None, page or 0, len(runs.get(run, ())), entry))
    for entries in runs.values():
        # a run's piece comes as it was written, unless a fetch was repeated
        if any(a > b for a, b in zip(entries, entries[1:])):
            entries.sort()
    out = []
    for item in LoserTree([runs[name] for name in sorted(runs)]):
        out.append(item[-1])
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def merge_index(entries: DataFrame) -> DataFrame:
    """The entries in global order of URL key, time and id: partition after partition, row after row."""
    return entries.repartitionByRange("url_key", "captured_at", "page_id").mapInArrow(_merged, INDEX)


def capture_histories(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back, and give the merged index."""
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_archives(pages, path)
    return merge_index(read_archives(spark, path))
