"""WARC archives and a globally ordered capture index.

Writing: a capture is one WARC/1.1 record. Of captures with equal payloads the one with
the largest id is a ``response`` with the payload, the others are ``revisit`` records
that refer to it and keep only the HTTP header. Records are written by Spark's text
writer with the record separator as line separator, so any file system that Spark can
write to takes them, and a lost executor's task is simply run again. An archive is one
gzip stream.

Reading: records are cut by their Content-Length, payload digests are computed anew and
must equal the header's. Each archive gives one run, sorted by (URL key, timestamp, id)
where it was read.

Index: runs are dealt to ranges of (URL key, timestamp, id) by sampled bounds, and each
range merges its slices of the k runs with a loser tree; range after range, that is a
globally ordered capture history. A URL that fills a third of the captures is split by
timestamp and id. A range's memory is bounded by the size of its partition, and the index
holds no payloads.

Defined results: null html is an empty payload; a null URL has the URI ``urn:none``; line
breaks and blanks in a URL are percent-encoded in the archive; a null id is the smallest
and shows as null; rows that repeat id and payload are written each; an empty table gives
no rows; other columns are not read. Without a timestamp column a capture's time is
2024-01-01 plus its id in seconds (modulo a thousand million).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

LEAST_BYTES = 0
RECORDS_PER_FILE = 10_000
SEPARATOR = "\r\n\r\n"
EPOCH = 1_704_067_200
INDEX = "page_id long, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long"


def base32_of(hexed: Column) -> Column:
    """The 40 hex digits of a SHA-1 as 32 base32 digits: ten of the former are eight of the latter."""
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, captured: str | None = None) -> DataFrame:
    page = work.id_or_least("page_id")
    seconds = F.col(captured).cast("timestamp").cast("long") if captured else F.lit(EPOCH) + F.when(F.col("page_id").isNull(), 0).otherwise(F.pmod("page_id", F.lit(1_000_000_000)))
    stamp = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.coalesce(seconds, F.lit(EPOCH))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.coalesce("html", F.lit(""))
    url = F.coalesce(F.nullif("url", F.lit("")), F.lit("urn:none"))
    for found, put in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        url = F.replace(url, F.lit(found), F.lit(put))
    return pages.select(page.alias("page"), url.alias("url"), stamp.alias("stamp"), payload.alias("payload"), F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("bytes"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, captured: str | None = None) -> None:
    every = captures(pages, captured)
    known = work.written(every.select("page", "sha", "bytes"), "captures")
    last = known.filter(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max("page").alias("refers"), F.count(F.lit(1)).alias("n"))
    last = work.written(last.filter("n > 1").drop("n"), "repeated-payloads")
    again = work.written(known.join(last, "sha").filter("page < refers").select("page", "sha", "refers").distinct(), "revisits")
    full = every.join(again, ["page", "sha"], "left")
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.when(F.col(c) == work.NO_ID, "null").otherwise(F.col(c).cast("string")), F.lit(">"))
    revisit = F.col("refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(SEPARATOR))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("page"), F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Date: "), F.col("stamp"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("refers"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_of(F.col("sha")), F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string"), F.lit(SEPARATOR), block,
    )
    full.select(record.alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str) -> str:
    """Host labels from the last, then path and query, lower-cased: captures of a site stand together."""
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url, re.I)
    return (",".join(reversed(m[1].lower().split("."))) + ")" + (m[2].lower() or "/")) if m else url.lower()


def parse_archive(data: bytes) -> Iterator[tuple]:
    """(page_id, url_key, captured, record_type, payload_bytes, payload_digest, refers_to, offset) of each record."""
    end = SEPARATOR.encode()
    at, view = 0, memoryview(data)
    while at < len(data):
        stop = data.index(end, at)
        first, *lines = data[at:stop].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        told = dict(x.split(": ", 1) for x in lines)
        start = stop + 4
        next_at = start + int(told["Content-Length"])
        if data[next_at : next_at + 4] != end:
            raise ValueError(f"the record at byte {at} has a wrong length")
        body = data.index(end, start) + 4
        kind, digest = told["WARC-Type"], told["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response":
            size = next_at - body
            if base64.b32encode(hashlib.sha1(view[body:next_at]).digest()).decode() != digest:
                raise ValueError(f"the record at byte {at} has a wrong digest")
        else:
            size = int(re.search(rb"Content-Length: (\d+)", data[start:body])[1])
        number = lambda x: None if x is None or x == "<urn:capture:null>" else int(x.removeprefix("<urn:capture:").rstrip(">"))
        refers = told.get("WARC-Refers-To")
        yield number(told["WARC-Record-ID"]), url_key(told["WARC-Target-URI"]), told["WARC-Date"], kind, size, digest, (work.NO_ID if refers == "<urn:capture:null>" else number(refers)), at
        at = next_at + 4


def _order(row: tuple) -> tuple:
    return row[1], row[2], work.NO_ID if row[0] is None else row[0]


def _batch(rows: Sequence[tuple], extra: dict[str, list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.strip().split(" ") for f in INDEX.split(",")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    arrays = {n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)}
    arrays |= {n: pa.array(c, pa.string() if n == "run" else pa.int64()) for n, c in extra.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """The archives' captures as one sorted run for each archive, with run and place; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                rows = sorted(parse_archive(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data), key=_order)
                yield _batch(rows, {"run": [name.as_py()] * len(rows), "place": list(range(len(rows)))})

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return work.written(files.mapInArrow(run, INDEX + ", run string, place long"), "capture-runs")


class LoserTree:
    """Merges k sorted sequences; each step replays one path of the tree, log2 k comparisons."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.losers = [-1] * self.k
        self.winner = self._build(1)

    def _head(self, r: int):
        return self.runs[r][self.at[r]] if 0 <= r < len(self.runs) and self.at[r] < len(self.runs[r]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return x is not None and (y is None or (x, a) <= (y, b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        """(run, place) in merged order."""
        while self._head(self.winner) is not None:
            r = self.winner
            yield r, self.at[r]
            self.at[r] += 1
            node = (r + self.k) // 2
            while node:
                if not self._beats(r, self.losers[node]):
                    r, self.losers[node] = self.losers[node], r
                node //= 2
            self.winner = r


def merge_runs(runs: DataFrame) -> DataFrame:
    """The index in global order: within partitions, and from partition to partition."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if slices is None:
            return
        names = slices["run"].to_pylist()
        starts = [i for i, n in enumerate(names) if not i or n != names[i - 1]]
        pages = [work.NO_ID if p is None else p for p in slices["page_id"].to_pylist()]
        keys = list(zip(slices["url_key"].to_pylist(), slices["captured"].to_pylist(), pages, strict=True))
        tree = LoserTree([keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)])
        merged = slices.drop_columns(["run", "place"]).take(pa.array([starts[r] + i for r, i in tree], pa.int64()))
        yield from merged.to_batches(max_chunksize=10_000)

    dealt = runs.repartitionByRange("url_key", "captured", "page_id").sortWithinPartitions("run", "place")
    return dealt.mapInArrow(merge, INDEX)


def capture_index(pages: DataFrame, path: str | None = None, **settings) -> DataFrame:
    """Writes pages as archives, reads them back and returns the merged index."""
    spark = pages.sparkSession
    path = path or work.fresh_path(spark, "archives")
    write_archives(pages, path, **settings)
    return merge_runs(sorted_runs(spark, path))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = capture_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", work.id_or_null("refers_to").alias("refers_to"), "url_key", "captured")
