"""WARC archives of pages and their capture index, merged from locally sorted runs.

Writing. Each row becomes one WARC/1.1 record. Of rows with equal payloads of at least ``min_revisit`` bytes the one
with the largest id is a response and the others are revisit records that refer to it, without the payload. Spark's
text writer stores the records (a record ends with CR LF CR LF, its line separator) as gzip files.

Reading. Every file is read as bytes and parsed record by record by Content-Length, so no payload can be taken for a
record's end. Its captures, sorted by URL key, time and id, are one run of the external index. The runs are dealt by key
ranges, and each task merges its slices of the runs with a loser tree; range and position give the global order.

Defined results: a null payload is an empty one, a null URL has the empty key, a null id is read back as null (it never
is the largest, and refers to the largest like others do), repeated rows are a record each (of equal payloads all rows
that repeat the largest id are responses), an empty table gives an empty index, extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import land, ship_package

MIN_REVISIT = 1000
RECORDS_PER_FILE = 5000
CAPTURES_PER_RANGE = 200_000
# Stand-in capture time of tables without one: this second plus the id.
FIRST_SECOND = 1_577_836_800
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("url_key string, captured_at string, page_id long, record_type string, refers_to long, payload_bytes long, "
         "payload_digest string, file string, offset long, run long, place long")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 time_col: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(record): the text of a WARC record for each row, without the CR LF CR LF that ends it."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    seconds = F.timestamp_seconds(F.lit(FIRST_SECOND) + F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(10 ** 9)))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        payload.alias("payload"), F.octet_length(payload).alias("size"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"), 
        (F.coalesce(F.col(time_col).cast("timestamp"), seconds) if time_col else seconds).alias("time"))
    repeated = land(rows.where(F.col("size") >= min_revisit).groupBy("digest", "size")
                    .agg(F.max("id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
                    .select("digest", "size", "last"), "repeated-payloads")
    known = rows.join(repeated, ["digest", "size"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("last")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return known.select(F.concat(head, F.lit(END), block).alias("record"))


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the records as gzip WARC files of at most ``records_per_file`` records."""
    (records.write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse_records(data: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, lower-case header fields, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        start = head_end + 4
        end = start + int(fields["content-length"])
        yield at, fields, data[start:end]
        at = end + 4


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed (without a leading www), then path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
    except ValueError:  # such as a malformed IPv6 host
        return url
    host = parts.netloc.lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _number(record_id: str | None):
    digits = (record_id or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _capture(offset: int, fields: dict, block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "revisit":  # the kept HTTP header tells the size of the payload that is not stored
        size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if fields["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    return (url_key(fields.get("warc-target-uri")), fields["warc-date"], _number(fields["warc-record-id"]),
            fields["warc-type"], _number(fields.get("warc-refers-to")), size, digest, offset)


def _order(capture: tuple) -> tuple:
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[7]


def _table(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({c: "Int64" for c in ("page_id", "refers_to")})


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """One locally sorted run of captures (INDEX) for each archive file below ``path``."""
    ship_package(spark)
    columns = [c.strip().split(" ")[0] for c in INDEX.split(",")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content, run in zip(pdf["path"], pdf["content"], pdf["run"]):
                data = bytes(content)
                if data[:2] == b"\x1f\x8b":
                    data = _unzipped(data)
                found = sorted((_capture(*r) for r in parse_records(data)), key=_order)
                yield _table([(*c[:7], file, c[7], run, i) for i, c in enumerate(found)], columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content", F.xxhash64("path").alias("run")).mapInPandas(read, INDEX)


def _unzipped(data: bytes) -> bytes:
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match, so the next smallest item takes
    one match per level."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * len(runs)
        self.winner = -1
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        ka, kb = self.key(a), self.key(b)
        return ka < kb or ka == kb and i < j

    def _play(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to arrive waits here
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self):
        while self.runs and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def merged_index(runs: DataFrame, captures_per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """The captures of all runs with range_id and position: ordered by both, they are ordered by URL key, time and id
    (null ids first) over all archives. A range holds about ``captures_per_range`` captures, however many share a URL."""
    runs = land(runs, "capture-runs")
    ranges = max(1, math.ceil(runs.count() / captures_per_range))
    columns = runs.columns
    at = {c: i for i, c in enumerate(columns)}

    def key(row):
        page = row[at["page_id"]]
        return (row[at["url_key"]], row[at["captured_at"]], page is not None, page or 0, row[at["run"]],
                row[at["place"]])

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[int, list] = {}  # rows come run by run, each in its order
        for pdf in frames:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for row in pdf.itertuples(index=False, name=None):
                slices.setdefault(row[at["run"]], []).append(row)
        number, rows = TaskContext.get().partitionId(), []
        for position, row in enumerate(LoserTree([iter(s) for s in slices.values()], key)):
            rows.append((*row, number, position))
            if len(rows) == 10_000:
                yield _table(rows, [*columns, "range_id", "position"])
                rows = []
        yield _table(rows, [*columns, "range_id", "position"])

    dealt = (runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id", "run", "place")
             .sortWithinPartitions("run", "place"))
    return dealt.mapInPandas(merge, INDEX + ", range_id int, position long")


def archive_and_index(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as WARC files below ``path`` (default: a new folder in the shared one), read them back and
    return their merged index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_warc(warc_records(pages, **options), path)
    return merged_index(capture_runs(spark, path))
