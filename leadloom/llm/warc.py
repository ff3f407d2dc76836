"""WARC archives of pages, and capture histories from an external merge of their indexes.

Writing: each task writes one archive at a time, a gzip member a record.  An
archive is a list of rows (archive, offset, record): its records in a row are
the file's bytes, so Spark's commit protocol guards it against lost executors.
Equal payloads of 1000 bytes or more are held once; others revisit it.

Reading: the task that parses an archive sorts its index lines by URL key and
timestamp: a run.  Runs are cut at common key bounds, and a loser tree merges
the sorted slices of each range, so ranges in order give one globally ordered
index.

Null html is an empty payload; a null url has an empty key and sorts first; a
null id stays null and counts as the least.  Repeated rows give repeated
records.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written

#: Payloads shorter than this are always written whole.
LEAST_REVISIT = 1000
#: Bytes of payload in an archive, and index lines that one merge task takes, about.
ARCHIVE_BYTES = 16 << 20
MERGED_LINES = 20_000
#: Merge tasks at most; beyond that each takes more lines.
MOST_RANGES = 100_000
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def url_key(url: Column) -> Column:
    """Sort-friendly URL key: host labels reversed, no scheme, user, leading www or m, default port or fragment; path and sorted query lowered."""
    plain = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    plain = F.regexp_replace(F.regexp_replace(plain, "#.*$", ""), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, "^([^/?]*)", 1), "^.*@", ""), ":(80|443)?$", "")
    port, host = F.regexp_extract(host, r"(:\d*)$", 1), F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^(www\d*|m)\.", "")
    rest = F.regexp_replace(F.regexp_replace(plain, "^[^/?]*", ""), r"\?.*$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&")), "&")
    path = F.when(rest == "", F.lit("/")).otherwise(rest)
    return F.when(host == "", F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    )


def captures(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Pages with their payload digest and the id that a revisit refers to.

    Copies are counted by digest first, and only digests of several pages are
    on the right of the join.  Pages move once; where a digest is hot, adaptive
    execution splits its pages among tasks, as each digest is one row on the right.
    """
    body = F.encode(F.coalesce(pages[payload].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    sums = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    found = rows.join(sums.select("digest", "first_id"), "digest", "left")
    # The largest id is the response; of rows that repeat it, each is.
    return found.withColumn("refers_to", F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def _stamp(page_id: int | None) -> str:
    return (FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record of a capture, not compressed."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", _stamp(page_id)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def write_archives(found: DataFrame) -> DataFrame:
    """archive, offset and record (a gzip member) of every capture; ``found`` as ``captures`` gives it."""
    ship(found.sparkSession)

    def work(batches):
        name, at = "", ARCHIVE_BYTES
        for batch in batches:
            out: list[list] = [[], [], []]
            for row in batch.to_pylist():
                raw = record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = squeeze.compress(raw) + squeeze.flush()
                if at >= ARCHIVE_BYTES or not name:
                    name, at = hashlib.sha1(raw[:4096] + str(row["page_id"]).encode()).hexdigest()[:20] + ".warc.gz", 0
                for column, value in zip(out, (name, at, member)):
                    column.append(value)
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.binary()))], ["archive", "offset", "record"])

    return found.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(work, "archive string, offset long, record binary")


def parse_record(member: bytes) -> dict:
    """Header fields of a gzip member with one record, its payload, and whether the payload has the digest that the header states."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of another length than its header states")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload of another digest than its header states")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "timestamp": fields["WARC-Date"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": stated,
        "payload_digest": digest,
        "refers_to": _page(fields.get("WARC-Refers-To", "")),
    }


def _page(urn: str) -> int | None:
    number = urn[len("<urn:page:") : -1]
    return int(number) if number else None


def index_lines(archives: DataFrame) -> DataFrame:
    """One line a record, read from the archives, with url_key; a task's lines are sorted within each archive."""
    ship(archives.sparkSession)
    names = ["page_id", "url", "timestamp", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(batches):
        for batch in batches:
            found = [parse_record(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[n] for r in found], t) for n, t in zip(names, kinds))], ["archive", "offset", *names])

    schema = "archive string, offset long, page_id long, url string, timestamp string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    lines = archives.select("archive", "offset", "record").mapInArrow(work, schema).withColumn("url_key", url_key(F.col("url")))
    return lines.sortWithinPartitions("archive", _merge_order())


def _merge_order() -> Column:
    return F.struct(F.col("url_key"), F.col("timestamp"), F.coalesce("page_id", F.lit(-(2**63))).alias("page_id"), F.col("archive"), F.col("offset"))


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match, the winner moves up."""

    END = None

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = len(runs)
        self.head = [next(r, self.END) for r in runs]
        self.loser = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is self.END or y is self.END:
            return y is self.END and (x is not self.END or a < b)
        return (x, a) < (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.head[self.winner] is not self.END:
            best = self.winner
            yield self.head[best]
            self.head[best] = next(self.runs[best], self.END)
            node = (best + self.k) // 2
            while node:
                if self._beats(self.loser[node], best):
                    self.loser[node], best = best, self.loser[node]
                node //= 2
            self.winner = best


#: Columns of the merge order; page_id and offset part captures of one URL and second.
ORDER = ["url_key", "timestamp", "page_id", "archive", "offset"]


def merged_histories(lines: DataFrame, *, together: int = MERGED_LINES) -> DataFrame:
    """Index lines in global order: merge_range and place (order within the range), and capture, the number of a line within its URL's history.

    ``lines`` is read several times: pass a written table.
    """
    spark = lines.sparkSession
    ship(spark)
    runs = lines.withColumn("sort_key", _merge_order())
    ranges = min(max(1, -(-lines.count() // together)), MOST_RANGES)
    # Range bounds on the whole merge order: one URL with a third of all captures is cut like any other.
    dealt = runs.repartitionByRange(ranges, "sort_key")
    fields = [f.name for f in lines.schema.fields]
    at = {name: k for k, name in enumerate(fields)}

    def merge(batches):
        # A task holds the slices of one range: about `together` lines.  A slice that arrives in parts is as many runs.
        slices: list[list[tuple]] = []
        now: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page, name = row[at["page_id"]], row[at["archive"]]
                entry = (row[at["url_key"]].encode(), row[at["timestamp"]], -(2**63) if page is None else page, name, row[at["offset"]], row)
                if name not in now or entry[:5] < now[name][-1][:5]:
                    now[name] = []
                    slices.append(now[name])
                now[name].append(entry)
        place, out = 0, []
        for entry in LoserTree([iter(x) for x in slices]):
            out.append((*entry[5], place))
            place += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], [*fields, "place"])

    kinds = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in lines.schema.fields] + [pa.int64()]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields) + ", place long"
    merged = written(dealt.select(*fields).mapInArrow(merge, schema).withColumn("merge_range", F.spark_partition_id()), "merged")
    # Number within a URL's history: lines of this URL in earlier ranges, and those before it in its own.
    own = Window.partitionBy("url_key", "merge_range").orderBy("place")
    earlier = Window.partitionBy("url_key").orderBy("merge_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = merged.groupBy("url_key", "merge_range").agg(F.count("*").alias("n"))
    several = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("before > 0").select("url_key", "merge_range", "before")
    return merged.withColumn("capture", F.row_number().over(own)).join(several, ["url_key", "merge_range"], "left").withColumn("capture", F.col("capture") + F.coalesce("before", F.lit(0))).drop("before")


def capture_histories(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write archives of all pages, read them back, and merge their indexes."""
    archives = written(write_archives(captures(pages, key=key, url=url, payload=payload)), "archives")
    return merged_histories(written(index_lines(archives), "lines"))
