"""WARC archives, and their index by external merge.

Records are built as columns and written by Spark's text writer with the record's end as the line separator, so files
are committed like any table and no task writes beside Spark. A record with the same payload as that of a smaller page id
is a revisit record without a body. Reading parses the archives by their Content-Length and checks every digest.

The index: each archive yields its captures sorted by URL key and time, which is a run. Runs are cut into blocks at
common splitters; each range of keys gets its blocks of all runs, in the order of their first keys, and merges them
with a loser tree. The ranges one after the other are the globally ordered capture histories.

At scale: digests are combined per task before the shuffle, and joins carry 100 bytes a page; payloads are shuffled
once, by page id. A merge holds one block a run at most, blocks come from Spark's spilling sort, and the splitters are
on (key, time, page), so one URL with a third of all captures is spread over many ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import Scratch, text_of

END = "\r\n\r\n"
RECORDS_A_FILE = 2000
FILE_BYTES = 16_000_000
BLOCK_CAPTURES = 1024
RANGE_CAPTURES = 200_000
SPLITTER_SAMPLE = 10_000
#: When the pages have no capture time: the first page's, then one second a page id.
FIRST_CAPTURE = 1_704_067_200

CAPTURE = "urlkey string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"
CAPTURE_SCHEMA = pa.schema([("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str | None) -> str:
    """The URL's host reversed, then its path and query, in lower case: captures of a host and its paths are neighbours."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"{url.strip().lower()})"
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def write_archives(pages: DataFrame, folder: str, tmp: Scratch, min_revisit_bytes: int = 0) -> None:
    """pages: page_id, url, html. Null html is empty. Of rows with equal payloads, those with the smallest page id are
    responses and others revisit it; payloads of fewer bytes than ``min_revisit_bytes`` are always responses."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    marks = pages.select("page_id", F.sha2("html", 256).alias("same"), F.octet_length("html").alias("size"))
    marks = tmp.save(marks.distinct(), "marks")
    groups = marks.filter(F.col("size") >= min_revisit_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = tmp.save(groups.select("same", "first"), "groups")
    revisits = marks.join(groups, "same").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("revisit"), F.col("same").alias("revisit_of"), "first")
    revisits = tmp.save(revisits, "revisits")

    on = F.col("page_id").eqNullSafe(F.col("revisit")) & (F.sha2("html", 256) == F.col("revisit_of"))
    rows = pages.join(revisits, on, "left")
    again = F.col("revisit_of").isNotNull()
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    uid = F.md5(F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    uid = F.regexp_replace(uid, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce(F.col("page_id"), F.lit(0)) % 3_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uid, F.lit(">"))), line("WARC-Date", when), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))),
        F.when(again, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n").otherwise(""),
        line("X-Page-Id", F.col("page_id").cast("string")), line("X-Refers-To-Page-Id", F.when(again, F.col("first").cast("string"))), line("X-Payload-Length", size),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")),
    )
    records = rows.select(F.concat(head, F.lit("\r\n"), block).alias("value"))
    mean = marks.agg(F.avg("size")).first()[0] or 0
    most = int(max(1, min(RECORDS_A_FILE, FILE_BYTES // (mean + 1))))
    records.write.option("lineSep", END).option("compression", "none").option("maxRecordsPerFile", most).text(folder)


def parse_archive(raw: memoryview, file: str) -> Iterator[tuple]:
    """The captures of an archive, in its order. A digest that the payload doesn't have is an error."""
    at = 0
    while at < len(raw):
        window = 4096
        while (head_end := bytes(raw[at : at + window]).find(b"\r\n\r\n")) < 0 and window < len(raw) - at:
            window *= 2
        lines = bytes(raw[at : at + head_end]).decode().split("\r\n")
        if head_end < 0 or lines[0] != "WARC/1.1":
            raise ValueError(f"{file}: no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, size = at + head_end + 4, int(head["Content-Length"])
        block = raw[start : start + size]
        end = start + size + len(END)
        if bytes(raw[start + size : end]) != END.encode():
            raise ValueError(f"{file}: the record at {at} has no end")
        digest, page, first = head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
        if head["WARC-Type"] == "response":
            body = block[bytes(block[:65536]).index(b"\r\n\r\n") + 4 :]
            if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != int(head["X-Payload-Length"]):
                raise ValueError(f"{file}: the payload at {at} isn't that of its digest")
        url, captured = head.get("WARC-Target-URI"), re.sub(r"\D", "", head["WARC-Date"])
        yield url_key(url), captured, None if page is None else int(page), url, head["WARC-Type"], None if first is None else int(first), int(head["X-Payload-Length"]), digest, file, at, end - at
        at = end


def _order(capture: tuple) -> tuple:
    """URL key, time, page id (null first), place."""
    return capture[0], capture[1], -1 << 63 if capture[2] is None else capture[2], capture[8], capture[9]


def read_runs(spark, folder: str) -> DataFrame:
    """Each archive's captures with its run (file) and their place in it, sorted by URL key and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                captures = sorted(parse_archive(memoryview(content.as_buffer()), path.rpartition("/")[2]), key=_order)
                for at in range(0, len(captures), 10_000):
                    columns = zip(*captures[at : at + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CAPTURE_SCHEMA, strict=True)], schema=CAPTURE_SCHEMA)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges sorted streams: each inner node holds the loser of its match, node 0 the winner. A next key costs log2(k) matches."""

    def __init__(self, k: int):
        self.k = k
        self.key: list = [None] * k  # None: nothing left, which loses against all
        self.node = [0] * max(1, k)

    def _beats(self, a: int, b: int) -> bool:
        if self.key[a] is None or self.key[b] is None:
            return self.key[b] is None and (self.key[a] is not None or a < b)
        return (self.key[a], a) < (self.key[b], b)

    def build(self) -> None:
        winners = [0] * self.k + list(range(self.k))
        for at in range(self.k - 1, 0, -1):
            a, b = winners[2 * at], winners[2 * at + 1]
            winners[at], self.node[at] = (a, b) if self._beats(a, b) else (b, a)
        self.node[0] = winners[1] if self.k > 1 else 0

    def replace_winner(self, key) -> None:
        leaf = self.node[0]
        self.key[leaf] = key
        winner, at = leaf, (leaf + self.k) // 2
        while at > 0:
            if self._beats(self.node[at], winner):
                winner, self.node[at] = self.node[at], winner
            at //= 2
        self.node[0] = winner

    def winner(self) -> int:
        return self.node[0]


def merge_blocks(blocks: Iterator[tuple[str, list[tuple]]]) -> Iterator[tuple]:
    """blocks: (run, sorted captures), in the order of their first captures. A block is opened when its first capture is due.

    Streams take the tree's leaves as their blocks open; the tree doubles when all its leaves are taken.
    """
    tree, streams, leaf_of = LoserTree(4), {}, {}
    tree.build()
    upcoming = next(blocks, None)

    def grown() -> None:
        nonlocal tree
        bigger = LoserTree(2 * tree.k)
        bigger.key[: tree.k] = tree.key
        tree = bigger

    while True:
        top = tree.winner()
        if upcoming is not None and (tree.key[top] is None or _order(upcoming[1][0]) <= tree.key[top]):
            run, captures = upcoming
            leaf = leaf_of.get(run)
            if leaf is None or leaf in streams:  # a run's next block can be due while it has captures with equal keys
                leaf = next((k for k in range(tree.k) if k not in streams), None)
                if leaf is None:
                    leaf = tree.k
                    grown()
                leaf_of[run] = leaf
            streams[leaf] = (captures, 0)
            tree.key[leaf] = _order(captures[0])
            tree.build()  # a match up from one leaf is only right for the winner's; once a block, this costs little
            upcoming = next(blocks, None)
            continue
        if tree.key[top] is None:
            return
        captures, at = streams[top]
        yield captures[at]
        if at + 1 < len(captures):
            streams[top] = (captures, at + 1)
            tree.replace_winner(_order(captures[at + 1]))
        else:
            del streams[top]
            tree.replace_winner(None)


def merged_index(runs: DataFrame, range_captures: int = RANGE_CAPTURES, block_captures: int = BLOCK_CAPTURES) -> DataFrame:
    """The captures with key_range and place: ordered by both, they are ordered by URL key, time and page id."""
    spark, total = runs.sparkSession, runs.count()
    ranges = max(1, -(-total // range_captures))
    splitters: list[tuple] = []
    if ranges > 1:  # a bounded sample; it only decides how even the ranges are
        keys = runs.sample(min(1.0, SPLITTER_SAMPLE / total), seed=5).select("urlkey", "captured", F.coalesce("page_id", F.lit(-1 << 63)).alias("p"), "file", "offset").limit(2 * SPLITTER_SAMPLE)
        found = sorted(map(tuple, keys.collect()))
        splitters = sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        def row(own: list[tuple], key_range: int) -> pa.RecordBatch:
            first = _order(own[0])
            columns = zip(*own, strict=True)
            body = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CAPTURE_SCHEMA, strict=True)], schema=CAPTURE_SCHEMA)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, CAPTURE_SCHEMA) as out:
                out.write_batch(body)
            return pa.RecordBatch.from_pydict({"key_range": pa.array([key_range], pa.int32()), "urlkey": [first[0]], "captured": [first[1]], "p": [first[2]], "run": [first[3]], "offset": [first[4]], "block": [sink.getvalue().to_pybytes()]})

        own, mine, run = [], -1, None
        for batch in batches:
            for capture in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key_range = bisect_right(splitters, _order(capture))
                # a new run, a new range or a full block
                if own and (key_range != mine or capture[8] != run or len(own) >= block_captures or _order(capture) < _order(own[-1])):
                    yield row(own, mine)
                    own = []
                mine, run = key_range, capture[8]
                own.append(capture)
        if own:
            yield row(own, mine)

    blocks = runs.select(*CAPTURE_SCHEMA.names).mapInArrow(cut, "key_range int, urlkey string, captured string, p long, run string, offset long, block binary")
    ordered = blocks.repartition(ranges, "key_range").sortWithinPartitions("key_range", "urlkey", "captured", "p", "run", "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened() -> Iterator[tuple[int, str, list[tuple]]]:
            for batch in batches:
                for key_range, run, block in zip(*(batch.column(c).to_pylist() for c in ("key_range", "run", "block")), strict=True):
                    with pa.ipc.open_stream(block) as reader:
                        yield key_range, run, [x for b in reader for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]

        from itertools import groupby

        for key_range, own in groupby(opened(), key=lambda x: x[0]):
            place, out = 0, []
            for capture in merge_blocks((run, captures) for _, run, captures in own):
                out.append((*capture, key_range, place))
                place += 1
                if len(out) == 10_000:
                    yield as_batch(out)
                    out = []
            if out:
                yield as_batch(out)

    full = CAPTURE_SCHEMA.append(pa.field("key_range", pa.int32())).append(pa.field("place", pa.int64()))

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), full, strict=True)], schema=full)

    return ordered.mapInArrow(merge, f"{CAPTURE}, key_range int, place long")


def archive_and_index(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads them back and returns the merged index, one row a page.

    Null html is an empty payload; a null url or page id has no header and reads as null again. A null page id is never
    the one revisited unless all of a group are null. Repeated rows of the smallest page id are all responses.
    An empty table gives an empty index. Other columns are ignored.
    """
    spark = pages.sparkSession
    tmp = Scratch(spark, "warc")
    write_archives(pages, tmp.folder("archives"), tmp, min_revisit_bytes)
    read_runs(spark, tmp.folder("archives")).write.parquet(tmp.folder("runs"))
    return merged_index(spark.read.schema(CAPTURE).parquet(tmp.folder("runs")))
