"""WARC archives with an external index merge (operator 5).

Each task writes its pages as one archive of gzipped records and a run of index rows, sorted by URL key and time.  The
index is dealt out by ranges of (key, time) of bounded size; in each range a loser tree merges the sorted runs, of which
it has a block each at hand, so the ranges in order are one globally ordered history of captures.  Archives are read back
in the order of that history: a batch of captures at a time, each archive of the batch from front to back.

Archives carry names of their own attempt, and the index is written before anything reads it: a task that ran twice
leaves a file that no index row names.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batch

#: Payloads of fewer bytes are always stored in full.
LEAST = 1000
#: Index rows of a range at most (about), rows of a batch, and archives that a task has open.
RANGE, BLOCK, OPEN = 1 << 18, 10_000, 64
#: Time of the first capture; pages carry none of their own, so page n counts as captured n seconds later.
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)

INDEX = "run string, url_key string, time string, page_id long, at long, size long"


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host reversed, no scheme, www, port or fragment."""
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    host = re.sub(r"^(?:www\d*|m)\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/").lower()


def capture_time(page_id: int | None) -> str:
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzipped record: a response with the payload, or a revisit that names the record that has it."""
    sha1 = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1.digest()).decode()}", f"WARC-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def read_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of a gzipped record."""
    raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def file_system(uri: str):
    """A file system for the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_archives(folder: str):
    """Rows (page_id, url, html, refers_to) to an archive of the task's own, and its sorted index run."""
    schema = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, rows, at = f"{uuid.uuid4().hex}.warc.gz", None, [], 0
        for part in batches:
            for page_id, url, html, refers_to in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    store, path = file_system(folder)
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                record = make_record(page_id, url, (html or "").encode(), refers_to)
                out.write(record)
                rows.append((name, url_key(url), capture_time(page_id), page_id, at, len(record)))
                at += len(record)
        if out is not None:
            out.close()
            rows.sort(key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0, r[4]))
            yield batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    return run


class LoserTree:
    """Merges sorted iterables; each inner node keeps the loser of its match, so the next row costs one path of matches.

    Only the first row of each run is held here; an iterator may fetch its rows in blocks.
    """

    def __init__(self, runs: Sequence[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.head = [next(r, None) for r in self.runs]
        self.k = max(1, len(self.runs))
        self.tree = [-1] * self.k
        winners = [-1] * self.k + [*range(len(self.runs))]
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1] if 2 * node + 1 < len(winners) else -1
            win, lose = (a, b) if self._less(a, b) else (b, a)
            winners[node], self.tree[node] = win, lose
        self.tree[0] = winners[1] if self.k > 1 else (0 if self.runs else -1)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a comes first; a run that has ended comes last, ties go to the earlier run."""
        if a < 0 or self.head[a] is None:
            return False
        if b < 0 or self.head[b] is None:
            return True
        x, y = self.head[a], self.head[b]
        return x < y or (x == y and a < b)

    def __iter__(self):
        while (win := self.tree[0]) >= 0 and self.head[win] is not None:
            yield self.head[win]
            self.head[win] = next(self.runs[win], None)
            node = (win + self.k) // 2
            while node:
                if self._less(self.tree[node], win):
                    self.tree[node], win = win, self.tree[node]
                node //= 2
            self.tree[0] = win


HISTORY = "range int, place long, run string, url_key string, time string, page_id long, at long, size long"


def run_rows(run: pa.Table, block: int) -> Iterator[tuple]:
    """The rows of a sorted run, a block of them at a time as Python values; a missing page_id comes first."""
    for a in range(0, run.num_rows, block):
        for name, key, time, page_id, at, size in zip(*(run.slice(a, block).column(i).to_pylist() for i in range(6)), strict=True):
            yield key, time, page_id is not None, page_id or 0, name, at, size


def merge_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the index, whose rows come run by run in order, to one sorted history.

    The range is held as Arrow columns; Python values exist of a block of each run and of the batch that goes out.
    """
    schema = pa.schema([("range", pa.int32()), ("place", pa.int64()), ("run", pa.string()), ("url_key", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])
    parts = [p for p in batches if p.num_rows]
    if not parts:
        return
    whole = pa.Table.from_batches(parts)
    ends = pc.run_end_encode(whole.column("run").combine_chunks()).run_ends.to_pylist()
    block = max(16, BLOCK // len(ends))
    runs = [run_rows(whole.slice(a, b - a), block) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    number, out = TaskContext.get().partitionId(), []
    for place, (key, time, known, page_id, name, at, size) in enumerate(LoserTree(runs)):
        out.append((number, place, name, key, time, page_id if known else None, at, size))
        if len(out) == BLOCK:
            yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
            out = []
    if out:
        yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))


CAPTURE = "range int, place long, page_id long, url string, url_key string, time string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(folder: str):
    """History rows to what the archives say, in the history's order.

    Of each batch every archive is read from front to back; at most ``OPEN`` archives are open.
    """
    schema = pa.schema([("range", pa.int32()), ("place", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("url_key", pa.string()), ("time", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        store, path = file_system(folder)
        files: dict[str, pa.NativeFile] = {}
        for part in batches:
            index = [*zip(*(part.column(x).to_pylist() for x in ("range", "place", "run", "url_key", "at", "size")), strict=True)]
            rows: list = [None] * len(index)
            for i in sorted(range(len(index)), key=lambda i: (index[i][2], index[i][4])):
                number, place, name, key, at, size = index[i]
                if name not in files:
                    if len(files) >= OPEN:
                        files.pop(next(iter(files))).close()
                    files[name] = store.open_input_file(f"{path}/{name}")
                fields, http, payload = read_record(files[name].read_at(size, at))
                kind = fields["WARC-Type"]
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                refers = fields.get("WARC-Refers-To-Page-ID")
                rows[i] = (number, place, int(fields["WARC-Page-ID"]) if fields["WARC-Page-ID"] else None, fields.get("WARC-Target-URI"), key, fields["WARC-Date"], int(http["Content-Length"]), digest, kind, int(refers) if refers else None)
            if rows:
                yield batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
        for file in files.values():
            file.close()

    return run


def archive_pages(pages: DataFrame, ws: Workspace, least: int = LEAST) -> tuple[DataFrame, str]:
    """Write every row of (page_id, url, html) as a record; gives the index runs (a written table) and the folder.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is a response, the others revisit it.
    Digests are counted with partial aggregation; only those that repeat are joined.  Rows that repeat the largest
    page_id are all responses; a row without a page_id revisits.  A null page is empty.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1("html")))
    copies = ws.table(rows.filter("digest is not null").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    folder = ws.path("archives")
    index = rows.join(copies, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(write_archives(folder), INDEX)
    return ws.table(index, "index"), folder


def merge_index(index: DataFrame) -> DataFrame:
    """Index runs to capture histories in global order of (url_key, time, page_id): by range, and by place within it."""
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE))
    order = ["url_key", "time", "page_id", "run", "at"]
    return index.repartitionByRange(parts, *order).sortWithinPartitions("run", "url_key", "time", "page_id", "at").mapInArrow(merge_runs, HISTORY)


def read_captures(history: DataFrame, folder: str) -> DataFrame:
    """What the archives hold, in the order of the history."""
    return history.mapInArrow(read_archives(folder), CAPTURE)


def warc_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages to archives, merge their index and read them back through it: range and place (the capture's place in
    the ordered history), page_id, url, url_key, time, payload_bytes, payload_digest (SHA-1 of the full payload),
    record_type and refers_to.  One row per input row; a null page is an empty payload, a null url has an empty key; other
    columns are ignored."""
    ws = Workspace(pages.sparkSession, "warc")
    index, folder = archive_pages(pages, ws, least)
    return ws.keep(read_captures(ws.table(merge_index(index), "history"), folder))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN k.keeper IS NULL OR k.keeper = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.keeper <> d.page_id THEN k.keeper END AS refers_to
FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest AND d.payload_bytes >= 1000
"""
