"""WARC archives with revisit records, and their index by an external merge of sorted capture runs.

``write_archives`` writes one gzip member per capture; captures with equal payloads refer to the one with the smallest
page_id. ``index_archives`` reads the archives back record by record, checks digests, and writes one run of index entries
per archive, sorted by URL key and timestamp. ``merge_runs`` merges runs, at most ``fan_in`` at a time, with a tree of losers
until that many are left, and then range by range: each task merges one range of (URL key, timestamp) of all runs. The
ranges in order are the capture histories in order. Runs are Arrow files, of which a merge holds one batch per run.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, scratch
from .token_files import open_fs

ARCHIVE_BYTES, RUN_ROWS, FAN_IN = 64 << 20, 4096, 64
EPOCH = datetime.datetime(2024, 1, 1)
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
ENTRY = pa.schema([
    ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
ENTRY_DDL = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host with its labels reversed, then the path and query: 'com,example)/a?b'."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", (url or "").strip(), re.I)
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return f"{','.join(reversed(host.split('.')))}{port}){m[3] or '/'}" if host or m[3] else ""


def _record_id(page_id: int | None, salt: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}' if page_id is not None else salt)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, when: str, salt: str) -> bytes:
    """One WARC/1.1 record as a gzip member: a response, or a revisit of page ``first`` with an identical payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, salt)}",
        f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first, '')}", f"X-Refers-To-Page-ID: {first}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Out:
    """A file that appears under its name when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream, self.size = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def _writer(base: str, most: int):
    def run(batches):
        from pyspark import TaskContext

        part, out, made, count = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for page_id, url, html, sha, first in zip(*cols, strict=True):
                if out is None:
                    uri = f"{base}/part-{part:06d}-{len(made):05d}.warc.gz"
                    out, _ = _Out(uri), made.append(uri)
                when = (EPOCH + datetime.timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                out.write(record(page_id, url, (html or "").encode(), base64.b32encode(bytes.fromhex(sha)).decode(), first, when, f"{part}:{count}"))
                count += 1
                if out.size >= most:
                    out.close()
                    out = None
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"uri": pa.array(made, pa.string())})

    return run


def write_archives(pages: DataFrame, base: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``base``; returns their (uri), written before it is returned.

    A null html is an empty payload. Of equal payloads of at least ``least_bytes`` bytes the record with the smallest page_id is the
    response, the others are revisits; smaller ones are responses all. Rows without page_id never are the one referred to,
    unless a payload has no other, when they are responses; rows that repeat the smallest page_id are responses too. Captures
    are dated by page_id, in seconds from 2024-01-01. An empty table gives no archive."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    firsts = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = materialise(firsts, "firsts")
    # Payloads that make up more than a thousandth of all repeats, fewer than 1000, are looked up where their pages are; these pages are then dealt evenly.
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = firsts.where(F.col("n") * 1000 > total).select("sha", F.col("first").alias("hot"))
    rest = firsts.where(F.col("n") * 1000 <= total).select(F.col("sha").alias("k"), "first")
    dealt = F.concat(F.lit("page "), F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)).cast("string"))
    rows = rows.join(F.broadcast(hot), "sha", "left").withColumn("k", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(dealt)).join(rest, "k", "left")
    rows = rows.withColumn("first", F.coalesce("hot", "first"))
    rows = rows.select("page_id", "url", "html", "sha", F.when(~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)), F.col("first")).alias("first"))
    return materialise(rows.mapInArrow(_writer(base, archive_bytes), "uri string"), "archives")


def records(uri: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each gzip member, read as a stream."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        held, offset = b"", 0
        while True:
            unpack, parts, length = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                held = held or stream.read(1 << 18)
                if not held:
                    if length:
                        raise ValueError(f"{uri}: cut short at {offset}")
                    return
                parts.append(unpack.decompress(held))
                length += len(held) - len(unpack.unused_data)
                held = unpack.unused_data
            yield offset, length, b"".join(parts)
            offset += length


def parse(uri: str, offset: int, length: int, data: bytes) -> tuple:
    """An index entry (the columns of ENTRY); raises if a payload doesn't match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{uri}: the payload at {offset} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    when = re.sub(r"\D", "", fields["WARC-Date"])
    return url_key(fields.get("WARC-Target-URI")), when, number("X-Page-ID"), size, digest, kind, number("X-Refers-To-Page-ID"), uri, offset, length


def _key(entry: tuple) -> tuple:
    return entry[0], entry[1], -1 if entry[2] is None else entry[2], entry[7], entry[8]


def _batch(entries: list[tuple], schema: pa.Schema = ENTRY) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in entries], t) for i, t in enumerate(schema.types)], schema=schema)


def _write_run(uri: str, entries: Iterable[tuple]) -> list[tuple[str, str]]:
    """Write sorted entries as batches; returns the first key of each batch."""
    out, firsts, held = _Out(uri), [], []
    with pa.ipc.new_file(out.stream, ENTRY) as file:
        for e in entries:
            held.append(e)
            if len(held) == RUN_ROWS:
                firsts.append(held[0][:2])
                file.write_batch(_batch(held))
                held = []
        if held:
            firsts.append(held[0][:2])
            file.write_batch(_batch(held))
    out.close()
    return firsts


def _read_run(uri: str, low: tuple[str, str] | None = None, high: tuple[str, str] | None = None) -> Iterator[tuple]:
    """Entries of a run with low <= (URL key, timestamp) < high; reads only the batches that may hold them."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as source, pa.ipc.open_file(source) as file:
        first = 0
        if low is not None:  # the first batch that doesn't end before low: by halving on the batches' first keys
            key = lambda i: (lambda b: (b.column(0)[0].as_py(), b.column(1)[0].as_py()))(file.get_batch(i))
            lo, hi = 0, file.num_record_batches
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if key(mid) < low else (lo, mid)
            first = max(0, lo - 1)
        for i in range(first, file.num_record_batches):
            for e in zip(*[c.to_pylist() for c in file.get_batch(i).columns], strict=True):
                if high is not None and e[:2] >= high:
                    return
                if low is None or e[:2] >= low:
                    yield e


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs with a tree of losers: each inner node keeps the run that lost there, so replacing the winner's entry
    replays only the games on its way to the root."""
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]
    keys = [(1,) if h is None else (0, *_key(h), i) for i, h in enumerate(heads)]
    losers = [-1] * k
    winner = -1
    for start in range(k):  # enter the runs one by one; the first to reach a node waits there
        at, node = start, (start + k) // 2
        while node and losers[node] >= 0:
            if keys[losers[node]] < keys[at]:
                at, losers[node] = losers[node], at
            node //= 2
        if node:
            losers[node] = at
        else:
            winner = at
    while keys[winner] != (1,):
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        keys[winner] = (1,) if heads[winner] is None else (0, *_key(heads[winner]), winner)
        at, node = winner, (winner + k) // 2
        while node:
            if keys[losers[node]] < keys[at]:
                at, losers[node] = losers[node], at
            node //= 2
        winner = at


RUN_DDL = "run string, url_key string, timestamp string"


def _described(uri: str, firsts: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"run": pa.array([uri] * len(firsts), pa.string()), "url_key": pa.array([f[0] for f in firsts], pa.string()), "timestamp": pa.array([f[1] for f in firsts], pa.string())})


def index_archives(archives: DataFrame, base: str) -> DataFrame:
    """Read archives (uri) back and write a sorted run for each below ``base``; returns (run, url_key, timestamp): the first
    key of each batch of a run."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                entries = sorted((parse(uri, *r) for r in records(uri)), key=_key)  # one archive's entries
                name = f"{base}/{hashlib.sha1(uri.encode()).hexdigest()}.arrow"
                yield _described(name, _write_run(name, entries))

    return materialise(_spread(archives, "uri").mapInArrow(run, RUN_DDL), "runs")


def _spread(df: DataFrame, by: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def merge_runs(runs: DataFrame, base: str, fan_in: int = FAN_IN, ranges: int | None = None, sample: int = 10_000) -> DataFrame:
    """The entries of all runs, with ``range``: ranges follow one another, and within a range ``place`` counts from 0."""
    spark = runs.sparkSession

    def combine(batches):
        for batch in batches:
            for group, uris in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{base}/merged-{uuid.uuid5(_NAMESPACE, ' '.join(sorted(uris)))}-{group}.arrow"
                yield _described(name, _write_run(name, merge([_read_run(u) for u in sorted(uris)])))

    while (n := runs.select("run").distinct().count()) > fan_in:
        groups = -(-n // fan_in)
        dealt = runs.select("run").distinct().withColumn("g", F.pmod(F.xxhash64("run"), F.lit(2 * groups)))
        # A hash deals about fan_in / 2 runs to a group; the few above fan_in are cut again.
        cut = dealt.withColumn("r", F.row_number().over(_by("g", "run"))).withColumn("s", F.floor((F.col("r") - 1) / fan_in))
        gathered = cut.groupBy("g", "s").agg(F.collect_list("run").alias("runs")).select(F.concat_ws("-", "g", "s").alias("g"), "runs")
        runs = materialise(_spread(gathered, "g").mapInArrow(combine, RUN_DDL), "runs")
    uris = sorted(r[0] for r in runs.select("run").distinct().collect())  # fan_in rows at most
    keys = sorted((r[0], r[1]) for r in runs.orderBy(F.xxhash64("run", "url_key", "timestamp")).limit(sample).select("url_key", "timestamp").collect())
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    bounds = [None, *cuts, None]

    def ranged(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                held, place = [], 0
                for e in merge([_read_run(u, bounds[i], bounds[i + 1]) for u in uris]):
                    held.append((*e, i, place))
                    place += 1
                    if len(held) == RUN_ROWS:
                        yield _batch(held, full)
                        held = []
                if held:
                    yield _batch(held, full)

    full = pa.schema([*ENTRY, ("range", pa.int64()), ("place", pa.int64())])
    return spark.range(0, len(cuts) + 1, 1, len(cuts) + 1).mapInArrow(ranged, ENTRY_DDL + ", range long, place long")


def _by(group: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(order)



def capture_histories(pages: DataFrame, base: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``pages``, read the archives back and return their index in global order (see the functions above)."""
    base = base or scratch(pages.sparkSession, "warc")
    archives = write_archives(pages, f"{base}/archives", least_bytes, archive_bytes)
    return merge_runs(index_archives(archives, f"{base}/runs"), f"{base}/runs")
