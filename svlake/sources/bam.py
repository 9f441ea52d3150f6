"""BAM files as a Spark data source: split files, region scans through an index, Arrow batches, a writer and an index builder.

A BAM file is a series of BGZF blocks, small gzip members that each say how long they are; a virtual offset is a block's place
in the file, shifted by 16 bits, and a place within its content. Three kinds of partitions come of it:

* with conditions on chrom, start0 and end0, and an index beside a file (``x.bam.bai``): its chunks that can hold such reads, merged, and
  cut at record starts that the linear index knows;
* without them: byte ranges of the file. A task finds the first block that begins in its range, then the first record that begins
  there by what every record must satisfy, and reads all records that begin before the range ends;
* files of plain gzip members can't be split and are one partition.

Conditions are applied while reading, to whole batches; records of other places are never made into rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

CIGAR_TYPE = "array<struct<op:int,len:int>>"
SCHEMA = f"chrom string, start0 long, end0 long, flag int, cigar {CIGAR_TYPE}, name string, mapq int"
OFFSETS = ", file string, at long, until long, part int"
#: Bytes of a file to a partition, and decompressed bytes that are parsed at once.
SPLIT, PARSE = 32 << 20, 1 << 20
WINDOW, META_BIN = 14, 37450
#: The first bin of each level of the index and how far a place is shifted to number the bins of a level (fixed by the format).
LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29))
ON_REFERENCE = np.array([c in (0, 2, 3, 7, 8) for c in range(16)])
#: An empty block ends a file (fixed by the format).
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":/", ":///", 1))


def bin_of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin that holds [begin, end), by the format's rule."""
    last, out = np.maximum(end, begin + 1) - 1, np.zeros(len(begin), np.int64)
    for first, shift in reversed(LEVELS):
        same = begin >> shift == last >> shift
        out[same] = first + (begin[same] >> shift)
    return out


# -- blocks ----------------------------------------------------------------------------------------------------------


def block_size(data: bytes, at: int = 0) -> int:
    """Length of the BGZF block that begins at ``at``, 0 if none does."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 18:
        return 0
    extra, i = int.from_bytes(data[at + 10 : at + 12], "little"), at + 12
    stop = i + extra
    while i + 6 <= min(stop, len(data)):
        n = int.from_bytes(data[i + 2 : i + 4], "little")
        if data[i : i + 2] == b"BC" and n == 2:
            return int.from_bytes(data[i + 4 : i + 6], "little") + 1
        i += 4 + n
    return 0


class Blocks:
    """Content of a file from a block on, with the place in the file of what has been read."""

    def __init__(self, file, at: int, chunk: int = 1 << 20):
        self.file, self.size, self.at, self.chunk = file, file.size(), at, chunk
        self.held, self.begin = b"", at
        self.data, self.starts, self.places = bytearray(), [], []  # starts: where each block begins in data, places: in the file

    def more(self) -> bool:
        """Add a block to ``data``; False at the end of the file."""
        if self.at >= self.size:
            return False
        rel = self.at - self.begin
        if rel + 65536 > len(self.held) and self.begin + len(self.held) < self.size:
            self.held, self.begin, rel = self.file.read_at(min(self.chunk, self.size - self.at), self.at), self.at, 0
        n = block_size(self.held, rel)
        if not n or rel + n > len(self.held):
            raise ValueError(f"no whole BGZF block at byte {self.at}")
        self.starts.append(len(self.data))
        self.places.append(self.at)
        self.data += zlib.decompress(self.held[rel : rel + n], 31)
        self.at += n
        return True

    def fill(self, n: int) -> bool:
        """Whether ``data`` has ``n`` bytes, after reading as needed."""
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def offsets(self, at: np.ndarray) -> np.ndarray:
        """Virtual offsets of places in ``data``."""
        starts = np.array([*self.starts, len(self.data)])
        places = np.array([*self.places, self.at])
        i = np.searchsorted(starts, at, "right") - 1
        return places[i] << 16 | (at - starts[i])

    def drop(self, n: int) -> None:
        """Forget the first ``n`` bytes of ``data``."""
        del self.data[:n]
        keep = max(0, int(np.searchsorted(self.starts, n, "right")) - 1)
        self.starts, self.places = [s - n for s in self.starts[keep:]], self.places[keep:]


def first_block(file, lo: int, hi: int) -> int | None:
    """The first block that begins within [lo, hi); one counts if it decompresses and another or the end of the file follows."""
    size, at = file.size(), lo
    while at < min(hi, size):
        data = file.read_at(min(1 << 18, size - at), at)
        i = data.find(b"\x1f\x8b\x08\x04")
        while 0 <= i and at + i < hi:
            n = block_size(data, i)
            if n and i + n + 18 > len(data) and i:  # not all of it is here: begin the next piece with it
                break
            if n and (at + i + n == size or block_size(data, i + n)):
                try:
                    zlib.decompress(data[i : i + n], 31)
                    return at + i
                except zlib.error:
                    pass
            i = data.find(b"\x1f\x8b\x08\x04", i + 1)
        at += i if 0 < i and at + i < hi else max(1, len(data) - 17) if at + len(data) < size else len(data)
    return None


# -- header and records ----------------------------------------------------------------------------------------------


def read_header(blocks: Blocks) -> list[tuple[str, int]]:
    """(name, length) of the contigs; what was read of the header is dropped from ``blocks``."""

    def need(n: int) -> None:
        if not blocks.fill(n):
            raise ValueError("the file ends within its header")

    need(12)
    if blocks.data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + int.from_bytes(blocks.data[4:8], "little")
    need(at + 4)
    contigs, at, n = [], at + 4, int.from_bytes(blocks.data[at : at + 4], "little")
    for _ in range(n):
        need(at + 4)
        size = int.from_bytes(blocks.data[at : at + 4], "little")
        need(at + 8 + size)
        contigs.append((bytes(blocks.data[at + 4 : at + 3 + size]).decode(), int.from_bytes(blocks.data[at + 4 + size : at + 8 + size], "little")))
        at += 8 + size
    blocks.drop(at)
    return contigs


def fixed_fields(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fixed fields of the records that begin at ``at``."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(FIXED.itemsize)]).view(FIXED).ravel()


def plausible(data: np.ndarray, at: np.ndarray, contigs: int) -> np.ndarray:
    """Which places could begin a record, by its fixed fields."""
    f = fixed_fields(data, at)
    ok = (f["ref"] >= -1) & (f["ref"] < contigs) & (f["pos"] >= -1) & (f["next_ref"] >= -1) & (f["next_ref"] < contigs) & (f["next_pos"] >= -1)
    ok &= (f["l_name"] > 0) & (f["l_seq"] >= 0) & (f["size"] > 32)
    l_seq = f["l_seq"].astype(np.int64)
    return ok & (f["size"] >= 32 + f["l_name"].astype(np.int64) + 4 * f["n_ops"].astype(np.int64) + (l_seq + 1) // 2 + l_seq)


def is_record(data: bytes, at: int, contigs: int) -> int | None:
    """Length of the record at ``at`` with its size field, 0 if there is none, None if it isn't all here."""
    if at + FIXED.itemsize > len(data):
        return None
    window = np.frombuffer(bytes(data[at : at + FIXED.itemsize]), np.uint8)
    if not plausible(window, np.zeros(1, np.int64), contigs)[0]:
        return 0
    f = window.view(FIXED)[0]
    name, n_ops, l_seq = int(f["l_name"]), int(f["n_ops"]), int(f["l_seq"])
    if at + 36 + name + 4 * n_ops > len(data):
        return None
    label = data[at + 36 : at + 36 + name]
    ops = np.frombuffer(bytes(data[at + 36 + name : at + 36 + name + 4 * n_ops]), "<u4")
    query = int((ops >> 4)[np.isin(ops & 15, (0, 1, 4, 7, 8))].sum())
    if label[-1] != 0 or any(not 33 <= c <= 126 for c in label[:-1]) or (ops & 15 > 8).any() or (n_ops and l_seq and query != l_seq):
        return 0
    return 4 + int(f["size"])


def candidates(data: np.ndarray, lo: int, hi: int, contigs: int, piece: int = 1 << 12) -> Iterator[int]:
    """Places of [lo, hi) that could begin a record. Their fixed fields are gathered ``piece`` places at a time: all at once they take over 300 bytes a place."""
    for begin in range(lo, hi, piece):
        places = np.arange(begin, min(begin + piece, hi))
        yield from places[plausible(data, places, contigs)].tolist()


def resync(blocks: Blocks, contigs: int, hi: int, chain: int = 4) -> bool:
    """Drop what lies before the first record that begins in a block before ``hi``; False if there is none. A place counts if
    it and the records behind it, ``chain`` in all or up to the end of the file, are well formed."""
    ended, at = not blocks.fill(PARSE), 0
    while True:
        limit = next((s for s, p in zip(blocks.starts, blocks.places, strict=True) if p >= hi), len(blocks.data))
        data = np.frombuffer(bytes(blocks.data), np.uint8)
        short = False
        for u in candidates(data, at, min(limit, len(data) - FIXED.itemsize + 1), contigs):
            end, n = u, 1
            for _ in range(chain):
                n = is_record(blocks.data, end, contigs)
                if not n:
                    break
                end += n
                if ended and end == len(blocks.data):
                    break
            if n is None and not ended:
                short, at = True, u
                break
            if n:
                blocks.drop(u)
                return True
        if ended or (not short and limit < len(blocks.data)):
            return False
        at = at if short else max(at, len(data) - FIXED.itemsize + 1)
        ended = not blocks.fill(len(blocks.data) + PARSE)


def _gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _lists(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


@dataclass
class Wanted:
    """Conditions on reads: contigs (None: any), and comparisons of start0 and end0 with numbers."""

    chroms: set | None = None
    bounds: list[tuple[str, str, int]] = field(default_factory=list)

    def region(self) -> tuple[int, int]:
        """[begin, end) that every wanted read overlaps or touches."""
        begin = max([0, *(v - 1 for _, op, v in self.bounds if op in (">", ">="))])
        end = min([1 << 29, *(v + 1 for _, op, v in self.bounds if op in ("<", "<="))])
        return min(begin, max(0, end - 1)), end  # reads that begin before a place and end behind a later one hold all between

    def mask(self, columns: dict[str, np.ndarray], known: np.ndarray) -> np.ndarray:
        ok = known[columns["ref"]]
        for name, op, v in self.bounds:
            x = columns[name]
            ok = ok & {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[op]
        return ok


def batches(blocks: Blocks, contigs: list[tuple[str, int]], until: int, wanted: Wanted, extra: tuple[str, int] | None = None) -> Iterator[pa.RecordBatch]:
    """Records from the beginning of ``blocks.data`` up to the virtual offset ``until``."""
    names = pa.array([c for c, _ in contigs] + ["*"], pa.string())
    known = np.array([wanted.chroms is None or c in wanted.chroms for c in names.to_pylist()], bool)
    ended = False
    while not ended:
        ended = not blocks.fill(PARSE)
        held, at, n = blocks.data, [], 0
        while n + 4 <= len(held):
            size = int.from_bytes(held[n : n + 4], "little") + 4
            if n + size > len(held):
                break
            at.append(n)
            n += size
        if not at:
            if ended and len(held):
                raise ValueError("the file ends within a record")
            had = len(held)
            if not ended and not blocks.fill(had + PARSE) and len(blocks.data) == had:
                raise ValueError("the file ends within a record")
            continue
        at, data = np.array(at), np.frombuffer(bytes(held[:n]), np.uint8)
        voffset = blocks.offsets(np.append(at, n))
        inside = voffset[:-1] < until
        f = fixed_fields(data, at[inside])
        here, size = at[inside], f["l_name"].astype(np.int64)
        n_ops = f["n_ops"].astype(np.int64)
        ops = _gather(data, here + 36 + size, 4 * n_ops).view("<u4")
        lengths = (ops >> 4).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(np.where(ON_REFERENCE[ops & 15], lengths, 0))])
        last = np.cumsum(n_ops)
        start = f["pos"].astype(np.int64)
        end = start + before[last] - before[last - n_ops]
        keep = wanted.mask({"ref": f["ref"], "start0": start, "end0": end}, known)
        text = _gather(data, here + 36, size - 1)
        cigar = pa.ListArray.from_arrays(_lists(n_ops), pa.StructArray.from_arrays([pa.array((ops & 15).astype(np.int32)), pa.array(lengths.astype(np.int32))], ["op", "len"]))
        label = pa.Array.from_buffers(pa.string(), len(size), [None, _lists(size - 1).buffers()[1], pa.py_buffer(text.tobytes())])
        made = {"chrom": names.take(pa.array(np.where(f["ref"] < 0, len(contigs), f["ref"]))), "start0": pa.array(start), "end0": pa.array(end), "flag": pa.array(f["flag"].astype(np.int32)), "cigar": cigar, "name": label, "mapq": pa.array(f["mapq"].astype(np.int32))}
        if extra:
            made |= {"file": pa.array([extra[0]] * len(here), pa.string()), "at": pa.array(voffset[:-1][inside]), "until": pa.array(voffset[1:][inside]), "part": pa.array(np.full(len(here), extra[1], np.int32))}
        if keep.any():
            yield pa.RecordBatch.from_pydict(made).filter(pa.array(keep))
        if not inside.all():
            return
        blocks.drop(n)
    if len(blocks.data):
        raise ValueError("the file ends within a record")


# -- index -----------------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """A file's index: for each contig its bins' chunks of virtual offsets, its linear index, and (mapped, unmapped) if known."""

    chunks: list[dict[int, list[tuple[int, int]]]]
    linear: list[np.ndarray]
    counts: list[tuple[int, int] | None]

    @classmethod
    def parse(cls, data: bytes) -> Index:
        if data[:4] != b"BAI\1":
            raise ValueError("not an index")
        at, out = 8, cls([], [], [])
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            bins, counts = {}, None
            (n,), at = struct.unpack_from("<i", data, at), at + 4
            for _ in range(n):
                number, m = struct.unpack_from("<Ii", data, at)
                pairs = struct.unpack_from(f"<{2 * m}Q", data, at + 8)
                at += 8 + 16 * m
                if number == META_BIN:
                    counts = pairs[2:4]
                else:
                    bins[number] = list(zip(pairs[::2], pairs[1::2], strict=True))
            (n,), at = struct.unpack_from("<i", data, at), at + 4
            out.chunks.append(bins)
            out.linear.append(np.frombuffer(data, "<u8", n, at).astype(np.int64))
            out.counts.append(counts)
            at += 8 * n
        return out

    def packed(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.chunks))]
        for bins, linear, counts in zip(self.chunks, self.linear, self.counts, strict=True):
            rows = {**bins, **({META_BIN: [(0, 0), counts]} if counts else {})}
            out.append(struct.pack("<i", len(rows)))
            for number, pairs in sorted(rows.items()):
                out.append(struct.pack("<Ii", number, len(pairs)) + b"".join(struct.pack("<QQ", *p) for p in pairs))
            out.append(struct.pack("<i", len(linear)) + linear.astype("<u8").tobytes())
        return b"".join(out)

    def ranges(self, ref: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Virtual offset ranges that hold every read of a contig overlapping [begin, end), in order, disjoint."""
        begin, end = max(0, begin), min(end, 1 << 29)
        if ref >= len(self.chunks) or begin >= end:
            return []
        linear = self.linear[ref]
        least = int(linear[min(begin >> WINDOW, len(linear) - 1)]) if len(linear) else 0
        found = sorted((max(b, least), e) for first, shift in LEVELS for k in range(first + (begin >> shift), first + (end - 1 >> shift) + 1) for b, e in self.chunks[ref].get(k, ()) if e > least)
        return merged(found)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(ranges):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        elif b < e:
            out.append((b, e))
    return out


def read_index(uri: str) -> Index | None:
    fs, path = open_uri(uri)
    for name in (f"{path}.bai", path.removesuffix(".bam") + ".bai"):
        if fs.get_file_info(name).type == pafs.FileType.File:
            with fs.open_input_stream(name) as s:
                return Index.parse(s.read())
    return None


# -- the data source -------------------------------------------------------------------------------------------------


@dataclass
class Part(ds.InputPartition):
    """Records that begin in [begin, until) of virtual offsets; ``whole``: begin is a record's; ``plain``: the file has no BGZF blocks."""

    uri: str
    begin: int
    until: int
    whole: bool
    plain: bool = False
    number: int = 0


def files_of(path: str) -> list[tuple[str, int]]:
    """(uri, size) of a file or of a folder's ``.bam`` files."""
    fs, inner = open_uri(path)
    info = fs.get_file_info(inner)
    found = [info] if info.type == pafs.FileType.File else [i for i in fs.get_file_info(pafs.FileSelector(inner)) if i.path.endswith(".bam")]
    at = path.find(inner) if "://" in path else -1
    return [((path[:at] if at > 0 else "") + i.path, i.size) for i in sorted(found, key=lambda i: i.path)]


class PlainBlocks(Blocks):
    """Content of a file of ordinary gzip members, read from its beginning; its offsets say nothing about places in the file."""

    def more(self) -> bool:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not self.held:
                self.held = self.file.read_at(min(self.chunk, self.size - self.begin), self.begin)
                self.begin += len(self.held)
                if not self.held:
                    if parts:
                        raise ValueError("a gzip member is cut short")
                    return False
            parts.append(unpack.decompress(self.held))
            self.held = unpack.unused_data
        self.data += b"".join(parts)
        return True

    def offsets(self, at: np.ndarray) -> np.ndarray:
        return np.zeros(len(at), np.int64)

    def drop(self, n: int) -> None:
        del self.data[:n]


class BamReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.offsets = str(options.get("offsets", "false")).lower() == "true"
        self.wanted = Wanted()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        signs = {ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
        for f in filters:
            if isinstance(f, (ds.EqualTo, ds.In)) and f.attribute == ("chrom",):
                values = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                self.wanted.chroms = values if self.wanted.chroms is None else self.wanted.chroms & values
            elif type(f) in signs and f.attribute in (("start0",), ("end0",)):
                self.wanted.bounds.append((f.attribute[0], signs[type(f)], f.value))
            elif not (isinstance(f, ds.IsNotNull) and f.attribute in (("chrom",), ("start0",), ("end0",))):  # these are never null
                yield f

    def partitions(self) -> list[Part]:
        parts: list[Part] = []
        for uri, size in files_of(self.path):
            fs, path = open_uri(uri)
            with fs.open_input_file(path) as file:
                if not block_size(file.read_at(min(size, 65536), 0)):
                    parts.append(Part(uri, 0, 1 << 62, True, True))
                    continue
                index = read_index(uri) if self.wanted.chroms is not None and "*" not in self.wanted.chroms and not self.offsets else None
                if index is None:
                    parts += [Part(uri, lo << 16, min(lo + self.split, size) << 16, False) for lo in range(0, size, self.split)]
                    continue
                contigs = [c for c, _ in read_header(Blocks(file, 0))]
            begin, end = self.wanted.region()
            for ref in (i for i, c in enumerate(contigs) if c in self.wanted.chroms):
                marks = np.unique(index.linear[ref]) if ref < len(index.linear) else np.empty(0, np.int64)
                for b, e in index.ranges(ref, begin, end):
                    while (e >> 16) - (b >> 16) > self.split:  # cut where a record is known to begin
                        i = int(np.searchsorted(marks, (b >> 16) + self.split << 16))
                        if i == len(marks) or marks[i] >= e:
                            break
                        parts.append(Part(uri, b, int(marks[i]), True))
                        b = int(marks[i])
                    parts.append(Part(uri, b, e, True))
        for k, p in enumerate(parts):
            p.number = k
        return parts

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark hands over if there are no partitions
            return
        fs, path = open_uri(part.uri)
        extra = (part.uri, part.number) if self.offsets else None
        with fs.open_input_file(path) as file:
            blocks = PlainBlocks(file, 0) if part.plain else Blocks(file, 0)
            contigs = read_header(blocks)
            if not part.plain and part.begin:
                at = part.begin >> 16 if part.whole else first_block(file, part.begin >> 16, part.until >> 16)
                if at is None:
                    return
                blocks = Blocks(file, at)
                if not part.whole:
                    if not resync(blocks, len(contigs), part.until >> 16):
                        return
                else:
                    blocks.fill(part.begin & 0xFFFF)
                    blocks.drop(part.begin & 0xFFFF)
            yield from batches(blocks, contigs, part.until, self.wanted, extra)


class BamSource(ds.DataSource):
    """``spark.dataSource.register(BamSource)``, then ``spark.read.format("bam").load(uri)``: reads of a BAM file or a folder of them.
    Options: ``split``, bytes to a partition; ``offsets``, true for the columns file, at, until (virtual offsets) and part. Needs
    spark.sql.python.filterPushdown.enabled; read_bam does all of it."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA + (OFFSETS if str(self.options.get("offsets", "false")).lower() == "true" else "")

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reads of a BAM file, or of a folder's BAM files. Conditions on chrom (=, in) and comparisons of start0 and end0 with numbers are applied
    while reading; with an index beside a file, only chunks that can hold such reads are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").options(**options).load(path)


def region(reads: DataFrame, chrom: str, begin: int, end: int) -> DataFrame:
    """Reads of a contig that overlap [begin, end)."""
    return reads.where((F.col("chrom") == chrom) & (F.col("start0") < end) & (F.col("end0") > begin))


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, len) of the headers of a BAM file or of a folder's BAM files, each contig once."""

    def heads(parts):
        for part in parts:
            for uri in part.column(0).to_pylist():
                fs, inner = open_uri(uri)
                with fs.open_input_file(inner) as file:
                    plain = not block_size(file.read_at(min(file.size(), 65536), 0))
                    rows = read_header(PlainBlocks(file, 0) if plain else Blocks(file, 0))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["chrom", "len"])

    found = files_of(path)
    uris = spark.createDataFrame([(u,) for u, _ in found], "uri string").repartition(max(1, min(len(found), 1000)), "uri")
    return uris.mapInArrow(heads, "chrom string, len long").distinct()


def index_stats(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, mapped, unmapped) of every contig with mapped reads, summed over files, from the indexes alone: no read is read. A file without
    index, or whose index has no counts, is an error."""

    def stats(parts):
        for part in parts:
            for uri in part.column(0).to_pylist():
                index, (fs, inner) = read_index(uri), open_uri(uri)
                if index is None or any(b and c is None for b, c in zip(index.chunks, index.counts, strict=True)):
                    raise ValueError(f"{uri}: no index with counts")
                with fs.open_input_file(inner) as file:
                    names = [c for c, _ in read_header(Blocks(file, 0))]
                rows = [(n, *map(int, c)) for n, c in zip(names, index.counts, strict=False) if c]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["chrom", "mapped", "unmapped"])

    uris = spark.createDataFrame([(u,) for u, _ in files_of(path)], "uri string").repartition(max(1, min(len(files_of(path)), 1000)), "uri")
    found = uris.mapInArrow(stats, "chrom string, mapped long, unmapped long")
    return found.groupBy("chrom").agg(F.sum("mapped").alias("mapped"), F.sum("unmapped").alias("unmapped")).where("mapped > 0")


def build_indexes(spark: SparkSession, path: str, split: int = SPLIT) -> None:
    """Write an index beside every file of ``path`` that is sorted by contig and place. Files are read in splits; chunks of a bin are
    gathered for each megabyte of a file, windows of 16384 bases get the first record that overlaps them. An index, a few numbers
    for each window of a contig, is put together by one task a file."""
    rows = read_bam(spark, path, offsets="true", split=split).where("chrom <> '*'")

    def numbered(parts):
        for b in parts:
            start = b.column("start0").to_numpy()
            end = np.maximum(b.column("end0").to_numpy(), start + 1)
            mapped = b.column("flag").to_numpy() & 4 == 0
            windows = (end - 1 >> WINDOW) - (start >> WINDOW) + 1
            row = np.repeat(np.arange(b.num_rows), windows)
            window = np.repeat(start >> WINDOW, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            index, at = pa.array(row), b.column("at")
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([b.column("file"), b.column("file").take(index)]), pa.concat_arrays([b.column("chrom"), b.column("chrom").take(index)]), pa.array(np.concatenate([np.zeros(len(start), np.int32), np.ones(len(row), np.int32)])),
                 pa.array(np.concatenate([bin_of(start, end), window])), pa.array(np.concatenate([at.to_numpy() >> 36, np.zeros(len(row), np.int64)])), pa.concat_arrays([at, at.take(index)]), pa.concat_arrays([b.column("until"), b.column("until").take(index)]),
                 pa.array(np.concatenate([mapped, np.zeros(len(row), bool)]).astype(np.int64)), pa.array(np.concatenate([~mapped, np.zeros(len(row), bool)]).astype(np.int64))],
                ["file", "chrom", "kind", "number", "stretch", "at", "until", "mapped", "unmapped"],
            )

    kinds = "file string, chrom string, kind int, number long, stretch long, at long, until long, mapped long, unmapped long"
    cells = rows.select("file", "chrom", "start0", "end0", "flag", "at", "until").mapInArrow(numbered, kinds)
    cells = cells.groupBy("file", "chrom", "kind", "number", "stretch").agg(F.min("at").alias("at"), F.max("until").alias("until"), F.sum("mapped").alias("mapped"), F.sum("unmapped").alias("unmapped"))

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        uri = key[0].as_py()
        fs, inner = open_uri(uri)
        with fs.open_input_file(inner) as file:
            names = {c: i for i, (c, _) in enumerate(read_header(Blocks(file, 0)))}
        index = Index([{} for _ in names], [np.empty(0, np.int64) for _ in names], [None for _ in names])
        for chrom in table.column("chrom").unique().to_pylist():
            of = table.filter(pc.equal(table.column("chrom"), chrom))
            kind, number, at, until = (of.column(c).to_numpy() for c in ("kind", "number", "at", "until"))
            ref, bins = names[chrom], {}
            for n, b, e in zip(number[kind == 0].tolist(), at[kind == 0].tolist(), until[kind == 0].tolist(), strict=True):
                bins.setdefault(n, []).append((b, e))
            index.chunks[ref] = {n: merged(pairs) for n, pairs in bins.items()}
            linear = np.zeros(int(number[kind == 1].max()) + 1, np.int64)
            linear[number[kind == 1]] = at[kind == 1]
            index.linear[ref] = np.where(linear == 0, np.minimum.accumulate(np.where(linear == 0, np.iinfo(np.int64).max, linear)[::-1])[::-1], linear)  # an empty window points to the next one's
            index.counts[ref] = (int(pc.sum(of.column("mapped")).as_py()), int(pc.sum(of.column("unmapped")).as_py()))
        part = f"{inner}.{uuid4().hex}.part"
        with fs.open_output_stream(part, compression=None) as out:
            out.write(index.packed())
        fs.move(part, f"{inner}.bai")
        return pa.table({"file": [uri]})

    cells.groupBy("file").applyInArrow(write, "file string").count()


# -- writing ---------------------------------------------------------------------------------------------------------


def record_bytes(batch: pa.RecordBatch, refs: dict[str, int]) -> bytes:
    """The records of a batch (chrom, start0, flag, cigar, name, mapq) without sequences."""
    ref = np.array([refs.get(c, -1) for c in batch.column("chrom").to_pylist()], np.int32)
    start = batch.column("start0").to_numpy()
    cigar, name = batch.column("cigar"), batch.column("name")
    flat, at = cigar.flatten(), np.asarray(cigar.offsets, np.int64)
    op, length = flat.field("op").to_numpy(zero_copy_only=False), flat.field("len").to_numpy(zero_copy_only=False).astype(np.int64)
    n_ops, at = np.diff(at), at - at[0]
    before = np.concatenate([[0], np.cumsum(np.where(ON_REFERENCE[op], length, 0))])
    end = start + before[at[1:]] - before[at[:-1]]
    text = b"".join(x.encode() + b"\0" for x in name.to_pylist())
    l_name = pc.binary_length(name).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    size = FIXED.itemsize + l_name + 4 * n_ops
    f = np.zeros(len(ref), FIXED)
    f["size"], f["ref"], f["pos"], f["l_name"], f["n_ops"] = size - 4, ref, start, l_name, n_ops
    f["mapq"], f["flag"], f["bin"] = batch.column("mapq").to_numpy(), batch.column("flag").to_numpy(), np.where(ref < 0, 4680, bin_of(np.maximum(start, 0), np.maximum(end, 1)))
    f["next_ref"], f["next_pos"] = -1, -1
    out, begin = np.zeros(int(size.sum()), np.uint8), np.cumsum(size) - size
    out[begin[:, None] + np.arange(FIXED.itemsize)] = f.view(np.uint8).reshape(len(ref), FIXED.itemsize)

    def put(where: np.ndarray, sizes: np.ndarray, content: np.ndarray) -> None:
        out[np.repeat(where - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = content

    put(begin + FIXED.itemsize, l_name, np.frombuffer(text, np.uint8))
    put(begin + FIXED.itemsize + l_name, 4 * n_ops, (length << 4 | op).astype("<u4").view(np.uint8))
    return out.tobytes()


def block(content: bytes) -> bytes:
    """A BGZF block of at most 65280 bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    return struct.pack("<4sIBBHccHH", b"\x1f\x8b\x08\x04", 0, 0, 255, 6, b"B", b"C", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


def header_bytes(contigs: list[tuple[str, int]]) -> bytes:
    text = ("@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)).encode()
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs)


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]], files: int | None = None) -> None:
    """Write reads (chrom, start0, cigar, and flag, name, mapq if there) as sorted BAM files below the URI ``path``, each holding
    a range of contigs and places. Reads of other contigs than ``contigs``, or without chrom, count as unplaced and come last. A file
    gets its name when it is complete."""
    missing = {"flag": F.lit(0), "name": F.lit("*"), "mapq": F.lit(255)}
    kinds = {"flag": "int", "name": "string", "mapq": "int"}
    refs = {c: i for i, (c, _) in enumerate(contigs)}
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in refs.items() for x in kv])[F.col("chrom")], F.lit(len(refs)))
    rows = reads.select(F.coalesce("chrom", F.lit("*")).alias("chrom"), F.coalesce("start0", F.lit(-1)).cast("long").alias("start0"), F.col("cigar").cast(CIGAR_TYPE).alias("cigar"), *[F.coalesce(F.col(c) if c in reads.columns else d, d).cast(kinds[c]).alias(c) for c, d in missing.items()])
    n = files or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("ref", order).repartitionByRange(n, "ref", "start0").sortWithinPartitions("ref", "start0", "name").drop("ref")

    def run(parts):
        from pyspark import TaskContext

        fs, folder = open_uri(path)
        held, target = bytearray(header_bytes(contigs)), f"{folder}/part-{TaskContext.get().partitionId():05d}.bam"
        part, n = f"{target}.{uuid4().hex}.part", 0
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(part, compression=None) as out:
            for b in parts:
                held += record_bytes(b, refs)
                n += b.num_rows
                while len(held) > 65280:
                    out.write(block(bytes(held[:65280])))
                    del held[:65280]
            if held:
                out.write(block(bytes(held)))
            out.write(END_BLOCK)
        if n:
            fs.move(part, target)
        else:
            fs.delete_file(part)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
