"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a row of frames, then an index of its documents and a seek table, both in skippable frames, so that any
zstandard tool can decompress it whole. Layout (all integers little-endian):

* frames: ids of whole consecutive documents, 32 bits each, about ``FRAME_IDS`` to a frame;
* skippable frame 0x184D2A50: a zstandard frame of the document index - doc_id, frame, first id within the frame, ids
  (64-bit columns, one after another), and a bitmap byte per document that says whether doc_id is present;
* skippable frame 0x184D2A5E: for each frame and the index its compressed size, decompressed size and checksum (the low
  32 bits of XXH64 of the content), then the footer: entries (4 bytes), flags (1 byte, 0x80: checksums), 0x8F92EAB1.

A reader fetches the footer, the table and the index, then only the frames that hold the documents it was asked for.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bounded_batches, by_bytes, materialise, scratch

FRAME_IDS = 32_768
#: About so many bytes of text go through the tokenizer at once.
CALL_BYTES = 4_000_000
#: A word that can't be encoded apart: empty, or with white space at an end, except one line break before letters. Unicode's white space and the separators 1C to 1F.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BESIDE = rf"^$|^[{_SPACE}]{{2}}|^[{_SPACE.replace(r'\t-', r'\t\x0b-')}]|[{_SPACE}]$"
#: Marks that can't join the letters before them.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
END_ID = 2
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":/", ":///", 1))


class Writer:
    """Streams documents to one file; memory holds a frame and the document index. The file appears under its name only when
    it is complete, so a retried task replaces it and never leaves half of one."""

    def __init__(self, uri: str, frame_ids: int = FRAME_IDS, level: int = 3):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{xxhash.xxh3_64_hexdigest(np.random.bytes(16))}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.frame_ids, self.zip = frame_ids, zstandard.ZstdCompressor(level=level)
        self.held, self.held_ids, self.table = [], 0, []
        self.docs: list[tuple[int | None, int, int, int]] = []

    def _frame(self, content: bytes) -> bytes:
        packed = self.zip.compress(content)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        return packed

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held_ids + len(ids) // 4 > self.frame_ids:
            self.flush()
        self.docs.append((doc_id, len(self.table), self.held_ids, len(ids) // 4))
        self.held.append(ids)
        self.held_ids += len(ids) // 4

    def flush(self) -> None:
        if self.held:
            self.out.write(self._frame(b"".join(self.held)))
            self.held, self.held_ids = [], 0

    def close(self) -> None:
        self.flush()
        cols = np.array([(d[0] or 0, *d[1:]) for d in self.docs], "<i8").reshape(-1, 4)
        index = self._frame(np.ascontiguousarray(cols.T).tobytes() + bytes(d[0] is not None for d in self.docs))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        entries, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError(f"{uri}: not a token file, or cut short")
        at = size - 9 - 12 * entries
        self.table = np.frombuffer(self.file.read_at(12 * entries, at), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:-1, 0], dtype=np.int64)])
        body = self._content(entries - 1, int(self.starts[-1]) + 8)
        n = len(body) // 33
        self.doc_id, self.frame, self.first, self.length = np.frombuffer(body[: 32 * n], "<i8").reshape(4, n)
        self.named = np.frombuffer(body[32 * n :], np.uint8).astype(bool)

    def _content(self, k: int, at: int) -> bytes:
        packed, size, checksum = map(int, self.table[k])
        content = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=max(size, 1))
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not match its checksum")
        return content

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order: all, or those with the given ids; a frame is decompressed once, if needed at all."""
        at = np.arange(len(self.doc_id)) if wanted is None else np.flatnonzero(self.named & np.isin(self.doc_id, list(wanted)))
        held, content = -1, b""
        for i in at:
            if (k := int(self.frame[i])) != held:
                held, content = k, self._content(k, int(self.starts[k])) if k < len(self.table) - 1 else b""
            yield int(self.doc_id[i]) if self.named[i] else None, np.frombuffer(content, "<u4", int(self.length[i]), 4 * int(self.first[i]))

    def close(self) -> None:
        self.file.close()


class Encoder:
    """Ids of whole texts, many to a call. A byte-level pre-tokenizer never joins what stands on the two sides of a lone space
    or line break, except that a space goes with the word behind it. So a batch is cut there, each distinct word is encoded
    once with the character before it, and texts are put together from the words' ids by index. A worker keeps the ids of at
    most ``most`` words; then the half that fewer calls had is dropped. Texts with other white space beside a
    space or with the spelling of an added token, and all texts of other kinds of tokenizers, are encoded whole."""

    def __init__(self, path: str, end_id: int, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.most = end_id, most
        self.slots: dict[str | bytes, int] = {}  # a word; as bytes, marks behind letters; a word from the start of a line has the break before it
        # The words' ids lie one behind the other in ``pool``; ``at`` says where each begins, the last entry where free room begins.
        self.pool, self.at, self.unsafe = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)
        self.calls = np.zeros(1 << 12, np.int64)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        described = str(self.tokenizer.pre_tokenizer)
        self.by_words = self.tokenizer.normalizer is None and described.startswith("ByteLevel(") and "add_prefix_space=False" in described and "use_regex=True" in described
        self.by_words &= not any(" " in t.content or "\n" in t.content or t.lstrip or t.rstrip or t.single_word for t in added)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False) if self.by_words else {}
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # a byte-level token has a character for each byte

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], together: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with the space or line break before it, and how many each has."""
        spaced = [w if w[0] == "\n" else " " + w for w in words]
        lengths = np.asarray(pc.binary_length(pa.array(spaced, pa.string())))
        groups = range(0, len(spaced), together)
        found, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k, ids in zip(groups, self._whole(["".join(spaced[k : k + together]) for k in groups]), strict=True):
            ends, got = np.cumsum(lengths[k : k + together]), np.cumsum(self.sizes[ids])
            cut = np.searchsorted(got, ends)
            if cut[-1] != len(ids) - 1 or (got[cut] != ends).any():
                single = self._whole(spaced[k : k + together])
                ids, cut = np.concatenate(single), np.cumsum([len(x) for x in single]) - 1
            found.append(ids)
            counts.append(np.diff(cut, prepend=-1))
        return np.concatenate(found), np.concatenate(counts)

    def _room(self, words: int, ids: int) -> None:
        for name, n in (("pool", ids), ("at", words + 1), ("unsafe", words), ("calls", words)):
            if len(held := getattr(self, name)) < n:
                setattr(self, name, np.concatenate([held, np.zeros(max(n - len(held), len(held)), held.dtype)]))

    def _keep(self, words: list, ids: np.ndarray, counts: np.ndarray) -> None:
        n, used = len(self.slots), int(self.at[len(self.slots)])
        self._room(n + len(words), used + len(ids))
        self.pool[used : used + len(ids)] = ids
        self.at[n + 1 : n + 1 + len(words)] = used + np.cumsum(counts)
        self.slots.update(zip(words, range(n, n + len(words)), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Give words their slots; unsafe ones have no ids. Marks at the end of letters are tokens of their own: such a word is a word and marks."""
        array = pa.array(words, pa.string())
        risky = pc.match_substring_regex(array, BESIDE)
        for t in self.added:
            risky = pc.or_(risky, pc.match_substring(array, t))
        bad = [words[i] for i in np.flatnonzero(risky).tolist()]
        if bad:
            apart = set(bad)
            words = [w for w in words if w not in apart]
        stems = [w.rstrip(MARKS) for w in words]
        ended = [(w, s) for w, s in zip(words, stems, strict=True) if len(s) < len(w) and (s.isalpha() or s[:1] == "\n" and s[1:].isalpha())]
        if ended:
            apart = {w for w, _ in ended}
            words = list(dict.fromkeys([*(w for w in words if w not in apart), *(s for _, s in ended if s not in self.slots)]))
        self._keep(words, *self._words(words))
        if ended:
            tails = [w[len(s) :].encode() for w, s in ended]
            if new := [t for t in dict.fromkeys(tails) if t not in self.slots]:
                ids = self._whole([t.decode() for t in new])
                self._keep(new, np.concatenate(ids), np.array([len(x) for x in ids]))
            pairs = np.array([[self.slots[s], self.slots[t]] for (_, s), t in zip(ended, tails, strict=True)])
            size = self.at[pairs + 1] - self.at[pairs]
            self._keep([w for w, _ in ended], _gather(self.pool, self.at[pairs].ravel(), size.ravel()), size.sum(axis=1))
        if bad:
            n = len(self.slots)
            self._keep(bad, np.empty(0, np.uint32), np.zeros(len(bad), np.int64))
            self.unsafe[n : n + len(bad)] = True

    def _forget(self) -> None:
        """Keep the half of the words that most calls had, the earlier ones of equals."""
        names, n = list(self.slots), len(self.slots)
        kept = np.sort(np.argsort(-self.calls[:n], kind="stable")[: self.most // 2])
        size = self.at[kept + 1] - self.at[kept]
        self.pool, self.unsafe, self.calls = _gather(self.pool, self.at[kept], size), self.unsafe[kept], self.calls[kept] // 2
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.slots = dict(zip(map(names.__getitem__, kept.tolist()), range(len(kept)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a string array without nulls) one after another, each text's followed by the end id, and how many each has."""
        end = np.array([self.end], np.uint32)
        if not self.by_words or not len(texts):
            whole = [np.concatenate([x, end]) for x in self._whole(texts.to_pylist())]
            return np.concatenate([end[:0], *whole]), np.array([len(x) for x in whole], np.int64)
        if len(self.slots) > self.most:
            self._forget()
        cut = pc.split_pattern(pc.replace_substring_regex(texts, r"(\S)\n(\S)", "\\1 \n\\2"), " ")
        bounds = np.asarray(cut.offsets, dtype=np.int64)
        first, lengths = bounds[:-1] - bounds[0], np.diff(bounds)
        coded = cut.flatten().dictionary_encode()
        distinct, words = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        behind = np.ones(len(words), bool)
        behind[first] = False
        slot = np.fromiter(map(self.slots.get, distinct, repeat(-1)), np.int64, len(distinct))
        needed = np.zeros(len(distinct), bool)
        needed[words[behind]] = True  # a word that only begins texts has no space before it
        if len(new := np.flatnonzero(needed & (slot < 0)).tolist()):
            unknown = [distinct[i] for i in new]
            self._learn(unknown)
            slot[new] = np.fromiter(map(self.slots.__getitem__, unknown), np.int64, len(new))
        self.calls[slot[slot >= 0]] += 1
        alone = np.logical_or.reduceat(self.unsafe[slot][words] & behind, first)
        alone |= np.asarray(pc.match_substring(texts, " \n"))
        heads = [distinct[i] for i in words[first].tolist()]
        alone |= [n > 1 and (not h or h[-1].isspace()) or any(t in h for t in self.added) for h, n in zip(heads, lengths.tolist(), strict=True)]
        for i in np.flatnonzero(alone).tolist():
            heads[i] = texts[i].as_py()
        # Beginnings and the end id lie in the free room behind the words, for this call only.
        spare = [*self._whole(heads), end]
        sizes = np.array([len(x) for x in spare], np.int64)
        used = int(self.at[len(self.slots)])
        self._room(0, used + int(sizes.sum()))
        self.pool[used : used + int(sizes.sum())] = np.concatenate(spare)
        begins = used + np.cumsum(sizes) - sizes
        begin, size = self.at[slot][words], (self.at[slot + 1] - self.at[slot])[words]
        size[np.repeat(alone, lengths)] = 0
        begin[first], size[first] = begins[:-1], sizes[:-1]
        begin, size = np.insert(begin, first + lengths, begins[-1]), np.insert(size, first + lengths, 1)
        return _gather(self.pool, begin, size), np.add.reduceat(size, first + np.arange(len(first)))


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``pool`` that begin at ``begin`` and have ``size`` entries, one after another."""
    return pool[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _writer(base: str, tokenizer: str, end_id: int, frame_ids: int):
    def run(batches):
        from pyspark import TaskContext

        if (tokenizer, end_id) not in _ENCODERS:
            _ENCODERS[tokenizer, end_id] = Encoder(tokenizer, end_id)
        encoder, shard = _ENCODERS[tokenizer, end_id], TaskContext.get().partitionId()
        uri = f"{base}/shard-{shard:06d}.zst"
        writer, docs, tokens = None, 0, 0
        for batch in batches:
            for part in by_bytes(batch, "text", CALL_BYTES):
                coded, counts = encoder.encode(pc.fill_null(part.column("text"), ""))
                cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
                writer = writer or Writer(uri, frame_ids)
                for doc_id, i, j in zip(part.column("doc_id").to_pylist(), cuts, cuts[1:], strict=False):
                    writer.add(doc_id, coded[i:j].astype("<u4", copy=False).tobytes())
                docs, tokens = docs + len(counts), tokens + len(coded)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "n_docs": [docs], "n_tokens": [tokens]})

    return run


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def write_token_files(docs: DataFrame, tokenizer: str, base: str, end_id: int = END_ID, frame_ids: int = FRAME_IDS, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files below ``base`` (a URI that all executors reach), ascending by doc_id from
    file to file; rows without doc_id come first, equal ids by text. Null texts are empty and hold the end id alone. Returns
    the manifest (shard, uri, n_docs, n_tokens, first_token), which is written before it is returned; an empty table gives
    an empty manifest and no file."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    made = materialise(rows.mapInArrow(_writer(base, tokenizer, end_id, frame_ids), "shard long, uri string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return materialise(made.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def _reader(batches):
    for batch in batches:
        for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reader, rows = Reader(uri), []
            for doc_id, ids in reader.documents():
                rows.append((doc_id, first, len(ids), zlib.crc32(ids.tobytes())))
                first += len(ids)
                if len(rows) == 10_000:
                    yield _digests(rows)
                    rows = []
            reader.close()
            yield _digests(rows)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def read_digests(manifest: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 of its ids as stored."""
    spread = manifest.select("uri", "first_token").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uri")
    return spread.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, base: str | None = None) -> DataFrame:
    return read_digests(write_token_files(docs, tokenizer, base or scratch(docs.sparkSession, "tokens")))


def read_documents(spark: SparkSession, manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents named in ``wanted``; only their frames are decompressed."""
    ids = list(wanted)

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                reader = Reader(uri)
                got = list(reader.documents(ids))
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tolist() for g in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return manifest.select("uri").mapInArrow(run, "doc_id long, ids array<long>")
