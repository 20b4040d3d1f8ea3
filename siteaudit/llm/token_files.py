"""Token ids in seekable files of independent zstandard frames.

File format (public zstd seekable format): zstandard frames of little-endian
unsigned 32-bit ids, each frame holding whole documents; skippable frames with the
document index (doc_id, frame, number of ids), `INDEX_DOCS` documents each; and the
seek table, a skippable frame with each frame's compressed size, raw size and checksum
(low 32 bits of XXH64 of the raw bytes), ended by the number of frames, a flag byte and
the magic number. Any zstandard tool can decompress the file; a reader of single
documents reads the tail and the index, then only the frames that hold them.

Writing: one range shuffle by doc_id, one sort inside partitions, one file for each
partition, in the shared folder; there are as many as makes a file about `FILE_BYTES`
of text, but not fewer than shuffle partitions. A file's name holds the number of the
attempt that wrote it, and the table of files, which Spark commits, names those of the
attempts that count; so retried or doubled tasks do no harm on any file system. Writer
and reader hold one frame and one part of the index. Reading back checks every checksum.
Global offsets are prefix sums over the files (one row each) and over the documents of a
file as they stream by.

Encoding goes through a bounded cache of white-space separated pieces where the
tokenizer's normaliser and splitter are those of `_BY_PIECES`, which never look across
white space (checked against whole-text encoding in the tests): pieces repeat far more
than texts do. Pieces are told apart by 64-bit hashes. Texts for any other tokenizer
file are encoded whole.

Nulls and empty texts have no ids but the end id. A null doc_id is stored with a
flag and comes first. Rows of one doc_id are ordered by the hash of their text. A very
long text is encoded whole and is a frame of its own; one of over 4 GB of ids, which no
Spark string gives, is refused before anything of it is written. Extra columns are
ignored. An empty table makes empty files and an empty result.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import new_folder

END_ID = 2
#: Raw bytes after which a frame is closed; a longer document is a frame of its own.
FRAME_BYTES = 1 << 20
#: Documents that one part of the index holds, and the bytes of text that a file is made for, about.
INDEX_DOCS, FILE_BYTES = 1 << 18, 1 << 28
#: Pieces that a worker's cache may hold, and the longest ids that are kept.
CACHE_PIECES, CACHE_BYTES = 700_000, 256
#: Bytes of text that are split and looked up at once.
PIECE_BYTES = 1 << 21
LEVEL = 3

SEEK_MAGIC, TABLE_MAGIC, INDEX_MAGIC = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("n", "<u8")])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The normaliser and splitter (parts of a tokenizer file) that work on each white-space separated piece alone,
# fold A-Z, and set off a comma or full stop after a letter.
_BY_PIECES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Encoder:
    """Ids of texts by a tokenizer file, through a cache of pieces.

    Pieces are runs without ASCII white space, known by the 64-bit hash of their bytes with A-Z folded, as the
    normaliser folds them. A comma or full stop after an ASCII letter is a token of its own and is split off.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        splitter = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        self.by_pieces = (parts.get("normalizer"), splitter[0]) == _BY_PIECES
        #: Names of special tokens aren't folded and mean one id.
        self.special = [t["content"].encode() for t in parts.get("added_tokens") or []]
        self.cache: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}
        self.tails = [self._whole(x) for x in ",."]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, encoded together as one text, split where the pieces end."""
        out: list[bytes] = []
        for lo in range(0, len(pieces), 150):
            part = pieces[lo : lo + 150]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begin = np.array([a for a, _ in got.offsets], np.int64)
            size = np.array([len(p) + 1 for p in part])
            if (np.diff(begin) < 0).any():  # an offset that runs back: one by one
                out += [self._whole(p) for p in part]
                continue
            edge = np.searchsorted(begin, np.concatenate((np.cumsum(size) - size, [size.sum()]))).tolist()
            raw = np.array(got.ids, "<u4").tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(edge[:-1], edge[1:])]
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers; nulls are empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_utf8())
        return [ids for block in tb.blocks(column, PIECE_BYTES) for ids in self._block(block)]

    def _block(self, block: tb.Block) -> list[bytes]:
        raw = block.raw.tobytes()
        if not self.by_pieces or any(t in raw for t in self.special):
            return [self._whole(block.text(r)) for r in range(block.hi - block.lo)]
        w = tb.words(block, tb.NONSPACE)
        if not len(w.starts):
            return [b""] * (block.hi - block.lo)
        last, before = block.raw[w.ends - 1], block.raw[np.maximum(w.ends - 2, 0)]
        tail = ((last == 44) | (last == 46)) & (w.ends - w.starts > 1) & _ASCII_LETTER[before]
        ends = w.ends - tail
        hashes = w.part_hashes(w.starts, ends)
        known, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        names = known.tolist()
        ids = list(map(self.cache.get, names))
        unknown = [i for i, b in enumerate(ids) if b is None]
        if unknown:
            learn = []
            for i in unknown:
                ids[i] = self.old.get(names[i])
                if ids[i] is None:
                    learn.append(i)
            where = at[learn]
            pieces = [raw[s:e].decode("utf-8", "replace") for s, e in zip(w.starts[where].tolist(), ends[where].tolist())]
            for i, b in zip(learn, self._learn(pieces)):
                ids[i] = b
            self.cache.update((names[i], ids[i]) for i in unknown if len(ids[i]) <= CACHE_BYTES)
            if len(self.cache) > CACHE_PIECES // 2:
                self.cache, self.old = {}, self.cache
        # The texts as units: pieces and split-off tails; then a ragged gather of all units' ids.
        flat = np.frombuffer(b"".join([*ids, *self.tails]), "<u4")
        size = np.array([len(b) // 4 for b in (*ids, *self.tails)])
        start = np.cumsum(size) - size
        place = np.arange(len(tail)) + np.cumsum(tail) - tail
        units = np.empty(len(tail) + int(tail.sum()), np.int64)
        units[place] = inverse
        units[place[tail] + 1] = len(ids) + (last[tail] == 46)
        n = size[units]
        upto = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(start[units] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        edge = (4 * upto[np.append(place, len(units))[w.first]]).tolist()
        return [out[a:b] for a, b in zip(edge[:-1], edge[1:])]


#: Encoders of this worker process by vocabulary file; tasks that follow find the cache warm.
_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path there."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes documents' ids to an open stream as independent frames."""

    def __init__(self, out: Any, index_docs: int = INDEX_DOCS) -> None:
        self.out, self.frames, self.index_docs = out, [], index_docs
        self.rows: list[tuple[int, bool, int, int]] = []
        self.index: list[bytes] = []
        self.held: list[bytes] = []
        self.size = 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if len(ids) >= 2**32:
            raise ValueError("a document of over 4 GB of ids doesn't fit a frame")
        if self.size and self.size + len(ids) > FRAME_BYTES:
            self._close_frame()
        self.rows.append((doc_id or 0, doc_id is None, len(self.frames), len(ids) // 4))
        if len(self.rows) == self.index_docs:
            self._close_index()
        self.held.append(ids)
        self.size += len(ids)

    def _close_frame(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def _close_index(self) -> None:
        """The index's rows so far as one compressed part; a few bytes for each document stay in memory until the end."""
        if self.rows:
            self.index.append(self.packer.compress(np.array(self.rows, _INDEX).tobytes()))
        self.rows = []

    def finish(self) -> None:
        self._close_frame()
        self._close_index()
        for part in self.index:
            self.out.write(struct.pack("<II", INDEX_MAGIC, len(part)) + part)
        body = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source: Any) -> None:
        self.source = source
        size = source.seek(0, 2) or source.tell()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums")
        self.end = size - 9 - 12 * n - 8
        source.seek(self.end)
        head = source.read(8 + 12 * n)
        if struct.unpack("<II", head[:8]) != (TABLE_MAGIC, 12 * n + 9):
            raise ValueError("broken seek table")
        self.frames = np.frombuffer(head[8:], "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        self.opened = 0

    def index(self) -> Iterator[np.ndarray]:
        """The document index, part by part."""
        at = int(self.starts[-1])
        while at < self.end:
            self.source.seek(at)
            magic, length = struct.unpack("<II", self.source.read(8))
            if magic != INDEX_MAGIC or at + 8 + length > self.end:
                raise ValueError("broken document index")
            yield np.frombuffer(zstandard.ZstdDecompressor().decompress(self.source.read(length)), _INDEX)
            at += 8 + length

    def frame(self, i: int) -> bytes:
        """The raw bytes of a frame, checked."""
        self.source.seek(int(self.starts[i]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.frames[i, 0])), max_output_size=int(self.frames[i, 1]))
        if len(raw) != self.frames[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[i, 2]:
            raise ValueError(f"checksum of frame {i} is wrong")
        self.opened += 1
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of all documents, or of those wanted: then only their frames are decompressed."""
        held, raw, place = -1, b"", 0
        for part in self.index():
            take = np.ones(len(part), bool) if wanted is None else np.isin(part["doc_id"], list(wanted)) & (part["null"] == 0)
            sizes = 4 * part["n"].astype(np.int64)
            for i, (frame, size, here) in enumerate(zip(part["frame"].tolist(), sizes.tolist(), take.tolist())):
                if frame != held:
                    held, raw, place = frame, b"", 0
                if here:
                    raw = raw or self.frame(frame)
                    yield (None if part["null"][i] else int(part["doc_id"][i])), raw[place : place + size]
                place += size

    def read(self, doc_ids: list[int]) -> list[tuple[int, np.ndarray]]:
        """Ids of the wanted documents."""
        return [(d, np.frombuffer(b, "<u4")) for d, b in self.documents(set(doc_ids))]


def write_tokens(docs: DataFrame, folder: str, *, vocabulary_path: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files and returns (part, file, n_docs, n_ids), a row for each, in order of part."""
    path = vocabulary_path or vocabulary()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    rows = docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("tie")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{task.taskAttemptId()}.zst"
        encoder, end = encoder_for(path), struct.pack("<I", end_id)
        n_docs = n_ids = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:  # by the name it would be packed twice
            writer = FrameWriter(out)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for lo in range(0, batch.num_rows, 2048):
                    for doc_id, b in zip(ids[lo : lo + 2048], encoder.encode(texts[lo : lo + 2048])):
                        writer.add(doc_id, b + end)
                        n_docs += 1
                        n_ids += len(b) // 4 + 1
            writer.finish()
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    # The rows are kept as a small table beside the files: writing happens once.
    files = f"{folder}/files"
    rows.mapInArrow(run, "part long, file string, n_docs long, n_ids long").write.mode("overwrite").parquet(files)
    return docs.sparkSession.read.parquet(files).orderBy("part")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files."""
    spark = files.sparkSession
    before, listed = 0, []
    for r in files.orderBy("part").toLocalIterator():
        if r["n_docs"]:
            listed.append((r["file"], before))
        before += r["n_ids"]
    table = spark.createDataFrame(listed, "file string, start long").repartition(max(1, len(listed)), "file") if listed else spark.createDataFrame([], "file string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as source:
                    out: list[tuple[int | None, int, int, int]] = []
                    for doc_id, ids in FrameReader(source).documents():
                        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(out) == 20_000:
                            yield _batch(out)
                            out = []
                    yield _batch(out)

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame) -> DataFrame:
    """The digest of op8: the files are written to the shared folder and read back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder), folder)


def read_documents(folder: str, file: str, doc_ids: list[int]) -> list[tuple[int, np.ndarray]]:
    """Ids of some documents of one file, decompressing only their frames."""
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/{file}") as source:
        return FrameReader(source).read(doc_ids)
