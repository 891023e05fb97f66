"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, a skippable frame with the index of its documents,
and a skippable seek table (format: zstandard seekable, with checksums). Each frame holds the
little-endian unsigned 32-bit ids of whole documents, so a reader decompresses only the frames that
hold the documents it asks for, and verifies the xxhash of what it decompressed.

Layout of the index (little endian): uint32 number of documents, uint32 zero, then for each document
int64 doc_id, uint32 frame, uint32 null flag, uint64 first id within the frame, uint64 ids. Frames are
cut at `FRAME` ids; a longer document has a frame of its own.

Defined cases: a null or empty text is a document of the end id alone; repeated doc_ids stand one
after the other, each with its own row; a null doc_id comes first; further columns are not written;
an empty table writes no file and reads back as no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmata.llm import _graph
from lemmata.llm._bytes import RELEASE, release
from lemmata.llm.tokenize import tokenizer

FRAME = 1 << 18
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX_MAGIC = 0x184D2A50
ENTRY = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("null", "<u4"), ("first", "<u8"), ("n", "<u8")])
#: bytes of text in one file, about
FILE_BYTES = 64 << 20


def filesystem(path: str):
    """A pyarrow file system and the path on it: local folders, hdfs://, s3:// and others by URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


class Writer:
    """Writes documents to one stream; `close` adds the index and the seek table."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.make = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.size, self.frames, self.entries = 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.size and self.size + len(ids) > FRAME:
            self._flush()
        self.entries.append((doc_id or 0, len(self.frames), doc_id is None, self.size, len(ids)))
        self.held.append(ids)
        self.size += len(ids)

    def _flush(self) -> None:
        import xxhash

        if self.held:
            raw = np.concatenate(self.held).astype("<u4").tobytes()
            packed = self.make.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        import xxhash

        self._flush()
        index = struct.pack("<II", len(self.entries), 0) + np.array(self.entries, ENTRY).tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = [*self.frames, (len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IBI", len(table), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class Reader:
    """Random access to one file: `index` lists its documents, `read` returns the ids of some."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.table = table
        source.seek(int(self.start[n - 1]))
        head = source.read(int(table[n - 1, 0]))
        if struct.unpack("<I", head[:4])[0] != INDEX_MAGIC:
            raise ValueError("the last frame is not the index of documents")
        (count,) = struct.unpack("<I", head[8:12])
        self.index = np.frombuffer(head[16:], ENTRY, count)

    def frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        self.source.seek(int(self.start[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def read(self, doc_ids) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of the documents asked for; only their frames are decompressed."""
        want = self.index[np.isin(self.index["doc_id"], np.asarray(list(doc_ids), np.int64)) & (self.index["null"] == 0)]
        now, ids = -1, None
        for e in want:
            if e["frame"] != now:
                now, ids = int(e["frame"]), self.frame(int(e["frame"]))
            yield int(e["doc_id"]), ids[int(e["first"]) : int(e["first"] + e["n"])]


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    writer = out = None
    total = docs = 0
    name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zst"
    encoder, part = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        if writer is None:
            encoder = tokenizer(path)
            fs, where = filesystem(name)
            fs.create_dir(where.rpartition("/")[0], recursive=True)
            out = fs.open_output_stream(where, compression=None)
            writer, part = Writer(out), b.column("part")[0].as_py()
        who = b.column("doc_id").to_pylist()
        for w, ids, first in encoder.documents(b.column("text")):
            for d in range(w.hi - w.lo):
                one = np.append(ids[first[d] : first[d + 1]], np.uint32(end_id))
                writer.add(who[w.lo + d], one)
                total += len(one)
                docs += 1
    if writer is not None:
        writer.close()
        out.close()
        release(RELEASE)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "docs": pa.array([docs], pa.int64()), "tokens": pa.array([total], pa.int64())})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            fs, where = filesystem(row["path"])
            with fs.open_input_file(where) as source:
                reader = Reader(source)
                start, now, ids, out = row["start"], -1, None, []
                for e in reader.index:
                    if e["frame"] != now:
                        now, ids = int(e["frame"]), reader.frame(int(e["frame"]))
                    one = ids[int(e["first"]) : int(e["first"] + e["n"])]
                    out.append((None if e["null"] else int(e["doc_id"]), start, len(one), zlib.crc32(one.tobytes())))
                    start += len(one)
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{_graph.shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_ids(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode and write; returns the manifest (part, path, docs, tokens, start), a row for each file.

    Files are cut by ranges of doc_id, and `start` is the number of ids before a file in that order.
    A task that is run again writes a new file; the manifest names the one that counts.
    """
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(_graph.partitions(spark), -(-size // FILE_BYTES))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    written = ranged.mapInArrow(partial(_write, folder=folder, path=path, end_id=end_id), "part int, path string, docs long, tokens long")
    manifest = _graph.cut(written)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_back(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32; every checksum is verified."""
    n = _graph.partitions(manifest.sparkSession)
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, doc_ids) -> DataFrame:
    """(doc_id, ids) of the documents asked for, from the frames that hold them."""
    wanted = [int(x) for x in doc_ids]

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                fs, where = filesystem(p)
                with fs.open_input_file(where) as source:
                    got = list(Reader(source).read(wanted))
                if got:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x for x, _ in got], pa.int64()), "ids": pa.array([y.astype(np.int64) for _, y in got], pa.list_(pa.int64()))})

    return manifest.select("path").mapInArrow(run, "doc_id long, ids array<long>")
