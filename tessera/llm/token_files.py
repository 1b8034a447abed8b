"""Token ids as seekable files: independent zstandard frames, a seek table with per-frame checksums at the end.

A file follows the public "zstd seekable format". Its frames hold whole documents, little-endian ids of 2 or 4 bytes;
a skippable frame then lists the documents, and the seek table (also a skippable frame) closes the file. A reader
takes the last bytes, the document list and only the frames of the documents it was asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh_dir, table, text_slices, written
from tessera.llm.encode import encoder, shipped, vocabulary

#: Fixed values of the public seekable format.
SKIP_LIST, SKIP_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
FRAME_BYTES = 1 << 16
#: A file is closed, and the next one opened, after so many bytes of ids (four an id).
FILE_BYTES = 1 << 29


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it; pyarrow knows S3 by one name only."""
    return fs.FileSystem.from_uri("s3" + uri.removeprefix("s3a") if uri.startswith("s3a:") else uri)


def _check(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFile:
    """Random access to one file. read(i) gives the ids of its i-th document; `docs` has doc_id, start and length."""

    def __init__(self, uri: str):
        import zstandard

        system, path = store(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        seek = np.frombuffer(self.file.read_at(12 * frames, size - 9 - 12 * frames), "<u4").reshape(-1, 3)
        self.packed, self.raw, self.checks = (seek[:, i] for i in range(3))
        self.at = np.concatenate([[0], np.cumsum(self.packed.astype(np.int64))])
        self.unpack = zstandard.ZstdDecompressor().decompress
        listed = self.file.read_at(int(self.packed[-1]), int(self.at[-2]))[8:]
        if _check(listed) != self.checks[-1]:
            raise ValueError(f"{uri}: the document list is damaged")
        listed = self.unpack(listed[1:], max_output_size=1 << 40) if listed[1:] else b""
        self.width = 2 if not len(self.raw) or self.file.read_at(9, int(self.at[-2]))[8] == 2 else 4
        self.docs = np.frombuffer(listed, np.dtype([("doc_id", "<i8"), ("known", "?"), ("frame", "<u4"), ("start", "<i8"), ("length", "<i8")]))
        begins = np.concatenate([[0], np.cumsum(self.raw[:-1].astype(np.int64))]) // self.width
        self.within = self.docs["start"] - begins[self.docs["frame"]]
        self.frame, self.held = -1, b""

    def read(self, i: int) -> np.ndarray:
        frame = int(self.docs["frame"][i])
        if frame != self.frame:
            data = self.file.read_at(int(self.packed[frame]), int(self.at[frame]))
            raw = self.unpack(data, max_output_size=int(self.raw[frame]))
            if _check(raw) != self.checks[frame]:
                raise ValueError(f"frame {frame} is damaged")
            self.frame, self.held = frame, raw
        low = int(self.within[i])
        return np.frombuffer(self.held, f"<u{self.width}")[low : low + int(self.docs["length"][i])]

    def find(self, doc_id: int) -> Iterator[np.ndarray]:
        """The ids of each document of that doc_id; only their frames are read."""
        for i in np.flatnonzero(self.docs["known"] & (self.docs["doc_id"] == doc_id)):
            yield self.read(int(i))


def write_file(uri: str, documents: Iterable[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Writes (doc_id, ids as uint32 bytes) in the order given; returns the numbers of documents and ids."""
    import zstandard

    system, path = store(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    pack = zstandard.ZstdCompressor(level=1).compress
    seek, listed, pending, held, total, n = [], [], [], 0, 0, 0
    with system.open_output_stream(path) as out:

        def flush() -> None:
            nonlocal pending, held
            raw = b"".join(pending)
            out.write(data := pack(raw))
            seek.append((len(data), len(raw), _check(raw)))
            pending, held = [], 0

        for doc_id, ids in documents:
            if held >= FRAME_BYTES:
                flush()
            length = len(ids) // 4
            listed.append((doc_id or 0, doc_id is not None, len(seek), total, length))
            if width == 2:
                ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
            pending.append(ids)
            held += len(ids)
            total += length
            n += 1
        if pending:
            flush()
        index = np.array(listed, np.dtype([("doc_id", "<i8"), ("known", "?"), ("frame", "<u4"), ("start", "<i8"), ("length", "<i8")])).tobytes()
        index = bytes([width]) + (pack(index) if index else b"")
        out.write(struct.pack("<II", SKIP_LIST, len(index)) + index)
        seek.append((len(index) + 8, 0, _check(index)))
        body = b"".join(struct.pack("<III", *x) for x in seek) + struct.pack("<IBI", len(seek), CHECKSUMS, SEEK_MAGIC)
        out.write(struct.pack("<II", SKIP_SEEK, len(body)) + body)
    return n, total


def _files(documents: Iterator[tuple[int | None, bytes]], most: int) -> Iterator[Iterator[tuple[int | None, bytes]]]:
    """The documents in runs of about `most` bytes, 32 of them for a document's place in the list; each to be used up before the next."""
    rest = [next(documents, None)]

    def run():
        size = 0
        while (row := rest[0]) is not None and size < most:
            size += len(row[1]) + 32
            yield row
            rest[0] = next(documents, None)

    while rest[0] is not None:
        yield run()


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None, most: int = FILE_BYTES) -> DataFrame:
    """Files for ranges of ascending doc_id; returns file, n_docs, n_tokens and base (ids of all files before it).

    A null or empty text is its end id alone; a null doc_id sorts first; rows with one doc_id all stay, in any order
    among themselves, and may lie in several files; other columns are ignored; an empty table gives no file. A task
    closes a file after `most` bytes of ids. A task that is run again writes other files, and only files that the
    returned table names count.
    """
    folder, held = folder or fresh_dir(docs.sparkSession, "token-files"), shipped(docs.sparkSession, path)

    def run(batches):
        code = encoder(held)
        width = 2 if code.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else 4
        end = np.array([end_id], "<u4").tobytes()

        def documents():
            for batch in batches:
                for first, last, _, _ in text_slices(batch, "text"):
                    keys = batch.column("doc_id")[first:last].to_pylist()
                    for key, ids in zip(keys, code.ids(batch.column("text")[first:last].to_pylist()), strict=True):
                        yield key, ids + end

        place = TaskContext.get().partitionId()
        for k, part in enumerate(_files(documents(), most)):
            uri = f"{folder}/part-{place:06d}-{k:04d}-{uuid.uuid4().hex}.tok"
            n, total = write_file(uri, part, width)
            yield pa.RecordBatch.from_pydict({"file": [uri], "place": pa.array([place], pa.int32()), "k": pa.array([k], pa.int32()), "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    order = ["doc_id", "h", "row"]  # so that one doc_id of very many rows is cut too
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = written(ordered.mapInArrow(run, "file string, place int, k int, n_docs long, n_tokens long"), "token-file-list")
    before = F.sum("n_tokens").over(Window.orderBy("place", "k").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    return files.withColumn("base", F.coalesce(before, F.lit(0))).drop("place", "k")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files (file, base), from the files' bytes.

    A null doc_id comes back null, repeated rows come back each; a file that is named twice is read twice; other columns
    are ignored; no files give no rows. A damaged frame, list or table is an error.
    """

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(uri)
                docs = file.docs
                crc = [zlib.crc32(file.read(i).astype("<u4").tobytes()) for i in range(len(docs))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs["doc_id"], pa.int64(), mask=~docs["known"]), "start": pa.array(docs["start"] + base, pa.int64()),
                    "n_tokens": pa.array(docs["length"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    n = max(1, files.count())
    return files.select("file", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(written(files, "token-file-bases"))
