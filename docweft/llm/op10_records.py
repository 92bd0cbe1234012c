"""Token ids as length-delimited binary records with an offset index for shuffled reads.

A ``.rec`` file is a row of frames: length (8 bytes), masked crc32 of it (4),
payload, masked crc32 of the payload (4), all little-endian. A payload is the
document's id (int64), flags (1: the id is null), the width of an id in bytes
(2 if the vocabulary allows, else 4) and the ids. The ``.idx`` file beside it
holds three int64 a record: its frame's offset, its number of ids, and the ids
of the file before it; an extra row closes the file. A reader of any record
needs one index row and one range of bytes, so epochs can be shuffled.

Files follow the order of ids: rows are range-partitioned and sorted by id (rows
of one id by a hash of their texts), and a task closes a file and opens the next
one when it holds FILE_BYTES, whatever the number of partitions. Tasks write under a name of their own
through the file system that the folder's URI names; only the files of
attempts whose rows reached the manifest count, so a lost executor's half file
is never read.

Scale: one range shuffle of the texts; a task holds about 1 MB of text, and the
index goes out with the frames. A null or repeated id may span partitions. Ids
are stored in 2 bytes where they fit. Reading is cut into pieces of a few
thousand records, and those into reads of READ_BYTES or one longer record.

Defined cases: null and empty text is a record of the end id alone; a null id
sorts first and stays null; repeated rows each get a record; an empty table
writes no files and reads as no rows; other columns are not written.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.scratch import Scratch
from docweft.llm.units import UnitEncoder, byte_level
from docweft.llm.words import slices, views

#: Fixed value: the constant of the usual checksum mask, crc rotated right by 15 bits plus this.
MASK = 0xA282EAD8
FRAME = 20
_READ = 2048
FILE_BYTES, READ_BYTES = 256 << 20, 8 << 20


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload)))])


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload at ``at`` and where the next frame starts; ValueError if a checksum is off."""
    size = data[at : at + 8]
    (length,) = struct.unpack("<Q", size)
    (check,) = struct.unpack_from("<I", data, at + 8)
    if check != masked(zlib.crc32(size)):
        raise ValueError(f"length checksum of the record at byte {at}")
    payload = data[at + 12 : at + 12 + length]
    (check,) = struct.unpack_from("<I", data, at + 12 + length)
    if check != masked(zlib.crc32(payload)):
        raise ValueError(f"payload checksum of the record at byte {at}")
    return payload, at + 16 + length


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags, width = struct.unpack_from("<qBB", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def _place(uri: str):
    """(file system, path) of a folder's URI."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


_ENCODERS: dict[bytes, UnitEncoder] = {}


def _encoder(data: bytes) -> UnitEncoder:
    if data not in _ENCODERS:
        _ENCODERS[data] = byte_level(data)
    return _ENCODERS[data]


class RecordFile:
    """One .rec file and its .idx, written as the frames come."""

    def __init__(self, system, folder: str, name: str):
        self.name, self.at, self.records, self.ids = name, 0, 0, 0
        self.rec, self.idx = (system.open_output_stream(f"{folder}/{name}.{x}") for x in ("rec", "idx"))

    def write(self, frames: list[bytes], counts: list[int]) -> None:
        sizes = np.array([len(x) for x in frames], np.int64)
        ids = np.array(counts, np.int64)
        self.rec.write(b"".join(frames))
        self.idx.write(np.stack([self.at + np.cumsum(sizes) - sizes, ids, self.ids + np.cumsum(ids) - ids], axis=1).astype("<i8").tobytes())
        self.at, self.records, self.ids = self.at + int(sizes.sum()), self.records + len(frames), self.ids + int(ids.sum())

    def close(self) -> None:
        self.idx.write(np.array([self.at, 0, self.ids], "<i8").tobytes())
        self.rec.close()
        self.idx.close()


def write_records(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` under the folder ``out`` in ascending order of ``key``; returns the lazy manifest.

    Manifest: part int and nth int (order of the files), file string, records
    long, ids long. Writing happens as the manifest is computed; keep it in a
    table and read only what it lists. The tokenizer's file is read on the driver.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions, "key", "tie").sortWithinPartitions("key", "tie").drop("tie")
    shared = spark.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(shared.value)
        width = 2 if max(len(encoder.opens) - 1, end_id) < 1 << 16 else 4
        system, folder = _place(out)
        part, nth, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex
        file: RecordFile | None = None

        def done(file: RecordFile) -> pa.RecordBatch:
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (nth, pa.int32()), (file.name, pa.string()), (file.records, pa.int64()), (file.ids, pa.int64()))], names=["part", "nth", "file", "records", "ids"])

        for batch in slices(batches, "text"):
            if file is not None and file.at >= file_bytes:
                yield done(file)
                file, nth = None, nth + 1
            if file is None:
                system.create_dir(folder, recursive=True)
                file = RecordFile(system, folder, f"part-{part:06d}-{nth:04d}-{attempt}")
            ids, bounds = encoder.encode(views(batch.column("text")))
            frames = [frame(pack(doc_id, np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)), width)) for i, doc_id in enumerate(batch.column("key").to_pylist())]
            file.write(frames, (np.diff(bounds) + 1).tolist())
        if file is not None:
            yield done(file)

    return rows.mapInArrow(run, "part int, nth int, file string, records long, ids long")


def read_index(folder: str, file: str, low: int = 0, high: int | None = None) -> np.ndarray:
    """Rows (offset, ids, ids before) of records low to high, and the one that closes them."""
    system, path = _place(folder)
    with system.open_input_file(f"{path}/{file}.idx") as f:
        high = f.size() // 24 - 1 if high is None else high
        return np.frombuffer(f.read_at((high + 1 - low) * 24, low * 24), "<i8").reshape(-1, 3)


def read_record(folder: str, file: str, record: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, for shuffled reads."""
    index = read_index(folder, file, record, record + 1)
    system, path = _place(folder)
    with system.open_input_file(f"{path}/{file}.rec") as f:
        return unpack(unframe(f.read_at(int(index[1, 0] - index[0, 0]), int(index[0, 0])), 0)[0])


def read_records(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Every record of the manifest's files, checksums verified, at its place in the whole.

    doc_id long, start long (ids of all records before), n_tokens long, ids_crc32
    long (unsigned crc32 of the ids as little-endian unsigned 32-bit), and
    input_ids array<int> if ``with_ids``. The prefix sum over files has a row a
    file; records take theirs from the index.
    """
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
        .withColumn("low", F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(_READ))))
        .withColumn("high", F.least(F.col("low") + _READ, F.col("records")))
        .select("file", "base", "low", "high")
        .repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                index = read_index(folder, row["file"], row["low"], row["high"])
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                keys, sizes, crcs, every = [], [], [], []
                at = index[:, 0]
                with system.open_input_file(f"{path}/{row['file']}.rec") as f:
                    low = 0
                    while low < len(at) - 1:
                        high = max(low + 1, int(np.searchsorted(at, at[low] + READ_BYTES, "right")) - 1)
                        data, spot = f.read_at(int(at[high] - at[low]), int(at[low])), 0
                        while spot < len(data):
                            payload, spot = unframe(data, spot)
                            key, ids = unpack(payload)
                            keys.append(key)
                            sizes.append(len(ids))
                            crcs.append(zlib.crc32(ids))
                            if with_ids:
                                every.append(ids)
                        low = high
                out = [pa.array(keys, pa.int64()), pa.array(index[:-1, 2] + row["base"]), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(every).astype(np.int32))))
                    names.append("input_ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return pieces.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", input_ids array<int>" * with_ids)


def token_records(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` (to ``folder``, a shared one by default) and return read_records() of the files."""
    scratch = Scratch(spark, "records")
    folder = folder or scratch.place("files")
    manifest = scratch.keep(write_records(docs, folder, tokenizer_path, end_id, key, text), "manifest")
    return read_records(manifest, folder)
