"""Token ids as length-delimited binary records with an offset index.

A shard ``<n>.rec`` holds records one after the other, each framed as

    uint64 length | uint32 masked crc32 of those 8 bytes | payload | uint32 masked crc32 of the payload

(little endian). The payload is a byte that tells whether the row has an id, the int64 row id (0 without one) and the
ids, as uint16 where the vocabulary allows it, else as uint32. ``<n>.idx`` holds the uint64 offset of each record, so single sequences can be read in
any order. A file is written under a name of the attempt's own and then renamed, so a task that runs
twice or is lost half way leaves whole shards only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm import pretrained_tokens as T
from docforge.llm import textkernel as K
from docforge.llm.workspace import Workspace

#: Fixed value: the mask that is added to rotated checksums.
MASK_DELTA = 0xA282EAD8
#: What a payload begins with: whether there is a row id, and the id.
HEAD = "<?q"


def masked(data: bytes) -> int:
    """crc32, rotated right by 15 bits, plus the mask: checksums of data that holds checksums stay useful."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[bytes, int]:
    """The payload at an offset and the next record's offset; raises ValueError on damage."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"damaged record length at byte {at}")
    n = struct.unpack("<Q", head)[0]
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + n


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _writer(root: str, vocabulary: str, kind: str, end_id: int, wide: bool):
    width = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(root)
        shard, encoder = TaskContext.get().partitionId(), T.encoder(vocabulary, kind)
        temporary = f"{path}/_{shard}-{uuid.uuid4().hex}"
        at, offsets, ids_seen, out = 0, [], 0, None
        for batch in batches:
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{temporary}.rec")
            data, offs = K.flat(batch.column(1))
            rows, k = batch.column(0).to_pylist(), 0
            for a, b, part, o in K.chunks(data, offs, T.CHUNK):
                ids, first = encoder.encode(part, o)
                for i in range(b - a):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype(width)
                    record = frame(struct.pack(HEAD, rows[k] is not None, rows[k] or 0) + own.tobytes())
                    offsets.append(at)
                    at += len(record)
                    ids_seen += len(own)
                    out.write(record)
                    k += 1
        if out is not None:
            out.close()
            with store.open_output_stream(f"{temporary}.idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            for suffix in ("rec", "idx"):
                store.move(f"{temporary}.{suffix}", f"{path}/{shard:06d}.{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(offsets)], pa.int64()), pa.array([ids_seen], pa.int64())], ["shard", "n_records", "n_ids"])

    return run


def write_records(docs: DataFrame, root: str, vocabulary: str, kind: str, end_id: int, vocabulary_size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write shards in ascending id order; returns (shard, n_records, n_ids, base).

    ``base`` is the number of ids in the shards before. Texts that are null count as empty: their record holds
    the end id alone. Rows with one id each get a record; those without one come first and are read back without one. An empty
    table writes no shard. The table of shards has one row for each partition, whatever the input's size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("row_id").sortWithinPartitions("row_id")
    made = ordered.mapInArrow(_writer(root, vocabulary, kind, end_id, vocabulary_size > 65536), "shard int, n_records long, n_ids long").collect()
    base, out = 0, []
    for r in sorted(made, key=lambda r: r["shard"]):
        out.append((r["shard"], r["n_records"], r["n_ids"], base))
        base += r["n_ids"]
    return docs.sparkSession.createDataFrame(out, "shard int, n_records long, n_ids long, base long")


_READ = pa.schema([("row_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _reader(root: str, wide: bool, block: int = 1 << 22):
    width = 4 if wide else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(root)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{path}/{shard:06d}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with store.open_input_file(f"{path}/{shard:06d}.rec") as f:
                    bounds = np.append(offsets, f.size())
                    k = 0
                    while k < len(offsets):  # records of about ``block`` bytes at a time
                        e = max(k + 1, int(np.searchsorted(bounds, bounds[k] + block, "right")) - 1)
                        data, rows = memoryview(f.read_at(int(bounds[e] - bounds[k]), int(bounds[k]))), []
                        for at in offsets[k:e] - bounds[k]:
                            payload, _ = unframe(data, int(at))
                            known, row_id = struct.unpack_from(HEAD, payload)
                            ids = np.frombuffer(payload, "<u4" if width == 4 else "<u2", offset=struct.calcsize(HEAD)).astype("<u4")
                            rows.append((row_id if known else None, start, len(ids), ids.tobytes()))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)
                        k = e

    return run


def read_records(shards: DataFrame, root: str, vocabulary_size: int) -> DataFrame:
    """(row_id, start, n_tokens, ids as little-endian uint32) of all records; checksums are verified."""
    n = max(1, shards.count())
    return shards.select("shard", "base").repartition(n, "shard").mapInArrow(_reader(root, vocabulary_size > 65536), "row_id long, start long, n_tokens long, ids binary")


def report(docs: DataFrame, vocabulary: str, kind: str = "bytes", end_id: int = 2, vocabulary_size: int = 50257) -> DataFrame:
    """Write the documents' records to the shared folder, read them back, digest them."""
    spark: SparkSession = docs.sparkSession
    root = Workspace(spark, "records").path("shards")
    shards = write_records(docs, root, vocabulary, kind, end_id, vocabulary_size)
    read = read_records(shards, root, vocabulary_size)
    return read.select(F.col("row_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
