"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A record is ``<u64 length> <u32 masked crc of the length bytes> payload <u32 masked crc of the
payload>``; the payload is ``<u8 flags> <i64 doc_id> <u32 tokens> zstd(ids)``, ids as little-endian
u16, or u32 where an id needs it. Masking rotates a crc32 right by 15 bits and adds a constant, so
that checksums of data that holds checksums stay sound. The index has file, position and length of
every record: readers can visit records in any order.

Writing is safe against lost executors: a task writes a file of its own name, and only files that
the committed index names are ever read.

Defined cases: null or empty text has the end id alone; a very long text is one record; a null ``doc_id`` sorts first and is kept
as null; repeated ids are all written; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.llm.common import new_path, partitions, small_batches, table
from tercet.llm.subwords import default_vocabulary, encoder

END_ID = 0
_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<BqI")
_NO_ID, _WIDE = 1, 2

INDEX = "doc_id long, pid int, row long, file string, position long, length long, n_tokens long"
RECORDS = "doc_id long, pid int, chunk long, row long, local_start long, n_tokens long, ids_crc32 long"
#: Bytes of a file that one task reads back, about; rows that it hands on at once; files that a shuffled reader keeps open.
CHUNK_BYTES, ROWS, OPEN_FILES = 32 << 20, 512, 32


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def pack_ids(doc_id: int | None, ids: np.ndarray, squeeze) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    flags = (_NO_ID if doc_id is None else 0) | (_WIDE if wide else 0)
    return _BODY.pack(flags, doc_id or 0, len(ids)) + squeeze(ids.astype("<u4" if wide else "<u2").tobytes())


def unpack_ids(payload: bytes, unsqueeze) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = _BODY.unpack_from(payload)
    kind = "<u4" if flags & _WIDE else "<u2"
    ids = np.frombuffer(unsqueeze(payload[_BODY.size :]), kind) if n else np.zeros(0, kind)
    if len(ids) != n:
        raise ValueError("a record does not hold as many ids as it says")
    return (None if flags & _NO_ID else doc_id), ids.astype("<u4")


def read_frame(source) -> bytes | None:
    """The next payload of an open file, None at its end; raises if a checksum is wrong."""
    head = source.read(_HEAD.size)
    if not head:
        return None
    size, crc = _HEAD.unpack(head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("the length of a record is damaged")
    payload = source.read(size)
    if struct.unpack("<I", source.read(4))[0] != masked_crc(payload):
        raise ValueError("a record is damaged")
    return payload


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents in ascending ``doc_id`` order; returns the index (also in ``folder``/index)."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = vocabulary or default_vocabulary()
    where, base = _open(folder)
    where.create_dir(f"{base}/records", recursive=True)

    def write(batches):
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1).compress
        tool, pid = encoder(vocabulary), TaskContext.get().partitionId()
        store, top = _open(folder)
        name = f"records/part-{pid:06d}-{uuid.uuid4().hex[:10]}.rec"
        row = position = 0
        with store.open_output_stream(f"{top}/{name}", buffer_size=1 << 20) as out:
            for batch in batches:
                keys = batch.column("doc_id").to_pylist()
                rows = []
                for i, ids in tool.encode_column(batch.column("text")):
                    ids = np.append(ids, np.uint32(end_id))
                    record = frame(pack_ids(keys[i], ids, squeeze))
                    out.write(record)
                    rows.append((keys[i], pid, row, name, position, len(record), len(ids)))
                    row, position = row + 1, position + len(record)
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "pid", "row", "file", "position", "length", "n_tokens"])

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(write, INDEX)
        .write.parquet(f"{folder}/index")
    )
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read every indexed record, files in chunks of about CHUNK_BYTES by different tasks, checking all checksums and places."""
    spark = index.sparkSession
    chunks = (
        index.withColumn("chunk", F.expr(f"position div {CHUNK_BYTES}")).groupBy("file", "pid", "chunk")
        .agg(F.min("position").alias("position"), F.max(F.col("position") + F.col("length")).alias("until"), F.min("row").alias("row"), F.count("*").alias("n"))
        .repartition(partitions(spark), "file", "chunk")
    )

    def read(batches):
        import zstandard

        unsqueeze = zstandard.ZstdDecompressor().decompress
        store, top = _open(folder)
        names, kinds = [part.split()[0] for part in RECORDS.split(", ")], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for name, pid, chunk, position, until, row, n in zip(*(batch.column(c).to_pylist() for c in ("file", "pid", "chunk", "position", "until", "row", "n")), strict=True):
                rows, start = [], 0
                with store.open_input_file(f"{top}/{name}") as source:
                    source.seek(position)
                    for k in range(n):
                        payload = read_frame(source)
                        if payload is None:
                            raise ValueError(f"{name} ends before its indexed records do")
                        doc_id, ids = unpack_ids(payload, unsqueeze)
                        rows.append((doc_id, pid, chunk, row + k, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == ROWS or k == n - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                    if source.tell() != until:
                        raise ValueError(f"{name} does not hold its records where the index says")

    return chunks.mapInArrow(read, RECORDS)


def read_shuffled(index: DataFrame, folder: str, seed: int) -> DataFrame:
    """Read single records in a seeded random order by their positions: (doc_id, ids)."""
    order = F.xxhash64(F.lit(seed), "pid", "row")
    visits = index.repartitionByRange(partitions(index.sparkSession), order).sortWithinPartitions(order)

    def visit(batches):
        import zstandard

        unsqueeze = zstandard.ZstdDecompressor().decompress
        store, top = _open(folder)
        held: dict[str, object] = {}
        for batch in batches:
            got = []
            for name, position in zip(batch.column("file").to_pylist(), batch.column("position").to_pylist(), strict=True):
                if name not in held:
                    if len(held) == OPEN_FILES:
                        held.pop(next(iter(held))).close()
                    held[name] = store.open_input_file(f"{top}/{name}")
                held[name].seek(position)
                got.append(unpack_ids(read_frame(held[name]), unsqueeze))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tolist() for g in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])
        for source in held.values():
            source.close()

    return visits.mapInArrow(visit, "doc_id long, ids array<long>")


def with_starts(records: DataFrame) -> DataFrame:
    """Add the number of ids before each record: sums by chunk of a file (one row for CHUNK_BYTES), then a running sum over chunks."""
    chunks = records.groupBy("pid", "chunk").agg(F.sum("n_tokens").alias("tokens"))
    before = chunks.select("pid", "chunk", (F.sum("tokens").over(Window.orderBy("pid", "chunk")) - F.col("tokens")).alias("before"))
    return records.join(before, ["pid", "chunk"]).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def random_order(n: int, seed: int) -> list[int]:
    """A seeded order of n shards, for readers that shuffle by file first."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tercet.llm.common import written

    folder = new_path(spark, "records")
    index = write_records(table(spark, sf_dir, "documents"), folder)
    return with_starts(written(read_records(index, folder), "records-read"))
