"""Token ids as length-delimited binary records with a separate offset index.

A shard file is a sequence of records::

    uint64 length | uint32 masked crc of the length | payload | uint32 masked crc of the payload

all little-endian; a payload is ``int64 doc_id, uint8 has_id, uint8 width`` and
the ids in ``width`` bytes each (2 while every id of the vocabulary fits).  The
checksum is CRC-32, masked by rotating right 15 bits and adding 0xA282EAD8.
Beside each shard an index file holds ``uint64 offset, uint64 length`` of every
record, so that records can be read in any order.

Shards are ranges of doc_id; each task writes its own shard under a name of its
own attempt, and only shards listed in the manifest (written by Spark's
committer) count, so lost executors and repeated attempts leave no wrong data.

Defined results: null text is empty and has only the end id; a null doc_id comes
first; rows with equal doc_id follow one another in the order of their texts' hashes
(equal hashes: of the texts); an empty table gives no shards and no rows; extra columns don't matter.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import ENCODE_BYTES, default_vocabulary, shared_library_encoder
from .common import bounded_batches, materialize, one_operator, scratch_path, text_bytes

END_ID = 2
#: Bytes of text of a shard; beyond MOST_SHARDS of them shards grow with the corpus.
SHARD_BYTES, MOST_SHARDS = 64 << 20, 20_000
#: Fixed value: the delta of the masking used by record files of this kind.
MASK_DELTA = 0xA282EAD8
_HEAD, _META = struct.Struct("<QI"), struct.Struct("<qBB")
FRAME = _HEAD.size + 4


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def read_frame(stream) -> bytes | None:
    """Next payload of a record file; None at its end.  Raises ValueError on damage."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("record file ends inside a length")
    length, crc = _HEAD.unpack(head)
    if crc != masked_crc(head[:8]):
        raise ValueError("damaged record length")
    body = stream.read(length + 4)
    if len(body) < length + 4:
        raise ValueError("record file ends inside a record")
    payload = body[:length]
    if masked_crc(payload) != int.from_bytes(body[length:], "little"):
        raise ValueError("damaged record")
    return payload


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _META.pack(doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, known, width = _META.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=_META.size)


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if uri.startswith("/") else uri)


def _write_shard(folder: str, path: str, end_id: int):
    """One shard per task; its manifest row is the only output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_operator("bpe")
        encoder = shared_library_encoder(path)
        width = 2 if max(max(encoder.vocab.token_bytes), end_id) < 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        fs, top = filesystem(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        out, offset, tokens, records, end = None, 0, 0, 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(top, recursive=True)
                out, index = (fs.open_output_stream(f"{top}/{name}.{kind}", buffer_size=1 << 20) for kind in ("rec", "idx"))
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                numbers = np.frombuffer(got + end, "<u4")
                record = frame(pack(doc_id, numbers, width))
                out.write(record)
                index.write(struct.pack("<QQ", offset, len(record)))
                offset += len(record)
                tokens += len(numbers)
                records += 1
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "records": records, "tokens": tokens, "bytes": offset}])

    return run


def write_records(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Write all rows in ascending doc_id order; returns the manifest (shard, name, records, tokens, bytes), one row per shard.

    Shards follow the bytes of text, but there are as many as the cluster has cores at least and MOST_SHARDS at most.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(min(-(-size // shard_bytes), MOST_SHARDS), docs.sparkSession.sparkContext.defaultParallelism)
    rows = bounded_batches(docs, ENCODE_BYTES).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    # by the text's hash too, so that one id with very many rows still spreads
    dealt = rows.withColumn("h", F.xxhash64("raw")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "raw")
    schema = "shard long, name string, records long, tokens long, bytes long"
    return materialize(dealt.select("doc_id", "raw").mapInArrow(_write_shard(folder, tokenizer or default_vocabulary(), end_id), schema), "manifest")


def _read_shard(folder: str):
    def run(batches):
        fs, top = filesystem(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                out = ([], [], [], [])
                start, records, size = shard["start"], 0, 0
                with fs.open_input_stream(f"{top}/{shard['name']}.rec", buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = unpack(payload)
                        for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                            column.append(value)
                        start += len(ids)
                        records += 1
                        size += FRAME + len(payload)
                        if len(out[0]) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = ([], [], [], [])
                if (records, start - shard["start"], size) != (shard["records"], shard["tokens"], shard["bytes"]):
                    raise ValueError(f"{shard['name']} holds {records} records, {start - shard['start']} tokens and {size} bytes, not {shard['records']}, {shard['tokens']} and {shard['bytes']}")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def with_starts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's first token position; one row per shard, so the driver adds them up."""
    at, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((r.name, at, r.records, r.tokens, r.bytes))
        at += r.tokens
    return spark.createDataFrame(rows, "name string, start long, records long, tokens long, bytes long").repartition(max(1, len(rows)))


def read_records(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the shard files and checked.

    A record that is damaged, or a shard that doesn't hold what the manifest says, raises ValueError.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return with_starts(spark, manifest).mapInArrow(_read_shard(folder), schema)


def read_record_at(folder: str, name: str, place: int) -> tuple[int | None, np.ndarray]:
    """One record through the index, for shuffled reads."""
    fs, top = filesystem(folder)
    with fs.open_input_file(f"{top}/{name}.idx") as f:
        f.seek(16 * place)
        offset, _ = struct.unpack("<QQ", f.read(16))
    with fs.open_input_file(f"{top}/{name}.rec") as f:
        f.seek(offset)
        return unpack(read_frame(f))


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the record files to the shared folder and describe what they hold."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "records")
    return read_records(spark, folder, write_records(docs, folder, doc_id, text, tokenizer))
