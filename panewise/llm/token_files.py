"""Token ids in files: a shared zstandard dictionary, one frame for each document.

A file set is two tables in one folder. `dictionary` has one row: the dictionary trained on
serialised ids, its SHA-256, the width of an id and the compression level. `shards` has one row
for each shard of about SHARD_BYTES: the dictionary's hash, the document ids, the frames' ends in
the payload (the offset index), the token counts, and the frames one after another. A reader
checks the hash and can open one document without the others (`document`).

Documents lie in ascending order of doc_id, equal ids by a hash of the text, which also spreads a
repeated id over partitions. Shards are numbered by partition and place; their first positions
are sums over partition totals and then over a partition's shards, so no task sees all documents.

Cases: a null or empty text is the end token alone. Null ids come first and stay null. Repeated
rows are documents of their own. An empty table gives an empty file set. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import coder
from .common import binary, bounded, texts

SHARD_BYTES = 4 << 20
LEVEL = 3
#: The dictionary is trained on windows of SAMPLE_IDS ids from at most about SAMPLES documents.
SAMPLES, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 512, 64 << 10

SHARD = (
    "part long, seq long, n_docs long, n_tokens long, dictionary_sha256 string, "
    "doc_ids array<long>, frame_ends array<long>, counts array<long>, payload binary"
)
READ = "doc_id long, part long, seq long, n_tokens long, ids_crc32 long, before long"


def train(docs: DataFrame, path: str, width: int, most: int = SAMPLES) -> bytes:
    """A dictionary for serialised ids; empty when there is too little to learn from."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            out = []
            for low, high, _, _, ids, bounds, *_ in code.encode(texts(batch)):
                for k in range(high - low):
                    n = int(bounds[k + 1] - bounds[k])
                    if n:
                        at = int(bounds[k]) + (crc32(str(n).encode()) % max(1, n - SAMPLE_IDS + 1))
                        out.append(ids[at : min(at + SAMPLE_IDS, int(bounds[k + 1]))].astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([binary(out)], names=["ids"])

    sample = bounded(docs.select("doc_id", "text").where("text is not null"), "doc_id", most)
    rows = [bytes(r[0]) for r in sample.mapInArrow(run, "ids binary").limit(2 * most).collect()]
    if sum(map(len, rows)) < 100 * 1024 or len(rows) < 100:
        return b"".join(sorted(rows)[:64])[:DICTIONARY_BYTES]
    return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(rows), k=256, d=8).as_bytes()


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, path: str, folder: str, end_id: int, level: int = LEVEL) -> None:
    """Encode (doc_id, text) and write the file set into folder, a place that all executors reach."""
    spark = docs.sparkSession
    width = 2 if coder(path).small else 4
    kind = f"<u{width}"
    data = train(docs, path, width)
    sha = hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seq, part = coder(path), 0, TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=level, dict_data=as_dictionary(data)).compress
        names: list = []
        frames: list[bytes] = []
        counts: list[int] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ends = np.cumsum([len(f) for f in frames]).tolist()
            row = {
                "part": part, "seq": seq, "n_docs": len(names), "n_tokens": sum(counts), "dictionary_sha256": sha,
                "doc_ids": list(names), "frame_ends": ends, "counts": list(counts), "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=SHARD_ARROW)

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for low, high, _, _, ids, bounds, *_ in code.encode(texts(batch)):
                ids, spots = ids.astype(kind), bounds.tolist()
                for k in range(low, high):
                    part_ids = ids[spots[k - low] : spots[k - low + 1]]
                    frame = pack(part_ids.tobytes() + end_id.to_bytes(width, "little"))
                    names.append(ids_of[k])
                    frames.append(frame)
                    counts.append(len(part_ids) + 1)
                    size += len(frame)
                    if size >= SHARD_BYTES:
                        yield shard()
                        names, frames, counts, size, seq = [], [], [], 0, seq + 1
        if names:
            yield shard()

    head = spark.createDataFrame([(bytearray(data), sha, width, level)], "dictionary binary, sha256 string, width int, level int")
    head.coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(run, SHARD).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/shards")


SHARD_ARROW = pa.schema([
    ("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("dictionary_sha256", pa.string()),
    ("doc_ids", pa.list_(pa.int64())), ("frame_ends", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def head_of(spark: SparkSession, folder: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary is damaged")
    return data, row["sha256"], row["width"]


def opened(frame: bytes, unpack, width: int, sha: str, expected: str) -> np.ndarray:
    if sha != expected:
        raise ValueError(f"the shard was written with dictionary {sha}, the folder has {expected}")
    return np.frombuffer(unpack(frame), f"<u{width}").astype("<u4")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document: its first position in the order of the files, its number of
    tokens and the CRC-32 of its ids as little-endian 32-bit integers."""
    data, sha, width = head_of(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=as_dictionary(data)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                begin, checks, counts = 0, [], []
                for end in row["frame_ends"]:
                    ids = opened(row["payload"][begin:end], unpack, width, row["dictionary_sha256"], sha)
                    checks.append(crc32(ids.tobytes()))
                    counts.append(len(ids))
                    begin = end
                n = len(counts)
                before = (np.cumsum(counts) - counts).tolist()
                cols = [row["doc_ids"], [row["part"]] * n, [row["seq"]] * n, counts, checks, before]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in READ.split(", ")])

    shards = spark.read.schema(SHARD).parquet(f"{folder}/shards")
    places = shards.select("part", "seq", "n_tokens")
    parts = places.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start"))
    places = places.join(parts, "part")
    rows = shards.select("part", "seq", "dictionary_sha256", "doc_ids", "frame_ends", "payload").mapInArrow(run, READ)
    start = (F.col("part_start") + F.col("shard_start") + F.col("before")).alias("start")
    return rows.join(places, ["part", "seq"]).select("doc_id", start, "n_tokens", "ids_crc32")


def document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of that id; only their frames are decompressed."""
    data, sha, width = head_of(spark, folder)
    unpack = zstandard.ZstdDecompressor(dict_data=as_dictionary(data)).decompress
    shards = spark.read.schema(SHARD).parquet(f"{folder}/shards")
    place = F.explode(F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.get("doc_ids", i) == doc_id))
    found = shards.where(F.array_contains("doc_ids", doc_id)).select("part", "seq", "dictionary_sha256", "frame_ends", "payload", place.alias("i"))
    begin = F.when(F.col("i") == 0, 0).otherwise(F.get("frame_ends", F.col("i") - 1))
    frame = F.substring("payload", (begin + 1).cast("int"), (F.get("frame_ends", F.col("i")) - begin).cast("int"))
    rows = found.select("part", "seq", "i", "dictionary_sha256", frame.alias("frame")).orderBy("part", "seq", "i").collect()
    return [opened(bytes(r["frame"]), unpack, width, r["dictionary_sha256"], sha).tolist() for r in rows]
