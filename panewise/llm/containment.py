"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions.

The items' sets of five-word shingles are partitioned by size, in powers of two. In a partition
of sets below u shingles, an item is searched for by the k = floor((1 - t) u) + 1 smallest of its
hashes. A document that contains a share t or more of an item's set misses fewer than k of its
shingles, so it has one of the k; no such document is lost. Every window of every document is
probed. Documents with a hit are verified: the exact number of the item's shingles in them.

Words are runs of characters other than white space, lower-cased. Fewer than five words count as
one shingle. Cases: null or wordless texts and items have no shingles and never match. Rows of one
doc_id are judged by their own texts. A null doc_id or item_id is an id like others. Repeated
items of one id are one set. Empty tables give no rows. Other columns are not read; their names
cannot clash, since only the named columns are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

WIDTH = 5
CONTAINED = 0.75
SPACES = "[\\x20\\x09-\\x0D]+"


def with_windows(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the 64-bit hash of each window of five words, repeats included. The words are bound to
    a lambda variable, so they are cut once for a text and not once for a window."""
    none = F.array().cast("array<bigint>")

    def windows(words: Column) -> Column:
        last = F.size(words) - WIDTH
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)]))
        return F.when(last >= 0, each).when(F.size(words) > 0, F.array(F.xxhash64(words, F.lit(WIDTH)))).otherwise(none)

    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACES), "")
    return rows.withColumn(name, F.get(F.transform(F.array(words), windows), F.lit(0)))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, hash, size, probe): the distinct shingles of each item, its set's size, and
    whether the hash is one of those searched for."""
    rows = with_windows(items.select("item_id", "text"), "text", "h").select("item_id", F.explode("h").alias("hash")).distinct()
    of_item = Window.partitionBy("item_id")
    rows = rows.withColumn("size", F.count("*").over(of_item)).withColumn("rank", F.row_number().over(of_item.orderBy("hash")))
    upper = F.expr("shiftleft(1L, cast(floor(log2(size)) as int) + 1) - 1")  # of the size partition
    return rows.select("item_id", "hash", "size", (F.col("rank") <= F.floor((1 - CONTAINED) * upper) + 1).alias("probe"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_common, n_item, containment) of each document that contains
    three quarters or more of an item's shingles. text_hash tells rows of one doc_id apart."""
    shingles = kept(item_shingles(items), "items")
    bodies = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("text is not null")
    windows = with_windows(bodies.select("doc_id", "text"), "text", "h").select("doc_id", F.explode("h").alias("hash"))
    probes = shingles.where("probe").select("hash").distinct()
    hits = kept(windows.join(kept(probes, "probes"), "hash", "left_semi").select("doc_id").distinct(), "hits")

    found = bodies.join(hits.withColumnRenamed("doc_id", "hit"), F.col("doc_id").eqNullSafe(F.col("hit")), "left_semi")
    found = with_windows(found, "text", "h").select("doc_id", "text_hash", F.explode(F.array_distinct("h")).alias("hash"))
    common = found.join(shingles.select("item_id", "hash", "size"), "hash").groupBy("doc_id", "text_hash", "item_id")
    common = common.agg(F.count_distinct("hash").alias("n_common"), F.first("size").alias("n_item"))
    return common.where(F.col("n_common") >= CONTAINED * F.col("n_item")).withColumn("containment", F.col("n_common") / F.col("n_item"))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document id and item that it contains."""
    rows = contaminated(docs, items).groupBy("doc_id", "item_id")
    return rows.agg(F.max("n_common").alias("n_common"), F.first("n_item").alias("n_item"), F.max("containment").alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, with their columns."""
    bad = kept(contaminated(docs, items).select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_text")).distinct(), "leaks")
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_text"])
    return docs.join(bad, same, "left_anti")
