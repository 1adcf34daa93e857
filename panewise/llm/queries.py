"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder
from .common import by_id, importable, table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), vocabulary())


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    folder = work_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), vocabulary(), folder, end_id=2)
    return token_files.read(spark, folder)


@query
def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity_join import classes_and_components

    return classes_and_components(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cross_parsing import identified, sample

    docs = by_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), 4)
    found = identified(docs, sample(docs, F.col("fold") != 2))
    return by_id(found, 4).select("doc_id", (F.col("fold") == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .novelty import dictionary, scanned

    docs = table(spark, sf_dir, "documents")
    return scanned(docs, dictionary(docs))


@query
def op10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .containment import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_templates import scanned

    return scanned(table(spark, sf_dir, "documents")).drop("places")


@query
def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gam import fitted, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = by_id(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), 3).where("fold <> 1")
    found = by_id(scored(docs, fitted(docs, labels)), 3)
    return found.select("doc_id", (F.col("fold") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxic_segments import fitted, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = by_id(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), 3).where("fold <> 1")
    found = by_id(scored(docs, fitted(docs, labels)), 3)
    return found.select("doc_id", (F.col("fold") == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repaired

    return repaired(damaged(table(spark, sf_dir, "conversations")))


@query
def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunked_bpe import digests, encoded

    return digests(encoded(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


@query
def op12_zone_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .zone_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))
