"""The corpus on disk: bodies stay in their splits, and one row group still gives many files."""

from __future__ import annotations

from panewise.queries import QUERIES, Corpus
from panewise.queries.base import ROWS_PER_FILE
from panewise.sources.corpus import captures


def _tables(spark, folder, texts):
    pages = [(i, f"https://s{i % 3}.example.org/p{i}", f"<p>{i}</p>") for i in range(30)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    spark.range(texts).selectExpr("id AS doc_id", "'a text' AS text", "'en' AS lang", "'src0' AS source").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_bodies_are_not_shuffled(spark, tmp_path):
    plan = captures(spark, _tables(spark, tmp_path, 10))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_manifest_candidates_run_no_other_detector(spark, tmp_path):
    c = Corpus(spark, _tables(spark, tmp_path, 10))
    rows = sorted(map(tuple, QUERIES["manifest_candidates"](c).collect()))
    assert "facts" not in c.scan.__dict__ and "f_hits" not in c.scan_of("technology").facts.columns
    assert c.scan.facts and c.scan_of("technology") is c.scan  # the whole pass serves it, once it is done
    assert sorted(map(tuple, QUERIES["manifest_candidates"](c).collect())) == rows


def test_one_row_group_becomes_files_of_few_rows(spark, tmp_path):
    written = Corpus(spark, _tables(spark, tmp_path, 3 * ROWS_PER_FILE + 1)).captures
    assert len(written.inputFiles()) >= 4
    assert written.count() == 2 * 30 + 3 * ROWS_PER_FILE + 1
