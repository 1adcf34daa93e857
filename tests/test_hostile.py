"""Texts made to break the patterns: none may end the JVM or take long."""

import time

import pytest
from pyspark.sql import functions as F

from panewise.rules import endpoints, vulns, words

_BY_ID = {r.id: r.pattern for r in vulns.MISC_RULES}
PATTERNS = {
    "email": endpoints.EMAIL, "absolute_url": endpoints.ABSOLUTE_URL, "protocol_relative": endpoints.PROTOCOL_RELATIVE,
    "api_path": endpoints.API_PATH, "generic_api_path": endpoints.GENERIC_API_PATH, "route_like": words.ROUTE_LIKE,
    "misc_internal": _BY_ID["misc_internal"], "misc_staging": _BY_ID["misc_staging"],
}
SEEDS = ("", "/api", "a", "https://", "//", "'https://", "a@")
REPEATS = ("a.", "/a", "a-", "/")


@pytest.mark.parametrize("name", PATTERNS)
def test_a_megabyte_of_repeats(spark, name):
    rows = [(seed, repeat) for seed in SEEDS for repeat in REPEATS]
    text = F.concat("seed", F.repeat(F.col("rep"), F.lit(500_000)))
    table = spark.createDataFrame(rows, "seed string, rep string").repartition(8)
    started = time.time()
    found = table.select(F.sum(F.length(F.regexp_replace(text, F.lit("(?dU)" + PATTERNS[name]), F.lit("")))))
    assert found.first()[0] is not None
    assert time.time() - started < 90
