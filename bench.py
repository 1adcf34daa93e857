"""Seconds per headline query; prints one JSON line.

Every query starts without shared tables except the written captures, so a query that needs
the whole scan pays for it.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from panewise.queries import QUERIES, Corpus  # noqa: E402
from panewise.session import local_session  # noqa: E402

HEADLINE = (
    "severity_counts", "scan_responses", "code_regions", "string_literals", "strip_comments",
    "misc_vulns", "xss_sinks", "sql_statements", "orm_usage", "first_seen_roles",
    "permission_checks", "secrets", "call_sites", "absolute_urls", "emails", "tech_content",
    "merge_technologies", "services", "missing_headers", "extract_page_links",
    "extract_script_links", "uncaptured_links", "page_reachability", "is_placeholder",
    "shannon_entropy", "looks_like_prose", "decode_escapes", "collapse_inferred_endpoints",
    "sink_json",
)


#: The detectors whose growth from the smaller folder is reported.
DETECTORS = ("misc_vulns", "xss_sinks", "sql_statements", "secrets", "services", "emails")


def prepared(spark, sf_dir: str):
    """The written captures of a folder, and the characters in them."""
    captures = Corpus(spark, sf_dir).captures
    return captures, captures.agg(F.sum(F.length("content"))).first()[0]


def timed(spark, sf_dir: str, captures, name: str) -> float:
    corpus = Corpus(spark, sf_dir)
    corpus.__dict__["captures"] = captures
    started = time.time()
    QUERIES[name](corpus).write.format("noop").mode("overwrite").save()
    return time.time() - started


def growth(spark, sf_dir: str, seconds: dict, chars: int) -> dict:
    """For each detector, the power of the input by which its seconds grow from sf0.01."""
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    if not os.path.isdir(small) or os.path.samefile(small, sf_dir):
        return {}
    captures, few = prepared(spark, small)
    return {
        name: round(math.log(seconds[name] / timed(spark, small, captures, name)) / math.log(chars / few), 2)
        for name in DETECTORS if name in seconds
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "panewise-bench")
    spark.sparkContext.setLogLevel("ERROR")

    started = time.time()
    captures, chars = prepared(spark, sf_dir)
    prepare = time.time() - started

    seconds = {name: round(timed(spark, sf_dir, captures, name), 3) for name in wanted}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
        "prepare_sec": round(prepare, 3), "content_chars": chars,
        "full_scan_chars_per_sec": round(chars / seconds[wanted[0]]) if wanted else None,
        "mchars_per_sec": {n: round(chars / 1e6 / x, 2) for n, x in seconds.items()},
        "growth_power": growth(spark, sf_dir, seconds, chars),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
