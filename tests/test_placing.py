"""Placing of hits: equal to the direct expressions, and linear in text and hits."""

import random
import time

from panewise.functions import text as tx
from panewise.functions.sqlexpr import F
from panewise.operators.vulnerabilities import misc_vulns
from panewise.sources.assets import CAPTURE_SCHEMA, scan_responses


def test_place_of_equals_the_direct_expressions(spark):
    rnd = random.Random(6)
    rows = []
    for size in (0, 1, 5, 4095, 4096, 4097, 9000, 30_000):
        for alphabet in ("ab \n", "é🎉x\n\t", "abc", "\n"):
            text = "".join(rnd.choice(alphabet) for _ in range(size))
            for _ in range(6):
                start = rnd.randrange(size + 1)
                rows.append((text, start, min(size, start + rnd.choice([0, 1, 20, 300, 5000]))))
    table = spark.createDataFrame(rows, "t string, a int, b int")
    t, a, b = F.col("t"), F.col("a"), F.col("b")
    place = tx.let(tx.placing(t), lambda p: tx.place_of(p, a, b))
    tail = tx.let(tx.text_parts(t), lambda p: tx.text_at(p, b, F.lit(200)))
    got = table.select(
        place.alias("p"), tail.alias("tail"), tx.line_of(t, a).alias("line"), tx.column_of(t, a).alias("col"),
        tx.make_snippet(t, a, b).alias("snippet"), F.substr(t, b + 1, F.lit(200)).alias("want"),
    )
    for r in got.collect():
        assert (r.p.line, r.p.col, r.p.snippet, r.tail) == (r.line, r.col, r.snippet, r.want)


def _seconds(spark, hits):
    body = "\n".join(f'var debugMode = true; var filler{i} = "some text";' for i in range(hits))
    rows = [("s", "https://s.example/", 1, True, "https://s.example/a.js", 200, "application/javascript", {}, body)]
    assets = scan_responses(spark.createDataFrame(rows, CAPTURE_SCHEMA))
    started = time.time()
    assert misc_vulns(assets).where("title = 'Debug mode enabled'").agg(F.max("line")).first()[0] == hits
    return time.time() - started


def test_time_follows_the_number_of_hits(spark):
    _seconds(spark, 100)
    few, many = _seconds(spark, 5_000), _seconds(spark, 20_000)
    assert many < 12 * few + 5, (few, many)
