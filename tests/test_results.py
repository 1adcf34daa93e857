"""Merging under skew, top-k, walks, targets and the stream."""

from __future__ import annotations

import pytest

from panewise.operators import links as lk
from panewise.operators import results as rs
from panewise.operators.vulnerabilities import misc_vulns, sql_statements
from panewise.plans.scan import Scan, select_detectors
from panewise.queries import ORACLES, QUERIES
from panewise.sources.assets import CAPTURE_SCHEMA, asset_cap, normalize_target, scan_responses


def _captures(spark, rows):
    return spark.createDataFrame(rows, CAPTURE_SCHEMA)


def _js(site, seq, content, url=None):
    return (site, f"https://{site}/", seq, seq == 0, url or f"https://{site}/{seq}.js", 200, "text/javascript", {}, content)


def test_a_hot_key_keeps_its_count_and_first_places(spark):
    rows = [_js("hot.com", i, "debug: true") for i in range(500)] + [_js("cold.com", 0, "debug: true")]
    found = misc_vulns(scan_responses(_captures(spark, rows)))
    merged = {r.site: r for r in rs.dedupe_findings(found).collect()}
    hot = merged["hot.com"]
    assert (hot.mentions, hot.occurrences, len(hot.also_seen)) == (500, 500, 50)
    assert hot.url == "https://hot.com/0.js" and hot.also_seen[0].url == "https://hot.com/1.js"
    assert merged["cold.com"].mentions == 1 and merged["cold.com"].also_seen == []


def test_top_k_is_cut_before_the_shuffle(spark):
    rows = [_js("s.com", i, "debug: true") for i in range(20)]
    found = misc_vulns(scan_responses(_captures(spark, rows)))
    plan = rs.dedupe_findings(found)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_findings_need_no_shuffle(spark):
    found = misc_vulns(scan_responses(_captures(spark, [_js("s.com", 0, "debug: true")])))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_numbering_spans_partitions(spark):
    from panewise.plans.reports import numbered

    rows = [_js("a.com", i, f"debug: true; eval(x{i}); password == 'abc{i}'") for i in range(60)] + [_js("b.com", 0, "debug: true")]
    scan = Scan(_captures(spark, rows))
    got = numbered(scan.findings.repartition(7)).collect()
    for site in ("a.com", "b.com"):
        mine = sorted((r for r in got if r.site == site), key=lambda r: r["index"])
        assert [r["index"] for r in mine] == list(range(1, len(mine) + 1))
        order = [(-r.severity_rank, -r.confidence_rank, r.category, r.title) for r in mine]
        assert order == sorted(order)
        assert [r.previous_category for r in mine] == [None] + [r.category for r in mine[:-1]]


def _screen(scan, **options):
    """The rows of each site's screen summary in order."""
    from panewise.plans.reports import console_summary

    rows = console_summary(scan, **options).orderBy("site", "section", "item", "sort_key", "part").collect()
    return {site: [r for r in rows if r.site == site] for site in {r.site for r in rows}}


def test_the_screen_summary_has_every_section(spark):
    key = "AKIA" + "Q7RZ4M2XW6PLD3VK"
    page = '<html lang="en"><body><script src="https://js.stripe.com/v3/"></script></body></html>'
    rows = [("big.com", "https://big.com/", 0, True, "https://big.com/", 200, "text/html", {"Server": "nginx/1.18.0"}, page)]
    rows += [_js("big.com", i, f'if (password === "N0rthDock?{i:02}") {{}} fetch("/api/v1/a{i:02}");') for i in range(1, 46)]
    rows.append(_js("big.com", 50, f'const k = "{key}";\neval(x);\nload("https://cdn.big.com/page/1")', "https://big.com/static/chunks/with/a/long/path/app-50.js"))
    rows += [_js("big.com", 51 + i, 'const n = "SELECT name FROM depots WHERE id = 7";') for i in range(2)]
    rows.append(_js("none.com", 0, "let a = 1;"))
    scan = Scan(_captures(spark, rows))
    got = _screen(scan)
    lines = [r.line for r in got["big.com"]]
    assert lines[:2] == ["SCAN SUMMARY", "Target      big.com"] and lines[2].startswith("Requests    49 request(s)   ·   ")
    assert lines[3].startswith("Findings    1 CRITICAL  46 HIGH  ")
    assert lines[4] == "1 low-confidence finding(s) hidden; min_confidence TENTATIVE shows them"
    headings = [x for x in lines if x.startswith("[")]
    assert headings[:5] == [
        "[+] TECHNOLOGIES & VERSIONS", "[+] THIRD-PARTY SERVICES", "[!] SECRETS & CREDENTIALS",
        "[!] VULNERABILITIES & BAD PRACTICES", "[!] INFORMATION EXPOSURE"]
    assert headings[5] == "[+] SECURITY HEADERS" and headings[6] == "[+] API ENDPOINTS (46)"
    assert headings[7] == "[+] 47 URL(s) collected (1 external, 45 same-origin, 1 subdomain)"
    assert "  nginx  1.18.0  server  server header" in lines and "  Stripe  payments  stripe.com" in lines
    assert f"  CRITICAL  Conf  AWS Access Key ID  {key[:6]}…{key[-4:]}  …/app-50.js:1" in lines and not any(key in x for x in lines)
    # the first 40 rows of a category, how many more there are, and every detail of HIGH and worse
    high = [x for x in lines if x.startswith("  HIGH  Firm  Client-side password comparison")]
    assert [x.split("?")[1][:2] for x in high] == [f"{i:02}" for i in range(1, 41)]
    assert high[0].endswith("  https://big.com/1.js:1") and "  … and 6 more in the report file" in lines
    assert lines.count("  ▸ Client-side password comparison The page compares what was typed with a password that it carries.") == 45
    at = lines.index("  ▸ Raw SQL statement in front-end code Delivered code holds a whole SQL statement. It tells tables and columns, "
                     "and hints at a page that queries the database itself.")
    assert lines[at + 1].startswith("    fix: Let the server own the statement") and lines[at - 1].startswith("    fix: ")
    assert not any("▸" in x and "Missing security header" in x for x in lines)
    calls = [x for x in lines if x.startswith("  GET  ")]
    assert calls[0] == "  GET  https://big.com/api/v1/a01  api  same-origin" and len(calls) == 40
    figures = {(r.requests, r.headline, r.hidden) for r in got["big.com"] if r.section == 0}
    assert figures == {(49, lines[3].removeprefix("Findings    "), 1)}
    assert all(r.headline is None for r in got["big.com"] if r.section > 0)
    assert [r.line for r in got["none.com"]][3:] == ["Findings    no findings above the confidence threshold"]


def test_the_screen_summary_counts_rows_and_places(spark):
    from panewise.functions.sqlexpr import F
    from panewise.model import Options
    from panewise.operators.findings import tags_of, to_findings

    def depots(scan):
        rows = scan.assets.where("site = 's.com'").withColumn("title", F.concat(F.lit("Depot "), F.col("asset_seq").cast("string")))
        return to_findings(
            rows, "misc", "Depots", severity=F.lit("HIGH"), confidence=F.lit("TENTATIVE"), value=F.lit(""),
            detail=F.lit("Two\nlines."), remediation=F.lit(""), line=F.lit(0), col=F.lit(0),
            snippet=F.rpad(F.lit("x"), 90, "x"), tags=tags_of("own"),
        )

    rows = [_js("s.com", i, "debug: true") for i in range(3)] + [_js("s.com", 9, "x", "https://s.com/gone.js")]
    rows[-1] = (*rows[-1][:5], 404, *rows[-1][6:])
    rows += [_js("s.com", 4, "y", "https://s.com/" + "d" * 50 + "/")]
    scan = Scan(_captures(spark, rows), options=Options(min_confidence="TENTATIVE"), extra=(depots,))
    lines = [r.line for r in _screen(scan, max_rows=2, verbose=True)["s.com"]]
    assert any(x.endswith("  https://s.com/0.js:1 (+2 more)") for x in lines)
    at = lines.index("[!] DEPOTS")  # a detector's own category, after the others
    assert at > lines.index("[!] VULNERABILITIES & BAD PRACTICES")
    assert lines[at + 2] == f"  HIGH  Tent  Depot 0  {'x' * 80}  https://s.com/0.js"
    assert lines[at + 4:] == ["  … and 2 more in the report file", "  ▸ Depot 0 Two lines.", "  ▸ Depot 1 Two lines.",
                              "  ▸ Depot 2 Two lines.", "  ▸ Depot 4 Two lines.", "", "Request errors", "  https://s.com/gone.js: HTTP 404"]
    whole = [r.line for r in _screen(scan)["s.com"]]
    assert f"  HIGH  Tent  Depot 4  {'x' * 80}  {'d' * 45}/" in whole
    assert not any("Request errors" in x or "hidden" in x for x in whole)


def test_walk_follows_links_by_level(spark):
    def page(seq, url, links):
        body = "<html>" + "".join(f'<a href="{x}">x</a>' for x in links)
        return ("w.com", "https://w.com/", seq, seq == 0, url, 200, "text/html", {}, body)

    rows = [page(0, "https://w.com/", ["/a", "/missing"]), page(1, "https://w.com/a", ["/b#x", "/"]),
            page(2, "https://w.com/b", ["/c"]), page(3, "https://w.com/c", []), page(4, "https://w.com/island", [])]
    assets = scan_responses(_captures(spark, rows))
    got = {(r.url, r.depth) for r in lk.page_reachability(assets, 2).collect()}
    assert got == {("https://w.com/", 0), ("https://w.com/a", 1), ("https://w.com/b", 2)}


def test_asset_cap_keeps_the_first(spark):
    assets = scan_responses(_captures(spark, [_js("c.com", i, "x") for i in range(10)]))
    assert sorted(r.asset_seq for r in asset_cap(assets, 3).collect()) == [0, 1, 2]


def test_targets(spark):
    rows = spark.createDataFrame([(t,) for t in (" example.com ", "http://h.com:81/p?q#f", "ftp://x.com", "", "a b.com", "[::1]")], "target string")
    got = {r.target: r for r in normalize_target(rows).collect()}
    assert got[" example.com "].base_url == "https://example.com/" and got[" example.com "].scheme_inferred
    assert got["http://h.com:81/p?q#f"].base_url == "http://h.com:81/p?q" and got["http://h.com:81/p?q#f"].domain == "h.com"
    assert got["ftp://x.com"].reject_reason == "unsupported scheme"
    assert got[""].reject_reason == "empty target" and got["a b.com"].reject_reason == "invalid hostname"
    assert got["[::1]"].base_url == "https://[::1]/"


def test_unknown_detector_is_an_error():
    assert select_detectors(skip=("xss",)) == ("technology", "secrets", "sql", "misc", "access", "endpoints", "headers")
    with pytest.raises(ValueError):
        select_detectors(only=("nope",))


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from panewise.plans.scan import Scan
    from panewise.streaming.scan import SiteTables, read_capture_stream, stream_scan

    rows = [_js("st.com", i, f"debug: true; el.innerHTML = location.hash; const userRole = 'admin{i}'; fetch('/api/v1/a{i % 3}');") for i in range(6)]
    rows.append(("st.com", "https://st.com/", 20, True, "https://st.com/", 200, "text/html", {"Server": "nginx/1.18.0"},
                 '<link href="/wp-content/plugins/one/a.css?ver=1.2"><script src="https://js.stripe.com/v3/"></script>'))
    rows.append(_js("st.com", 21, 'jQuery.fn.jquery = "1.2.3"; fetch("/api/v1/a1", {method: "POST"}); w = "wss://st.com/live"', "https://st.com/jq.js"))
    rows.append(("st.com", "https://st.com/", 22, False, "https://st.com/.env", 200, "text/plain", {}, "A=b"))
    late = _js("st.com", 6, "debug: true; var late = 1;", "https://st.com/late.js")
    rows += [(*late[:5], 404, *late[6:]), ("st.com", late[1], 7, *late[3:])]  # an error, then the page
    rows.append(_js("st.com", 8, '{"version":3,"sources":["a.ts"],"sourcesContent":["debug: true"]}', "https://st.com/m.js.map"))
    repeat = _js("st.com", 90, "debug: true", "https://st.com/0.js")  # a repeated fetch
    arrived = _captures(spark, [*rows, repeat]).withColumn("fetched_at", F.timestamp_seconds(F.col("asset_seq") + 1704067200))
    for low, high in ((0, 21), (21, 100)):
        arrived.where(f"asset_seq >= {low} and asset_seq < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tables, seen = SiteTables(spark, str(tmp_path / "out")), []

    note = lambda _tables, batch: seen.append(batch)
    stream_scan(read_capture_stream(spark, str(tmp_path / "in"), 1), tables, str(tmp_path / "ck"), on_batch=note).awaitTermination()
    scan = Scan(_captures(spark, rows))
    assert len(seen) == 2
    for name in ("technologies", "services", "endpoints", "urls", "emails"):
        want, got = getattr(scan, name), getattr(tables, name)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), name
    show = ("site", "category", "title", "key", "severity", "confidence", "url", "line", "mentions")
    want = sorted(tuple(r) for r in scan.findings.select(*show).collect())
    assert sorted(tuple(r) for r in tables.findings.select(*show).collect()) == want
    assert {"Outdated component: jQuery 1.2.3", "WordPress plugins enumerated"} <= {r[2] for r in want}
    tables.add(_captures(spark, [r for r in rows if r[2] >= 21]), seen[-1])  # a batch that is tried again changes nothing
    assert sorted(tuple(r) for r in tables.technologies.collect()) == sorted(tuple(r) for r in scan.technologies.select(*tables.technologies.columns).collect())


def test_stream_of_captures_scans_every_capture_of_a_url(spark, tmp_path):
    from pyspark.sql import functions as F

    from panewise.streaming.scan import SiteTables, each_capture, read_capture_stream, stream_scan

    rows = [_js("two.com", i, f"load('https://two.com/page/{i}')", "https://two.com/a.js") for i in range(2)]
    arrived = _captures(spark, rows).withColumn("fetched_at", F.timestamp_seconds(F.col("asset_seq") + 1704067200))
    for _ in range(2):  # delivered twice
        arrived.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tables = SiteTables(spark, str(tmp_path / "out"))
    stream = read_capture_stream(spark, str(tmp_path / "in"), 1)
    stream_scan(stream, tables, str(tmp_path / "ck"), once=each_capture).awaitTermination()
    assert sorted(r.url for r in tables.urls.collect()) == ["https://two.com/page/0", "https://two.com/page/1"]


def test_stream_query_equals_batch_where_a_url_is_captured_twice(spark, tmp_path):
    from panewise.queries import Corpus

    pages = [(i, "https://twice.example.org/p", f'<a href="https://twice.example.org/x/{i}">{i}</a>') for i in range(1, 4)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    texts = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    c = Corpus(spark, str(tmp_path))
    batch, stream = (sorted(map(tuple, QUERIES[q](c).collect())) for q in ("dedupe_urls", "stream_urls"))
    assert stream == batch and {f"https://twice.example.org/x/{i}" for i in range(1, 4)} <= {r[1] for r in batch}


def test_batches_are_scanned_with_aqe(spark, tmp_path):
    """The session of a stateful stream has none: there each shuffle keeps all of its partitions."""
    from pyspark.sql import functions as F

    from panewise.streaming.scan import SiteTables, read_capture_stream, stream_scan

    class Noted(SiteTables):
        def add(self, captures, batch_id):
            seen.append(captures.sparkSession.conf.get("spark.sql.adaptive.enabled"))
            rows.extend(captures.select("url").collect())

    seen, rows = [], []
    arrived = _captures(spark, [_js("aqe.com", i, "debug: true", f"https://aqe.com/{i}.js") for i in range(3)])
    arrived = arrived.withColumn("fetched_at", F.timestamp_seconds(F.col("asset_seq") + 1704067200))
    arrived.coalesce(1).write.parquet(str(tmp_path / "in"))
    tables = Noted(spark, str(tmp_path / "out"))
    stream_scan(read_capture_stream(spark, str(tmp_path / "in")), tables, str(tmp_path / "ck")).awaitTermination()
    assert seen == ["true"] and sorted(r.url for r in rows) == [f"https://aqe.com/{i}.js" for i in range(3)]


def test_a_stream_query_runs_the_detectors_of_its_table(spark, tmp_path):
    from panewise.plans.scan import DETECTORS
    from panewise.queries import Corpus

    pages = [(i, f"https://few.example.org/{i}", '<script src="https://js.stripe.com/v3/"></script>') for i in range(4)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    texts = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    c = Corpus(spark, str(tmp_path))
    batch, stream = (sorted(map(tuple, QUERIES[q](c).collect())) for q in ("dedupe_services", "stream_services"))
    assert stream == batch and batch
    [(ran, tables)] = c.streamed.items()
    assert ran == ("technology",) and tables.versions("services") and not tables.versions("endpoints")
    QUERIES["stream_scan"](c)
    assert set(c.streamed) == {("technology",), DETECTORS}
    QUERIES["stream_endpoints"](c)  # the whole stream serves it
    assert set(c.streamed) == {("technology",), DETECTORS}


def test_own_detector(spark):
    from panewise.operators import rule_join as rj
    from panewise.operators.findings import tags_of, to_findings
    from panewise.operators.regions import code_regions
    from panewise.plans.scan import Scan
    from panewise.functions.sqlexpr import F

    def depots(scan):
        rules = spark.createDataFrame([("own", "DEPOT-[0-9]+", 0, ["depot-"], [])], rj.RULES)
        keys = ("site", "asset_seq", "url", "region_idx")
        hits = rj.rule_hits(code_regions(scan.assets), rules, keys)
        return to_findings(
            hits, "misc", "Information Exposure", pos=F.col("start"), title=F.lit("Depot number"), severity=F.lit("LOW"),
            confidence=F.lit("FIRM"), value=F.col("text"), detail=F.lit("A depot is named."), remediation=F.lit(""),
            line=F.lit(1), col=F.col("start") + 1, snippet=F.col("text"), tags=tags_of("own"),
        )

    scan = Scan(_captures(spark, [_js("own.com", 1, "const d = 'DEPOT-77';")]), extra=(depots,))
    assert [r.value for r in scan.findings.where("title = 'Depot number'").collect()] == ["DEPOT-77"]


def test_every_query_has_an_oracle_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"sink_markdown", "sink_text", "sink_json"}


def test_statements_that_differ_late_stay_two_findings(spark):
    columns = ", ".join(f"column_number_{i}" for i in range(15))
    body = "\n".join(f'var q{n} = "SELECT {columns} FROM orders WHERE kind = {n} ORDER BY id";' for n in (1, 2))
    rows = [("s", "https://s.example/", 1, True, "https://s.example/a.js", 200, "application/javascript", {}, body)]
    found = sql_statements(scan_responses(spark.createDataFrame(rows, CAPTURE_SCHEMA)))
    merged = rs.dedupe_findings(found).collect()
    assert len(merged) == 2 and all(len(r.value) > 200 for r in merged)
    assert rs.finding_places(found).count() == 2
