"""What must and must not be found, every case in one scan."""

from __future__ import annotations

import pytest

from panewise.plans.scan import Scan
from panewise.sources import corpus as c
from panewise.sources.assets import CAPTURE_SCHEMA

BASE = "https://example.com/"
JS = "https://example.com/app.js"

# (case, content, table, fragment, present, severity)
SCRIPTS = [
    ("aws", f'const k = "{c.AWS}";', "findings", "AWS Access Key", True, "CRITICAL"),
    ("stripe_sk", f'const a = "{c.STRIPE_SECRET}";', "findings", "Stripe Secret Key", True, "CRITICAL"),
    ("stripe_pk", f'const b = "{c.STRIPE_PUBLIC}";', "findings", "Stripe Publishable Key", True, "INFO"),
    ("google", f'key: "{c.GOOGLE}"', "findings", "Google API Key", True, None),
    ("jwt", f'const t = "{c.JWT_ADMIN}";', "findings", "JSON Web Token", True, "CRITICAL"),
    ("dburl", f'const url = "{c.DATABASE_URL}";', "findings", "Database Connection String", True, "CRITICAL"),
    ("pem", 'const k = "-----BEGIN RSA ' + 'PRIVATE KEY-----\\nMIIE...";', "findings", "Private Key", True, None),
    ("generic", f'const clientSecret = "{c.GENERIC}";', "findings", "credential", True, None),
    ("github", f'a="{c.GITHUB}"; b="{c.SLACK}";', "findings", "GitHub Token", True, None),
    ("slack", f'a="{c.GITHUB}"; b="{c.SLACK}";', "findings", "Slack Token", True, None),
    ("sql_raw", 'const q = "SELECT id, email FROM users WHERE active = 1 ORDER BY id";', "findings", "Raw SQL", True, "HIGH"),
    ("sql_tpl", "const q = `SELECT * FROM orders WHERE user_id = ${userId} LIMIT 10`;", "findings", "SQL injection", True, "CRITICAL"),
    ("sql_concat", 'var q = "SELECT * FROM accounts WHERE name = \'" + name + "\'";', "findings", "SQL", True, None),
    ("sql_insert", 'const a = "INSERT INTO logs (msg, level) VALUES (?, ?)";', "findings", "SQL", True, None),
    ("sql_update", 'const b = "UPDATE users SET role = ? WHERE id = ?";', "findings", "SQL", True, None),
    ("sql_delete", 'const c = "DELETE FROM sessions WHERE expires_at < NOW()";', "findings", "SQL", True, None),
    ("prisma", "const users = await prisma.user.findMany({where:{id}});", "findings", "Prisma", True, None),
    ("roles", 'const ROLES = ["admin", "editor", "viewer"];', "findings", "catalogue", True, None),
    ("app_roles", 'const APP_ROLES = ["admin", "editor", "viewer"];', "findings", "catalogue", True, None),
    ("role_name", 'const userRole = "super_admin";', "findings", "Privileged role", True, None),
    ("permission", 'can("invoice.delete") && can("user.manage")', "findings", "Permission identifier", True, None),
    ("authz", "if (user.isAdmin) { showAdminPanel(); }", "findings", "Client-side authorization", True, None),
    ("bypass", "const config = { skipAuth: true };", "findings", "bypass", True, None),
    ("role_const", 'const R = "ROLE_SUPER_ADMIN";', "findings", "role", True, None),
    ("xss_taint", "el.innerHTML = location.hash.substring(1);", "findings", "innerHTML", True, "MEDIUM"),
    ("xss_clean", "el.innerHTML = renderTemplate(data);", "findings", "innerHTML", True, "LOW"),
    ("internal", 'const api = "http://10.0.5.23:8080/internal";', "findings", "Internal", True, None),
    ("internal2", 'const api = "https://billing.internal:8443/v1";', "findings", "Internal", True, None),
    ("password", 'if (password === "Sup3rS3cret!") login();', "findings", "password comparison", True, None),
    ("storage", 'localStorage.setItem("access_token", token);', "findings", "Web Storage", True, None),
    ("tls", "const agent = new https.Agent({rejectUnauthorized: false});", "findings", "TLS verification", True, None),
    ("http", 'const api = "http://api.example.com/v1/orders";', "findings", "Insecure HTTP", True, None),
    ("redirect", "location.href = params.redirectUrl;", "findings", "Open redirect", True, None),
    ("staging", 'const api = "https://staging.example.com/api/v1";', "findings", "Staging", True, None),
    ("staging2", 'const api = "https://api-dev.example.com/v1";', "findings", "Staging", True, None),
    ("jquery", 'jQuery.fn.jquery = "3.4.1";', "findings", "Outdated component", True, None),
    ("routes", c.ROUTE_TABLE, "endpoints", "member/reset_secret", True, None),
    ("route_cred", c.ROUTE_TABLE, "findings", "credential", False, None),
    ("mime_route", c.ROUTE_TABLE + 'a.type="text/html";b.type="image/png";', "endpoints", "text/html", False, None),
    ("tokens", 'a="bg.emphasized/60",b="blue.500/40",c="fg.muted/80",d="cart/update_cart",'
               'e="banner/get_banners",f="campaign/active";', "endpoints", "cart/update_cart", True, None),
    ("tokens2", 'a="bg.emphasized/60",b="blue.500/40",c="fg.muted/80",d="cart/update_cart",'
                'e="banner/get_banners",f="campaign/active";', "endpoints", "emphasized", False, None),
    ("vitals", "fetch(`https://vitals.example.com/v2/vitals?dsn=${a}`);", "endpoints", "${", False, None),
    # must not be found
    ("fetch_opt", 'fetch(url, {credentials:"same-origin", mode:"cors"});', "findings", "credential", False, None),
    ("echo", 'const cfg = {api_key:"apikey", password:"password"};', "findings", "credential", False, None),
    ("env", 'const key = "${NEXT_PUBLIC_API_KEY}"; const t = "{{ token }}";', "findings", "credential", False, None),
    ("mask", 'token: "****************", secret: "xxxxxxxxxxxxxxxx"', "findings", "credential", False, None),
    ("repeat", 'const secret = "abcabcabcabc"; const token = "aaaaaaaaaaaaaaa";', "findings", "credential", False, None),
    ("not_jwt", 'const blob = "eyJub3RhdG9rZW4iZmFrZQ.eyJzdGlsbG5vdGFqd3Q.zzz";', "findings", "JSON Web Token", False, None),
    ("hash", 'const token = "a3f5c9e1b2d4f6a8c0e2b4d6f8a0c2e4";', "findings", "credential", False, None),
    ("escaped", r'{"endpoints":{"authorization":"https:\/\/wordpress.org\/wp-admin\/authorize.php"}}', "findings", "credential", False, None),
    ("i18n", c.I18N, "findings", "credential", False, None),
    ("minified", 'a.token="+d);switch($[0]){case 1:n.push(d),r.push(this.lexer.yytext),'
                 'i.push(this.lexer.yylloc),n.push($[1]),d=null"', "findings", "credential", False, None),
    ("tpl", 'const tpl = "<ul><li>Select an option from the list below</li></ul>";', "findings", "SQL", False, None),
    ("icon", 'const label = "select icon from set";', "findings", "SQL", False, None),
    ("comment", "// SELECT * FROM users WHERE id = 1;\nconst x = 1;", "findings", "SQL", False, None),
    ("css", 'const css = "select.form-control { color: red }";', "findings", "SQL", False, None),
    ("mime_perm", 'const types = ["image.read", "application.view"];', "findings", "Permission identifier", False, None),
    ("control", 'const m = {Alt:"altKey", Control:"ctrlKey", Shift:"shiftKey"};', "findings", "role", False, None),
    ("language", "const d = e.toLocaleDateString(window.navigator.language);"
                 "if (p.localName == v) { return c.localName; }", "findings", "Internal", False, None),
    ("w3", 'const NS = "http://www.w3.org/2000/svg";const M = "http://www.w3.org/1998/Math/MathML";', "findings", "Insecure HTTP", False, None),
    ("next", "window.location.href = window.next.__pendingUrl.toString();", "findings", "Open redirect", False, None),
    ("devto", 'const a = "https://dev.to/t/vue";const b = "https://developer.mozilla.org/en-US/docs";'
              'const c = "https://testing-library.com/docs";', "findings", "Staging", False, None),
]
WP = ('<link rel="stylesheet" href="/wp-content/plugins/contact-form-7/style.css?ver=5.7.2">'
      '<script src="/wp-content/plugins/woocommerce/assets/js/frontend.js?ver=8.1.0"></script>')
# (case, content, headers, table, fragment, present)
PAGES = [
    ("inline_sql", '<html><p>Select a plan from our catalogue</p><script>const q = "SELECT password_hash FROM users '
                   "WHERE email = '\" + email;</script></html>", {}, "findings", "SQL", True),
    ("copy", "<h2>Select a plan from our catalogue</h2><p>Update your profile and set a new password whenever you "
             "want.</p><p>Delete from your cart the items you no longer need.</p>", {}, "findings", "SQL", False),
    ("copy_es", "<p>Seleccione un producto de nuestra tienda</p><div>Insert into the box</div>", {}, "findings", "SQL", False),
    ("aria", '<div role="button"></div><nav role="navigation"></nav>', {}, "findings", "role", False),
    ("wp", WP, {}, "findings", "WordPress plugins enumerated", True),
    ("server", "<html></html>", {"Server": "nginx/1.18.0"}, "findings", "version disclosed", True),
    ("server_t", "<html></html>", {"Server": "nginx/1.18.0"}, "technologies", "nginx", True),
    ("csp", "<html></html>", {"Content-Type": "text/html"}, "findings", "Content-Security-Policy", True),
    ("hsts", "<html></html>", {"Content-Type": "text/html"}, "findings", "Strict-Transport-Security", True),
    ("cors", "<html></html>", {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Credentials": "true"},
     "findings", "Dangerous CORS", True),
    ("cookie", "<html></html>", {"Set-Cookie": "sessionid=abc; Path=/"}, "findings", "missing", True),
    ("nuxt", "window.__NUXT__={};", {}, "technologies", "Nuxt", True),
    ("nextjs", '<script src="/_next/static/chunks/main.js"></script>', {}, "technologies", "Next.js", True),
    ("vue", 'Vue.version = "3.2.47";', {}, "technologies", "Vue.js", True),
    ("angular", '<div ng-version="15.1.0"></div>', {}, "technologies", "Angular", True),
    ("wordpress", '<link href="/wp-content/themes/x/style.css">', {}, "technologies", "WordPress", True),
    ("gtm", '<script src="https://www.googletagmanager.com/gtm.js"></script>', {}, "services", "Google Tag Manager", True),
    ("stripe", '<script src="https://js.stripe.com/v3/"></script>', {}, "services", "Stripe", True),
]


def _row(case, url, content, headers, main=True, seq=0, kind="application/javascript"):
    return (case, BASE, seq, main, url, 200, kind, headers, content)


@pytest.fixture(scope="module")
def found(spark):
    rows = [_row(f"s:{x[0]}", JS, x[1], {}) for x in SCRIPTS]
    rows += [_row(f"p:{x[0]}", BASE, x[1], x[2], kind="text/html") for x in PAGES]
    rows += [
        _row("vendor", "https://example.com/vendor/jquery-3.6.0.min.js", 'var x = {token: "aaaa"};', {}),
        _row("third", BASE, "<html></html>", {}, kind="text/html"),
        _row("third", "https://www.googletagmanager.com/gtm.js", "x", {"Server": "Google Tag Manager"}, False, 1),
        _row("themes", BASE, '<link href="/wp-content/themes/advantage-theme/style.css?ver=2.1">', {}, kind="text/html"),
        _row("themes", "https://example.com/a.js", '"/wp-content/themes/advantage-theme-child/app.js"', {}, False, 1),
        _row("wpjson", "https://example.com/wp-json/", '{"routes":{"/wp/v2/users":{},"/tangible/v1/token":{}}}', {},
             kind="application/json"),
        _row("cloud", BASE, "<html></html>", {"Server": "cloudflare", "CF-Ray": "abc-XYZ"}, kind="text/html"),
        _row("calls", JS, 'fetch("/api/v1/users", {method: "POST", body: b});\naxios.delete("/api/v1/users/42");\n'
                          'const ws = "wss://realtime.example.com/socket";', {}),
        _row("gen", BASE, '<meta name="generator" content="WordPress 7.2-alpha-63632">', {}, kind="text/html"),
        _row("map", BASE, "<html></html>", {}, kind="text/html"),
        _row("map", "https://example.com/a.js.map",
             '{"sources":["a.js"],"sourcesContent":["el.innerHTML = location.hash;"]}', {}, False, 1, "application/json"),
        _row("env", "https://example.com/.env", "A=1", {}, False, 1, "text/plain"),
        _row("fakeenv", "https://example.com/.env", "<!doctype html><html>a=1", {}, False, 1, "text/html"),
    ]
    scan = Scan(spark.createDataFrame(rows, CAPTURE_SCHEMA))
    return {
        "scan": scan,
        "findings": [r.asDict() for r in scan.findings.collect()],
        "endpoints": [dict(r.asDict(), title=r["url"]) for r in scan.endpoints.collect()],
        "technologies": [dict(r.asDict(), title=r["name"]) for r in scan.technologies.collect()],
        "services": [dict(r.asDict(), title=r["name"]) for r in scan.services.collect()],
    }


def _matching(found, table, site, fragment):
    return [r for r in found[table] if r["site"] == site and fragment.lower() in r["title"].lower()]


@pytest.mark.parametrize("case", SCRIPTS, ids=lambda x: x[0])
def test_script(found, case):
    name, _content, table, fragment, present, severity = case
    rows = _matching(found, table, f"s:{name}", fragment)
    assert bool(rows) == present
    if severity:
        assert rows[0]["severity"] == severity


@pytest.mark.parametrize("case", PAGES, ids=lambda x: x[0])
def test_page(found, case):
    name, _content, _headers, table, fragment, present = case
    assert bool(_matching(found, table, f"p:{name}", fragment)) == present


def test_token_claims_are_evidence(found):
    row = _matching(found, "findings", "s:jwt", "JSON Web Token")[0]
    assert row["evidence"]["claims"] == "exp, role, sub"
    assert "privileged" in row["detail"]


def test_vendor_file_is_quiet(found):
    assert not _matching(found, "findings", "vendor", "credential")


def test_third_party_header_is_not_the_sites_stack(found):
    assert not _matching(found, "technologies", "third", "Google Tag Manager")


def test_themes_are_reported_once(found):
    rows = _matching(found, "findings", "themes", "themes enumerated")
    assert [r["value"] for r in rows] == ["advantage-theme 2.1, advantage-theme-child"]


def test_wp_json_routes_keep_their_namespace(found):
    urls = {r["url"] for r in found["endpoints"] if r["site"] == "wpjson"}
    assert "https://example.com/wp-json/tangible/v1/token" in urls
    assert "https://example.com/wp/v2/users" not in urls


def test_case_variants_merge(found):
    names = [r["name"] for r in found["technologies"] if r["site"] == "cloud"]
    assert names.count("Cloudflare") == 1 and "cloudflare" not in names


def test_methods_and_sockets(found):
    rows = {(r["method"], r["url"]) for r in found["endpoints"] if r["site"] == "calls"}
    assert ("POST", "https://example.com/api/v1/users") in rows
    assert ("DELETE", "https://example.com/api/v1/users/42") in rows
    assert ("GET", "https://example.com/api/v1/users/42") not in rows
    assert ("WS", "wss://realtime.example.com/socket") in rows


def test_generator_version(found):
    row = _matching(found, "technologies", "gen", "WordPress")[0]
    assert row["version"] == "7.2-alpha-63632"


def test_map_sources_are_scanned(found):
    assert _matching(found, "findings", "map", "Source map published")[0]["severity"] == "MEDIUM"
    assert _matching(found, "findings", "map", "innerHTML")[0]["url"].endswith("(original sources)")


def test_exposed_file_is_told_from_a_catch_all_page(found):
    assert _matching(found, "findings", "env", "Environment file")
    assert not _matching(found, "findings", "fakeenv", "Environment file")


def test_reports_never_hold_a_credential(found, tmp_path, spark):
    from panewise.functions.sqlexpr import F
    from panewise.plans.reports import json_rows, markdown_lines, report_name, text_lines, write_reports

    scan = found["scan"]
    folders = write_reports(scan, str(tmp_path), "stamp", ("json", "md", "txt"))
    assert len(folders) == 3
    for rows, column in ((markdown_lines(scan), "line"), (text_lines(scan), "line"), (json_rows(scan), "json")):
        text = "\n".join(r[column] for r in rows.where("site like 's:%'").select(column).collect())
        for secret in (c.AWS, c.STRIPE_SECRET, c.GITHUB, c.JWT_ADMIN, c.GENERIC):
            assert secret not in text
    name = spark.range(1).select(report_name(F.lit("s:aws"), F.lit("stamp"))).first()[0]
    report = sorted((tmp_path / "md" / f"report={name}").glob("part-*"))
    lines = "".join(p.read_text() for p in report).split("\n")
    assert lines[0] == "# Front-end security scan — s:aws"
    assert lines.index("## Findings by severity") < lines.index("## Findings")
    assert "#### 1. [CRITICAL] AWS Access Key ID" in lines
