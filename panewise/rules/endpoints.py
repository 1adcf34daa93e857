"""Endpoint, URL, router and link patterns."""

from __future__ import annotations

from .vulns import Rule

# The engine recurses on a repeated group of varying length, so a long hostile text could end the
# JVM. Such groups are possessive where nothing can be given back; host names have 127 labels at
# most and the local part of an address 64 characters, as their standards say.
_HOST = r"(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.){1,127}[a-z]{2,24}"

ABSOLUTE_URL = r"(?i)\bhttps?://" + _HOST + r"(?::\d{2,5})?(?:/[^\s\"'`<>\\)\]}]*)?"
PROTOCOL_RELATIVE = r"(?i)(?<![:\w])//(" + _HOST + r"(?:/[^\s\"'`<>]*)?)"
WEBSOCKET = r"(?i)\bwss?://[^\s\"'`<>]{4,}"
TRAILING_JUNK = r"[),;:.'\"\\]+$"
INTERPOLATED_TAIL = r"\$\{[\s\S]*$"

API_PATH = (
    r"(?i)^/(?:api|apis|rest|graphql|gql|v[0-9]{1,2}|rpc|oauth2?|auth|admin|internal"
    r"|webhook|webhooks|_next/data|wp-json|services?|backend|gateway|query)"
    r"(?:/[\w\-.~%:@]+|/\$\{[^}]{1,60}\}|/:[\w]+|/\*)*+/?$"
)
GENERIC_API_PATH = (
    r"(?i)^/[\w\-./]{2,}/(?:list|create|update|delete|search|login|logout|register|signup"
    r"|signin|token|refresh|profile|me|upload|download|export|import|status|health"
    r"|checkout|payment|order|orders|users?|customers?|products?|items?)"
    r"(?:/[\w\-.:${}]*)*+/?$"
)
FETCH_CALL = (
    r"(?i)\b(?:fetch|axios|request|http|api|client|instance|\$\.ajax|superagent|ky|got)"
    r"\s*(?:\.\s*(get|post|put|patch|delete|head|options)\s*)?"
    r"\(\s*[`\"']([^`\"']++)[`\"']"
)
METHOD_OPTION = (
    r"(?i)\b(?:method|type)\s*:\s*[\"'](GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)[\"']"
)
METHOD_URL = (
    r"(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+"
    r"(https?://[^\s\"'`<>]{4,}|/[\w\-./]{2,})"
)
ROUTE_DECLARATION = r"(?i)\bpath\s*:\s*[\"'](/[^\"']*+)[\"']"
EMAIL = r"\b[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,127}[A-Za-z]{2,24}\b"
EMAIL_NOT = (".png", ".jpg", ".gif", ".js", ".css")
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"

STATIC_EXTENSIONS = (
    ".js", ".mjs", ".cjs", ".css", ".map", ".png", ".jpg", ".jpeg", ".gif",
    ".svg", ".webp", ".avif", ".ico", ".bmp", ".woff", ".woff2", ".ttf",
    ".eot", ".otf", ".mp4", ".webm", ".mp3", ".wav", ".pdf", ".zip", ".gz",
    ".txt", ".xml", ".rss", ".atom", ".webmanifest",
)
NON_BACKEND_HOSTS = (
    "fonts.googleapis.com", "fonts.gstatic.com", "cdnjs.cloudflare.com",
    "unpkg.com", "jsdelivr.net", "bootstrapcdn.com", "w3.org", "schema.org",
    "gmpg.org", "purl.org", "creativecommons.org", "github.com",
    "googletagmanager.com", "google-analytics.com", "doubleclick.net",
    "facebook.com", "facebook.net", "twitter.com", "x.com", "instagram.com",
    "linkedin.com", "youtube.com", "ytimg.com", "vimeo.com", "wordpress.org",
    "mozilla.org", "apache.org", "wixstatic.com",
)
NOT_AN_ADDRESS = ("data:", "blob:", "mailto:", "tel:", "javascript:", "#")

# Links between captures.
UNRESOLVABLE = ("data:", "javascript:", "mailto:", "tel:", "#", "blob:")
INLINE_SCRIPT_URL = r"[\"'`]([^\"'`\s]+\.(?:js|mjs|json))(?:\?[^\"'`\s]*)?[\"'`]"
SOURCEMAP_COMMENT = r"//[#@]\s*sourceMappingURL\s*=\s*([^\s*]+)"
NEXT_CHUNK = r"[\"'](/_next/static/[^\"']+\.js)[\"']"
NEXT_BUILD_ID = r"\"buildId\"\s*:\s*\"([^\"]{1,64})\""
MANIFEST_PATHS = (
    ("Next.js", "/_next/static/chunks/webpack.js"),
    ("Next.js", "/_next/static/chunks/main.js"),
    ("Next.js", "/_next/static/chunks/pages/_app.js"),
    ("Next.js", "/_next/static/chunks/pages/index.js"),
    ("Nuxt", "/_nuxt/manifest.json"),
    ("WordPress", "/wp-json/"),
    ("WordPress", "/wp-json/wp/v2/types"),
)
BUILD_MANIFESTS = ("_buildManifest.js", "_ssgManifest.js", "_middlewareManifest.js")

CALL_RULES = (
    Rule("ep_call", "", FETCH_CALL, "INFO",
         ("fetch", "axios", "request", "http", "api", "client", "instance", "$.ajax",
          "superagent", "ky", "got"), groups=2, tail=240, needs=("(",)),
    Rule("ep_mention", "", METHOD_URL, "INFO",
         ("get", "post", "put", "patch", "delete", "head", "options"), groups=2, needs=("/",)),
    Rule("ep_route", "", ROUTE_DECLARATION, "INFO", ("path",), groups=1, needs=("/",)),
)
