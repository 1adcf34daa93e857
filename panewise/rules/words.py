"""Word lists of the value filters."""

# Literal values that look like a secret to a pattern and never are one.
PLACEHOLDER_VALUES = (
    # generic stand-ins
    "", " ", "-", "--", "n/a", "na", "none", "null", "nil", "undefined", "empty",
    "true", "false", "0", "1", "test", "tests", "testing", "demo", "sample",
    "example", "examples", "dummy", "fake", "mock", "mocked", "placeholder",
    "changeme", "change_me", "todo", "tbd", "xxx", "xxxx", "yyy", "zzz", "foo",
    "bar", "baz", "qwerty", "unknown", "default", "value", "string", "number",
    "boolean", "object", "array", "text", "hidden", "required", "optional",
    # the key's own name as its value
    "password", "passwd", "pass", "secret", "secrets", "token", "apikey",
    "api_key", "api-key", "apisecret", "api_secret", "accesstoken",
    "access_token", "refresh_token", "id_token", "clientsecret",
    "client_secret", "client_id", "clientid", "privatekey", "private_key",
    "publickey", "public_key", "credential", "credentials", "authorization",
    "auth", "authtoken", "auth_token", "bearer", "basic", "jwt", "key", "keys",
    "username", "user", "userid", "user_id", "email", "login", "admin",
    "password123", "yourpassword", "your_password", "your-password",
    # request option values
    "same-origin", "include", "omit", "cors", "no-cors", "navigate",
    "no-store", "no-cache", "force-cache", "only-if-cached", "reload",
    "default-src", "follow", "error", "manual", "application/json",
    # enum values
    "on", "off", "yes", "no", "auto", "always", "never", "enabled", "disabled",
    "production", "development", "staging", "local", "localhost",
    "utf-8", "utf8", "get", "post", "put", "patch", "delete", "head", "options",
)

# Shapes of templates and placeholders, searched in the trimmed value.
PLACEHOLDER_SHAPES = (
    r"(?i)^[\s*x•·.\-_=#?]+$",
    r"\$\{[^}]*\}",
    r"\{\{[^}]*\}\}",
    r"<%[-=]?[\s\S]*?%>",
    r"%\(?[sd]\)?\b",
    r"^<[^>]+>$",
    r"^\[[^\]]+\]$",
    r"(?i)\b(?:process\.env|import\.meta\.env|os\.environ)\b",
    r"(?i)^(?:your|my|the|a|an|some|insert|enter|replace|add|put)[\s_\-]",
    r"(?i)(?:^|[\s_\-])(?:goes[\s_\-]?)?here$",
    r"(?i)^(?:sk|pk|key|token|secret)[\-_](?:test|example|sample|xxx|123)",
    r"(?i)^(?:redacted|removed|hidden|masked|obfuscated|sanitized)$",
    r"^#[0-9a-fA-F]{3,8}$",
    r"(?i)^(?:rgba?|hsla?|calc|var|url|translate|matrix)\(",
    r"(?i)^\d+(?:\.\d+)*+(?:px|em|rem|vh|vw|%|s|ms|deg)?$",
    r"^[/.]{0,2}/[\w\-./]*$",
    r"(?i)^data:[a-z]+/",
)

# English and Spanish stop words.
COMMON_WORDS = (
    # english
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "by",
    "at", "from", "as", "is", "are", "be", "was", "were", "this", "that",
    "these", "those", "your", "our", "my", "their", "its", "it", "you", "we",
    "they", "he", "she", "all", "any", "some", "more", "most", "other", "which",
    "what", "where", "when", "who", "how", "why", "here", "there", "please",
    "one", "two", "three", "list", "item", "items", "page", "pages", "below",
    "above", "next", "previous", "click", "select", "choose", "option",
    "options", "available", "up", "down", "out", "over", "under", "again",
    "us", "them", "him", "her", "can", "will", "would", "should", "may",
    "must", "have", "has", "had", "do", "does", "did", "get", "got", "make",
    "made", "see", "seen", "use", "used", "using", "want", "need", "like",
    "new", "old", "best", "free", "now", "today", "time", "day", "year",
    # spanish
    "el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "y",
    "o", "en", "con", "por", "para", "que", "se", "su", "sus", "lo", "al",
    "como", "mas", "pero", "sin", "sobre", "entre", "hasta", "desde", "todo",
    "toda", "todos", "todas", "este", "esta", "estos", "estas", "ser", "estar",
    "tiene", "hacer", "puede", "aqui", "alli", "nuestro", "nuestra", "tu",
    "seleccione", "elegir", "elija", "pagina", "inicio", "buscar",
)

VENDOR_URL = (
    r"(?i)/(?:node_modules|vendor|bower_components)/"
    r"|(?:^|/)(?:jquery|bootstrap|lodash|moment|underscore|angular|vue|react"
    r"|polyfill|core-js|regenerator|swiper|slick|gsap|three|chart|d3|axios"
    r"|popper|modernizr|tailwind|fontawesome)[.\-@]?[\d.]*(?:\.min)?\.js"
)

ROUTE_LIKE = r"^[a-z][a-z0-9_.\-]*(?:/(?:[a-z0-9_.\-]+|\{[^}]{1,40}\}|:[a-z]\w*))++/?$"
MIME_LIKE = (
    r"^(?:application|audio|font|image|message|model|multipart|text|video)/[\w.+\-]+$"
)
HTML_TAG = r"</?[a-zA-Z][\w:-]*(?:\s[^<>]{0,200})?/?>"
JSX_TAG = r"</?[A-Z][\w.]*[\s/>]"
HTML_ENTITY = r"&(?:[a-zA-Z]{2,10}|#\d{2,5});"
HTML_DOCUMENT = r"(?i)<(?:!doctype\s+html|html|head|body|div|span|p|meta|title)\b"
HASH_LENGTHS = (7, 8, 16, 20, 32, 40, 64, 128)

# Ours: what every text of an unanchored shape holds, tested before the pattern.
SHAPE_PARTS = {
    r"\$\{[^}]*\}": "${",
    r"\{\{[^}]*\}\}": "{{",
    r"<%[-=]?[\s\S]*?%>": "<%",
    r"%\(?[sd]\)?\b": "%",
}
