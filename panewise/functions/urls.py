"""URL expressions: parts, joining, scope. Null-safe on text that is no URL."""

from __future__ import annotations

from pyspark.sql import Column

from .sqlexpr import F
from ..rules import endpoints as R
from .text import let, rx, strip

# The generic URI split of RFC 3986, appendix B.
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URI, group)


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority_of(url: Column) -> Column:
    return _part(url, 2)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def host_of(url: Column) -> Column:
    """Lower-case host without user info and port; empty when there is none."""
    return let(
        F.substring_index(authority_of(url), "@", -1),
        lambda a: F.lower(
            F.when(a.startswith("["), F.regexp_extract(a, r"^\[([^\]]*)\]", 1))
            .otherwise(F.substring_index(a, ":", 1))
        ),
    )


def origin_of(url: Column) -> Column:
    return F.concat(scheme_of(url), F.lit("://"), authority_of(url))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def registrable(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _under(host: Column, root: Column) -> Column:
    return (host == root) | F.endswith(host, F.concat(F.lit("."), root))


def same_site(url: Column, base_url: Column) -> Column:
    """Same host, or a host under the same registrable name."""
    return let(
        F.struct(host_of(url).alias("host"), host_of(base_url).alias("base")),
        lambda h: (h["host"] != "") & (h["base"] != "")
        & ((h["host"] == h["base"]) | _under(h["host"], registrable(h["base"]))),
    )


def url_scope(url: Column, domain: Column) -> Column:
    """same-origin, subdomain or external, seen from ``domain``."""
    return let(
        F.struct(host_of(url).alias("host"), F.lower(domain).alias("base")),
        lambda h: F.when(
            (h["host"] == "") | (h["host"] == h["base"]), F.lit("same-origin")
        ).when(_under(h["host"], registrable(h["base"])), F.lit("subdomain"))
        .otherwise(F.lit("external")),
    )


def remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    dotted = path.rlike(r"(?:^|/)\.\.?(?:/|$)")

    def walk(segments: Column) -> Column:
        return F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(s))),
        )

    trailing = path.rlike(r"(?:^|/)\.\.?$")
    body = F.array_join(walk(F.split(F.substr(path, F.lit(2)), "/")), "/")
    tail = F.when(trailing & (body != ""), F.lit("/")).otherwise(F.lit(""))
    return F.when(dotted & path.startswith("/"), F.concat(F.lit("/"), body, tail)).otherwise(path)


def join_url(base: Column, ref: Column) -> Column:
    """RFC 3986 reference resolution for http bases."""
    parts = F.struct(
        ref.alias("ref"),
        scheme_of(ref).alias("scheme"),
        authority_of(ref).alias("authority"),
        path_of(ref).alias("path"),
        F.regexp_extract(ref, r"^[^?#]*((?:\?[^#]*)?(?:#[\s\S]*)?)$", 1).alias("rest"),
        base.alias("base"),
        origin_of(base).alias("origin"),
        path_of(base).alias("base_path"),
    )

    def joined(p: Column) -> Column:
        folder = F.when(
            p["base_path"].contains("/"), F.regexp_extract(p["base_path"], r"^([\s\S]*/)[^/]*$", 1)
        ).otherwise("/")
        base_query = F.regexp_extract(p["base"], r"^[^?#]*(\?[^#]*)?", 1)
        http = p["scheme"].isin("http", "https") & (p["authority"] != "")
        return (
            F.when(p["ref"] == "", p["base"])
            .when(http, F.concat(p["scheme"], F.lit("://"), p["authority"],
                                 remove_dots(p["path"]), p["rest"]))
            .when(p["scheme"] != "", p["ref"])
            .when(p["ref"].startswith("//"), F.concat(
                scheme_of(p["base"]), F.lit("://"), p["authority"], remove_dots(p["path"]),
                p["rest"]))
            .when(p["path"].startswith("/"),
                  F.concat(p["origin"], remove_dots(p["path"]), p["rest"]))
            .when(p["path"] != "", F.concat(
                p["origin"], remove_dots(F.concat(folder, p["path"])), p["rest"]))
            .when(p["ref"].startswith("?"), F.concat(p["origin"], p["base_path"], p["rest"]))
            .otherwise(F.concat(p["origin"], p["base_path"], base_query, p["rest"]))
        )

    return let(parts, joined)


def resolve_url(base: Column, value: Column) -> Column:
    """A link as an absolute http(s) URL, or null."""
    def resolved(v: Column) -> Column:
        skip = F.lit(False)
        for prefix in R.UNRESOLVABLE:
            skip = skip | v.startswith(prefix)
        return let(
            join_url(base, v),
            lambda u: F.when(
                ~skip & (v != "") & (u.startswith("http://") | u.startswith("https://")), u
            ),
        )

    return let(strip(F.coalesce(value, F.lit(""))), resolved)


def clean_url(url: Column) -> Column:
    """Cut at an interpolation, trim the tail; empty without two slashes."""
    return let(
        F.rtrim(F.regexp_replace(url, rx(R.INTERPOLATED_TAIL), ""), F.lit("?&=/")),
        lambda u: F.when(
            F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit(""))) >= 2, u
        ).otherwise(F.lit("")),
    )


def has_static_extension(url: Column) -> Column:
    ends = "|".join(e[1:] for e in R.STATIC_EXTENSIONS)
    return F.lower(path_of(url)).rlike(r"\.(?:" + ends + r")\z")


def is_backend_host(host: Column) -> Column:
    """No asset, analytics or social host: the hints match anywhere in the name."""
    return ~host.rlike("|".join(h.replace(".", r"\.") for h in R.NON_BACKEND_HOSTS))


def is_api_path(path: Column) -> Column:
    return let(path, lambda p: p.rlike(rx(R.API_PATH)) | p.rlike(rx(R.GENERIC_API_PATH)))


def endpoint_kind(url: Column) -> Column:
    return let(
        F.lower(path_of(url)),
        lambda p: F.when(p.contains("graphql") | p.endswith("/gql"), F.lit("graphql"))
        .when(is_api_path(p), F.lit("api"))
        .otherwise(F.lit("page")),
    )


def is_api_like(url: Column) -> Column:
    return let(
        path_of(url), lambda p: ~p.isin("", "/") & is_api_path(p)
    ) & is_backend_host(host_of(url))


def resolve_api_path(asset_url: Column, base_url: Column, path: Column) -> Column:
    """An absolute path as a URL; paths listed by a wp-json index live under it."""
    under_wp = path_of(asset_url).contains("/wp-json") & ~path.startswith("/wp-json")
    return F.when(
        under_wp, F.concat(origin_of(asset_url), F.lit("/wp-json"), path)
    ).otherwise(join_url(base_url, path))


def asset_filename(url: Column) -> Column:
    tail = F.substring_index(F.rtrim(F.substring_index(url, "?", 1), F.lit("/")), "/", -1)
    return F.when(tail == "", url).otherwise(tail)
