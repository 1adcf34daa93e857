"""Credentials in string literals: provider shapes, decoded tokens, high-entropy values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions.sqlexpr import F
from ..functions.predicates import (
    is_hash_like, is_human_text, is_jwt, is_placeholder, is_route_like, is_vendor_bundle,
    jwt_part, looks_random,
)
from ..functions.text import contains_any, exploded, let, marked, matches, pinned, rx
from ..model import SECRET, Options
from ..rules import secrets as R
from ..rules.access import JWT_AUTHZ_CLAIMS, PRIVILEGED_ROLES
from ..tables import local_table
from .findings import evidence_of, tags_of, to_findings
from .hits import hits, within_literal


def _names_secret(name: Column) -> Column:
    return name.rlike(R.SECRET_KEY)


def secret_gate(value: Column, name: Column) -> Column:
    return contains_any(value, R.PROVIDER_HINTS) | ((name != "") & _names_secret(name))


def _matches(text: Column) -> Column:
    """array<start, ord, value>: every provider shape and token of a literal, in one pass. Where
    shapes overlap the one that begins first counts, of those that begin together the first
    provider's."""
    shapes = [pattern for _id, _title, pattern, _severity in R.PROVIDERS] + [R.JWT]
    every = rx("|".join(f"({p})" for p in shapes))
    return matches(
        marked(text, every, [f"${i + 1}" for i in range(len(shapes))]),
        lambda f: F.length(F.array_join(f, "")),
        lambda start, f: F.struct(
            start.alias("start"), (F.array_position(F.transform(f, lambda x: x != ""), F.lit(True)) - 1).cast("int").alias("ord"),
            F.array_join(f, "").alias("value"),
        ),
    )


def _candidates(hit_rows: DataFrame) -> DataFrame:
    """What each literal holds: all provider shapes and tokens, or else a generic value."""
    text, name = F.col("text"), F.element_at("groups", 1)
    token = len(R.PROVIDERS)
    shaped = F.filter(_matches(text), lambda m: (m["ord"] < token) | is_jwt(m["value"]))
    generic = (
        _names_secret(name)
        & ~is_vendor_bundle(F.col("url"))
        & ~is_placeholder(text, name)
        & ~text.contains("://")
        & ~is_route_like(text)
        & ~is_human_text(text)
        & ~is_hash_like(text)
        & ~text.rlike(rx(r"[\s(){};]"))
        & looks_random(text)
    )
    whole = F.struct(F.lit(0).alias("start"), F.lit(token + 1).alias("ord"), text.alias("value"))
    found = let(shaped, lambda ms: F.when(F.size(ms) > 0, ms).when(generic, F.array(whole)))
    rows = pinned(hit_rows.where(F.col("rule") == "secret"), name=name, all=found)
    kinds = [(i, *kind) for i, kind in enumerate(
        [(rule_id, title, severity) for rule_id, title, _pattern, severity in R.PROVIDERS]
        + [("jwt", "JSON Web Token (JWT)", "HIGH"), ("generic", R.GENERIC_TITLE, "HIGH")]
    )]
    table = local_table(rows.sparkSession, ("rule_ord", "shape", "title", "severity"), kinds)
    keep = [c for c in rows.columns if c != "all"]
    rows = exploded(rows, keep, F.col("all"), "found").withColumn("rule_ord", F.col("found.ord"))
    part = F.col("rule_ord") <= token
    place = {c: F.when(part, x).otherwise(F.col(c)) for c, x in within_literal(F.col("found.start")).items()}
    same = [c for c in rows.columns if c not in place]
    rows = rows.select(*same, *[x.alias(c) for c, x in place.items()])
    return rows.join(F.broadcast(table), "rule_ord")


def secret_findings(hit_rows: DataFrame, options: Options = Options()) -> DataFrame:
    now = F.lit(options.as_of) if options.as_of is not None else F.unix_timestamp()
    found = F.col("found")
    kind = F.col("shape")
    rows = (
        pinned(
            _candidates(hit_rows),
            claims_map=F.when(kind == "jwt", jwt_part(found["value"], 1)),
        )
        .withColumn(
            "authz",
            F.array_sort(F.filter(F.map_keys("claims_map"), lambda c: c.isin(*JWT_AUTHZ_CLAIMS))),
        )
        .withColumn(
            "privileged",
            F.exists(
                F.filter(F.map_keys("claims_map"), lambda c: c.isin(*JWT_AUTHZ_CLAIMS)),
                lambda c: F.arrays_overlap(
                    F.regexp_extract_all(
                        F.lower(F.element_at("claims_map", c)), F.lit(r"[a-z][a-z_\-]*"), F.lit(0)
                    ),
                    F.array(*[F.lit(r) for r in PRIVILEGED_ROLES]),
                )
                | (c.isin("is_admin", "isAdmin", "admin") & (F.element_at("claims_map", c) == "true")),
            ),
        )
        .withColumn("expires", F.element_at("claims_map", F.lit("exp")).cast("double").cast("bigint"))
    )
    is_token = kind == "jwt"
    authz, privileged, expires = F.col("authz"), F.col("privileged"), F.col("expires")
    token_detail = F.array_join(
        F.filter(
            F.array(
                F.when(F.size(authz) > 0, F.concat(
                    F.lit("The token states rights: "), F.array_join(authz, ", "),
                    F.lit("."))).otherwise(F.lit("The token states no rights.")),
                F.when(privileged, "One of them is privileged."),
                F.when(expires >= now, "It has not run out.")
                .when(expires < now, "It has run out."),
            ),
            lambda s: s.isNotNull(),
        ),
        " ",
    )
    claims = F.array_join(F.array_sort(F.map_keys("claims_map")), ", ")
    return to_findings(
        rows, "secrets", SECRET,
        severity=F.when(is_token & privileged, "CRITICAL").otherwise(F.col("severity")),
        confidence=F.when(kind == "generic", "FIRM").otherwise("CONFIRMED"),
        value=found["value"],
        detail=F.when(is_token, token_detail)
        .when(kind == "generic", R.GENERIC_DETAIL).otherwise(R.PROVIDER_DETAIL),
        remediation=F.when(
            is_token, "Let each session fetch its own token."
        ).otherwise(R.REMEDIATION),
        evidence=F.when(is_token, evidence_of(
            claims=claims, authz_claims=F.array_join(authz, ", "),
            expires_at=F.coalesce(expires.cast("string"), F.lit(""))))
        .otherwise(evidence_of(key=F.col("name"))),
        tags=F.when(is_token, F.concat(tags_of("secret", "jwt"), authz))
        .otherwise(tags_of("secret")),
    )


def secrets(assets: DataFrame, options: Options = Options()) -> DataFrame:
    return secret_findings(hits(assets, literal_gates={"secret": secret_gate}), options)
