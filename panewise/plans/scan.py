"""The whole scan: captures in, site tables out.

``Scan`` wires the operators together. One narrow pass over the text yields the facts table;
everything after that works on its small columns (only source maps and sensitive files are
looked up in the captures again, without any matching). Nothing runs until a table is asked
for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame

from ..functions.sqlexpr import F
from ..model import Options
from ..operators import access as acc
from ..operators import endpoints as ep
from ..operators import exposure as ex
from ..operators import headers as hd
from ..operators import links as lk
from ..operators import results as rs
from ..operators import secrets as sc
from ..operators import technologies as tc
from ..operators import vulnerabilities as vu
from ..operators.facts import facts_table
from ..operators.findings import main_documents, opening
from ..operators.hits import hit_array, hit_rows
from ..rules import endpoints as ep_rules
from ..rules import technologies as tech_rules
from ..rules import vulns as vu_rules
from ..session import work_folder, written
from ..sources.assets import scan_responses

#: Detectors in the order their findings read best.
DETECTORS = (
    "technology", "secrets", "sql", "xss", "misc", "access", "endpoints", "headers",
)


def select_detectors(
    only: Iterable[str] | None = None, skip: Iterable[str] | None = None
) -> tuple[str, ...]:
    """The detectors to run; an unknown name is an error."""
    asked = [n.strip().lower() for n in (only or skip or ()) if n.strip()]
    unknown = [n for n in asked if n not in DETECTORS]
    if unknown:
        raise ValueError(
            f"Unknown detector(s): {', '.join(unknown)}. Available: {', '.join(DETECTORS)}"
        )
    if only:
        return tuple(n for n in DETECTORS if n in asked)
    return tuple(n for n in DETECTORS if n not in asked)


def site_findings(
    detectors: Iterable[str], technologies: DataFrame | None, endpoints: DataFrame | None, mains: DataFrame
) -> list[DataFrame]:
    """Findings that need a whole site's merged tables."""
    parts = []
    if "technology" in detectors:
        parts += [tc.outdated_components(technologies, mains), tc.wordpress_summary(technologies, mains)]
    if "endpoints" in detectors:
        parts.append(rs.backend_summary(endpoints))
    return parts


@dataclass
class Scan:
    captures: DataFrame
    detectors: tuple[str, ...] = DETECTORS
    options: Options = field(default_factory=Options)
    #: folder for intermediate tables; None makes one below the shared checkpoint folder
    work_dir: str | None = None
    #: a user's own detectors: each takes the scan and returns findings
    extra: tuple[Callable[[Scan], DataFrame], ...] = ()

    def _keep(self, name: str, table: DataFrame) -> DataFrame:
        """Compute an intermediate table once, as a written table, for all its readers."""
        if self.work_dir is None:
            self.work_dir = work_folder(table.sparkSession, "scan")
        return written(table, f"{self.work_dir}/{name}")

    @cached_property
    def admitted(self) -> DataFrame:
        return scan_responses(self.captures)

    @cached_property
    def assets(self) -> DataFrame:
        """What the detectors read: maps are opened, and their sources stand in for them."""
        return self.admitted.where("kind != 'map'").unionByName(
            ex.sourcemap_sources(self.admitted)
        )

    @cached_property
    def facts(self) -> DataFrame:
        """The one pass over the text: one row per asset, without the body."""
        on = set(self.detectors)
        raw, stripped, gates = [], [], {}
        builders = {"f_chars": lambda: F.length("content"), "f_head": opening}
        if "misc" in on:
            raw += vu_rules.MISC_RULES
        if "endpoints" in on:
            raw += ep_rules.CALL_RULES
            gates.update(ep.LITERAL_GATES)
            builders |= {
                "f_urls": ep.url_matches, "f_relative_urls": ep.relative_url_matches,
                "f_sockets": ep.socket_matches, "f_emails": ep.email_matches,
            }
        if "sql" in on:
            stripped += vu_rules.ORM_RULES
            gates["sql"] = vu.sql_gate
        if "xss" in on:
            stripped += vu_rules.XSS_RULES
        if "access" in on:
            stripped += acc.ACCESS_RULES
        if "secrets" in on:
            gates["secret"] = sc.secret_gate
        if "technology" in on:
            builders |= {
                "f_tech": tc.content_matches, "f_banners": tc.banner_matches,
                "f_payload": tc.next_payloads, "f_services": tc.service_matches,
                **{
                    f"f_wp_{kind}": (lambda p=pattern: tc.extension_matches(p))
                    for kind, pattern in tech_rules.WP_EXTENSIONS
                },
            }
        if raw or stripped or gates:
            builders["f_hits"] = lambda: hit_array(raw, stripped, gates)
        return self._keep("facts", facts_table(self.assets, builders))

    @cached_property
    def hits(self) -> DataFrame:
        skip = (*vu.MISC_VENDOR_SKIP, *vu.ORM_IDS, *vu.XSS_IDS, *acc.ACCESS_IDS, "sql")
        return hit_rows(self.facts, F.col("f_hits"), skip)

    @cached_property
    def technologies(self) -> DataFrame:
        return self._keep(
            "technologies", tc.merge_technologies(tc.raw_technologies(self.facts))
        )

    @cached_property
    def services(self) -> DataFrame:
        return tc.services(self.facts)

    @cached_property
    def endpoint_mentions(self) -> DataFrame:
        return self._keep("endpoint_mentions", ep.raw_endpoints(self.facts, self.hits))

    @cached_property
    def endpoints(self) -> DataFrame:
        return self._keep(
            "endpoints",
            ep.collapse_inferred_endpoints(ep.dedupe_endpoints(self.endpoint_mentions)),
        )

    @cached_property
    def urls(self) -> DataFrame:
        return ep.dedupe_urls(self.facts, self.endpoint_mentions)

    @cached_property
    def emails(self) -> DataFrame:
        return ep.emails(self.facts)

    @cached_property
    def errors(self) -> DataFrame:
        return rs.detector_errors(self.captures)

    @cached_property
    def sites(self) -> DataFrame:
        return self.captures.select("site").distinct()

    @cached_property
    def page_findings(self) -> DataFrame:
        """Findings that one capture gives by itself, before merging."""
        on, parts = set(self.detectors), []
        if "technology" in on:
            parts += [tc.version_disclosures(self.facts), tc.next_data_findings(self.facts)]
        if "secrets" in on:
            parts.append(sc.secret_findings(self.hits, self.options))
        if "sql" in on:
            parts += [vu.sql_findings(self.hits), vu.orm_findings(self.hits)]
        if "xss" in on:
            parts.append(vu.xss_findings(self.hits))
        if "misc" in on:
            parts.append(vu.misc_findings(self.hits))
        if "access" in on:
            parts += [
                acc.role_findings(self.hits), acc.check_findings(self.hits),
                acc.bypass_findings(self.hits), acc.idor_findings(self.hits),
            ]
        if "headers" in on:
            parts.append(hd.header_findings(self.facts))
        parts += [ex.sourcemap_exposure(self.admitted), ex.exposed_paths(self.captures)]
        parts += [detector(self) for detector in self.extra]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def asset_findings(self) -> DataFrame:
        """Findings before merging."""
        of_site = site_findings(
            self.detectors, self.technologies if "technology" in self.detectors else None,
            self.endpoints if "endpoints" in self.detectors else None, main_documents(self.facts),
        )
        return self._keep("asset_findings", reduce(DataFrame.unionByName, [self.page_findings, *of_site]))

    @cached_property
    def findings(self) -> DataFrame:
        """Merged findings at or above the severity floor."""
        return self._keep(
            "findings",
            rs.filter_min_severity(
                rs.dedupe_findings(self.asset_findings), self.options.min_severity
            ),
        )

    @cached_property
    def links(self) -> DataFrame:
        return lk.link_table(self.admitted)

    @cached_property
    def severity_counts(self) -> DataFrame:
        return rs.severity_counts(self.findings, self.sites, self.options.min_confidence)

    @cached_property
    def stats(self) -> DataFrame:
        return rs.scan_stats(
            self.facts, self.captures, self.findings, self.endpoints, self.urls,
            self.technologies, self.services,
        )

    def gate(self) -> DataFrame:
        return rs.ci_gate(
            self.findings, self.sites, self.options.fail_on or "CRITICAL",
            self.options.min_confidence,
        )
