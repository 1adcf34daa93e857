"""The whole scan over an arriving stream of captures.

Each micro-batch is scanned like a small batch of captures. Its findings are appended; what is
merged per site (technologies, services, endpoints, URLs, mail addresses, main documents) is kept
as state that can be merged: the few mentions that decide the merged row. A batch's mentions are
distilled, joined to the state and distilled again, so the state grows with the distinct names and
addresses of the sites, not with the captures, and after every batch the tables are those that one
scan over all captures so far gives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.sqlexpr import F
from ..functions.urls import without_fragment
from ..model import Options
from ..operators import endpoints as ep
from ..operators import results as rs
from ..operators import technologies as tc
from ..operators.findings import main_documents
from ..plans.scan import DETECTORS, Scan, site_findings
from ..sources.assets import CAPTURE_SCHEMA, ROWS_PER_FILE, is_admitted

#: name -> (what a batch adds, how mentions are distilled)
State = tuple[Callable[[Scan], DataFrame], Callable[[DataFrame], DataFrame]]
STATE: dict[str, State] = {
    "technologies": (lambda scan: tc.raw_technologies(scan.facts), tc.first_technologies),
    "services": (lambda scan: tc.service_mentions(scan.facts), tc.first_services),
    "endpoints": (lambda scan: scan.endpoint_mentions, ep.dedupe_endpoints),
    "urls": (lambda scan: scan.urls, lambda rows: rows.groupBy("site", "url").agg(F.min("scope").alias("scope"))),
    "emails": (lambda scan: scan.emails, DataFrame.distinct),
    "mains": (lambda scan: main_documents(scan.facts), DataFrame.distinct),
}
#: The states that need a detector.
NEEDS = {"technologies": "technology", "services": "technology", "endpoints": "endpoints", "urls": "endpoints", "emails": "endpoints"}


def read_capture_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet captures with an arrival time column ``fetched_at``."""
    return (
        spark.readStream.schema(CAPTURE_SCHEMA + ", fetched_at timestamp")
        .option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def first_fetches(captures: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each URL once while it can still arrive again, the seen set as keyed, expiring state: the
    first admitted answer, and the first that is not, so an early error does not hide a page."""
    return (
        captures.withColumn("url_nofrag", without_fragment(F.col("url")))
        .withColumn("usable", F.coalesce(is_admitted(), F.lit(False)))
        .withWatermark("fetched_at", lateness)
        .dropDuplicatesWithinWatermark(["site", "url_nofrag", "usable"])
    )


def each_capture(captures: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each capture once, as it is numbered in its site: one that is delivered again is dropped,
    another capture of the same URL is not."""
    return (
        captures.withWatermark("fetched_at", lateness)
        .dropDuplicatesWithinWatermark(["site", "asset_seq"])
    )


@dataclass
class SiteTables:
    """The folder of a streamed scan."""

    spark: SparkSession
    folder: str
    detectors: tuple[str, ...] = DETECTORS
    options: Options = Options()

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def versions(self, name: str) -> list[int]:
        """The batches whose state was written to its end, in order."""
        files, path = self._files(), self._path(name)
        found = files.listStatus(path) if files.exists(path) else []
        names = [x.getPath().getName() for x in found]
        return sorted(int(n.split("=")[1]) for n in names if files.exists(self._path(name, n, "_SUCCESS")))

    def merge(self, name: str, scan: Scan, batch_id: int) -> None:
        """The state after a batch, from the state before it: a batch that is tried again begins at
        the same state, and the one before it stays until the next batch."""
        adds, distil = STATE[name]
        rows = distil(adds(scan))
        earlier = [v for v in self.versions(name) if v < batch_id]
        if earlier:
            old = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}/version={earlier[-1]}")
            rows = distil(old.unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={batch_id}")
        for v in earlier[:-1]:
            self._files().delete(self._path(name, f"version={v}"), True)

    def arrived(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """A batch's captures as files, read in the tables' own session. That of a stateful stream plans
        without AQE: there every later shuffle has as many tasks as the state, and each task sends the
        driver the metrics of its stage's whole plan."""
        path = f"{self.folder}/work/batch={batch_id}/captures"
        batch.write.mode("overwrite").options(maxRecordsPerFile=ROWS_PER_FILE, compression="zstd").parquet(path)
        return self.spark.read.schema(batch.schema).parquet(path)

    def forget(self, batch_id: int) -> None:
        """Drop what was written only to work on a batch."""
        self._files().delete(self._path("work", f"batch={batch_id}"), True)

    def add(self, captures: DataFrame, batch_id: int) -> None:
        """Scan a batch and merge it. Everything of a batch is written under its number, so a batch
        that is tried again replaces what it wrote."""
        scan = Scan(captures, self.detectors, self.options, f"{self.folder}/work/batch={batch_id}")
        scan.page_findings.write.mode("overwrite").parquet(f"{self.folder}/findings/batch={batch_id}")
        for name in STATE:
            if NEEDS.get(name) is None or NEEDS[name] in self.detectors:
                self.merge(name, scan, batch_id)
        self.forget(batch_id)

    def state(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/version={self.versions(name)[-1]}")

    @property
    def technologies(self) -> DataFrame:
        return tc.merge_technologies(self.state("technologies"))

    @property
    def services(self) -> DataFrame:
        return tc.dedupe_services(self.state("services"))

    @property
    def endpoints(self) -> DataFrame:
        return ep.collapse_inferred_endpoints(self.state("endpoints"))

    @property
    def urls(self) -> DataFrame:
        return self.state("urls")

    @property
    def emails(self) -> DataFrame:
        return self.state("emails")

    @property
    def findings(self) -> DataFrame:
        """Merged findings of all batches, with those of whole sites."""
        rows = self.spark.read.parquet(f"{self.folder}/findings").drop("batch")
        on = self.detectors
        for more in site_findings(
            on, self.technologies if "technology" in on else None,
            self.endpoints if "endpoints" in on else None, self.state("mains"),
        ):
            rows = rows.unionByName(more)
        return rs.filter_min_severity(rs.dedupe_findings(rows), self.options.min_severity)


def stream_scan(
    captures: DataFrame, tables: SiteTables, checkpoint: str, lateness: str = "1 hour",
    on_batch: Callable[[SiteTables, int], None] | None = None,
    once: Callable[[DataFrame, str], DataFrame] = first_fetches,
) -> StreamingQuery:
    """Scan what has arrived, batch by batch, into the site tables. ``once`` says what counts as
    seen: ``first_fetches`` for a crawl that meets a URL again, ``each_capture`` for a table of
    captures of which each counts, as in one scan over it."""
    columns = [x.split()[0] for x in CAPTURE_SCHEMA.split(", ")]

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = tables.arrived(batch.select(*columns), batch_id)
        if rows.isEmpty():  # one that only moves the watermark on
            tables.forget(batch_id)
            return
        tables.add(rows, batch_id)
        if on_batch is not None:
            on_batch(tables, batch_id)

    return (
        once(captures, lateness).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
