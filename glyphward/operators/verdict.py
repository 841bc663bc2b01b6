"""The verdict on a corpus, observed in the pass that writes it: no further look at the table, no rows to the driver."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.unicode import DANGEROUS

#: What counts of scan() may hold.
KINDS = (*DANGEROUS, "homoglyph", "pii:pii", "secret")
#: The name under which a stream's metrics are observed.
NAME = "glyphward"


@dataclass(frozen=True)
class Verdict:
    """Rows seen, those of them that are dangerous, and findings by category (without those that have none)."""

    rows: int = 0
    dangerous: int = 0
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def exit_code(self) -> int:
        """1 if any row is dangerous."""
        return int(self.dangerous > 0)

    def __add__(self, other: Verdict) -> Verdict:
        return Verdict(self.rows + other.rows, self.dangerous + other.dangerous, dict(Counter(self.counts) + Counter(other.counts)))


def _metrics(prefix: str) -> list[Column]:
    each = [F.sum(F.coalesce(F.try_element_at(F.col(f"{prefix}counts"), F.lit(k)), F.lit(0))).alias(k) for k in KINDS]
    return [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(f"{prefix}dangerous")).alias("dangerous"), *each]


def _of(metrics: dict | Row) -> Verdict:
    seen = metrics.asDict() if isinstance(metrics, Row) else metrics
    return Verdict(seen.get("rows") or 0, seen.get("dangerous") or 0, {k: seen[k] for k in KINDS if seen.get(k)})


def observed(scanned: DataFrame, prefix: str = "") -> tuple[DataFrame, Observation]:
    """scan()'s result, observed: the first action on it also fills the observation, for verdict(). prefix is scan()'s."""
    seen = Observation(NAME)
    return scanned.observe(seen, *_metrics(prefix)), seen


def verdict(seen: Observation) -> Verdict:
    """What the action on observed()'s table has met; waits for it."""
    return _of(seen.get)


def write_scanned(scanned: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", prefix: str = "", **options: str) -> Verdict:
    """Writes scan()'s result and gives its verdict, in one pass over the input. An empty table is not dangerous."""
    rows, seen = observed(scanned, prefix)
    rows.write.format(fmt).mode(mode).options(**options).save(path)
    return verdict(seen)


class StreamVerdicts(StreamingQueryListener):
    """Adds up the verdicts of all batches of the streams in a session that observed_stream() has prepared.

        with StreamVerdicts(spark) as seen:
            query = ...
            query.awaitTermination()
        seen.total(query).exit_code
    """

    def __init__(self, spark):
        self.spark, self.totals, self.ended = spark, {}, set()

    def __enter__(self) -> StreamVerdicts:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        # events come after the batches that they tell of
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        """Nothing is known yet."""

    def onQueryIdle(self, event) -> None:
        """Nothing new."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if NAME in p.observedMetrics:
            # a batch that runs again is told of again: the last time counts
            self.totals.setdefault(str(p.id), {})[p.batchId] = _of(p.observedMetrics[NAME])

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def total(self, query) -> Verdict:
        return sum(self.totals.get(str(query.id), {}).values(), Verdict())


def observed_stream(scanned: DataFrame, prefix: str = "") -> DataFrame:
    """A scanned stream whose batches tell their verdict to StreamVerdicts."""
    return scanned.observe(NAME, *_metrics(prefix))
