"""When a micro-batch starts a run: enough rows, or any rows and enough time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from newsweave.fixed_values import HOT_REFRESH_ROWS, TRIGGER_ROWS, TRIGGER_WAIT_SECONDS
from newsweave.streaming.tables import read_batches, write_batch

CONTROL = (
    "arrived BIGINT, backlog BIGINT, ran BOOLEAN, reason STRING, first_pending BIGINT, last_run DOUBLE, "
    "accumulated BIGINT, refreshed BOOLEAN"
)


def run_reason(backlog: int, waited: float, rows: int = TRIGGER_ROWS, wait: float = TRIGGER_WAIT_SECONDS, force: bool = False) -> str | None:
    """Why a run is due, None when it is not."""
    if force:
        return "forced"
    if backlog >= rows:
        return "rows"
    if backlog > 0 and waited >= wait:
        return "time"
    return None


def refresh_due(accumulated: int, rows: int = HOT_REFRESH_ROWS) -> bool:
    return accumulated >= rows


class TriggeredRuns:
    """A ``foreachBatch`` function that keeps rows until a run is due and then hands them over.

    Arriving rows and one control row per batch are tables below ``path``, both written under the
    batch id. The state of a batch follows from the control rows before it, so a replayed or
    restarted batch decides the same way. The refresh counter starts at its threshold: the first run
    refreshes.
    """

    def __init__(
        self, path: str, schema: str, run: Callable[[DataFrame, int], None], refresh: Callable[[int], None] | None = None,
        rows: int = TRIGGER_ROWS, wait: float = TRIGGER_WAIT_SECONDS, refresh_rows: int = HOT_REFRESH_ROWS,
        clock: Callable[[], float] = time.time, force: bool = False,
    ):
        self.rows_path, self.control_path, self.schema = f"{path}/rows", f"{path}/control", schema
        self.run, self.refresh, self.clock, self.force = run, refresh, clock, force
        self.rows, self.wait, self.refresh_rows = rows, wait, refresh_rows

    def control(self, spark: SparkSession) -> DataFrame:
        return read_batches(spark, self.control_path, CONTROL)

    def _before(self, spark: SparkSession, batch_id: int) -> Row | None:
        if batch_id == 0:
            return None
        return self.control(spark).where(F.col("batch") < batch_id).orderBy(F.desc("batch")).first()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, self.clock()
        write_batch(batch, self.rows_path, batch_id)
        arrived = read_batches(spark, self.rows_path, self.schema).where(F.col("batch") == batch_id).count()
        last = self._before(spark, batch_id)
        first_pending = batch_id if last is None or last["ran"] else last["first_pending"]
        backlog = arrived + (0 if last is None or last["ran"] else last["backlog"])
        last_run = now if last is None else last["last_run"]
        accumulated = self.refresh_rows if last is None else last["accumulated"]
        reason = run_reason(backlog, now - last_run, self.rows, self.wait, self.force)
        refreshed = False
        if reason:
            accumulated += backlog
            refreshed = refresh_due(accumulated, self.refresh_rows) or self.force
            pending = read_batches(spark, self.rows_path, self.schema)
            pending = pending.where(F.col("batch").between(first_pending, batch_id)).drop("batch")
            if refreshed:
                accumulated = 0
                if self.refresh:
                    self.refresh(batch_id)
            self.run(pending, batch_id)
            last_run = now
        state = (arrived, backlog, bool(reason), reason, first_pending, float(last_run), accumulated, refreshed)
        write_batch(spark.createDataFrame([state], CONTROL), self.control_path, batch_id)
