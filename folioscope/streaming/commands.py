"""A stream of commands on review runs, decided in the order of their own time whatever the order of arrival.

State of each run: its Run, and the commands that the watermark hasn't passed yet. When it passes, a timer takes them in order and gives a row for each; what is late is rejected and changes nothing. So for arrivals within the watermark's delay the rows are those of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioscope.operators.commands import COMMAND, DECIDED, FIELDS, Run

OUTPUT = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("time", T.TimestampType()), T.StructField("seq", T.LongType()), *DECIDED])
#: The session setting that state of this kind needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(time: datetime) -> int:
    """As the session's zone has it; a task has the same zone as the driver."""
    return int((time if time.tzinfo else time.astimezone(timezone.utc)).timestamp() * 1000)


class Commands(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", T.StructType([T.StructField("held", T.StringType())]))
        self.waiting = handle.getListState("waiting", COMMAND)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            values = tuple(row[c] for c in COMMAND.names)
            due = _millis(row["time"])
            if passed > 0 and due <= passed:
                yield self._row(key[0], row, {"action": row["action"], "accepted": False, "code": "COMMAND_LATE", "run_status": None, "attempt": None, "finding": None, "finding_status": None})
                continue
            self.waiting.appendValue(values)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        names = COMMAND.names
        held = [dict(zip(names, row)) for row in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((c for c in held if _millis(c["time"]) <= passed), key=lambda c: (c["time"], c["seq"]))
        if not due:
            return
        run = Run(self.run.get()[0] if self.run.exists() else None)
        made = [self._row(key[0], c, run.decide({f: c[f] for f in FIELDS})) for c in due]
        self.run.update((run.to_json(),))
        left = [tuple(c[n] for n in names) for c in held if _millis(c["time"]) > passed]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        yield from made

    @staticmethod
    def _row(run_id, command, values: dict) -> Row:
        return Row(run_id=run_id, time=command["time"], seq=command["seq"], **values)

    def close(self) -> None:
        pass


def decisions(commands: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A row of OUTPUT for each command of a stream, once its time has passed by the delay. The session has to name PROVIDER."""
    return commands.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay).groupBy("run_id").transformWithState(statefulProcessor=Commands(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
