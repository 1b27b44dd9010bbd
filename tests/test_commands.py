"""The command processor: rules one by one, and a stream in any order against the batch."""

import random

from pyspark.sql import functions as F

from folioscope.operators import commands as C
from folioscope.queries.commands import commands
from folioscope.streaming import commands as S


def codes(*steps):
    run = C.Run()
    out = []
    for action, values in steps:
        run = C.Run(run.to_json())  # as a stream keeps it
        out.append(run.decide({**dict.fromkeys(C.FIELDS), "action": action, **values})["code"])
    return out


PLAN = ("plan", {"tasks": ["T0", "T1"]})


def record(task, auditor, status="pass", **more):
    return "record", {"task_id": task, "auditor": auditor, "status": status, **more}


def test_a_run_from_plan_to_complete():
    assert codes(record("T0", "A"), PLAN, PLAN, ("close", {}), PLAN, record("T0", "A"), ("close", {}), record("T1", "a "), record("T1", "B"), ("close", {}), ("close", {}), PLAN) == [
        "RUN_NOT_FOUND", "planned", "RUN_ALREADY_OPEN", "invalidated", "planned", "recorded", "RUN_TASKS_PENDING", "AUDITOR_NOT_INDEPENDENT", "recorded", "complete", "already closed", "RUN_ALREADY_COMPLETE",
    ]


def test_findings_keep_a_run_open():
    steps = [PLAN, record("T0", "A", severity="MINOR", fix_class="SUPERVISOR_APPROVAL"), record("T0", "A"), record("T1", "B", severity="MAJOR"), ("close", {}), PLAN]
    steps += [("accept_risk", {"finding_id": "F-001"}), ("accept_risk", {"finding_id": "F-002", "reason": "r"}), ("waive", {"finding_id": "F-002"}), ("waive", {"finding_id": "F-001"}), ("waive", {"finding_id": "F-001"}), ("accept_risk", {"finding_id": "F-009", "reason": "r"})]
    assert codes(*steps) == [
        "planned", "recorded", "RETRY_REASON_REQUIRED", "recorded", "reported", "RUN_HAS_OPEN_FINDINGS", "REASON_REQUIRED", "ACCEPT_RISK_DENIED", "WAIVE_DENIED", "waived", "WAIVE_DENIED", "FINDING_NOT_FOUND",
    ]


def test_what_a_command_may_lack():
    assert codes(("plan", {}), ("plan", {"tasks": ["T", "T"]}), (None, {}), PLAN, record("T9", "A"), record("T0", " "), record("T0", "A", "maybe"), record("T0", "A"), ("close", {"reason": "over"}), record("T1", "B"), PLAN) == [
        "PLAN_EMPTY", "PLAN_DUPLICATE_TASK", "COMMAND_UNKNOWN", "planned", "TASK_NOT_FOUND", "AUDITOR_ID_INVALID", "REPORT_SCHEMA_INVALID", "recorded", "abandoned", "RUN_CLOSED", "planned",
    ]


def test_stream_in_any_order(spark, sf, tmp_path):
    spark.conf.set(*S.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        given = commands(spark, sf).filter("seq < 400").withColumn("time", F.col("time").cast("timestamp"))  # the stream's test, not a query
        rows = given.collect()
        random.Random(4).shuffle(rows)
        last = max(r["time"] for r in rows)
        end = [row.asDict() | {"run_id": "end", "time": last.replace(year=last.year + 1)} for row in rows[:1]]
        source = tmp_path / "in"
        for i in range(3):
            spark.createDataFrame(rows[i::3], given.schema).coalesce(1).write.mode("append").parquet(str(source))
        spark.createDataFrame([tuple(e[c] for c in given.columns) for e in end], given.schema).coalesce(1).write.parquet(str(tmp_path / "end"))
        stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(str(source))

        def run():
            query = S.decisions(stream, "400 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert query.exception() is None

        run()
        later = end[0] | {"time": last.replace(year=last.year + 3)}
        for row in (end[0], later):  # time goes on, and the watermark passes what is held
            spark.createDataFrame([tuple(row[c] for c in given.columns)], given.schema).coalesce(1).write.mode("append").parquet(str(source))
            run()
        out = spark.read.schema(S.OUTPUT).parquet(str(tmp_path / "out")).filter("run_id <> 'end'")
        want = C.decided(given)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.select(*out.columns).collect()), key=repr)
        # what comes when its time is over is rejected, and a restart goes on from the kept state
        spark.createDataFrame(rows[:1], given.schema).coalesce(1).write.mode("append").parquet(str(source))
        run()
        late = spark.read.schema(S.OUTPUT).parquet(str(tmp_path / "out")).filter(F.col("code") == "COMMAND_LATE")
        assert late.count() <= 1
    finally:
        spark.conf.unset(S.PROVIDER[0])
        spark.conf.set("spark.sql.shuffle.partitions", "4")
