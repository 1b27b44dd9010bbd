"""Migration of records of mixed versions: each is held as VARIANT and taken up step by step until it has the current version.

A step is a function from one version to the next. All steps are column expressions of one map: no shuffle, whatever the mix. A record of the current version passes unchanged, so migrating twice changes nothing; what can't be read or taken up is put aside with the reason.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


def migrated(records: DataFrame, payload: str, steps: Sequence[tuple[Step, Column]], version: str = "$.version") -> DataFrame:
    """records with from_version, record (JSON of the current version, keys in order; null if put aside), problem, and legacy_sha256 (of a payload that was taken up).

    steps[k] is (a function from the VARIANT of version k + 1 to JSON text of version k + 2, whether record can be taken up), both of the column record; a record without a version has the first. Reasons: unreadable (no JSON object), unknown version, and for a step "not version k".
    """
    last = len(steps) + 1
    df = records.withColumn("record", F.try_parse_json(payload))
    readable = F.coalesce(F.expr("schema_of_variant(record)").startswith("OBJECT"), F.lit(False))
    own = F.expr(f"try_variant_get(record, '{version}', 'int')")
    stated = F.expr(f"try_variant_get(record, '{version}')").isNotNull()
    df = df.withColumn("from_version", F.when(readable, F.when(stated, own).otherwise(1)))
    known = F.coalesce(F.col("from_version").between(1, last), F.lit(False))
    df = df.withColumn("problem", F.when(~readable, "unreadable").when(~known, "unknown version")).withColumn("__now", F.when(F.col("problem").isNull(), F.col("from_version")))
    for k, (step, good) in enumerate(steps, start=1):
        due = F.col("problem").isNull() & (F.col("__now") == k)
        df = df.withColumn("problem", F.when(due & ~F.coalesce(good, F.lit(False)), F.lit(f"not version {k}")).otherwise(F.col("problem")))
        due = F.col("problem").isNull() & (F.col("__now") == k)
        df = df.withColumns({"record": F.when(due, F.try_parse_json(step(F.col("record")))).otherwise(F.col("record")), "__now": F.when(due, k + 1).otherwise(F.col("__now"))})
    old = F.col("problem").isNull() & (F.col("from_version") < last)
    return df.withColumns({"record": F.when(F.col("problem").isNull(), F.to_json("record")), "legacy_sha256": F.when(old, F.sha2(F.col(payload).cast("binary"), 256))}).drop("__now")
