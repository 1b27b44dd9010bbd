"""Rows dealt out evenly before a costly map.

A file may have fewer pieces that can be read apart than a cluster has cores (a small table, or one written as a single row group), and a map over it would keep to as many tasks. What is worked out of a row costs far more here than sending the row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame) -> DataFrame:
    """df's rows in as many parts as the session's shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Parts of rows that are dealt out by key for sorts and groups, at least.
KEYED_PARTS = 192


def dealt_by(df: DataFrame, *by: str) -> DataFrame:
    """df's rows dealt out by key, for the windows and groups that follow. A part that is small as it is sent may be large in a sort or a group, so parts aren't left to be joined by what is sent: they are as many as the session's shuffles have, and KEYED_PARTS at least."""
    return df.repartition(max(KEYED_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


#: Bytes of an Arrow batch of whole texts, at which it is closed.
BATCH_BYTES = 2 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """df. From now on its session's Arrow batches are closed at BATCH_BYTES, unless the session has a bound of its own: what a worker makes of a batch of texts is many times as large. Results don't depend on it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df
