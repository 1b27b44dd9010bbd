"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words as the contamination and shingle operators take them: ASCII letters, digits and all that is beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only; every other character stays."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


#: In UTF-8 every byte from 0x80 on is part of a word's character; A-Z become lower case, and all that is no word a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in order, A-Z in lower case, as UTF-8; none for null. They are WORD's matches in ascii_lower's text."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def ascii_lower_col(col: Column) -> Column:
    """The JVM's form of ascii_lower, with null as the empty text."""
    return F.translate(F.coalesce(col, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own, as in tests; a cluster has to name one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="folioscope-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def step_path(spark: SparkSession, keep: str = "") -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/folioscope-{keep or 'step'}-{uuid.uuid4().hex}"


def stored(df: DataFrame, keep: str = "", path: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder (or at path) and read back: lineage is cut, and any executor can be lost."""
    spark = df.sparkSession
    path = path or step_path(spark, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str | None) -> None:
    """Delete a step that nothing reads any more."""
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Plans whose rows are the same, in the same places, each time they are read.
_FIXED = {"Project", "LogicalRelation", "SubqueryAlias"}


def settled(df: DataFrame) -> DataFrame:
    """df where it only reads files, else df stored: an operator that reads its input twice finds each row in its place again."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _FIXED:
            return stored(df, "input")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return df


def heavy_rows(total: int) -> float:
    """A key with more rows than this is joined by broadcast: a thousandth of the rows, a million at most. So there are at most a thousand such keys, or one for each million rows."""
    return min(max(2.0, total / 1000), 1e6)


def free_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without columns that an operator is about to add; an input column of the same name gives way."""
    return df.drop(*[c for c in df.columns if c in set(names)])


def keeping_columns(docs: DataFrame, work: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """The rows of docs that work leaves, with docs's columns as they were, whatever their names: work gets docs under stand-in names, and those by name."""
    stand_in = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    return work(docs.toDF(*stand_in.values()), stand_in).select(*stand_in.values()).toDF(*docs.columns)


def adding_columns(docs: DataFrame, outputs: Sequence[str], work: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """docs's columns as they were, whatever their names, and the outputs that work makes: work gets docs under stand-in names, and those by name. An input column with an output's name gives way."""
    stand_in = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    kept = [c for c in docs.columns if c not in set(outputs)]
    return work(docs.toDF(*stand_in.values()), stand_in).select(*[stand_in[c] for c in kept], *outputs).toDF(*kept, *outputs)


#: Rows that are worked on at once.
SLICE = 256
#: Bytes of an Arrow batch, at which it is closed (Spark's own bound of 64 MB is held several times over by an executor and its worker).
BATCH_BYTES = 2 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(df: DataFrame) -> DataFrame:
    """df. From now on its session's Arrow batches are closed at BATCH_BYTES, unless the session has a bound of its own; results don't depend on it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


def map_texts(
    df: DataFrame, fields: Sequence[T.StructField], make: Callable[[], Callable[[list[str | None]], Sequence[pa.Array]]], text_col: str = "text", keep: Sequence[str] | None = None, arrow: bool = False
) -> DataFrame:
    """df's columns (or those in keep) and the fields that a function computes from the text, one Arrow batch at a time.

    make() is called once in each task and returns the function; that gets a slice of a batch's texts as a list (with arrow: a whole batch's as an Arrow array) and returns an array for each field. An input column with a field's name gives way.
    """
    names = [f.name for f in fields]
    passed = [c for c in (df.columns if keep is None else keep) if c not in names]
    types = [df.schema[c] for c in passed]
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(passed)], F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(types)), *(T.StructField(f"n{i}", f.dataType, f.nullable) for i, f in enumerate(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if arrow:
                *rest, texts = batch.columns
                yield pa.RecordBatch.from_arrays([*rest, *work(texts)], names=schema.names)
                continue
            for at in range(0, batch.num_rows, SLICE):  # so that what a worker makes of a batch never is in memory as a whole
                *rest, texts = batch.slice(at, SLICE).columns
                yield pa.RecordBatch.from_arrays([*rest, *work(texts.to_pylist())], names=schema.names)

    return bounded_batches(source).mapInArrow(run, schema).toDF(*passed, *names)


_HELD: dict = {}


def _give_back() -> None:
    """Free memory that the process keeps for itself goes back to the machine, as far as its C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def held(owner: str, key: object, build: Callable[[], object]) -> object:
    """A worker's one large object (a token table, a memory of chunks, an automaton), built where the owner or its key is another one. Workers are used by one stage after the other; what an earlier stage held is let go first."""
    if _HELD.get("at") != (owner, key):
        _HELD.clear()
        _give_back()
        _HELD.update(value=build(), at=(owner, key))
    return _HELD["value"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
