"""Readers and writers of registries, journals and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as X

#: Names under which an object may hold its list of sources.
LISTS = ("sources", "items", "bibliography", "refs", "references")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON files, each a whole; what can't be read is in _corrupt_record."""
    reader = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with their number in the file, the value by a schema, and an error; bad lines stay as rows, blank lines go."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).filter("trim(line) <> ''")
    value = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    bad = F.try_parse_json("line").isNull()
    return lines.select("file", (F.col("i") + 1).alias("line_no"), F.when(~bad, value).alias("value"), F.when(bad, F.lit("not JSON")).alias("error"))


def parsed_lines(df: DataFrame, line: str, schema: str) -> DataFrame:
    """df with value and error of a column of JSON lines."""
    bad = F.try_parse_json(line).isNull()
    return df.withColumn("value", F.when(~bad, F.from_json(line, schema))).withColumn("error", F.when(bad, F.lit("not JSON")))


def registry_items(df: DataFrame) -> DataFrame:
    """A row for each source, whatever name the list has; a table of sources stays as it is."""
    have = [c for c in LISTS if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)]
    if not have:
        return df
    return df.select(F.explode(F.coalesce(*[F.col(c) for c in have])).alias("s")).select("s.*")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(tier, phrase) of a JSON object of lists; names that begin with an underscore are comments. A missing file is an error, never an empty lexicon."""
    df = read_json(spark, path)
    tiers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and not f.name.startswith("_")]
    if not tiers:
        raise ValueError(f"{path} has no lists of phrases")
    out = None
    for t in tiers:
        rows = df.select(F.lit(t).alias("tier"), F.explode(t).alias("phrase"))
        out = rows if out is None else out.unionByName(rows)
    return out


def drafts(spark: SparkSession, path: str) -> DataFrame:
    """Draft files with kind and number from their names (chapter-2.md)."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).withColumn("path", F.input_file_name())
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return df.select("path", F.regexp_extract(name, r"^([a-z]+)", 1).alias("kind"), F.regexp_extract(name, r"-(\d+)$", 1).try_cast("int").alias("number"), F.col("value").alias("text"))


def tracked_files(spark: SparkSession, path: str) -> DataFrame:
    """logical_id, size and SHA-256 of the files under a root, without temporary and hidden ones."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split(":", 1)[-1]
    inside = X.logical_id(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + "".join(rf"\{c}" if c in r"\.[]{}()*+-?^$|" else c for c in root) + "/*", ""))
    return df.select(inside.alias("logical_id"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).filter(~F.col("logical_id").rlike(r"(?:^|/)(?:\.|~\$|Thumbs\.db$|__pycache__/)|\.tmp$"))


def write_new(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write where nothing is yet; an existing target is an error."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Replace a report; the committer swaps it in as a whole."""
    df.write.mode("overwrite").json(path)


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
