"""Consistency checks of projects: each yields findings (project_id, code, severity, path), with a severity by stage.

Inputs are tables keyed by project_id; stage is a column of projects.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import audit as A
from folioscope.operators import bibliography as B
from folioscope.operators import registry as R
from folioscope.operators import segments as S

#: Domains of a project's settings, fields of its title page, and the least length of a draft.
DOMAINS = {"mode": ("full", "section", "audit"), "audit_intensity": ("balanced", "strict", "maximum")}
TITLE_FIELDS = ("university", "institute", "department", "direction", "profile", "topic", "author", "supervisor", "city", "year")
LEAST_CHARS = 300


def _found(df: DataFrame, code: str, severity: Column, path: Column) -> DataFrame:
    return df.select("project_id", F.lit(code).alias("code"), severity.alias("severity"), path.alias("path")).filter("severity is not null")


def absent(projects: DataFrame, files: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required files that a project lacks."""
    want = projects.select("project_id", F.explode(F.array(*[F.lit(r) for r in required])).alias("path"))
    return _found(R.unmatched(want, files, ["project_id", "path"]), "STRUCTURE_MISSING", F.lit("ERROR"), F.col("path"))


def unreadable(lines: DataFrame) -> DataFrame:
    """Lines of journals that are no JSON. lines: project_id, file, line_no, error."""
    return _found(lines.filter("error is not null"), "JSON_INVALID", F.lit("ERROR"), F.concat_ws(":", "file", F.col("line_no").cast("string")))


def config(projects: DataFrame, domains: Mapping[str, Sequence[str]] = DOMAINS) -> DataFrame:
    """Settings outside of their domains."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c).isin(*v), F.lit(False)), F.lit(c)) for c, v in domains.items() if c in projects.columns]))
    return _found(projects.select("project_id", F.explode(bad).alias("p")), "CONFIG_INVALID", F.lit("ERROR"), F.col("p"))


def labels(states: DataFrame, required: Sequence[str]) -> DataFrame:
    """Labels that a project's state text lacks. states: project_id, text."""
    bad = F.array_compact(F.array(*[F.when(~F.contains(X.null_empty(F.col("text")), F.lit(r)), F.lit(r)) for r in required]))
    return _found(states.select("project_id", F.explode(bad).alias("p")), "STATE_LABEL_MISSING", F.lit("WARNING"), F.col("p"))


def evidence(entries: DataFrame) -> DataFrame:
    """Evidence with neither or both of path and url, unsafe paths, and ids that a project has twice. entries: project_id, id, path, url."""
    have = lambda c: F.trim(X.null_empty(F.col(c))) != ""
    one = _found(entries, "EVIDENCE_INVALID", F.when(have("path") == have("url"), "ERROR").when(have("path") & ~X.safe_path(F.col("path")), "ERROR"), F.col("id"))
    twice = entries.groupBy("project_id", F.lower("id").alias("key")).agg(F.count("*").alias("__n")).filter("__n > 1")
    return one.unionByName(_found(twice, "EVIDENCE_DUPLICATE", F.lit("ERROR"), F.col("key")))


def sources(records: DataFrame, stage: Column) -> DataFrame:
    """Records without confirmation (by stage), confirmed ones without verification fields, doubled keys. records: project_id, pos, id, title, doi, status, method, checked_at, url and stage."""
    status = R.normal_status(F.col("status"))
    unchecked = _found(records, "SOURCE_UNCONFIRMED", F.when(status == "rejected", "ERROR").when(status != "confirmed", A.by_stage(stage, "INFO", "WARNING", "ERROR")), F.col("id"))
    missing = B.missing_fields(records.filter(status == "confirmed"), ["method", "checked_at", "url"])
    bare = _found(missing, "VERIFICATION_INCOMPLETE", F.when(F.size("missing") > 0, "ERROR"), F.concat_ws(":", "id", F.array_join("missing", "+")))
    key = F.when(X.null_empty(F.col("doi")) != "", F.concat(F.lit("doi:"), F.lower("doi"))).otherwise(F.regexp_replace(F.lower(X.null_empty(F.col("title"))), r"[^\p{L}\p{N}]", ""))
    twice = R.duplicates(records, key, "pos", ["project_id"])
    return unchecked.unionByName(bare).unionByName(_found(twice, "SOURCE_DUPLICATE", F.lit("WARNING"), F.col("key")))


def placeholders(texts: DataFrame, stage: Column) -> DataFrame:
    """Unfinished marks in texts without their code; soft ones pass until the final stage. texts: project_id, path, text and stage."""
    df = texts.withColumn("__stage", stage).withColumn("text", X.mask_code(F.col("text")))
    found = S.markers(df, ["project_id", "path", "__stage"])
    soft = S.is_soft(F.col("mark"))
    return _found(found, "PLACEHOLDER", F.when(soft, A.by_stage(F.col("__stage"), "INFO", "INFO", "ERROR")).otherwise(A.by_stage(F.col("__stage"), "INFO", "ERROR", "ERROR")), F.concat_ws(":", "path", "code")).distinct()


def drafts(texts: DataFrame, stage: Column) -> DataFrame:
    """Drafts with too few significant characters."""
    n = X.significant_length(F.col("text"))
    return _found(texts, "DRAFT_EMPTY", F.when(n < LEAST_CHARS, A.by_stage(stage, "INFO", "ERROR", "ERROR")), F.col("path"))


def title_page(projects: DataFrame, stage: Column, fields: Sequence[str] = TITLE_FIELDS) -> DataFrame:
    have = [f for f in fields if f in projects.columns]
    df = B.missing_fields(projects, have)
    return _found(df.withColumn("p", F.explode("missing")), "TITLE_FIELD_MISSING", A.by_stage(stage, "INFO", "WARNING", "ERROR"), F.col("p"))


def memory(index: DataFrame, files: DataFrame) -> DataFrame:
    """Files that changed, went or came since they were recorded. Both: project_id, path, sha256."""
    diff = R.snapshot_diff(index, files, ["project_id", "path"], "sha256")
    severity = F.when(F.col("change") == "removed", "ERROR").otherwise("WARNING")
    code = F.when(F.col("change") == "removed", "MEMORY_MISSING").when(F.col("change") == "added", "MEMORY_UNTRACKED").otherwise("MEMORY_CHANGED")
    return diff.select("project_id", code.alias("code"), severity.alias("severity"), "path")


def page_count(stored: DataFrame, actual: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Documents whose stored number of characters is far from the actual one. stored: project_id, path, chars; actual: project_id, path, n."""
    df = stored.join(actual, ["project_id", "path"])
    return _found(df, "PAGES_STALE", F.when(F.abs(F.col("chars") - F.col("n")) > ratio * F.col("n"), "WARNING"), F.col("path"))


def claims(table: DataFrame, records: DataFrame, stage: Column) -> DataFrame:
    """Claims with missing or unconfirmed sources. table: project_id, claim_id, source_ids; records: source id and status."""
    found = R.claims(table, "claim_id", "source_ids", records, "id", "status").join(table.select("project_id", "claim_id").distinct(), "claim_id")
    return _found(found, "CLAIM_UNSUPPORTED", F.when(F.col("outcome") == "missing", "ERROR").when(F.col("outcome") == "unsupported", A.by_stage(stage, "INFO", "WARNING", "ERROR")), F.col("claim_id").cast("string"))


def diagnose(*findings: DataFrame) -> DataFrame:
    """All checks' findings together."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def readiness(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Counts by severity and the status of every project, those without findings too."""
    known = A.verdict(findings, ["project_id"])
    return projects.select("project_id").join(known, "project_id", "left").na.fill(0).na.fill("ready", ["status"])
