"""Checks of a project's review and of what is handed in: each yields findings (project_id, code, severity, path), like those of doctor.

projects: project_id, stage (draft, prefinal, final) and what a check names besides. Late stages are prefinal and final. All joins are on the project, and on a run, snapshot or path inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import audit as A
from folioscope.operators import registry as R
from folioscope.operators.doctor import _found

#: The document that is handed in, and the parts that it needs.
FINAL = "final/work.docx"
PARTS = ("[Content_Types].xml", "word/document.xml")
#: How an annotation states its pages, and how it says that they are those of a part.
STATED_PAGES = r"(?iu)(?<![\d.,])(\d{1,4})\s*(?:с\.|стр\.?(?![а-яё])|страниц[а-яё]*)"
PARTIAL = r"(?iuU)текстов\w*\s+част|основн\w+\s+(?:текст|част)|без\s+(?:учёта\s+|учета\s+)?приложени|без\s+списка\s+литератур|не\s+считая\s+приложени"
INTENSITIES = ("balanced", "strict", "maximum")


def _stage() -> Column:
    return F.col("stage")


def _late() -> Column:
    return _stage().isin("prefinal", "final")


def snapshots(projects: DataFrame, recorded: DataFrame, recorded_inputs: DataFrame, current_inputs: DataFrame) -> DataFrame:
    """No recorded snapshot; one whose hash isn't the manifest's or that of its stored copy; one whose inputs have changed since.

    recorded: project_id, sha, manifest_sha, copy_sha; inputs: project_id, path, sha256. The path of a stale snapshot's finding is the first changed input's.
    """
    df = projects.join(recorded, "project_id", "left")
    missing = _found(df, "AUDIT_SNAPSHOT_MISSING", F.when(F.col("sha").isNull(), A.by_stage(_stage(), "INFO", "WARNING", "ERROR")), F.lit("audit/snapshot-inputs.json"))
    differs = ~F.col("sha").eqNullSafe(F.col("manifest_sha")) | ~F.col("sha").eqNullSafe(F.col("copy_sha"))
    hashed = _found(df, "AUDIT_SNAPSHOT_HASH_MISMATCH", F.when(F.col("sha").isNotNull() & differs, A.by_stage(_stage(), "WARNING", "ERROR", "ERROR")), F.lit("audit/snapshot-inputs.json"))
    changed = R.snapshot_diff(recorded_inputs, current_inputs, ["project_id", "path"], "sha256").groupBy("project_id").agg(F.min("path").alias("path"))
    stale = _found(df.filter("sha is not null").join(changed, "project_id"), "AUDIT_SNAPSHOT_STALE", A.by_stage(_stage(), "INFO", "WARNING", "ERROR"), F.col("path"))
    return missing.unionByName(hashed).unionByName(stale)


def audit_registry(projects: DataFrame, runs: DataFrame, findings: DataFrame, reports: DataFrame, attempts: DataFrame, problems: DataFrame) -> DataFrame:
    """What a review's records say against it: reports that no attempt names, runs of an older protocol, problems of the replay, open findings of high severity, unfinished runs, and open failures on the snapshot that counts.

    projects: also current_sha, recorded_sha. runs: project_id, run_id, status, pending, unclosed (numbers of tasks and findings), snapshot_sha, legacy. findings: project_id, finding_id, status, severity. reports and attempts: project_id, path. problems: project_id, problem.
    """
    stage = projects.select("project_id", "stage")
    three = A.by_stage(_stage(), "WARNING", "ERROR", "ERROR")
    out = [_found(R.unmatched(reports, attempts, ["project_id", "path"]).join(stage, "project_id"), "AUDIT_REPORT_ORPHAN", three, F.col("path"))]
    out.append(_found(runs.filter("legacy").select("project_id").distinct(), "AUDIT_LEGACY_RUNS", F.lit("WARNING"), F.lit("audit/manifest.json")))
    out.append(_found(problems.join(stage, "project_id"), "AUDIT_REPLAY_PROBLEM", three, F.col("problem")))
    high = findings.filter((F.col("status") == "open") & F.col("severity").isin(*A.HIGH))
    out.append(_found(high.join(stage, "project_id"), "AUDIT_FINDINGS_OPEN", three, F.col("finding_id").cast("string")))
    own = runs.filter("not legacy").join(projects.select("project_id", "stage", "current_sha", "recorded_sha"), "project_id")
    unfinished = F.col("status").isin("planned", "running") | ((F.col("status") == "reported") & (F.col("pending") > 0))
    out.append(_found(own, "AUDIT_RUNS_INCOMPLETE", F.when(unfinished, A.by_stage(_stage(), "INFO", "ERROR", "ERROR")), F.col("run_id").cast("string")))
    focus = F.coalesce((F.col("snapshot_sha") == F.col("current_sha")) | (F.col("snapshot_sha") == F.col("recorded_sha")), F.lit(False))
    out.append(_found(own, "AUDIT_FAIL_UNCLOSED", F.when(focus & (F.col("unclosed") > 0), three), F.col("run_id").cast("string")))
    return _all(out)


def _all(found: Sequence[DataFrame]) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def final_files(projects: DataFrame, files: DataFrame, name: str = FINAL, parts: Sequence[str] = PARTS) -> DataFrame:
    """Projects in their final stage: other files beside the document, a wrong name, no document or several, and a document that is no package, lacks parts or is damaged.

    files: project_id, path, is_document, parts (an array, null where it is no package), damaged.
    """
    final = projects.filter("stage = 'final'").select("project_id")
    own = files.join(final, "project_id")
    counts = own.groupBy("project_id").agg(F.count_if("is_document").alias("docs"), F.count_if(~F.col("is_document")).alias("others"), F.coalesce(F.bool_or(F.col("is_document") & (F.col("path") == name)), F.lit(False)).alias("named"))
    df = final.join(counts, "project_id", "left").na.fill(0, ["docs", "others"]).na.fill(False, ["named"])
    codes = F.array_compact(F.array(F.when(F.col("others") > 0, "FINAL_EXTRA_FILES"), F.when((F.col("docs") > 0) & ~F.col("named"), "FINAL_DOCX_NAME"), F.when(F.col("docs") == 0, "FINAL_DOCX_MISSING"), F.when(F.col("docs") > 1, "FINAL_DOCX_MULTIPLE")))
    counted = df.select("project_id", F.explode(codes).alias("code"), F.lit("ERROR").alias("severity"), F.lit("final/").alias("path"))
    lacks = F.col("parts").isNull() | (F.size(F.array_except(F.array(*[F.lit(p) for p in parts]), "parts")) > 0)
    docs = own.filter("is_document")
    invalid = _found(docs, "FINAL_DOCX_INVALID", F.when(lacks, "ERROR"), F.col("path"))
    corrupt = _found(docs, "FINAL_DOCX_CORRUPT", F.when(F.col("parts").isNotNull() & F.col("damaged"), "ERROR"), F.col("path"))
    return counted.unionByName(invalid).unionByName(corrupt)


def outdated_build(projects: DataFrame, files: DataFrame, built: DataFrame, now: DataFrame, name: str = FINAL) -> DataFrame:
    """Late projects whose document was made from other inputs than there are now. built and now: project_id, path, sha256; files: project_id, path."""
    late = projects.filter(_late()).join(files.filter(F.col("path") == name).select("project_id").distinct(), "project_id", "left_semi")
    changed = R.snapshot_diff(built, now, ["project_id", "path"], "sha256").select("project_id").distinct()
    return _found(late.join(changed, "project_id", "left_semi"), "FINAL_DOCX_OUTDATED", F.lit("ERROR"), F.lit(name))


def stated_pages(c: Column) -> Column:
    """Numbers of pages that a text states, code and comments left out."""
    found = F.regexp_extract_all(_prose(c), F.lit(STATED_PAGES), F.lit(1)).cast("array<int>")
    return F.filter(found, lambda n: n > 0)


def partial_pages(c: Column) -> Column:
    """Whether a sentence with a number of pages says that they are those of a part."""
    around = F.regexp_extract_all(_prose(c), F.lit(r"(?iu)[^.;\n]*(?<![\d.,])\d{1,4}\s*(?:с\.|стр\.?(?![а-яё])|страниц[а-яё]*)[^.;\n]*"), F.lit(0))
    return F.exists(around, lambda s: s.rlike(PARTIAL))


def _prose(c: Column) -> Column:
    return F.regexp_replace(X.mask_code(X.null_empty(c)), r"(?s)<!--.*?-->", " ")


def annotation_pages(projects: DataFrame, annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Late projects whose annotation states no pages, or others than the document has (each alone or all added up). annotations: project_id, path, text; pages: project_id, pages (null: not known)."""
    df = projects.filter(_late()).join(annotations, "project_id").join(pages, "project_id")
    df = df.filter(X.strip(X.null_empty(F.col("text"))) != "").withColumn("n", stated_pages(F.col("text")))
    n, actual = F.col("n"), F.col("pages")
    fits = F.array_contains(n, actual) | ((F.size(n) > 1) & (F.aggregate(n, F.lit(0), lambda a, x: a + x) == actual))
    final = _stage() == "final"
    code = F.when(F.size(n) == 0, "ANNOTATION_PAGES_UNVERIFIED").when(actual.isNull(), "ANNOTATION_PAGES_UNVERIFIED").when(fits, None).when(partial_pages(F.col("text")), "ANNOTATION_PAGES_PARTIAL").otherwise("ANNOTATION_PAGES_MISMATCH")
    df = df.withColumn("code", code).withColumn("severity", F.when(F.col("code") == "ANNOTATION_PAGES_MISMATCH", "ERROR").when(F.col("code") == "ANNOTATION_PAGES_PARTIAL", "WARNING").when((F.size(n) > 0) & final, "WARNING").otherwise("INFO"))
    return df.filter("code is not null").select("project_id", "code", "severity", "path")


def validation(projects: DataFrame, documents: DataFrame, reports: DataFrame, reruns: DataFrame) -> DataFrame:
    """A project's one document against the recorded report and a new run of the rules: no report, an unreadable one, one of another document or profile, a run that failed, errors, warnings, and a report that says something else than the run. Before the final stage only the warnings of a report on this document are shown.

    projects: also profile. documents: project_id, path, sha256. reports: project_id, document_sha256, profile, errors, warnings, readable. reruns: project_id, errors (null: failed), warnings.
    """
    one = documents.groupBy("project_id").agg(F.min("path").alias("path"), F.min("sha256").alias("sha256"), F.count("*").alias("__n")).filter("__n = 1")
    r = reports.select("project_id", "document_sha256", F.col("profile").alias("r_profile"), F.col("errors").alias("r_errors"), F.col("warnings").alias("r_warnings"), "readable")
    df = projects.select("project_id", "stage", "profile").join(one, "project_id").join(r, "project_id", "left").join(reruns, "project_id", "left")
    final, same = _stage() == "final", F.coalesce(F.col("document_sha256") == F.col("sha256"), F.lit(False))
    readable = F.coalesce("readable", F.lit(False))
    ran = F.col("errors").isNotNull()
    rows = [
        (final & F.col("readable").isNull(), "AUTOMATED_VALIDATION_MISSING", "ERROR"),
        (final & ~F.coalesce("readable", F.lit(True)), "AUTOMATED_VALIDATION_INVALID", "ERROR"),
        (final & readable & ~(same & F.col("r_profile").eqNullSafe(F.col("profile"))), "AUTOMATED_VALIDATION_STALE", "ERROR"),
        (final & ~ran, "VALIDATION_FAILED_TO_RUN", "ERROR"),
        (final & (F.col("errors") > 0), "VALIDATION_ERRORS", "ERROR"),
        ((final & ran & (F.col("warnings") > 0)) | (~final & readable & same & (F.col("r_warnings") > 0)), "VALIDATION_WARNINGS", "WARNING"),
        (final & ran & readable & same & ~F.col("r_errors").eqNullSafe(F.col("errors")), "AUTOMATED_VALIDATION_MISMATCH", "ERROR"),
    ]
    each = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for c, code, s in rows]))
    return df.select("project_id", F.explode(each).alias("f"), "path").select("project_id", "f.code", "f.severity", "path")


def final_waves(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """Final projects without a complete primary wave on the current snapshot, or without a complete blind one planned after it was closed, by other people, with other tasks and executions; and waves of a lower intensity than an earlier run's.

    projects: also current_sha, intensity. runs: project_id, run_id, kind, snapshot_sha, planned, closed, complete, degraded, intensity, auditors, tasks, executions (arrays).
    """
    final = projects.filter("stage = 'final'").select("project_id", "current_sha", F.col("intensity").alias("own_intensity"))
    good = runs.join(final, "project_id").filter((F.col("snapshot_sha") == F.col("current_sha")) & F.col("complete"))
    primary = good.filter("kind = 'primary'")
    a = primary.select("project_id", "run_id", F.col("planned").alias("p"), F.coalesce("closed", F.lit(0)).alias("c"), F.col("degraded").alias("d"), F.col("auditors").alias("a"), F.col("tasks").alias("t"), F.col("executions").alias("e"), F.coalesce(F.when(F.col("intensity").isin(*INTENSITIES), F.col("intensity")), F.col("own_intensity")).alias("applied"))
    b = good.filter("kind = 'blind_regression'").select("project_id", "planned", "degraded", "auditors", "tasks", "executions")
    apart = (F.col("degraded") | F.col("d") | ~F.arrays_overlap("auditors", "a")) & ~F.arrays_overlap("tasks", "t") & ~F.arrays_overlap("executions", "e")
    pairs = a.join(b, "project_id").filter((F.col("planned") > F.col("c")) & F.coalesce(apart, F.lit(True))).groupBy("project_id").agg(F.min(F.struct("p", "applied", "run_id")).alias("x"))
    no_primary = final.join(primary.select("project_id").distinct(), "project_id", "left_anti")
    no_blind = final.join(primary.select("project_id").distinct(), "project_id", "left_semi").join(pairs, "project_id", "left_anti")
    rank = lambda c: F.array_position(F.array(*[F.lit(i) for i in INTENSITIES]), c)
    earlier = runs.filter(F.col("intensity").isin(*INTENSITIES)).join(pairs.select("project_id", "x.*"), "project_id").filter(F.col("planned") < F.col("p")).groupBy("project_id", F.col("applied")).agg(F.max(rank(F.col("intensity"))).alias("top"))
    out = [_found(no_primary, "AUDIT_PRIMARY_WAVE_MISSING", F.lit("ERROR"), F.lit("audit/manifest.json")), _found(no_blind, "AUDIT_BLIND_WAVE_MISSING", F.lit("ERROR"), F.lit("audit/manifest.json"))]
    out.append(_found(earlier, "AUDIT_INTENSITY_LOWERED", F.when(F.col("top") > rank(F.col("applied")), "WARNING"), F.lit("project.json")))
    return _all(out)


def defense_evidence(projects: DataFrame, entries: DataFrame) -> DataFrame:
    """Final projects without a file of their defence. entries: project_id, group, size."""
    have = entries.filter((F.col("group") == "defense") & (F.col("size") > 0))
    return _found(projects.filter("stage = 'final'").join(have, "project_id", "left_anti"), "USER_EVIDENCE_REQUIRED", F.lit("ERROR"), F.lit("evidence/index.json"))


def next_actions(findings: DataFrame, order: Sequence[str] = ("ERROR", "WARNING", "INFO"), most: int = 3) -> DataFrame:
    """The codes that a project has to deal with first: by severity, then by how many findings have them, then by name."""
    counted = findings.groupBy("project_id", "severity", "code").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("severity"))
    w = Window.partitionBy("project_id").orderBy(rank, F.desc("n"), "code")
    return counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("project_id", "place", "code", "severity", "n")
