"""Review logs: replay into a registry of findings, plans, integrity, verdicts; snapshots and journals.

A log is a table of events with a sequence number. Replay groups it by finding and folds each finding's events in order with a built-in aggregate; what depends on other findings is joined to the events beforehand, so findings are replayed independently of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as X
from folioscope.operators.walk import walked

#: Domains of the log.
GATES = ("MET", "SRC", "LOG", "LNG", "STY", "EVD", "TEC", "DOC", "OWN")
SEVERITIES = ("BLOCKER", "MAJOR", "MINOR", "INFO")
HIGH = ("BLOCKER", "MAJOR")
SUBJECTIVE = ("STY", "LNG", "LOG")
LEVELS = ("E0", "E1", "E2", "E3", "E4")
STATUSES = ("open", "resolved", "rejected", "accepted_risk", "waived")
VERDICTS = ("pass", "fail", "partial", "invalid_finding")

EVENT = "struct<seq:bigint,ord:int,action:string,verdict:string,snapshot_seq:bigint,snapshot_sha:string,auditor:string,evidence_level:string,severity:string,gate:string,fix_class:string,reason:string,allowed:boolean>"


def auditor_key(c: Column) -> Column:
    """A person's id without white space, in lower case."""
    return X.title_key(c)


def first_registrations(events: DataFrame) -> DataFrame:
    """Of each finding the first registration; a later one is only a problem."""
    regs = events.filter("action = 'register'")
    return regs.withColumn("__k", F.row_number().over(Window.partitionBy("finding_id").orderBy("seq", "ord"))).filter("__k = 1").drop("__k")


def replay_problems(events: DataFrame) -> DataFrame:
    """Registrations of a known finding, and rechecks and decisions on one that isn't known yet."""
    first = events.filter("action = 'register'").groupBy("finding_id").agg(F.min(F.struct("seq", "ord")).alias("__first"))
    seen = events.join(first, "finding_id", "left")
    here = F.struct("seq", "ord")
    code = F.when((F.col("action") == "register") & (here > F.col("__first")), "duplicate").when((F.col("action") == "recheck") & (F.col("__first").isNull() | (here < F.col("__first"))), "unknown recheck").when(~F.col("action").isin("register", "recheck") & (F.col("__first").isNull() | (here < F.col("__first"))), "unknown decision")
    return seen.select("finding_id", "seq", code.alias("problem")).filter("problem is not null")


def _step(a: Column, e: Column) -> Column:
    """One event. A recheck's pass closes on a newer snapshot without a negative verdict; invalid_finding needs another person and E3 or E4; a negative one opens again. A decision needs its conditions."""
    known = a["status"].isNotNull()
    open_ = a["status"] == "open"
    recheck = e["action"] == "recheck"
    negative = e["verdict"].isin("fail", "partial")
    clean = ~F.array_contains(a["negative"], F.coalesce(e["snapshot_sha"], F.lit("")))
    newer = (e["snapshot_seq"] > a["snapshot_seq"]) & (e["snapshot_sha"] != a["snapshot_sha"])
    independent = auditor_key(e["auditor"]) != auditor_key(a["auditor"])
    reasoned = F.length(F.trim(F.coalesce(e["reason"], F.lit("")))) > 0
    status = (
        F.when(~known, F.when(e["action"] == "register", "open"))
        .when(recheck & (e["verdict"] == "pass") & open_ & clean & newer, "resolved")
        .when(recheck & (e["verdict"] == "invalid_finding") & open_ & clean & independent & F.upper(e["evidence_level"]).isin("E3", "E4"), "rejected")
        .when(recheck & negative & a["status"].isin("resolved", "rejected"), "open")
        .when((e["action"] == "accept_risk") & open_ & reasoned & ~a["severity"].isin(*HIGH) & F.coalesce(e["allowed"], F.lit(True)), "accepted_risk")
        .when((e["action"] == "waive") & open_ & (a["fix_class"] == "SUPERVISOR_APPROVAL") & F.coalesce(e["allowed"], F.lit(False)), "waived")
        .otherwise(a["status"])
    )
    starts = ~known & (e["action"] == "register")
    keep = lambda name: F.when(starts, e[name]).otherwise(a[name]).alias(name)
    counted = known & (e["action"] != "register")
    changed = counted & ~status.eqNullSafe(a["status"])
    return F.struct(
        status.alias("status"),
        keep("snapshot_seq"),
        keep("snapshot_sha"),
        keep("auditor"),
        keep("severity"),
        keep("gate"),
        keep("fix_class"),
        F.when(known & recheck & negative, F.array_append(a["negative"], F.coalesce(e["snapshot_sha"], F.lit("")))).otherwise(a["negative"]).alias("negative"),
        (a["history"] + F.when(counted & (recheck | changed), 1).otherwise(0)).alias("history"),
        F.when(changed, F.when(status == "open", F.lit(None).cast("bigint")).otherwise(e["seq"])).otherwise(a["resolved_seq"]).alias("resolved_seq"),
    )


def _start() -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        none("string").alias("status"), none("bigint").alias("snapshot_seq"), none("string").alias("snapshot_sha"), none("string").alias("auditor"), none("string").alias("severity"), none("string").alias("gate"),
        none("string").alias("fix_class"), F.array().cast("array<string>").alias("negative"), F.lit(0).alias("history"), none("bigint").alias("resolved_seq"),
    )


def replay(events: DataFrame) -> DataFrame:
    """The registry: each known finding's status, severity, gate, number of history entries and the event that resolved it.

    events: finding_id, seq, ord (0 before 1 at equal seq), action (register, recheck, accept_risk, waive) and the other fields of EVENT. A finding's events are few (they are one row's array); findings are many.
    """
    fields = [x.split(":")[0] for x in EVENT[7:-1].split(",")]
    grouped = events.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct(*fields).cast(EVENT))).alias("e"))
    out = grouped.select("finding_id", F.aggregate("e", _start(), _step).alias("r")).filter("r.status is not null")
    return out.select("finding_id", "r.status", "r.severity", "r.gate", "r.history", "r.resolved_seq")


#: Ranges of time that a gate's waves and questions are dealt into.
TIMES = 64


def _latest(tops: list, planned: int, key: str, most: int) -> None:
    """Keeps (planned, key) of the `most` different keys whose latest plan is last, the last one first."""
    if len(tops) == most and planned <= tops[-1][0]:
        return
    for i, (p, k) in enumerate(tops):
        if k == key:
            if planned <= p:
                return
            del tops[i]
            break
    tops.append((planned, key))
    tops.sort(key=lambda t: -t[0])
    del tops[most:]


def _waves_so_far():
    """A step over waves (as they are closed) and questions of one gate: three other texts planned behind a question's finding, and a wave among these that brought evidence, are told by the four, or two, texts planned last."""
    texts: list = []
    fresh: list = []

    def step(row: dict) -> dict | None:
        if row["ord"] == 1:
            _latest(texts, row["planned"], row["key"], 4)
            if row["fresh"]:
                _latest(fresh, row["planned"], row["key"], 2)
            return None
        if row["ord"] == 2:  # the end of a range of time
            return {"held": [{"planned": p, "key": k, "fresh": new} for tops, new in ((texts, False), (fresh, True)) for p, k in tops], "allowed": None}
        behind = lambda tops: sum(p > row["planned"] and k != row["key"] for p, k in tops) if row["planned"] is not None else 0
        return {"held": None, "allowed": behind(texts) >= 3 and behind(fresh) == 0}

    return step


_WALKED = (T.StructField("held", T.ArrayType(T.StructType([T.StructField("planned", T.LongType()), T.StructField("key", T.StringType()), T.StructField("fresh", T.BooleanType())]))), T.StructField("allowed", T.BooleanType()))


def risk_facts(events: DataFrame, waves: DataFrame, findings: DataFrame) -> DataFrame:
    """events with allowed set for accept_risk on a MINOR finding of a subjective gate: at least three later closed waves of the gate with different texts, none of which brought a finding with E2 or more.

    waves: gate, run_id, planned, closed, content_key. findings: finding_id, gate, run_id, planned, content_key, evidence_level, severity; a finding has one row.

    Questions aren't paired with waves. A gate's waves and questions are walked in the order of their time, in ranges of time; what a range begins with comes from the few latest texts of each range before it.
    """
    subjective = F.col("gate").isin(*SUBJECTIVE)
    mine = findings.filter(subjective & (F.col("severity") == "MINOR")).select("finding_id", "gate", F.col("planned").cast("long").alias("planned"), F.col("content_key").cast("string").alias("key"))
    asks = events.filter("action = 'accept_risk' and seq is not null").select("finding_id", F.col("seq").cast("long").alias("at")).distinct().join(mine, "finding_id")
    fresh = findings.filter(subjective & F.col("evidence_level").isin("E2", "E3", "E4")).select("gate", "run_id").distinct().withColumn("fresh", F.lit(True))
    closed = waves.filter(subjective & F.col("closed").isNotNull() & F.col("planned").isNotNull() & F.col("content_key").isNotNull()).join(fresh, ["gate", "run_id"], "left")
    closed = closed.select("gate", F.col("closed").cast("long").alias("at"), F.col("planned").cast("long").alias("planned"), F.col("content_key").cast("string").alias("key"), F.coalesce("fresh", F.lit(False)).alias("fresh"))
    bounds = closed.groupBy("gate").agg(F.percentile_approx("at", [i / TIMES for i in range(1, TIMES)], F.lit(1000)).alias("bounds"))
    dealt = lambda df: df.join(F.broadcast(bounds), "gate", "left").withColumn("block", F.when(F.col("bounds").isNull(), 0).otherwise(F.size(F.filter("bounds", lambda b: b < F.col("at"))))).drop("bounds")  # noqa: E731 - a row for each subjective gate
    closed, asks = dealt(closed), dealt(asks)
    nothing = lambda kind: F.lit(None).cast(kind)
    row = lambda df, at, ord_, id_, planned, key, fresh: df.select("gate", "block", at.alias("at"), F.lit(ord_).alias("ord"), id_.alias("finding_id"), planned.alias("planned"), key.alias("key"), fresh.alias("fresh"))
    id_type = asks.schema["finding_id"].dataType
    c = F.col

    # of each range of time the texts planned last, and what all ranges before hold
    each = closed.groupBy("gate", "block", "fresh", "key").agg(F.max("planned").alias("planned"))
    place = F.row_number().over(Window.partitionBy("gate", "block", "fresh").orderBy(F.desc("planned"), "key"))
    few = each.withColumn("place", place).filter("place <= 4")
    ends = few.select("gate", "block").distinct()
    steps = row(few, c("block").cast("long"), 1, nothing(id_type), c("planned"), c("key"), c("fresh")).unionByName(row(ends, c("block").cast("long"), 2, nothing(id_type), nothing("long"), nothing("string"), nothing("boolean")))
    held = walked(steps.drop("block"), ["gate"], ["at", "ord"], _waves_so_far, _WALKED).select("gate", c("at").cast("int").alias("after"), "held")
    # the next range that has questions or waves begins with it; a range without waves hands on what it got
    after = held.withColumn("until", F.coalesce(F.lead("after").over(Window.partitionBy("gate").orderBy("after")), F.lit(TIMES - 1)))
    begun = after.filter("after < until").select("gate", F.explode(F.sequence(c("after") + 1, c("until"))).alias("block"), "held").select("gate", "block", F.explode("held").alias("h"))
    points = row(begun, nothing("long"), 1, nothing(id_type), c("h.planned"), c("h.key"), c("h.fresh"))
    points = points.unionByName(row(closed, c("at"), 1, nothing(id_type), c("planned"), c("key"), c("fresh"))).unionByName(row(asks, c("at"), 0, c("finding_id"), c("planned"), c("key"), nothing("boolean")))
    subject = walked(points, ["gate", "block"], ["at", "ord", "finding_id"], _waves_so_far, _WALKED).groupBy("finding_id", c("at").alias("seq")).agg(F.bool_or("allowed").alias("__ok"))
    joined = events.join(subject, ["finding_id", "seq"], "left")
    return joined.withColumn("allowed", F.when((F.col("action") == "accept_risk") & F.col("__ok").isNotNull(), F.col("__ok")).otherwise(F.col("allowed"))).drop("__ok")


def findings_view(registry: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts by status, and the open ids of high severity in order."""
    high = F.array_sort(F.collect_list(F.when((F.col("status") == "open") & F.col("severity").isin(*HIGH), F.col("finding_id").cast("string"))))
    return registry.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.array_join(high, ",").alias("open_high"))


def blocking(tasks: DataFrame, registry: DataFrame, by: Sequence[str]) -> DataFrame:
    """Why a run can't be closed: tasks without an attempt, and open findings of high severity.

    tasks: by, task_id, attempts, status, finding_ids (an array)."""
    pending = tasks.groupBy(*by).agg(F.count_if((F.col("attempts") == 0) & (F.col("status") != "cancelled")).alias("pending"))
    each = tasks.select(*by, F.explode("finding_ids").alias("finding_id")).join(registry.filter("status = 'open'").select("finding_id", "severity"), "finding_id")
    opened = each.groupBy(*by).agg(F.count("*").alias("unclosed"), F.count_if(F.col("severity").isin(*HIGH)).alias("open_high"))
    return pending.join(opened, list(by), "left").na.fill(0, ["unclosed", "open_high"])


#: Roles of each preset with their counts: at any intensity, and more at the highest (in the second place). A count of None is 2 at the highest intensity, else 1.
MATRIX = {
    "intake": (("MET", 1), ("EVD", 1), ("TEC", 1)),
    "plan": (("MET", 1), ("LOG", 2), ("EVD", 1), ("TEC", 1)),
    "subsection": (("LOG", 1), ("SRC", 1), ("LNG", 1)),
    "sources": (("SRC-BIB", 2), ("SRC-CIT", None)),
    "product": (("TEC", 2), ("EVD", 1), ("LOG", 1), ("OWN-QUESTIONS", 1)),
    "chapter": (("MET", None), ("LOG", 2), ("SRC", None), ("LNG", 1), ("STY", 1), ("OWN-QUESTIONS", 1)),
    "pilot": (("EVD", 2), ("LOG", 1), ("SRC", 1)),
    "docx": (("DOC-STRUCTURE", 1), ("DOC-VISUAL", 1), ("MET-FORMAT", 1), ("SRC-CROSSREF", 1)),
    "draft": (("MET", 1), ("SRC", 1), ("LOG", 1), ("LNG", 1), ("STY", 1), ("EVD", 1), ("TEC", 1), ("DOC", 1), ("OWN-QUESTIONS", 1)),
    "prefinal": tuple((g, 1) for g in GATES),
    "final": tuple((g, None) for g in GATES),
}
FINAL_DOUBLED = ("MET", "LOG", "SRC", "EVD", "TEC", "DOC")
CHAPTER_PROJECT = (("EVD", None), ("TEC", None))


def plan_rows(preset: str, intensity: str, project: bool = False, odd_index: bool = False) -> list[tuple[str, int]]:
    """(role, replicas) of a preset."""
    most = 2 if intensity == "maximum" else 1
    rows = [*MATRIX[preset], *(CHAPTER_PROJECT if preset == "chapter" and project else ())]
    if preset == "subsection" and (intensity == "maximum" or intensity == "strict" and odd_index):
        rows.append(("STY", 1))
    out = [(role, most if n is None else n) for role, n in rows]
    if preset == "final" and intensity in ("strict", "maximum"):
        out = [(role, 2 if role in FINAL_DOUBLED else n) for role, n in out]
    return out


def plan_tasks(runs: DataFrame) -> DataFrame:
    """A task for each replica of each role of a run's plan. runs: run_id, preset, intensity, project, odd_index."""
    choices = [(p, i, j, o) for p in MATRIX for i in ("balanced", "strict", "maximum") for j in (False, True) for o in (False, True)]
    rows = [(p, i, j, o, role, n) for p, i, j, o in choices for role, n in plan_rows(p, i, j, o)]
    plan = runs.sparkSession.createDataFrame(rows, "preset string, intensity string, project boolean, odd_index boolean, role string, replicas int")
    tasks = runs.join(F.broadcast(plan), ["preset", "intensity", "project", "odd_index"])  # a fixed table of some hundred rows
    return tasks.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("replicas")))).select("run_id", "role", "replica", F.concat_ws("-", "run_id", "role", F.col("replica").cast("string")).alias("task_id"))


def review_order(parts: Column, replica: Column) -> Column:
    """An array turned by a replica's place, so that replicas begin at different parts."""
    n = F.size(parts)
    k = F.pmod(replica, n)
    return F.concat(F.slice(parts, k + 1, n), F.slice(parts, F.lit(1), F.greatest(k, F.lit(0))))


def report_problems(reports: DataFrame) -> DataFrame:
    """Violations of a report's findings: unknown values, and a high severity without evidence level E2, evidence, criterion and a place.

    reports: report_id, severity, evidence_level, n_evidence, criterion, section, quote."""
    high = F.col("severity").isin(*HIGH)
    code = F.array_compact(
        F.array(
            F.when(~F.col("severity").isin(*SEVERITIES), "severity"),
            F.when(~F.col("evidence_level").isin(*LEVELS), "evidence_level"),
            F.when(high & (F.col("evidence_level") < "E2"), "weak evidence"),
            F.when(high & (F.col("n_evidence") == 0), "no evidence"),
            F.when(high & (F.trim(X.null_empty(F.col("criterion"))) == ""), "no criterion"),
            F.when(high & (F.trim(X.null_empty(F.col("section"))) == "") & (F.trim(X.null_empty(F.col("quote"))) == ""), "no place"),
        )
    )
    return reports.select("report_id", F.explode(code).alias("problem"))


def stored_status(status: Column, severities: Column) -> Column:
    """A task's status as it is kept: a pass with a finding of high severity is a failure."""
    return F.when((status == "pass") & F.exists(severities, lambda s: s.isin(*HIGH)), "fail").otherwise(status)


def close_outcome(tasks: DataFrame, by: Sequence[str]) -> DataFrame:
    """complete if every task passed or doesn't apply, else reported; open while a task is pending."""
    return tasks.groupBy(*by).agg(F.when(F.bool_or(F.col("status") == "pending"), "open").when(F.every(F.col("status").isin("pass", "not_applicable")), "complete").otherwise("reported").alias("outcome"))


def run_order_problems(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts that aren't numbered from 1 in order, or lie outside of planned and closed. runs: run_id, planned, closed; attempts: run_id, task_id, attempt, seq."""
    numbered = attempts.withColumn("__n", F.row_number().over(Window.partitionBy("run_id", "task_id").orderBy("seq")))
    df = numbered.join(runs, "run_id")
    code = F.array_compact(F.array(F.when(F.col("attempt") != F.col("__n"), "number"), F.when(F.col("seq") <= F.col("planned"), "before plan"), F.when(F.col("seq") >= F.col("closed"), "after close")))
    return df.select("run_id", "task_id", "seq", F.explode(code).alias("problem"))


def snapshot_sha(inputs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One SHA-256 for each group's inputs (logical_id, kind, sha256), whatever their order."""
    rows = F.array_sort(F.collect_list(F.struct("logical_id", "kind", "sha256")))
    return inputs.groupBy(*by).agg(F.count("*").alias("n_inputs"), F.sha2(F.to_json(rows), 256).alias("snapshot_sha"))


def snapshots_to_add(found: DataFrame, known: DataFrame) -> DataFrame:
    """Snapshots whose SHA isn't recorded yet."""
    return found.join(known.select("snapshot_sha"), "snapshot_sha", "left_anti")


def chained_ids(events: DataFrame, by: Sequence[str], order: str, content: Sequence[str], digest: str | None = None) -> DataFrame:
    """Event ids that hang on the id before: SHA-256 of it and of the event's content, with the id before it (none: empty), and with the content's own SHA-256 under the name of digest, if one is given. Contents are hashed in parallel; each group's chain is one ordered walk that holds the last id only."""
    hashed = events.select(*by, order, X.canonical_sha256(*content).alias("__h"))

    def make():
        last = ""

        def step(row: dict) -> dict:
            nonlocal last
            before, last = last, hashlib.sha256(f"{last}|{row['__h']}".encode()).hexdigest()
            return {"event_sha": last, "previous_sha": before, digest: row["__h"]}

        return step

    return walked(hashed, by, [order], make, [T.StructField(name, T.StringType()) for name in ("event_sha", "previous_sha", *([digest] if digest else []))])


def journal_append(journal: DataFrame, events: DataFrame, key: Sequence[str] = ("event_id",)) -> DataFrame:
    """Events that the journal doesn't hold yet, each once: recording twice adds nothing."""
    return events.dropDuplicates(list(key)).join(journal.select(*key), list(key), "left_anti")


def staleness(handoff: DataFrame, changes: DataFrame, by: Sequence[str], recorded: str, seq: str) -> DataFrame:
    """Handoffs with a change beyond the recorded one."""
    last = changes.groupBy(*by).agg(F.max(seq).alias("last"))
    return handoff.join(last, list(by), "left").select(*by, recorded, "last", F.coalesce(F.col("last") > F.col(recorded), F.lit(False)).alias("stale"))


def memory_status(changed: Column, missing: Column, untracked: Column, unfinished: Column) -> Column:
    return F.when(unfinished > 0, "recovery_required").when(missing > 0, "needs_rebaseline").when((changed > 0) | (untracked > 0), "external_changes").otherwise("ok")


def by_stage(stage: Column, draft: str, prefinal: str, final: str) -> Column:
    """A check's severity by the stage of the work."""
    return F.when(stage == "final", final).when(stage == "prefinal", prefinal).otherwise(draft)


def verdict(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Readiness of each group from its findings' severities."""
    out = findings.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s.lower() + "s") for s in ("ERROR", "WARNING", "INFO")])
    return out.withColumn("status", F.when(F.col("errors") > 0, "not_ready").when(F.col("warnings") > 0, "ready_with_warnings").otherwise("ready"))


def lowered(runs: DataFrame, by: Sequence[str], order: str, rank: str) -> DataFrame:
    """Runs with a lower rank than some earlier run of their group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("highest", F.max(rank).over(w)).filter(F.col(rank) < F.col("highest"))


def blind_pairs(runs: DataFrame) -> DataFrame:
    """Pairs of a primary run and a blind one of the same work that was planned after the primary was closed, with no person in common. runs: work, run_id, kind, planned, closed, auditors (an array)."""
    a = runs.filter("kind = 'primary'").select("work", F.col("run_id").alias("primary_run"), F.col("closed").alias("__c"), F.col("auditors").alias("__a"))
    b = runs.filter("kind = 'blind'").select("work", F.col("run_id").alias("blind_run"), F.col("planned").alias("__p"), F.col("auditors").alias("__b"))
    return a.join(b, "work").filter(F.col("__c").isNotNull() & (F.col("__p") > F.col("__c")) & ~F.arrays_overlap("__a", "__b")).select("work", "primary_run", "blind_run")


def verification_stale(recorded: Column, now: Column) -> Column:
    return F.coalesce(recorded, F.lit("")) != now


def forbidden_identifier(c: Column, words: Sequence[str]) -> Column:
    """An id with a forbidden word among its parts (split at case and digits), or as a whole without signs."""
    parts = F.transform(F.regexp_extract_all(X.null_empty(c), F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll})|\d+"), F.lit(0)), F.lower)
    whole = F.lower(F.regexp_replace(X.null_empty(c), r"[^\p{L}\p{N}]", ""))
    return F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words])) | whole.isin(*words)


def subsection_index(runs: DataFrame) -> DataFrame:
    """For each run how many other subsections of its chapter were reviewed before it was planned: run_id, chapter, index, odd (then an extra review of style is due).

    runs: work, run_id, kind, preset, checkpoint, planned, closed (null: not completed); both are places in the log. Distinct checkpoints subsection-<chapter>.<n> of completed primary runs count, without regard to case; a run without a chapter counts those of completed subsection runs of all chapters. One running count over plans and first completions: no run is joined with the others.
    """
    name = F.lower(X.null_empty(F.col("checkpoint")))
    chapter = F.nullif(F.regexp_extract(name, r"^subsection-0*(\d+)\.\d", 1), F.lit(""))
    rows = runs.withColumns({"__name": F.when(name != "", name).otherwise(F.col("run_id").cast("string")), "chapter": chapter})
    done = rows.filter("kind = 'primary' and closed is not null")
    # a run asks in its chapter's line, or in that of all subsection runs ('*')
    lines = done.filter("chapter is not null").select("work", "chapter", "__name", "closed").unionByName(done.filter("preset = 'subsection'").select("work", F.lit("*").alias("chapter"), "__name", "closed"))
    firsts = lines.groupBy("work", F.col("chapter").alias("__line"), "__name").agg(F.min("closed").alias("__at"))
    asks = rows.withColumn("__line", F.coalesce("chapter", F.lit("*")))
    points = asks.select("work", "__line", F.col("planned").alias("__at"), F.lit(0).alias("__one"), "run_id").unionByName(firsts.select("work", "__line", "__at", F.lit(1).alias("__one"), F.lit(None).cast(dict(runs.dtypes)["run_id"]).alias("run_id")))
    before = Window.partitionBy("work", "__line").orderBy("__at", "__one").rowsBetween(Window.unboundedPreceding, -1)
    counted = points.withColumn("__n", F.coalesce(F.sum("__one").over(before), F.lit(0))).filter("__one = 0").select("work", "run_id", "__n")
    own = asks.join(firsts.withColumnRenamed("__at", "__first"), ["work", "__line", "__name"], "left").select("work", "run_id", "chapter", F.coalesce(F.col("__first") < F.col("planned"), F.lit(False)).cast("int").alias("__own"))
    index = (F.col("__n") - F.col("__own")).cast("long")
    return own.join(counted, ["work", "run_id"]).select("work", "run_id", "chapter", index.alias("index"), (index % 2 == 1).alias("odd"))


def approval_problems(decisions: DataFrame, files: DataFrame, entries: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """Decisions whose approval doesn't hold: by, id_col, problem. decisions: approval (a path), sha (as it was, or null); files: path, size, sha256; entries of the evidence index: grp, path. Paths are compared as logical ids, without regard to case.

    outside: not a relative path inside evidence/; missing: no such file, or an empty one; unregistered: not among the index's approvals; changed: the file isn't what it was."""
    by = list(by)
    key = lambda c: F.lower(X.logical_id(c))
    there = files.groupBy(*by, key(F.col("path")).alias("__key")).agg(F.max("size").alias("__size"), F.max("sha256").alias("__now"))
    listed = entries.filter("grp = 'approvals'").select(*by, key(F.col("path")).alias("__key")).distinct().withColumn("__listed", F.lit(True))
    seen = decisions.withColumn("__key", key(F.col("approval"))).join(there, [*by, "__key"], "left").join(listed, [*by, "__key"], "left")
    inside = X.safe_path(F.col("approval")) & F.col("__key").startswith("evidence/")
    problem = (
        F.when(~F.coalesce(inside, F.lit(False)), "outside")
        .when(F.coalesce("__size", F.lit(0)) == 0, "missing")
        .when(F.col("__listed").isNull(), "unregistered")
        .when(F.col("sha").isNotNull() & ~F.col("sha").eqNullSafe(F.col("__now")), "changed")
    )
    return seen.select(*by, id_col, problem.alias("problem")).filter("problem is not null")


def stable_sha(payload: Column, volatile: Sequence[str]) -> Column:
    """SHA-256 of a JSON object without its volatile keys, keys in order; null for what is no object."""
    held = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    kept = F.transform_values(F.map_filter(held, lambda k, v: ~k.isin(*volatile)), lambda k, v: F.to_json(v))
    return F.sha2(F.to_json(F.array_sort(F.map_entries(kept))).cast("binary"), 256)


def stored_reports(reports: DataFrame, by: Sequence[str], order: str, payload: str, volatile: Sequence[str]) -> DataFrame:
    """Of each group's reports those that are stored: the first, and each that differs from the one before it in more than volatile keys (times, paths). by, order and sha; what is no JSON object is never stored, and doesn't part equal ones."""
    seen = reports.select(*by, order, stable_sha(F.col(payload), volatile).alias("sha")).filter("sha is not null")
    last = F.lag("sha").over(Window.partitionBy(*by).orderBy(order))
    return seen.withColumn("__last", last).filter("__last is null or __last <> sha").drop("__last")
