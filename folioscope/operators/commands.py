"""Commands on a review run: plan, record, close, accept_risk, waive. Each is accepted or rejected by the run's state, and says why.

A run's state is small: its status, its tasks with attempts and status, and its findings. One step takes a command; the batch walks each run's commands in order, and the stream (folioscope.streaming.commands) buffers them until the watermark has passed and takes the same steps.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.operators.audit import HIGH
from folioscope.operators.walk import walked

#: Columns of a command beside run_id, time and seq.
FIELDS = ("action", "tasks", "task_id", "status", "severity", "fix_class", "finding_id", "auditor", "reason")
DECIDED = (
    T.StructField("action", T.StringType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("code", T.StringType()),
    T.StructField("run_status", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("finding", T.StringType()),
    T.StructField("finding_status", T.StringType()),
)
_ARRAY = T.ArrayType(T.StringType())
COMMAND = T.StructType(
    [T.StructField("run_id", T.StringType()), T.StructField("time", T.TimestampType()), T.StructField("seq", T.LongType())]
    + [T.StructField(f, _ARRAY if f == "tasks" else T.StringType()) for f in FIELDS]
)

OPEN, CLOSED = ("planned", "running"), ("complete", "invalidated", "abandoned")
PASSED = ("pass", "not_applicable")


class Rejected(Exception):
    """A command that the state doesn't allow."""


def _said(text: str | None) -> bool:
    return bool(text and text.strip())


class Run:
    """The state of one run. to_json and from_json keep it between batches."""

    def __init__(self, held: str | None = None):
        state = json.loads(held) if held else {}
        self.status: str | None = state.get("status")
        self.tasks: dict[str, dict] = state.get("tasks", {})
        self.findings: dict[str, dict] = state.get("findings", {})

    def to_json(self) -> str:
        return json.dumps({"status": self.status, "tasks": self.tasks, "findings": self.findings})

    def decide(self, command: dict) -> dict:
        """What becomes of a command, and the state behind it; a rejected command changes nothing."""
        made = {"attempt": None, "finding": None}
        steps: dict[str, Callable] = {"plan": self._plan, "record": self._record, "close": self._close, "accept_risk": self._accept_risk, "waive": self._waive}
        try:
            if command["action"] not in steps:
                raise Rejected("COMMAND_UNKNOWN")
            code = steps[command["action"]](command, made)
            accepted = True
        except Rejected as why:
            code, accepted = str(why), False
        finding = self.findings.get(made["finding"] or "")
        return {"action": command["action"], "accepted": accepted, "code": code, "run_status": self.status, **made, "finding_status": finding and finding["status"]}

    def _plan(self, command: dict, made: dict) -> str:
        tasks = [t for t in command["tasks"] or [] if _said(t)]
        if not tasks:
            raise Rejected("PLAN_EMPTY")
        if len(set(tasks)) < len(tasks):
            raise Rejected("PLAN_DUPLICATE_TASK")
        if self.status in OPEN:
            raise Rejected("RUN_ALREADY_OPEN")
        if self.status == "complete":
            raise Rejected("RUN_ALREADY_COMPLETE")
        if self.status == "reported" and any(f["status"] == "open" for f in self.findings.values()):
            raise Rejected("RUN_HAS_OPEN_FINDINGS")
        self.status, self.tasks = "planned", {t: {"attempts": 0, "status": "planned", "auditor": None} for t in tasks}
        return "planned"

    def _planned(self) -> None:
        if self.status is None:
            raise Rejected("RUN_NOT_FOUND")

    def _record(self, command: dict, made: dict) -> str:
        self._planned()
        task = self.tasks.get(command["task_id"] or "")
        if task is None:
            raise Rejected("TASK_NOT_FOUND")
        if self.status not in OPEN:
            raise Rejected("RUN_CLOSED")
        if not _said(command["auditor"]):
            raise Rejected("AUDITOR_ID_INVALID")
        if task["attempts"] and not _said(command["reason"]):
            raise Rejected("RETRY_REASON_REQUIRED")
        who = "".join(command["auditor"].split()).lower()
        if any(t["auditor"] == who for name, t in self.tasks.items() if name != command["task_id"]):
            raise Rejected("AUDITOR_NOT_INDEPENDENT")
        status, severity = command["status"], command["severity"]
        if status not in (*PASSED, "fail", "partial"):
            raise Rejected("REPORT_SCHEMA_INVALID")
        task.update(attempts=task["attempts"] + 1, auditor=who, status="fail" if status == "pass" and severity in HIGH else status)
        self.status, made["attempt"] = "running", task["attempts"]
        if severity:
            made["finding"] = f"F-{len(self.findings) + 1:03d}"
            self.findings[made["finding"]] = {"status": "open", "severity": severity, "fix_class": command["fix_class"]}
        return "recorded"

    def _close(self, command: dict, made: dict) -> str:
        self._planned()
        if self.status in CLOSED:
            return "already closed"
        pending = [t for t in self.tasks.values() if not t["attempts"]]
        if self.status in OPEN and len(pending) == len(self.tasks):
            self.status = "invalidated"
        elif pending:
            if not _said(command["reason"]):
                raise Rejected("RUN_TASKS_PENDING")
            self.status = "abandoned"
        else:
            opened = any(f["status"] == "open" for f in self.findings.values())
            self.status = "complete" if not opened and all(t["status"] in PASSED for t in self.tasks.values()) else "reported"
        for task in pending:
            task["status"] = "cancelled"
        return self.status

    def _finding(self, command: dict, denied: str) -> dict:
        finding = self.findings.get(command["finding_id"] or "")
        if finding is None:
            raise Rejected("FINDING_NOT_FOUND")
        if finding["status"] != "open":
            raise Rejected(denied)
        return finding

    def _accept_risk(self, command: dict, made: dict) -> str:
        if not _said(command["reason"]):
            raise Rejected("REASON_REQUIRED")
        finding = self._finding(command, "ACCEPT_RISK_DENIED")
        if finding["severity"] in HIGH:
            raise Rejected("ACCEPT_RISK_DENIED")
        finding["status"], made["finding"] = "accepted_risk", command["finding_id"]
        return "accepted_risk"

    def _waive(self, command: dict, made: dict) -> str:
        finding = self._finding(command, "WAIVE_DENIED")
        if finding["fix_class"] != "SUPERVISOR_APPROVAL":
            raise Rejected("WAIVE_DENIED")
        finding["status"], made["finding"] = "waived", command["finding_id"]
        return "waived"


def decided(commands: DataFrame) -> DataFrame:
    """run_id, time, seq and DECIDED of each command of COMMAND's columns, taken in the order of time and seq. A null action is an unknown command; repeated commands are taken as often as they come."""

    def make():
        run = Run()
        return run.decide

    return walked(commands, ["run_id"], ["time", "seq"], make, DECIDED)
