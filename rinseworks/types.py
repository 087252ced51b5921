"""Schemas and the small driver-side records of decisions and reports."""

from __future__ import annotations

from dataclasses import dataclass, field

ISSUE_SCHEMA = (
    "issue_type string, column string, affected_rows bigint, percentage double, "
    "severity string, description string"
)
ISSUE_FIELDS = [part.split()[0] for part in ISSUE_SCHEMA.split(", ")]


@dataclass(frozen=True)
class Issue:
    issue_type: str
    column: str | None
    affected_rows: int
    percentage: float
    severity: str
    description: str


@dataclass(frozen=True)
class Strategy:
    name: str
    description: str = ""
    parameters: dict = field(default_factory=dict)


@dataclass
class Action:
    issue: Issue
    strategy: Strategy
    rows_affected: int = 0
    success: bool = True
    error: str | None = None


@dataclass
class CleaningReport:
    issues: list[Issue]
    actions: list[Action]
    before: dict
    after: dict
    seconds: float
