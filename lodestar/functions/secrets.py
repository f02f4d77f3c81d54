"""Secrets in texts: found, counted and redacted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "[REDACTED]"
PATTERNS = {
    "assignment": r"(?i)(?:api[_-]?key|secret|token|password|passwd)\s{0,4}[=:]\s{0,4}[\"']?[A-Za-z0-9_+/=.~-]{8,}[\"']?",
    "sk_key": r"\bsk-[A-Za-z0-9_-]{16,}",
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
}


def secret_counts(text: Column) -> dict[str, Column]:
    """Findings of each pattern."""
    return {name: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for name, p in PATTERNS.items()}


def secret_count(text: Column) -> Column:
    return sum(secret_counts(text).values(), F.lit(0))


def redacted(text: Column) -> Column:
    """The text with the marker for everything that a pattern finds."""
    for p in PATTERNS.values():
        text = F.regexp_replace(text, p, MARKER)
    return text
