"""Change scope: two manifests (path, sha256) joined, changes judged by allowed and protected patterns."""

from __future__ import annotations

import fnmatch
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files whose change calls for a review of dependencies. Fixed values.
DEPENDENCY_FILES = [
    "pyproject.toml", "requirements.txt", "requirements-dev.txt", "poetry.lock", "uv.lock", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.toml", "cargo.lock", "go.mod", "go.sum",
]


class PatternError(ValueError):
    """A pattern is absolute, leaves the root, or is not a string."""


def checked(patterns: Any, label: str) -> list[str]:
    if not isinstance(patterns, (list, tuple)) or any(not isinstance(p, str) or not p for p in patterns):
        raise PatternError(f"{label} must be a list of non-empty strings")
    out = [p.replace("\\", "/") for p in patterns]
    for p in out:
        if p.startswith("/") or ".." in p.split("/"):
            raise PatternError(f"{label}: patterns must be relative with no '..': {p}")
    return out


def glob_regex(pattern: str) -> str:
    """One regular expression for Java: a folder ends in /; * and ? also cross /."""
    if pattern.endswith("/"):
        return "^" + re.sub(r"([^\w/])", r"\\\1", pattern)
    return "^" + fnmatch.translate(pattern).replace(r"\Z", r"\z")


def matches(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, deleted or modified. Both sides have one row per path, so the join's keys are unique."""
    b, c = baseline.select("path", F.col("sha256").alias("was")), current.select("path", F.col("sha256").alias("now"))
    both = b.join(c, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("modified").alias("change"))


def judged(changed: DataFrame, allowed: list[str], protected: list[str] = ()) -> DataFrame:
    """Adds status, label and dependency; protected wins over allowed."""
    allow, deny = checked(allowed, "allowed"), checked(list(protected), "protected")
    path = F.col("path")
    label = F.when(matches(path, deny), "protected path changed").when(matches(path, allow), "change is within the allowed scope").otherwise("change is outside the allowed scope")
    status = F.when(label == "change is within the allowed scope", "PASS").otherwise("FAIL")
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    return changed.withColumns({"label": label, "status": status, "dependency": name.isin(DEPENDENCY_FILES)})
