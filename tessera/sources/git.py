"""Changes of a git working tree against HEAD, read by child processes on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


class NotARepository(ValueError):
    pass


def git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True, timeout=120)
    if done.returncode:
        raise NotARepository(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return done.stdout.decode("utf-8", "replace")


def require_head(root: str) -> None:
    if git(root, "rev-parse", "--is-inside-work-tree").strip() != "true":
        raise NotARepository("not inside a git work tree")
    git(root, "rev-parse", "--verify", "HEAD")


def changes(root: str) -> list[tuple[str, str]]:
    """(kind, path) by path: M, A, D, R or another letter; a rename has its new path."""
    parts = git(root, "diff", "--name-status", "-z", "--find-renames", "HEAD").split("\0")
    out, k = [], 0
    while k + 1 < len(parts):
        kind = parts[k][:1]
        step = 3 if kind in "RC" else 2
        out.append((kind, parts[k + step - 1]))
        k += step
    return sorted(out, key=lambda c: c[1])


def untracked(root: str) -> list[str]:
    rows = git(root, "status", "--porcelain", "-z", "--untracked-files=all").split("\0")
    return sorted(r[3:] for r in rows if r.startswith("?? "))


def at_head(root: str, path: str) -> str:
    return git(root, "show", f"HEAD:{path}")


def hunk_fields(header: Column) -> list[Column]:
    """old_start, old_count, new_start, new_count of a hunk header; a missing count is 1."""

    def number(k: int) -> Column:
        text = F.regexp_extract(header, HUNK, k)
        return F.when(text == "", 1).otherwise(text.cast("int")) if k in (2, 4) else text.cast("int")

    return [number(k).alias(n) for k, n in enumerate(("old_start", "old_count", "new_start", "new_count"), 1)]


def hunks(spark: SparkSession, root: str) -> DataFrame:
    """path and hunk_fields() of every hunk of the diff against HEAD."""
    rows, path, inside = [], None, False
    for line in git(root, "diff", "HEAD", "--unified=0", "--no-color", "--no-ext-diff", "--src-prefix=a/", "--dst-prefix=b/").split("\n"):
        if line.startswith("diff --git "):
            path, inside = None, False
        elif line.startswith("+++ ") and not inside:  # inside a hunk this is an added line
            path = line[6:].rstrip("\t") if line.startswith("+++ b/") else None
        elif line.startswith("@@ ") and path is not None:
            inside = True
            rows.append((path, line))
    found = spark.createDataFrame(rows, "path string, header string")
    return found.select("path", *hunk_fields(F.col("header")))
