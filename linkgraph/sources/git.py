"""What a change stages, as tables: its documents and the lines that it adds."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *arguments: str) -> list[str]:
    try:
        done = subprocess.run(["git", "-c", "core.quotePath=false", *arguments], cwd=root, capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError) as error:
        raise ValueError(f"git can't tell what is staged in {root}") from error
    return done.stdout.decode("utf-8", "surrogateescape").split("\n")


def staged(spark: SparkSession, root: str) -> DataFrame:
    """path, relative to root, of the documents that are staged and still there: added, copied, changed or renamed."""
    names = _git(root, "diff", "--cached", "--relative", "--name-only", "--diff-filter=ACMR", "--", "*.md")
    return spark.createDataFrame([(os.path.normpath(x),) for x in names if x], "path string")


def staged_hunks(spark: SparkSession, root: str) -> DataFrame:
    """path, start_line, n_lines of the lines that staged documents get, by the hunk headers of a diff without context."""
    rows, path = [], None
    for line in _git(root, "diff", "--cached", "--relative", "--no-color", "--no-ext-diff", "--unified=0", "--diff-filter=ACMR", "--", "*.md"):
        if line.startswith("diff --git "):
            path = None
        elif path is None and line.startswith("+++ b/"):
            path = line[6:].rstrip("\t")
        elif path is not None and line.startswith("@@ "):
            start, _, count = line.split(" ")[2].lstrip("+").partition(",")
            rows.append((path, int(start), int(count or 1)))
    return spark.createDataFrame(rows, "path string, start_line int, n_lines int")
