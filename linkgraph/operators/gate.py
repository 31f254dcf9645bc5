"""Policies over findings: which of them count, and whether a change may pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = {"repair": ("integrity",), "check": ("integrity", "strict"), "max": ("integrity", "strict")}


def by_mode(findings: DataFrame, mode: str, created: DataFrame | None = None) -> DataFrame:
    """Findings of the mode's axes; mode max adds those of a second pass that may create frontmatter."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    kept = findings.where(F.col("axis").isin(*MODES[mode]))
    if mode != "max" or created is None:
        return kept
    # The same link twice in a document is two findings, so rows are set against each other one by one.
    return kept.unionByName(created.where("axis = 'strict'").exceptAll(findings.where("axis = 'strict'")))


def staged(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of the given files (path)."""
    return findings.join(files.select("path").distinct(), "path", "left_semi")


def hunks_of(diff: DataFrame) -> DataFrame:
    """path, start_line, n_lines of rows (path, header) with hunk headers of a diff without context; a count that is left out is 1."""
    header = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    n = F.regexp_extract("header", header, 2)
    return diff.where(F.col("header").rlike(header)).select("path", F.regexp_extract("header", header, 1).cast("int").alias("start_line"), F.when(n == "", 1).otherwise(n.cast("int")).alias("n_lines"))


def on_added_lines(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings on lines that hunks (path, start_line, n_lines) add: an equi-join on the path with a range of lines."""
    h = hunks.where("n_lines > 0").select(F.col("path").alias("_path"), "start_line", "n_lines")
    on = (F.col("path") == F.col("_path")) & (F.col("line") >= F.col("start_line")) & (F.col("line") < F.col("start_line") + F.col("n_lines"))
    return findings.join(h, on, "left_semi")


def dangling(findings: DataFrame, rung: str, hunks: DataFrame | None = None) -> DataFrame:
    """Dangling findings that count on a rung: off, warn (none fails), added-lines, repo."""
    if rung not in ("off", "warn", "added-lines", "repo"):
        raise ValueError("rung is one of off, warn, added-lines, repo")
    found = findings.where("kind = 'dangling'")
    if rung in ("off", "warn"):
        return found.where("false")
    if rung == "added-lines":
        if hunks is None:
            raise ValueError("the rung added-lines needs hunks")
        return on_added_lines(found, hunks)
    return found


def within_budget(findings: DataFrame, most: int) -> DataFrame:
    """n, most, passes."""
    return findings.agg(F.count("*").alias("n")).select("n", F.lit(most).alias("most"), (F.col("n") <= most).alias("passes"))
