"""The history of a git work tree as tables: touches of files by commits, and files that changed."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOUCHES = "commit string, at timestamp, email string, path string"
_MARK = "\x01"


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", *args], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def touches(spark: SparkSession, root: str, commits_a_task: int = 10_000) -> DataFrame:
    """(commit, at, email, path) of every file that a commit other than a merge touched.

    Tasks read ranges of the history, so ``root`` must be a path that executors reach; a lost task is read again. The
    history is that of the commit that is checked out when the plan is made.
    """
    head = _git(root, "rev-parse", "HEAD").strip()
    n = int(_git(root, "rev-list", "--count", "--no-merges", head))
    ranges = spark.range(0, max(1, -(-n // commits_a_task)), 1, max(1, -(-n // commits_a_task)))

    def read(parts: Iterator) -> Iterator:
        import pandas as pd

        for part in parts:
            for i in part["id"]:
                text = _git(root, "log", "--no-merges", "--name-only", f"--format={_MARK}%H%x09%ct%x09%ae", f"--skip={i * commits_a_task}", f"--max-count={commits_a_task}", head)
                rows = []
                for block in text.split(_MARK)[1:]:
                    first, *names = block.split("\n")
                    commit, at, email = first.split("\t", 2)
                    rows += [(commit, pd.Timestamp(int(at), unit="s"), email, name) for name in names if name]
                yield pd.DataFrame(rows, columns=["commit", "at", "email", "path"]).astype({"at": "datetime64[ns]"})

    return ranges.mapInPandas(read, TOUCHES)


def changed(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """Distinct paths that differ from ``ref`` or are not tracked; what a work tree holds besides is small."""
    names = _git(root, "diff", "--name-only", ref).splitlines() + _git(root, "ls-files", "--others", "--exclude-standard").splitlines()
    return spark.createDataFrame([(n,) for n in names], "path string").distinct()


def file_history(found: DataFrame) -> DataFrame:
    """(path, commits, authors, first_at, last_at) of touches."""
    return found.groupBy("path").agg(F.count("*").alias("commits"), F.count_distinct("email").alias("authors"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
