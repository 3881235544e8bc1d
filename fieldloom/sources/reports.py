"""Report sinks: a run's reports by name, written once, apart from what changes with every run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldloom import commits
from fieldloom.sources import writers

# The reports of each kind of run.
REPORTS = {
    "prepare": ["class_counts", "file_inventory", "id_join", "id_join_summary", "exact_duplicates", "duplicate_summary", "cross_class_conflicts", "near_pairs", "clusters", "quarantine", "quarantine_by_class"],
    "recovery": ["metadata_inventory", "matched", "ambiguous", "unresolved", "recovery_status", "shared_keys", "examples"],
    "review": ["groups", "group_sizes", "sample", "shared_prefixes", "judgments", "large_chains"],
    "splits": ["integrity", "components", "allocation", "summary", "deviation", "train", "val", "test"],
    "validation": ["checks", "overlaps", "cluster_consistency"],
}
METADATA = "run_metadata"


def write(kind: str, reports: dict[str, DataFrame], folder: str, metadata: dict[str, str] | None = None) -> list[str]:
    """Write a run's reports below ``folder``, each as JSON lines with sorted keys, and return their paths.

    All that the kind of run asks for must be given, and nothing else; nothing is written over. What changes with
    every run (times, hosts) goes to a report of its own, so that the others are the same for the same input.
    """
    if set(reports) != set(REPORTS[kind]):
        raise ValueError(f"{kind}: reports {sorted(reports)}; {sorted(REPORTS[kind])} are declared")
    paths = {name: f"{folder}/{name}" for name in REPORTS[kind]}
    some = next(iter(reports.values()))
    there = [p for p in paths.values() if writers.exists(some, p)]
    if there:
        raise FileExistsError(", ".join(there))
    for name, path in paths.items():
        writers.report_json(reports[name], path)
    if metadata:
        rows = some.sparkSession.createDataFrame(sorted(metadata.items()), "key string, value string")
        writers.report_json(rows, f"{folder}/{METADATA}")
    return list(paths.values())


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A report that ``write`` has written."""
    return spark.read.json(f"{folder}/{name}")


# --------------------------------------------------------------------------------------------- committed sets

_SETS = "_sets"


def commit(kind: str, reports: dict[str, DataFrame], folder: str, metadata: dict[str, str] | None = None) -> dict[str, int]:
    """Write a run's reports as one set that takes effect at once, and return how many rows each has.

    The reports are written aside, each counted while it is written. Then one small file names the run's folder and the
    counts: from then on readers see this set, and all of it. A run that ends before leaves the set of the run before.
    A report that is a plan is read again for no count and no check.
    """
    if set(reports) != set(REPORTS[kind]):
        raise ValueError(f"{kind}: reports {sorted(reports)}; {sorted(REPORTS[kind])} are declared")
    spark = next(iter(reports.values())).sparkSession
    before = commits.last(spark, f"{folder}/{_SETS}")
    number = before[0] + 1 if before else 1
    home, rows = f"run-{number:06d}-{uuid.uuid4().hex[:8]}", {}
    for name in REPORTS[kind]:
        counted = Observation(f"{home}-{name}")
        reports[name].observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/{home}/{name}")
        rows[name] = counted.get["rows"]
    commits.put(spark, f"{folder}/{_SETS}", number, {"kind": kind, "home": home, "rows": rows, "metadata": metadata or {}})
    return rows


def committed(spark: SparkSession, folder: str) -> dict:
    """What the last complete set of a folder is: kind, home, rows by report, metadata."""
    found = commits.last(spark, f"{folder}/{_SETS}")
    if found is None:
        raise FileNotFoundError(f"{folder}: no complete set of reports")
    return found[1]


def open_report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A report of the last complete set."""
    of = committed(spark, folder)
    if name not in of["rows"]:
        raise KeyError(f"{of['kind']} has no report {name}")
    return spark.read.parquet(f"{folder}/{of['home']}/{name}")


def sweep(spark: SparkSession, folder: str) -> int:
    """Delete the folders of torn and of earlier runs; returns how many."""
    fs, path = commits.files(spark, folder)
    home, gone = committed(spark, folder)["home"], 0
    for s in fs.globStatus(path(f"{folder}/run-*")) or []:
        if s.getPath().getName() != home:
            gone += fs.delete(s.getPath(), True)
    commits.trim(spark, f"{folder}/{_SETS}")
    return gone
