"""Hashes, run ids, manifests and status of runs; driver-side except where files are hashed in parallel."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The form of a run id and of the time in it.
STAMP = "%Y-%m-%dT%H%MZ"
RUN_ID = re.compile(r"^(?P<experiment>[A-Za-z0-9._-]+)__(?P<commit>[0-9a-f]{7})__(?P<utc>\d{4}-\d{2}-\d{2}T\d{4}Z)$")
RUNNING, COMPLETE, FAILED = "RUNNING", "COMPLETE", "FAILED"
REQUIRED = ("run_id", "inputs", "outputs", "status")


class StatusError(RuntimeError):
    """A run that ended keeps its status."""


def canonical_json(value: object) -> str:
    """PV-01: sorted keys, no blanks, no escapes of letters."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_address(*parts: object) -> str:
    """PV-02, PV-03: sha256 over all inputs."""
    return hashlib.sha256(canonical_json(list(parts)).encode()).hexdigest()


def mint_run_id(experiment: str, commit: str, now: datetime | None = None) -> str:
    """PV-05: experiment, short commit and minute in UTC."""
    if not experiment:
        raise ValueError("an experiment has a name")
    return f"{experiment}__{commit[:7]}__{(now or datetime.now(UTC)).astimezone(UTC).strftime(STAMP)}"


def parse_run_id(run_id: str) -> dict[str, str]:
    found = RUN_ID.match(run_id)
    if not found:
        raise ValueError(f"{run_id} is no run id")
    return found.groupdict()


def write_manifest(path: Path, manifest: dict) -> None:
    """PV-07: all required fields must be there."""
    missing = [k for k in REQUIRED if k not in manifest]
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    path.write_text(json.dumps(manifest, sort_keys=True, indent=1))


def write_status(folder: Path, status: str) -> None:
    """PV-09: RUNNING may become COMPLETE or FAILED, which stay."""
    at = folder / "STATUS"
    if at.exists() and at.read_text() in (COMPLETE, FAILED) and at.read_text() != status:
        raise StatusError(f"{folder} is {at.read_text()}")
    at.write_text(status)


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (name, sha256) of all files below a folder, by path relative to it, hashed where they are.

    Only paths move; each task streams the files of its paths, so a file need not fit in memory.
    """
    root = Path(folder.removeprefix("file:"))
    paths = sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file())
    names = spark.createDataFrame([(p,) for p in paths], "name string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism)))
    base = str(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for name in batch["name"]:
                with open(f"{base}/{name}", "rb") as file:
                    made.append(hashlib.file_digest(file, "sha256").hexdigest())
            yield pd.DataFrame({"name": batch["name"], "sha256": made})

    return names.mapInPandas(run, "name string, sha256 string")


def verify_outputs(spark: SparkSession, folder: str, outputs: dict[str, str]) -> DataFrame:
    """PV-08, PV-10: outputs of a manifest that are missing or differ."""
    wanted = spark.createDataFrame([*outputs.items()], "name string, wanted string")
    met = wanted.join(file_hashes(spark, folder), "name", "left")
    return met.filter(~F.col("sha256").eqNullSafe(F.col("wanted"))).select("name", F.when(F.col("sha256").isNull(), "missing").otherwise("differs").alias("finding"))


def without_copies(spark: SparkSession, folder: str) -> DataFrame:
    """SO-06: one file of each content."""
    return file_hashes(spark, folder).groupBy("sha256").agg(F.min("name").alias("name"))
