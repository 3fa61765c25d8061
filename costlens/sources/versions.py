"""Versions of a stored table: folders that never change, and numbered files that name one.

    table/data-<id>/            a version, written once
    table/manifests/<number>    the name of a version; the highest complete one counts

A version becomes current when its manifest is complete, the last thing that is written.
Nothing is renamed and no file is written twice, so object stores do as well as HDFS. A
job lost at any step leaves the version before it: a folder that no manifest names is
never read, and a manifest that was cut off does not count. Readers look the version up
once, when they plan; the one before the current is kept, so they finish on it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

from costlens.sources import files

KEEP = 2
ORPHAN_HOURS = 24.0
_MANIFESTS = "manifests"
DATA = "data-"


def new_folder(path: str) -> str:
    """A folder for the table's next version, which nobody else writes to."""
    return f"{path.rstrip('/')}/{DATA}{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Of all manifests, the newest first."""
    found = files.names(spark, f"{path}/{_MANIFESTS}")
    return sorted((int(n) for n in found if n.isdigit()), reverse=True)


def _manifest(spark: SparkSession, path: str, number: int) -> dict | None:
    """A manifest's content, None if its writer was lost before its end."""
    try:
        text = files.read_text(spark, f"{path}/{_MANIFESTS}/{number:020d}")
        return json.loads(text) if text.endswith("\n") else None
    except (ValueError, OSError):
        return None


def _complete(spark: SparkSession, path: str, most: int) -> list[dict]:
    """The newest complete manifests."""
    out = []
    for number in _numbers(spark, path):
        content = _manifest(spark, path, number)
        if content is not None:
            out.append(content)
        if len(out) == most:
            break
    return out


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version; None before the first."""
    path = path.rstrip("/")
    newest = _complete(spark, path, 1)
    return f"{path}/{newest[0]['data']}" if newest else None


def publish(spark: SparkSession, path: str, folder: str) -> None:
    """Make a written folder the table's current version, then drop what is out of use."""
    path = path.rstrip("/")
    text = json.dumps({"data": folder.rsplit("/", 1)[-1]}) + "\n"
    number = max(_numbers(spark, path), default=0) + 1
    while not files.write_new(spark, f"{path}/{_MANIFESTS}/{number:020d}", text):
        number += 1  # another load was faster; the later one counts
    clean(spark, path)


def clean(spark: SparkSession, path: str, keep: int = KEEP, orphan_hours: float = ORPHAN_HOURS) -> None:
    """Delete versions that neither the newest ``keep`` manifests name nor a load may still write."""
    used = {m["data"] for m in _complete(spark, path, keep)}
    numbers = _numbers(spark, path)
    old = {m["data"] for n in numbers if (m := _manifest(spark, path, n)) is not None} - used
    before = (time.time() - orphan_hours * 3600) * 1000
    for name in files.names(spark, path):
        if name.startswith(DATA) and name not in used:
            if name in old or files.modified(spark, f"{path}/{name}") < before:
                files.delete(spark, f"{path}/{name}")
    kept = 0
    for number in numbers:
        kept += _manifest(spark, path, number) is not None
        if kept > keep:
            files.delete(spark, f"{path}/{_MANIFESTS}/{number:020d}")
