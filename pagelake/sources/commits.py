"""State of a stored table: which of its folders count, committed by one rename.

A table of many folders is changed by writing new folders first and then naming them in a small state
file. Readers take the highest state, so they see a change whole or not at all; a writer that dies leaves
folders that no state names. State numbers go up by one, and a rename onto a taken number fails: of two
writers that started from one state, one has to begin again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer committed first."""


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    return jvm, folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def read_state(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last state; 0 and nothing for a table not begun."""
    jvm, folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return 0, {}
    names = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
    if not numbers:
        return 0, {}
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"{max(numbers):010d}.json"))
    try:
        return max(numbers), json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, number: int, state: dict) -> int:
    """Make ``state`` the successor of state ``number``; its own number."""
    jvm, folder, fs = _folder(spark, path)
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{number + 1:010d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    fs.mkdirs(folder)
    stream = fs.create(draft)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise CommitConflict(f"state {number + 1} of {path} is taken")
    return number + 1


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
