"""Stored derivations: versions below one folder, each published by its manifest, the last file written.

A version is a folder ``v-<number>`` with tables and a manifest. Readers take the newest version that has a manifest,
so a build that dies is never seen, and a reader keeps the version it opened while newer ones come.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import SparkSession

MANIFEST = "manifest.json"


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def files(spark: SparkSession, path: str) -> int:
    """How many files lie at a path; the file system counts them, no names come to the driver."""
    fs, p = _files(spark, path)
    return fs.getContentSummary(p).getFileCount()


def as_pattern(path: str) -> str:
    """A path as a pattern that only it matches: a stream can then read a table that is one file as well as a folder of files."""
    return f"{path[:-1]}[{path[-1]}]"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions, oldest first."""
    fs, p = _files(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    numbers = sorted(int(n[2:]) for n in names if n.startswith("v-"))
    return [n for n in numbers if fs.exists(_files(spark, f"{folder}/v-{n}/{MANIFEST}")[1])]


def publish(spark: SparkSession, folder: str, build: Callable[[str], dict]) -> str:
    """Let ``build`` write a new version into the folder it is given, then publish it with the manifest it returns."""
    fs, p = _files(spark, folder)
    fs.mkdirs(p)
    number = max([int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v-")], default=0) + 1
    path = f"{folder}/v-{number}"
    if not fs.mkdirs(_files(spark, path)[1]):
        raise OSError(f"cannot create {path}")
    manifest = json.dumps(build(path), sort_keys=True)
    out = fs.create(_files(spark, f"{path}/{MANIFEST}")[1], False)
    try:
        out.write(bytearray(manifest.encode()))
    finally:
        out.close()
    return path


def current(spark: SparkSession, folder: str) -> tuple[str, dict] | None:
    """(path, manifest) of the newest published version."""
    known = versions(spark, folder)
    if not known:
        return None
    path = f"{folder}/v-{known[-1]}"
    return path, json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def prune(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` published versions; returns those deleted."""
    gone = versions(spark, folder)[:-keep] if keep else []
    for n in gone:
        fs, p = _files(spark, f"{folder}/v-{n}")
        fs.delete(p, True)
    return gone


def drop(spark: SparkSession, path: str) -> None:
    """Delete what a build needed but its version doesn't."""
    fs, p = _files(spark, path)
    fs.delete(p, True)


def snapshot(spark: SparkSession, *paths: str) -> str:
    """A digest of what lies at the paths: bytes, number of files and the time of the last change of each."""
    state = []
    for path in paths:
        fs, p = _files(spark, path)
        summary = fs.getContentSummary(p)
        state.append((path, summary.getLength(), summary.getFileCount(), fs.getFileStatus(p).getModificationTime()))
    return sha256(json.dumps(state).encode()).hexdigest()[:24]


def derived(spark: SparkSession, name: str, sources: list[str], build: Callable[[str], dict]) -> tuple[str, dict]:
    """(path, manifest) of a derivation of source tables below the shared folder, built when these tables have none yet."""
    folder = f"{shared_root(spark)}/derived/{name}-{snapshot(spark, *sources)}"
    found = current(spark, folder)
    if found is None:
        publish(spark, folder, build)
        found = current(spark, folder)
    return found
