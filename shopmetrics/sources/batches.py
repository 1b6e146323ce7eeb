"""Batches that are published once (K4, W1-W10): a table is what its published batches hold.

A batch writes its tables to a folder of its own, and becomes visible by one small file, its manifest, that gets its
name when it is complete. Readers take only what manifests name, so a batch that broke off is never read, and one that
runs again after it was published changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "_published"
_MANIFEST = "number BIGINT, batch STRING, folder STRING, appended ARRAY<STRING>, replaced ARRAY<STRING>"


class AlreadyPublished(RuntimeError):
    """Another batch took the number: the batch has to be worked out again on what that one published."""


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, root: str) -> list[T.Row]:
    """One row per published batch, in their order."""
    folder, files = _files(spark, f"{root}/{MANIFESTS}")
    if not files.exists(folder) or not any(s.getPath().getName().endswith(".json") for s in files.listStatus(folder)):
        return []
    return spark.read.schema(_MANIFEST).json(f"{root}/{MANIFESTS}/*.json").orderBy("number").collect()


def publish(
    spark: SparkSession, root: str, batch: str, appended: Mapping[str, DataFrame], replaced: Mapping[str, DataFrame] | None = None
) -> bool:
    """Write the tables of a batch under ``root`` and publish them together; False if the batch is published already.

    ``appended`` holds rows that are added to tables, ``replaced`` the next state of whole tables. The tables are worked
    out here, from what was published when this began: where another batch is published meanwhile, this one is not, and
    ``AlreadyPublished`` is raised.
    """
    root, replaced = root.rstrip("/"), dict(replaced or {})
    known = _manifests(spark, root)
    if any(m["batch"] == batch for m in known):
        return False
    number, folder = len(known) + 1, f"batches/{uuid.uuid4().hex}"
    for name, df in {**appended, **replaced}.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    manifest = {
        "number": number, "batch": batch, "folder": folder, "appended": sorted(appended), "replaced": sorted(replaced)
    }
    target, files = _files(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
    files.mkdirs(target.getParent())
    draft, _ = _files(spark, f"{root}/{MANIFESTS}/_draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    jvm = spark._jvm
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()[0]
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = rename
    assert str(rename) == "NONE"  # without it a rename replaces nothing
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(
            draft, target, options
        )
    except Exception as taken:
        if not files.exists(target):
            raise
        files.delete(draft, False)
        raise AlreadyPublished(f"batch {batch}: number {number} is taken") from taken
    return True


def published(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """The rows of a table: the last state that replaced it, and what was appended since. Empty before its first batch."""
    root, paths = root.rstrip("/"), []
    for m in _manifests(spark, root):
        if name in m["replaced"]:
            paths = []
        if name in m["replaced"] or name in m["appended"]:
            paths.append(f"{root}/{m['folder']}/{name}")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
