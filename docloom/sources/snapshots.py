"""Versions of a table that become visible at once: a manifest names the files of each, and buckets that a change does not touch stay where they are.

``root/data`` holds the files of all versions, ``root/manifests/<n>.json`` what belongs to
version n.  A version exists when its manifest has been renamed into place, which the file
system does as one step and refuses where the name is taken; a reader takes the greatest
number, so it sees a whole version or none of it.  One writer works on a root at a time; a
second one that commits the same number fails.  What a failed write leaves behind belongs to
no manifest and goes with a later commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.sources.io import latest

#: Versions that stay readable, with the present one.
KEPT = 3


@dataclass
class Manifest:
    """``parts``: the folder of each bucket; ``batch``: the last batch of a stream that it holds."""

    version: int
    schema: str
    kind: str = "parquet"
    buckets: int = 1
    parts: dict[str, str] = field(default_factory=dict)
    batch: int = -1


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> Manifest | None:
    """The manifest of the greatest version; None where there is none."""
    version = latest(spark, f"{root}/manifests", ".json")
    if version is None:
        return None
    return manifest(spark, root, version)


def manifest(spark: SparkSession, root: str, version: int) -> Manifest:
    path, fs = _fs(spark, f"{root}/manifests/{version}.json")
    stream = fs.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def commit(spark: SparkSession, root: str, new: Manifest, keep: int = KEPT) -> Manifest:
    """Make ``new`` the present version, by one rename; then drop versions and files that are kept no longer."""
    jvm = spark.sparkContext._jvm
    draft, fs = _fs(spark, f"{root}/manifests/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(new.__dict__, ensure_ascii=False).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(fs.makeQualified(draft), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{new.version}.json")), none)
    _clear(spark, root, new.version, keep)
    return new


def _clear(spark: SparkSession, root: str, version: int, keep: int) -> None:
    """Drop manifests older than the kept ones, and data folders that no manifest names."""
    folder, fs = _fs(spark, f"{root}/manifests")
    named: set[str] = set()
    for status in fs.listStatus(folder):
        stem = status.getPath().getName().removesuffix(".json")
        if stem.isdigit() and int(stem) > version - keep:
            named |= {p.split("/")[0] for p in manifest(spark, root, int(stem)).parts.values()}
        elif stem.isdigit():
            fs.delete(status.getPath(), True)
    data, fs = _fs(spark, f"{root}/data")
    if fs.exists(data):
        for status in fs.listStatus(data):
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)


def read(spark: SparkSession, root: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """A version (the present one by default), or only some of its buckets; None where there is none."""
    known = current(spark, root) if version is None else manifest(spark, root, version)
    if known is None:
        return None
    paths = [f"{root}/data/{p}" for b, p in known.parts.items() if buckets is None or int(b) in buckets]
    if not paths:
        return spark.createDataFrame([], known.schema)
    reader = spark.read.schema(known.schema)
    return reader.json(paths) if known.kind == "json" else reader.parquet(*paths)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def replace(df: DataFrame, root: str, *, kind: str = "json", keep: int = KEPT) -> Manifest:
    """A whole new version.  JSON keeps characters outside ASCII as they are."""
    spark = df.sparkSession
    before, name = current(spark, root), uuid.uuid4().hex
    writer = df.write
    (writer.json if kind == "json" else writer.parquet)(f"{root}/data/{name}")
    return commit(spark, root, Manifest(before.version + 1 if before else 0, _ddl(df.schema), kind, 1, {"0": name}), keep)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(df: DataFrame, root: str, keys: list[str], buckets: int) -> dict[str, str]:
    """Files of ``df`` by bucket, one each; the folder of each bucket that has rows."""
    name = uuid.uuid4().hex
    df.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/data/{name}")
    path, fs = _fs(df.sparkSession, f"{root}/data/{name}")
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    return {f.split("=")[1]: f"{name}/{f}" for f in found if f.startswith("_bucket=")}


def change(batch: DataFrame, root: str, keys: list[str], combine: Callable[[DataFrame | None, DataFrame], DataFrame], *, batch_id: int, buckets: int = 64, keep: int = KEPT) -> Manifest | None:
    """Bring a batch into the table: only the buckets of its keys are read and written, the others stay as files.

    ``combine`` makes the new rows of these buckets from their old ones (None for a first
    version) and the batch.  A batch that the table already holds changes nothing, so
    a stream may repeat it; an empty batch gives no version.  ``buckets`` counts for a new table only.
    """
    spark = batch.sparkSession
    before = current(spark, root)
    if before is not None and before.batch >= batch_id:
        return before
    n = before.buckets if before else buckets
    # at most as many rows as buckets come to the driver
    touched = [r[0] for r in batch.select(_bucket(keys, n).alias("b")).distinct().collect()]
    if not touched:
        return before
    old = read(spark, root, before.version, touched) if before else None
    done = combine(old, batch)
    written = _write(done, root, keys, n)
    parts = {b: p for b, p in (before.parts.items() if before else ()) if int(b) not in touched} | written
    return commit(spark, root, Manifest(before.version + 1 if before else 0, _ddl(done.schema), "parquet", n, parts, batch_id), keep)


def rebucket(spark: SparkSession, root: str, keys: list[str], buckets: int, keep: int = KEPT) -> Manifest | None:
    """The same rows in another number of buckets, each of one file; for a table that has outgrown its buckets."""
    before = current(spark, root)
    if before is None:
        return None
    parts = _write(read(spark, root, before.version), root, keys, buckets)
    return commit(spark, root, Manifest(before.version + 1, before.schema, "parquet", buckets, parts, before.batch), keep)
