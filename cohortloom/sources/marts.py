"""Published marts: versions in folders of their own, and a pointer that is switched last.

A build writes a new version beside the old ones and then moves a small pointer file onto the
current one, in a single rename. A reader that follows the pointer never sees a half-written
mart, a failed build leaves the old version in place, and a build may read the version that it
replaces.

A keyed mart takes the place of an index: its files are bucketed and sorted by a key, so a join or an
aggregation on the key, and a join of two marts with the same key and number of buckets, needs no
shuffle. The pointer keeps the layout, so any session can use it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTER = "CURRENT"


@dataclass(frozen=True)
class Version:
    """What the pointer says."""

    folder: str
    schema: str
    partition_by: str | None = None
    key: str | None = None
    buckets: int = 0


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> Version | None:
    """The published version of a mart, None before the first."""
    files, pointer = _files(spark, path), _path(spark, f"{path}/{POINTER}")
    try:
        stream = files.open(pointer)
    except Py4JJavaError as error:
        if "FileNotFoundException" in error.java_exception.getClass().getName():
            return None
        raise
    try:
        return Version(**json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, version: Version) -> None:
    """Write the pointer under another name and move it onto the old one."""
    files = _files(spark, path)
    fresh = _path(spark, f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    stream = files.create(fresh, False)
    stream.write(bytearray(json.dumps(asdict(version)).encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, _path(spark, f"{path}/{POINTER}"), options)


def _table(spark: SparkSession, version: Version) -> DataFrame:
    schema = StructType.fromJson(json.loads(version.schema))
    if not version.key:
        return spark.read.schema(schema).parquet(version.folder)
    # The session's catalog learns the layout; the files stay where they are.
    name = "mart_" + version.folder.rsplit("-", 1)[-1]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"create table if not exists {name} ({columns}) using parquet "
        f"clustered by (`{version.key}`) sorted by (`{version.key}`) into {version.buckets} buckets "
        f"location '{version.folder}'")
    return spark.table(name)


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    """The published version. A reader keeps the version it began with while others are published."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version of {path} is published")
    return _table(spark, version)


def publish_mart(
    df: DataFrame, path: str, partition_by: str | None = None, key: str | None = None, buckets: int = 0
) -> DataFrame:
    """Write a new version of a mart, switch the pointer to it, and read it back.

    ``partition_by`` makes one folder for each value, which filters open alone. ``key`` with
    ``buckets`` makes a keyed mart; one task writes a bucket, so let a bucket be a task's share of
    rows. An empty table is a version like any other.
    """
    if key and (partition_by or buckets < 1):
        raise ValueError("a keyed mart needs a number of buckets and has no partition column")
    spark, path = df.sparkSession, path.rstrip("/")
    # Names ascend with time, so that old versions can be told from new ones.
    folder = f"{path}/v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    if key:
        # Dealt out as the bucket function deals, so that a task writes whole buckets and a bucket is one file.
        table = "write_" + folder.rsplit("-", 1)[-1]
        df.repartition(buckets, F.col(key)).write.bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(table)
        # The catalog entry goes, the files of an external table stay.
        spark.sql(f"drop table {table}")
    elif partition_by:
        # Rebalance gathers a value's rows into few files and splits a big one.
        df.hint("rebalance", F.col(partition_by)).write.partitionBy(partition_by).parquet(folder)
    else:
        df.write.parquet(folder)
    version = Version(folder, df.schema.json(), partition_by, key, buckets)
    _switch(spark, path, version)
    return _table(spark, version)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove versions older than the published one, but for the last ``keep`` of them, and return how
    many went. Versions newer than the pointer are left: they may be being written."""
    version = current_version(spark, path)
    if version is None:
        return 0
    files = _files(spark, path)
    found = sorted(s.getPath().getName() for s in files.listStatus(_path(spark, path)) if s.isDirectory())
    published = version.folder.rsplit("/", 1)[-1]
    older = [name for name in found if name.startswith("v-") and name < published]
    gone = older[:len(older) - keep] if keep else older
    for name in gone:
        files.delete(_path(spark, f"{path}/{name}"), True)
    return len(gone)
