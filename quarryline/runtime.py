"""Session helpers shared by all operators: reading tables, cutting lineage, numbering rows."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test data; timestamps without zone are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, it is one of our own on a local master and an error on any other."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is unset: on {sc.master} it has to name a folder that all executors share")
        sc.setCheckpointDir(folder or Path(tempfile.mkdtemp(prefix="spark-")).as_uri())
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed columnar table: smaller on disk, and later reads prune columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Deletes tables of stored() that nothing reads any more: whatever was made from them is stored itself, or was counted."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether anything has a path of that pattern, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt out to all cores where its splits would leave half of them idle, for work that is heavy per row.

    Only small scans have so few splits (each holds up to spark.sql.files.maxPartitionBytes); large ones stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() * 2 <= cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for exchanges that must not be coalesced since work per row is heavy."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a column of ids 0, 1, 2 ... in the order of the given columns.

    Rows are range-partitioned and sorted; only one count per partition reaches the driver, and the first id of each
    partition is joined as a small table, so the plan doesn't grow with the partitions.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    starts, total = [], 0
    for part, n in sorted(ranged.groupBy(F.spark_partition_id()).count().collect()):
        starts.append((part, total))
        total += n
    known = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_within": within})
    return placed.join(F.broadcast(known), "_part").withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")
