"""Session settings the operators rely on.

``configure`` only touches runtime SQL settings, so it is safe on a session
someone else built; memory and cores stay the cluster's.

Shuffles begin with many partitions and AQE joins small ones up to ``PARTITION_BYTES``. So what a
task sorts or folds does not grow with the input, as it would with a fixed, small
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Partitions a shuffle begins with, and the compressed bytes of one after AQE joined them.
FIRST_PARTITIONS = 384
PARTITION_BYTES = "16m"

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(FIRST_PARTITIONS),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": PARTITION_BYTES,
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs the next operator a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Prune the big side of a join by the keys that survive on the small side.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cpus: int = 8, app: str = "cohortloom", memory: str = "12g", shared: str = "/tmp/checkpoints"
) -> SparkSession:
    """A local session for tests and the benchmark; ``shared`` is its folder for stages."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", shared)
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
