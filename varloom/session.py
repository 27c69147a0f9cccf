"""Session helpers: recommended settings, reliable checkpoints, checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class DataCheckError(ValueError):
    """An input or result breaks a rule of the data model."""


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is tuned for.

    On a cluster leave both arguments unset: master, shuffle width and
    ``spark.checkpoint.dir`` come from the submit configuration.
    """
    builder = (
        SparkSession.builder.appName("varloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # wide projections: methods above the JIT limit run interpreted, so split them
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # small inputs: keep all cores busy instead of packing everything into one task
            builder = (
                builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
                .config("spark.sql.files.openCostInBytes", "65536")
                .config("spark.driver.memory", "8g")
            )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory of the session.

    The directory configured by the cluster (``spark.checkpoint.dir``) wins. A
    temporary one is made only for a local master, never on a cluster.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    Used where a later step must see exactly the same rows again (positions
    after a range sort, fixpoint loops); survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` as Parquet below the checkpoint folder, read again, and its number of rows.

    One job: the rows are counted while they are written. For loops over rows, whose
    later rounds then scan columns and know the size of what they join.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise when ``violations`` has a row; one small action, stops at the first row."""
    row = violations.limit(1).collect()
    if row:
        raise DataCheckError(f"{message}: {row[0].asDict(recursive=True)}")


def dbl(value: float):
    """A double literal (a bare Python float in SQL text would become a decimal)."""
    return F.lit(float(value)).cast("double")


def score_round(column, digits: int = 6):
    """Round half up on the decimal value.

    The nudge is far below the last kept digit and far above the noise of
    summing doubles in another order, so ties round the same way everywhere.
    """
    return F.round(column + dbl(1e-9), digits)
