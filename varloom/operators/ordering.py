"""Source ordinals and deterministic ranks that never put a group on one task.

A window over ``partitionBy(run)`` sorts a whole run on one task. Here rows are
range-partitioned on (group, order) instead, so a group of any size spreads over
many tasks; a row's rank is its position inside its range slice plus the size of
the group's earlier slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varloom.session import materialize, written

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
STEPS = 512  # equal steps of the value range from 0 to 1 that rows are dealt out by
HOT_STEP = 1_000_000  # rows of a step that one task may sort
_LOCAL = 33  # monotonically_increasing_id keeps the in-partition index in the low 33 bits


def checked_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` with a broadcast hint when it is small, in rows and in bytes of its values.

    Beyond either bound the frame is returned as it is and the join shuffles. Give
    a materialised frame: the check reads at most ``max_rows + 1`` rows of it.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    rows, held = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if rows <= max_rows and held <= max_bytes:
        return F.broadcast(df)
    return df


def place(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Range-partition and sort, then write the rows with ``_slice`` and ``_pos``.

    The placed rows go to the checkpoint folder, so positions and slice totals
    come from the same placement even when executors are lost in between. They are
    columns there: sorted rows pack well, and slice totals read the group alone.
    """
    placed, _ = written(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id()),
        "placed",
    )
    return placed.withColumn("_slice", F.shiftright("_pos", _LOCAL))


def _carry(placed: DataFrame, group: list[str], total: Column, running) -> DataFrame:
    """Per slice and group: the slice start and ``running`` over the earlier slices."""
    window = (
        Window.partitionBy(*(group or [F.lit(0)]))
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return materialize(
        placed.groupBy("_slice", *group)
        .agg(F.min("_pos").alias("_first"), total.alias("_total"))
        .withColumn("_before", running("_total").over(window))
        .drop("_total")
    )


def rank_within(
    df: DataFrame, group: list[str], order: list[Column], name: str = "rank", value: str | None = None
) -> DataFrame:
    """Add ``name``: the 1-based position of a row in its group under ``order``.

    ``order`` must be total inside a group. With ``value``, the number that ``order`` begins with, highest
    first, no placed row is written; ``df`` is read twice then, so give a saved one.
    """
    if value is not None:
        return _rank_by_steps(df, group, order, name, F.col(value))
    placed = place(df, [F.col(c) for c in group] + order)
    spans = _carry(placed, group, F.count(F.lit(1)), F.sum)
    before = F.coalesce("_before", F.lit(0))
    return placed.join(checked_broadcast(spans), ["_slice", *group]).select(
        *df.columns, (F.col("_pos") - F.col("_first") + before + F.lit(1)).alias(name)
    )


def _rank_by_steps(df: DataFrame, group: list[str], order: list[Column], name: str, value: Column) -> DataFrame:
    """``rank_within`` by steps of the value: a rank is the rows of higher steps and the position in its own.

    The steps are counted first, so positions need no placement that is written. A step depends on the
    value alone and follows its order: NaN is highest, NULL lowest, and what lies beyond 0 and 1 is in
    the outer steps. A step above ``HOT_STEP`` rows (equal values) is placed by ranges.
    """
    inside = F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * F.lit(float(STEPS)))
    step = F.when(value.isNull(), -1).when(F.isnan(value), STEPS + 1).otherwise(inside).cast("int")
    marked = df.withColumn("_step", step)
    key = [*group, "_step"]
    counts, _ = written(marked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), "steps")
    # a group has at most STEPS + 3 steps
    higher = Window.partitionBy(*group).orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select(*key, F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_before")))
    hot = counts.where(F.col("_n") > HOT_STEP).select(*key)
    # the step goes first, as a sort tells most rows apart by its first column
    own = Window.partitionBy("_step", *group[::-1]).orderBy(*order)
    if hot.limit(1).collect():
        hot = checked_broadcast(materialize(hot))
        placed = rank_within(marked.join(hot, key, "left_semi").select(*marked.columns), key, order, "_at")
        marked = marked.join(hot, key, "left_anti").select(*marked.columns)
        ranked = marked.withColumn("_at", F.row_number().over(own)).unionByName(placed)
    else:
        ranked = marked.withColumn("_at", F.row_number().over(own))
    return ranked.join(checked_broadcast(starts), key).select(*df.columns, (F.col("_before") + F.col("_at")).alias(name))


def running_max(
    df: DataFrame, group: list[str], order: list[Column], value: Column, name: str
) -> DataFrame:
    """Add ``name``: the largest ``value`` of the group up to and including the row.

    Two-level scan: a window inside each range slice plus the carry of the
    earlier slices; a group may span any number of slices.
    """
    keys = [F.col(c) for c in group] + order
    placed = place(df.withColumn("_value", value), keys)
    spans = _carry(placed, group, F.max("_value"), F.max)
    local = Window.partitionBy("_slice", *group).orderBy("_pos")
    scanned = placed.withColumn("_local", F.max("_value").over(local))
    return scanned.join(checked_broadcast(spans), ["_slice", *group]).select(
        *df.columns, F.greatest("_local", "_before").alias(name)
    )


def with_ordinal(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """Global 1-based record number in the given order."""
    return rank_within(df, [], [F.col(c) if isinstance(c, str) else c for c in order], name)


def top_within(df: DataFrame, group: list[str], order: list[Column], k: int,
               name: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their rank.

    For a small constant ``k`` the optimizer limits each group before the
    shuffle (window group limit), so a hot group moves at most ``k`` rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast(T.LongType())).where(
        F.col(name) <= k
    )


def line_ordinals(lines: DataFrame, saved: bool = False) -> DataFrame:
    """Line numbers for a text scan with (path, block_start, value).

    ``saved`` writes the lines first, so a scan that is dear to read is read once.

    Lines of one file split are read in order; a split's offset is the number of
    lines in the earlier splits of its file.
    """
    numbered = lines.withColumn("_pos", F.monotonically_increasing_id())
    if saved:
        numbered, _ = written(numbered, "lines")
    splits = numbered.groupBy("path", "block_start").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy("path").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop(
        "_n"
    )
    return numbered.join(offsets, ["path", "block_start"]).select(
        "path",
        (F.col("_pos") - F.col("_first") + F.col("_before") + 1).alias("line_no"),
        "value",
    )
