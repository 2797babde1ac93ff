"""Order-dependent building blocks that no single key can overload.

A window partitioned by customer puts a customer's whole history into one task.
Here a history is first cut into cells (for example date and hour). Counting
cells is an ordinary aggregate, the running total over cells is a window over
the calendar rather than over rows, and only the rows of one cell are ranked
together. Positions are exact and do not depend on how data is partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketcast.session import store

# Rows of one cell that are ranked together.
SUB_ROWS = 1_000_000
# Rows of one key that a window over blocks handles together.
BLOCK_ROWS = 100_000


def with_position(df: DataFrame, key: Sequence[str], cell: Sequence[str], order: Sequence[str],
                  name: str = "pos", descending: Sequence[str] = (), sub_rows: int = SUB_ROWS) -> DataFrame:
    """Number the rows of each key from 0 by ``(*cell, *order)``.

    ``order`` must make rows unique within a cell. Rows with a null key drop
    out, as grouping by customer drops them. A null cell value sorts first.
    A cell of more than ``sub_rows`` rows is cut into ranges of the first
    column of ``order``, so that no task ranks many more rows than that.
    """
    def direction(column: str) -> Column:
        return F.desc_nulls_last(column) if column in descending else F.asc_nulls_first(column)

    keyed = df.dropna(subset=list(key)) if key else df
    counts = store(keyed.groupBy(*key, *cell).agg(F.count("*").alias("_n")))
    keyed, cells = keyed.withColumn("_sub", F.lit(0)), list(cell)
    hot = counts.filter(F.col("_n") > sub_rows)
    largest = hot.agg(F.max("_n")).first()[0]
    if largest is not None:
        keyed = in_ranges(keyed, hot, key, cell, order[0], math.ceil(largest / sub_rows), order[0] in descending)
        cells.append("_sub")
        counts = keyed.groupBy(*key, *cells).agg(F.count("*").alias("_n"))
    running = (Window.partitionBy(*key).orderBy(*[direction(c) for c in cells])
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        *[F.col(c).alias(f"_of_{c}") for c in (*key, *cells)],
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    same = [F.col(c) == F.col(f"_of_{c}") for c in key]
    same += [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cells]
    inside = Window.partitionBy(*key, *cells).orderBy(*[direction(c) for c in order])
    return (keyed.join(offsets, same)
            .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
            .select(*df.columns, name))


def in_ranges(rows: DataFrame, hot: DataFrame, key: Sequence[str], cell: Sequence[str], column: str, parts: int, falling: bool) -> DataFrame:
    """Rows with ``_sub``: in the cells of ``hot``, the number of a range of ``column`` with about equally many rows each.

    Ranges are numbered in the order of ``column``; nulls stand where it puts them. There are at most
    (rows / rows of a range) hot cells, whose bounds are stored and broadcast.
    """
    on = [*key, *cell]
    names = {c: f"_at_{c}" for c in on}
    marks = hot.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = store(rows.join(F.broadcast(marks), same).groupBy(*names.values())
                   .agg(F.percentile_approx(column, shares, 20 * parts).alias("_bounds")))
    below = F.size(F.filter("_bounds", lambda b: b < F.col(column)))
    place = F.when(F.col("_bounds").isNull(), 0).when(F.col(column).isNull(), parts + 1 if falling else -1).otherwise(-below if falling else below)
    return rows.join(F.broadcast(bounds), same, "left").withColumn("_sub", place).drop("_bounds", *names.values())


def halo_blocks(df: DataFrame, reach_back: int = 0, reach_ahead: int = 0, pos: str = "pos",
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut numbered histories into blocks that overlap at their edges.

    Every row is owned by block ``pos div block_rows`` (``owned`` true) and is
    copied into a neighbouring block when that block's rows look back or ahead
    at it. Window functions over ``(key, block)`` that reach at most
    ``reach_back`` rows back and ``reach_ahead`` ahead are then exact on owned
    rows.
    """
    if max(reach_back, reach_ahead) > block_rows:
        raise ValueError("blocks must be longer than the reach of the window")
    block = F.floor(F.col(pos) / F.lit(block_rows)).cast("long")
    inside = F.pmod(F.col(pos), F.lit(block_rows))
    copies = [F.struct(block.alias("block"), F.lit(True).alias("owned"))]
    if reach_back:
        copies.append(F.when(inside >= block_rows - reach_back,
                             F.struct((block + 1).alias("block"), F.lit(False).alias("owned"))))
    if reach_ahead:
        copies.append(F.when((inside < reach_ahead) & (block > 0),
                             F.struct((block - 1).alias("block"), F.lit(False).alias("owned"))))
    return df.select("*", F.inline(F.filter(F.array(*copies), lambda c: c.isNotNull())))


def last_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int,
              name: str = "back") -> DataFrame:
    """The last ``n`` rows of each key; ``name`` is 1 for the newest.

    Spark limits each key inside the map tasks before the shuffle, so a large
    history sends at most ``n`` rows per task.
    """
    newest = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return (df.dropna(subset=list(key)).withColumn(name, F.row_number().over(newest))
            .filter(F.col(name) <= n))
