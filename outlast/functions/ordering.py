"""Order statistics and ranks that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlast.functions.hashing import PRIME

SKETCH_ACCURACY = 10_000
SMALL_GROUP = 100_000  # ranks of a group this small are not bracketed, all its values are counted
SLICE_ROWS = 1_000_000
LEAST_SLICES = 64


def _bracket_probs(probs: Sequence[float]) -> list[float]:
    margin = 4.0 / SKETCH_ACCURACY
    edges = []
    for p in probs:
        edges += [max(0.0, p - margin), min(1.0, p + margin)]
    return edges


def _refine(rows: DataFrame, keys: list[str], sketch: DataFrame, probs: Sequence[float],
            small_group: int) -> DataFrame:
    """Turn per-group sketches (keys, _n, _edges) into exact quantiles of ``rows`` (keys, _v)."""
    inf = F.lit(float("inf"))
    small = F.col("_n") <= small_group
    brackets = sketch.select(*keys, "_n", F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
            F.when(small, -inf).otherwise(F.col("_edges")[2 * i]).alias("lo"),
            F.when(small, inf).otherwise(F.col("_edges")[2 * i + 1]).alias("hi"),
        ) for i, p in enumerate(probs)])).alias("_b")).select(*keys, "_n", "_b.*")
    # Everything under the bracket collapses into one null-valued group: counted, never kept.
    counted = (rows.join(brackets, keys).where(F.col("_v") <= F.col("hi"))
               .groupBy(*keys, "i", "p", "_n", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v"))
               .agg(F.count("*").alias("_c")))
    ascending = Window.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_c").over(ascending.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", upto).where(F.col("_v").isNotNull())
    spot = F.col("p") * (F.col("_n") - 1)

    def at(rank: Column) -> Column:
        covers = (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
        return F.max(F.when(covers, F.col("_v")))

    found = ranked.groupBy(*keys, "i").agg(
        at(F.floor(spot)).alias("low"), at(F.ceil(spot)).alias("high"),
        F.max(spot - F.floor(spot)).alias("part"))
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == i, value)).alias(f"_q{i}") for i in range(len(probs))])


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                      small_group: int = SMALL_GROUP) -> DataFrame:
    """Exact linear-interpolation quantiles per group, safe for groups of any size.

    Output: keys plus ``_q0, _q1, ...``. A bounded sketch per group first brackets each wanted
    rank; only the values inside a bracket (about 0.1 % of a large group) are then counted one by
    one. Both passes combine on the map side.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(
        F.col("_v"), _bracket_probs(probs), SKETCH_ACCURACY).alias("_edges"))
    return _refine(rows, keys, sketch, probs, small_group)


def long_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the named columns; plans stay small however many columns there are."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     small_group: int = SMALL_GROUP) -> DataFrame:
    """Exact quantiles of whole columns: rows of (column, _q0, _q1, ...); all-null columns are absent."""
    return grouped_quantiles(long_columns(df, columns), ["column"], "value", probs, small_group)


def slices_for(df: DataFrame) -> int:
    """A power of two, so that a slice of evenly spread rows holds about SLICE_ROWS at most."""
    rows, slices = df.count(), LEAST_SLICES
    while slices * SLICE_ROWS < rows:
        slices *= 2
    return slices


def number_rows(df: DataFrame, hashed: Column, tiebreak: Column, by: Sequence[str] = (),
                name: str = "_rank", slices: int | None = None) -> DataFrame:
    """1-based row number per ``by`` group in order of (hashed, tiebreak).

    ``hashed`` must be spread evenly over [0, PRIME): the range is cut into equal slices, rows are
    numbered inside a slice and shifted by the row counts of the slices before it. No task sees
    more than one slice, and the offset table has one row per group and slice. Without ``slices``
    their number follows from a count of ``df``.
    """
    by, slices = list(by), slices or slices_for(df)
    sliced = df.withColumn("_h", hashed).withColumn(
        "_slice", F.floor(F.col("_h") * slices / F.lit(PRIME)).cast("int"))
    sizes = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_h", tiebreak)
    return (sliced.withColumn("_in", F.row_number().over(inside))
            .join(offsets, [*by, "_slice"])
            .withColumn(name, (F.col("_in") + F.col("_before")).cast("bigint"))
            .drop("_h", "_slice", "_in", "_before"))


def slot_of(value: Column, bounds: Column, size: int) -> Column:
    """How many of the ``size`` (2^k - 1) ascending ``bounds`` are <= value, by binary search."""
    steps = []
    step = (size + 1) // 2
    while step:
        steps.append(step)
        step //= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: at + F.when(F.get(bounds, at + s - 1) <= value, s).otherwise(0))


def rank_by_range(df: DataFrame, by: Sequence[str], column: str, slices: int, name: str = "_rank") -> DataFrame:
    """1-based rank of each row of ``df``, whose ``column`` is distinct within a ``by`` group, in ascending order.

    The groups are cut into ``slices`` ranges (a power of two) at sketched quantiles; rows are numbered
    inside a range and shifted by the counts of the ranges below, so no task holds a group.
    """
    by = list(by)
    edges = F.percentile_approx(column, [i / slices for i in range(1, slices)], SKETCH_ACCURACY).alias("_bounds")
    bounded = df.join(df.groupBy(*by).agg(edges), by) if by else df.withColumn("_bounds", df.agg(edges).scalar())
    sliced = bounded.withColumn("_slice", slot_of(F.col(column), F.col("_bounds"), slices - 1)).drop("_bounds")
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_size")).select(
        *by, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_slice").orderBy(column)
    return (sliced.withColumn("_in", F.row_number().over(inside)).join(offsets, [*by, "_slice"])
            .withColumn(name, (F.col("_in") + F.col("_before")).cast("bigint")).drop("_slice", "_in", "_before"))
