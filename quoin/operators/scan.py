"""Operators over the order of elements: ranks, sorts, prefix sums, differences, searches.

Nothing here puts a whole array into one task. Places and prefix sums work in two levels: chunks of the
order, and the chunks' totals, of which there are few. Sorting goes by distinct values, so that a hot value
is a chain of chunks too.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..darray import DArray, as_darray, names
from ..session import shared_folder, spark

#: Elements of a chunk.
CHUNK = 1 << 16
#: Elements of a range of values that one task sorts, about, and the most ranges.
RANGE, RANGES = 1 << 20, 20_000
#: Elements beyond which both sides of a join are dealt out, whatever Spark takes a compressed file for: a side that is broadcast goes through the driver.
DEALT = 1 << 20


def dealt(df: DataFrame, size: int) -> DataFrame:
    return df.hint("merge") if size > DEALT else df


def _before(sums: DataFrame, keys: list[str], total, both) -> DataFrame:
    """keys, chunk and the total `before` of all chunks before it within the keys, from totals t of chunks.

    Chunks are taken together by CHUNK once more, so that no task sees more than their number, squared.
    total: an aggregate; both: of two totals, either of which may be null.
    """
    upto = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("over", F.floor(F.col("chunk") / CHUNK))
    over = sums.groupBy(*keys, "over").agg(total(F.col("t")).alias("t"))
    over = over.select(*keys, "over", total(F.col("t")).over(upto(keys, "over")).alias("far"))
    near = sums.withColumn("near", total(F.col("t")).over(upto([*keys, "over"], "chunk")))
    return near.join(over, [*keys, "over"]).select(*keys, "chunk", both(F.col("near"), F.col("far")).alias("before"))


def _chunk_sums(df: DataFrame, keys: list[str], order: str, total: Column) -> DataFrame:
    """keys, chunk of `order` and the total of all chunks before it within the keys."""
    sums = df.groupBy(*keys, F.floor(F.col(order) / CHUNK).alias("chunk")).agg(total.alias("t"))
    return _before(sums, keys, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def places(df: DataFrame, order: str) -> tuple[DataFrame, int]:
    """df with its place `at` by the distinct non-negative integers in `order`, and the number of rows."""
    df = df.withColumn("chunk", F.floor(F.col(order) / CHUNK))
    before = _chunk_sums(df, [], order, F.count("*"))
    w = Window.partitionBy("chunk").orderBy(order)
    out = df.join(before, "chunk").withColumn("at", (F.coalesce("before", F.lit(0)) + F.row_number().over(w) - 1).cast("bigint"))
    return out.drop("chunk", "before"), df.count()


def _in_ranges(counts: DataFrame, size: int) -> DataFrame:
    """counts (v, n) with `part`, ranges of v in order, and pb and pk, the sum of n and the number of v in those before.

    Ranges grow in number with the array; more than one are dealt by sampled bounds and written once.
    """
    ranges = min(RANGES, -(-size // RANGE))
    if ranges <= 1:
        return counts.select("*", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pb"), F.lit(0).cast("bigint").alias("pk"))
    path = shared_folder("ranges")
    counts.repartitionByRange(ranges, "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    counts = spark().read.parquet(path)
    whole = counts.groupBy("part").agg(F.sum("n").alias("pn"), F.count("*").alias("pd"))
    w0 = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    whole = whole.select("part", F.coalesce(F.sum("pn").over(w0), F.lit(0)).alias("pb"), F.coalesce(F.sum("pd").over(w0), F.lit(0)).alias("pk"))
    return counts.join(F.broadcast(whole), "part")


def value_ranks(df: DataFrame, size: int, extra: list[str] = []) -> DataFrame:
    """For each distinct v (and extra keys) of df, of `size` elements: how many elements are less (`below`) and how
    many equal (`n`); `nth` is its place among the distinct ones. NaN is the greatest."""
    counts = df.groupBy(*extra, "v").agg(F.count("*").alias("n"))
    if extra:  # one order for each row or column of a matrix
        w = Window.partitionBy(*extra).orderBy("v")
        return counts.select(*extra, "v", "n", (F.sum("n").over(w) - F.col("n")).alias("below"), (F.row_number().over(w) - 1).cast("bigint").alias("nth"))
    w = Window.partitionBy("part").orderBy("v")
    out = _in_ranges(counts, size)
    return out.select("v", "n", (F.sum("n").over(w) - F.col("n") + F.col("pb")).alias("below"), (F.row_number().over(w) - 1 + F.col("pk")).cast("bigint").alias("nth"))


def sort(a: DArray) -> DArray:
    """A vector's elements in order, a matrix by its last axis."""
    keys = names(a.ndim)[:-1]
    ranks = value_ranks(a.df, a.size, keys)
    at = F.explode(F.sequence(F.col("below").cast("bigint"), (F.col("below") + F.col("n") - 1).cast("bigint")))
    return DArray(ranks.select(*keys, at.alias(f"i{a.ndim - 1}"), "v"), a.shape)


msort = sort_complex = partition = sort


def order_places(a: DArray) -> DataFrame:
    """i0, v and the stable place `at` of each element of a vector in sorted order."""
    df = a.df.withColumn("chunk", F.floor(F.col("i0") / CHUNK))
    ties = _chunk_sums(df, ["v"], "i0", F.count("*"))
    w = Window.partitionBy("v", "chunk").orderBy("i0")
    same = df.join(dealt(ties, a.size), ["v", "chunk"]).withColumn("k", F.row_number().over(w) - 1 + F.coalesce("before", F.lit(0)))
    return same.join(dealt(value_ranks(a.df, a.size).select("v", "below"), a.size), "v").select("i0", "v", (F.col("below") + F.col("k")).cast("bigint").alias("at"))


def argsort(a: DArray) -> DArray:
    return DArray(order_places(a).select(F.col("at").alias("i0"), F.col("i0").alias("v")), a.shape)


argpartition = argsort


def lexsort(keys: list[DArray]) -> DArray:
    """The order by the last key, then the one before it, and so on, stable: one sort by all keys together."""
    both = keys[-1].with_value(F.struct(keys[-1].value.alias("k0")))
    for j, k in enumerate(keys[-2::-1], 1):
        both = both.combine(k, lambda s, v, j=j: F.struct(*[s[f"k{i}"].alias(f"k{i}") for i in range(j)], v.alias(f"k{j}")))
    return argsort(both)


def top_k(a: DArray, k: int, largest: bool = True) -> tuple[DArray, DArray]:
    """The k greatest (or least) values in order and their indices, ties to the smaller index; NaN left out."""
    rows = a.df.where(~F.isnan(F.col("v").cast("double"))).orderBy(F.desc("v") if largest else F.asc("v"), "i0").limit(k)
    w = Window.orderBy(F.desc("v") if largest else F.asc("v"), "i0")  # k rows
    rows = rows.withColumn("at", (F.row_number().over(w) - 1).cast("bigint"))
    n = min(k, a.size)
    return DArray(rows.select(F.col("at").alias("i0"), "v"), (n,)), DArray(rows.select(F.col("at").alias("i0"), F.col("i0").alias("v")), (n,))


def _prefix(a: DArray, axis: int, total, both, running) -> DArray:
    """total: an aggregate of values; both: of two totals; running: from the running aggregate and what came before to the result."""
    keys = [c for k, c in enumerate(names(a.ndim)) if k != axis]
    order = f"i{axis}"
    df = a.df.withColumn("chunk", F.floor(F.col(order) / CHUNK))
    sums = df.groupBy(*keys, "chunk").agg(total(F.col("v")).alias("t"))
    sums = _before(sums, keys, total, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both(a, b)))
    w = Window.partitionBy(*keys, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("r", total(F.col("v")).over(w)).join(sums, [*keys, "chunk"])
    return DArray(out.select(*names(a.ndim), running(F.col("r"), F.col("before")).alias("v")), a.shape)


def cumsum(a: DArray, axis: int | None = None) -> DArray:
    from .shape import ravel

    if axis is None:
        a, axis = ravel(a), 0
    return _prefix(a, axis, F.sum, lambda x, y: x + y, lambda r, b: r + F.coalesce(b, F.lit(0)))


def cumprod(a: DArray, axis: int | None = None) -> DArray:
    from .shape import ravel

    if axis is None:
        a, axis = ravel(a), 0
    return _prefix(a.astype("double"), axis, F.product, lambda x, y: x * y, lambda r, b: r * F.coalesce(b, F.lit(1.0)))


cumproduct = cumprod


def nancumsum(a: DArray, axis: int | None = None) -> DArray:
    return cumsum(a.map(lambda v: F.nanvl(v, F.lit(0.0))), axis)


def nancumprod(a: DArray, axis: int | None = None) -> DArray:
    return cumprod(a.map(lambda v: F.nanvl(v, F.lit(1.0))), axis)


def _shifted(a: DArray, by: int, axis: int) -> DArray:
    """a[.. + by ..]: the elements that lie `by` further on."""
    return DArray(a.df.withColumn(f"i{axis}", F.col(f"i{axis}") - by).where(F.col(f"i{axis}") >= 0), a.shape)


def diff(a: DArray, n: int = 1, axis: int = -1) -> DArray:
    axis %= a.ndim
    for _ in range(n):
        shape = list(a.shape)
        shape[axis] -= 1
        nxt = _shifted(a, 1, axis).df.withColumnRenamed("v", "w")
        a = DArray(a.df.join(nxt, names(a.ndim)).select(*names(a.ndim), (F.col("w") - F.col("v")).alias("v")), shape)
    return a


def ediff1d(a: DArray, to_begin=None, to_end=None) -> DArray:
    from .shape import concatenate, ravel

    parts = [x if x is None else as_darray(np.atleast_1d(x)).astype(a.dtype) for x in (to_begin, to_end)]
    return concatenate([p for p in (parts[0], diff(ravel(a)), parts[1]) if p is not None])


def gradient(a: DArray, step: float = 1.0) -> DArray:
    """Central differences of a vector, one-sided at its ends."""
    n, df = a.size, a.df
    near = df.select("i0", F.explode(F.array(F.struct((F.col("i0") + 1).alias("at"), F.lit(-1).alias("side")), F.struct((F.col("i0") - 1).alias("at"), F.lit(1).alias("side")), F.struct(F.col("i0").alias("at"), F.lit(0).alias("side")))).alias("s"), "v")
    near = near.groupBy(F.col("s.at").alias("i0")).agg(*[F.max(F.when(F.col("s.side") == k, F.col("v"))).alias(c) for k, c in ((-1, "p"), (0, "m"), (1, "q"))]).where((F.col("i0") >= 0) & (F.col("i0") < n))
    v = F.when(F.col("i0") == 0, F.col("q") - F.col("m")).when(F.col("i0") == n - 1, F.col("m") - F.col("p")).otherwise((F.col("q") - F.col("p")) / 2)
    return DArray(near.select("i0", (v / F.lit(step)).alias("v")), a.shape)


def trapz(y: DArray, x: DArray | None = None, dx: float = 1.0) -> DArray:
    from .reduce import sum_

    mean = (y + _shifted(y, 1, 0)) / 2.0
    return sum_(mean * diff(x)) if x is not None else sum_(mean) * dx


def unwrap(a: DArray) -> DArray:
    """Phases without jumps of more than pi: a running sum of the corrections."""
    tau = 2 * math.pi
    d = diff(a)
    fold = lambda v: v - F.lit(tau) * F.floor((v + math.pi) / tau)
    fix = d.map(lambda v: F.when(F.abs(v) < math.pi, F.lit(0.0)).otherwise(F.when((fold(v) == -math.pi) & (v > 0), F.lit(math.pi)).otherwise(fold(v)) - v))
    turn = cumsum(fix)
    more = turn.df.select((F.col("i0") + 1).alias("i0"), F.col("v").alias("w"))
    return DArray(a.df.join(more, "i0", "left").select("i0", (F.col("v") + F.coalesce("w", F.lit(0.0))).alias("v")), a.shape)


def searchsorted(points: DArray, v: DArray, side: str = "left") -> DArray:
    """Places at which elements of v go into sorted points: ranks in the union of both, so that either may be large."""
    p = points.df.select(F.col("v").cast("double").alias("v"), F.lit(1).alias("is_point"))
    q = v.df.select(F.col("v").cast("double").alias("v"))
    counts = p.groupBy("v").agg(F.count("*").alias("n")).unionByName(q.distinct().withColumn("n", F.lit(0).cast("bigint"))).groupBy("v").agg(F.sum("n").alias("n"))
    rows = _in_ranges(counts, points.size + v.size)
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + F.col("pb")
    ranks = rows.select(F.col("v").alias("w"), (upto if side == "right" else upto - F.col("n")).cast("bigint").alias("at"))
    return DArray(v.df.join(ranks, F.col("v").cast("double") == F.col("w")).select(*names(v.ndim), F.col("at").alias("v")), v.shape)


def digitize(v: DArray, bins: DArray, right: bool = False) -> DArray:
    return searchsorted(bins, v, "left" if right else "right")


def interp(x: DArray, xp: DArray, fp: DArray) -> DArray:
    """Piecewise linear through the points (xp ascending), constant outside."""
    at = searchsorted(xp, x, "right").df.withColumnRenamed("v", "k")
    pts = xp.combine(fp, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))).df.select("i0", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    n = xp.size
    low, high = pts.select(F.col("i0").alias("lo"), F.col("x").alias("x0"), F.col("y").alias("y0")), pts.select(F.col("i0").alias("hi"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    rows = (x.df.join(at, names(x.ndim)).withColumn("lo", F.greatest(F.lit(0), F.col("k") - 1)).withColumn("hi", F.least(F.lit(n - 1), F.col("k")))
            .join(low, "lo").join(high, "hi"))
    v = F.when(F.col("k") == 0, F.col("y0")).when(F.col("k") == n, F.col("y1")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("v") - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0)))
    return DArray(rows.select(*names(x.ndim), v.alias("v")), x.shape)


def convolve(a: DArray, kernel, mode: str = "full") -> DArray:
    """With a short kernel, which becomes part of the plan: each element goes to len(kernel) places."""
    kernel = [float(k) for k in np.asarray(kernel.get() if isinstance(kernel, DArray) else kernel)]
    n, m = a.size, len(kernel)
    spread = F.explode(F.array(*[F.struct((F.col("i0") + k).alias("at"), (F.col("v") * F.lit(w)).alias("w")) for k, w in enumerate(kernel)]))
    full = a.df.select(spread.alias("s")).groupBy(F.col("s.at").alias("i0")).agg(F.sum("s.w").alias("v"))
    lo, size = {"full": (0, n + m - 1), "same": ((min(n, m) - 1) // 2, max(n, m)), "valid": (min(n, m) - 1, max(n, m) - min(n, m) + 1)}[mode]
    return DArray(full.where((F.col("i0") >= lo) & (F.col("i0") < lo + size)).withColumn("i0", F.col("i0") - lo), (size,))


def correlate(a: DArray, kernel, mode: str = "valid") -> DArray:
    kernel = np.asarray(kernel.get() if isinstance(kernel, DArray) else kernel)
    return convolve(a, kernel[::-1], mode)
