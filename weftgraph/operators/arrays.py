"""Array operators: scatter, gather, reduce, element-wise combination, average, pick.

Arrays are rows with an order; n-dimensional ones are rows with an index for each axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDUCERS = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min}
ELEMENTWISE = {"add": F.sum, "multiply": F.product, "maximum": F.max, "minimum": F.min}


def _sort_key(df: DataFrame, name: str) -> Column:
    """A number that never falls where the column rises: rows of a piece stay together."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.substring(F.hex(name), 1, 12), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def ranked(df: DataFrame, order: list[str], name: str = "idx", parts: int | None = None) -> DataFrame:
    """Zero-based global row index by `order`, without sending all rows to one task.

    Approximate quantiles of the first order column cut the rows into ranges; a range's
    offset is the running sum of the range sizes (one row for each range), and rows are
    numbered within their range: one shuffle of the rows.  Null order values come first.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", _sort_key(df, order[0]))
    cuts = keyed.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 1000 * parts)).first()[0] if parts > 1 else []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts or []))]) if cuts else F.expr("cast(array() as array<double>)")
    dealt = keyed.withColumn("_part", F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("_key"))), F.lit(0))).drop("_key")
    dealt = dealt.withColumn("_part", F.when(F.col(order[0]).isNull(), -1).otherwise(F.col("_part")))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + local).drop("_part", "_offset")


def tile_of(idx: Column, n: int, k: int) -> Column:
    """The piece (0..k-1) of row idx when n rows are split into k consecutive pieces of
    which the first n mod k hold one row more."""
    base, extra = divmod(n, k)
    late = extra + F.floor((idx - extra * (base + 1)) / max(base, 1))
    return F.when(idx < extra * (base + 1), F.floor(idx / (base + 1))).otherwise(late).cast("long")


def scatter(df: DataFrame, k: int, order: list[str], name: str = "tile") -> DataFrame:
    """Split into k consecutive pieces by order; some are empty if there are fewer rows."""
    return ranked(df, order, "_idx").withColumn(name, tile_of(F.col("_idx"), df.count(), k)).drop("_idx")


def first_of_each(pieces: DataFrame, by: str, order: str, *cols: str) -> DataFrame:
    """The first element of every piece."""
    return pieces.groupBy(by).agg(*[F.min_by(c, order).alias(c) for c in cols])


def scatter_axis(df: DataFrame, axis: str, length: int, k: int, name: str = "tile") -> DataFrame:
    """Split an n-dimensional array, given in long form, along one of its axes."""
    return df.withColumn(name, tile_of(F.col(axis), length, k))


def gather_chunks(df: DataFrame, width: int, order: list[str], value: Column) -> DataFrame:
    """Consecutive chunks of `width` rows, each reduced to its sum and size."""
    return ranked(df, order, "_idx").groupBy(F.floor(F.col("_idx") / width).cast("long").alias("chunk")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def concat(*inputs: DataFrame) -> DataFrame:
    """All inputs in declaration order; input_no and the rows' own order keep it."""
    parts = [x.withColumn("input_no", F.lit(i)) for i, x in enumerate(inputs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dict_gather(inputs: dict[str, Column], df: DataFrame, arguments: dict[str, str] | None = None) -> DataFrame:
    """One map of name -> value; arguments that are not empty fill absent names."""
    given = F.create_map(*[x for n, c in inputs.items() for x in (F.lit(n), c.cast("string"))])
    extra = {k: v for k, v in (arguments or {}).items() if v not in (None, "") and k not in inputs}
    more = F.create_map(*[F.lit(x) for kv in extra.items() for x in kv]) if extra else None
    return df.select((F.map_concat(given, more) if more is not None else given).alias("value"))


def array_gather(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The list of all inputs of a group, in order, once for every output."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda x: x["v"]).alias("value"))


def reduce_gather(df: DataFrame, by: str, value: Column, function: str) -> DataFrame:
    """Reduce each input, then combine the reductions: partial and final aggregation."""
    reduce = REDUCERS[function]
    return df.groupBy(by).agg(reduce(value).alias("part")).agg(reduce("part").alias("value"))


def elementwise(df: DataFrame, array: str, function: str, *by: str) -> DataFrame:
    """Combine arrays of equal shape position by position (positions from 0)."""
    return df.select(*by, F.posexplode(array).alias("pos", "v")).groupBy(*by, "pos").agg(ELEMENTWISE[function](F.col("v").cast("double")).alias("value"))


def average(df: DataFrame, value: Column, method: str = "mean") -> DataFrame:
    """One scalar over the elements of all one-dimensional inputs."""
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method {method}")
    return df.agg((F.median(value) if method == "median" else F.avg(value)).alias("value"))


def average_elementwise(df: DataFrame, array: str, method: str = "mean", *by: str) -> DataFrame:
    """Rows of two-dimensional inputs averaged position by position."""
    v = F.col("v").cast("double")
    return df.select(*by, F.posexplode(array).alias("pos", "v")).groupBy(*by, "pos").agg((F.median(v) if method == "median" else F.avg(v)).alias("value"))


def pick_first(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_rn = 1").drop("_rn")


def pick_rest(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """All but the first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_rn > 1").drop("_rn")


def pick_array(array: Column) -> tuple[Column, Column]:
    """Head (null if empty) and tail of an array column."""
    return F.get(array, F.lit(0)), F.slice(array, 2, F.greatest(F.size(array), F.lit(0)))


def random_array(spark, size: int, low: int, high: int, integer: bool = True, seed: int = 42) -> DataFrame:
    """Random integers of [low, high), or floats (r + low) * high with r of [0, 1)."""
    r = F.rand(seed)
    value = (F.floor(r * (high - low)) + low).cast("long") if integer else (r + low) * high
    return spark.range(size).select(F.col("id").alias("idx"), value.alias("value"))


def list_thrash(spark, size: int, seed: int = 7) -> DataFrame:
    """`size` random numbers, `size` times: a load for benchmarks; rows and their sum."""
    draws = spark.range(size * size).select(F.rand(seed).alias("r"))
    return draws.agg(F.count("*").alias("n"), F.sum("r").alias("total"))
