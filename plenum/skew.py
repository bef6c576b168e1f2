"""Helpers that keep a plan whole when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A table is broadcast only when a count and its bytes prove it small.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast after counting at most ``max_rows + 1`` rows and the bytes they hold; else leave the join to AQE."""
    held = F.sum(F.length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), held).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


ROWS_PER_TASK = 500_000


def pieces(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Into how many pieces so many rows are dealt, so that what one task sorts stays the same at any size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over all cores before work that costs much per row.

    A file is read by as many tasks as it has row groups, and narrow rows by the million may lie in one. The number
    of pieces is fixed, because adaptive execution would join pieces of few bytes whatever their work.
    """
    spark = df.sparkSession
    return df.repartition(max(pieces(spark, 0), 2 * spark.sparkContext.defaultParallelism), *keys)


def few(df: DataFrame, what: str, max_rows: int = 10_000) -> DataFrame:
    """A list a person owns (rules, required wording): refused, not truncated, when it is longer."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} {what}: this is data, not a profile")
    return df


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running sums and last-non-null values per key, without one task per key.

    ``chunk`` is a monotone function of the first ``order`` column that cuts a key into bounded
    pieces. Windows run inside ``(keys, chunk)``; only one row per chunk is carried across, so a
    key with a third of the table still spreads over as many tasks as it has chunks.
    """
    sums, lasts = sums or {}, lasts or {}
    cut = [*keys, "_chunk"]
    work = df.withColumn("_chunk", chunk)
    for name, col in {**sums, **lasts}.items():
        work = work.withColumn(f"_in_{name}", col)
    if lasts:
        work = work.withColumn("_ord", F.struct(*order))
    totals = work.groupBy(*cut).agg(
        *[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col("_ord"))).alias(f"_tot_{n}")
            for n in lasts
        ],
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *cut,
        *[F.coalesce(F.sum(f"_tot_{n}").over(before), F.lit(0)).alias(f"_pre_{n}") for n in sums],
        *[F.last(f"_tot_{n}", ignorenulls=True).over(before).alias(f"_pre_{n}") for n in lasts],
    )
    here = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = work.select(
        "*",
        *[F.sum(f"_in_{n}").over(here).alias(f"_run_{n}") for n in sums],
        *[F.last(f"_in_{n}", ignorenulls=True).over(here).alias(f"_run_{n}") for n in lasts],
    )
    # null-safe on every key: a null key is a key like any other
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in cut]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    joined = local.alias("l").join(carried.alias("c"), on, "left")
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"_run_{n}") + F.col(f"_pre_{n}")).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_run_{n}"), F.col(f"_pre_{n}")).alias(n) for n in lasts],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based row number (bigint) per key in ``order``, one way at every size.

    The rows are range-partitioned on (keys, order) and written, so that the cut stays put if an executor
    is lost; they are numbered inside each piece and shifted by the sizes of the pieces before it. A null
    key is a key like any other.
    """
    ranged = settle(df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    here = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order))
    on = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranged.withColumn("_rn", here).join(shift, on).withColumn(name, (F.col("_rn") + F.col("_shift")).cast("bigint")).select(*df.columns, name)


_SETTLED: list[str] = []


def settle(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write an intermediate that several branches read, and continue from the written table.

    It lands in the session's checkpoint folder (shared by all executors), so a lost executor costs
    no recomputation, later reads prune columns, and the plan above stays small. ``release`` removes it.
    ``rows_per_file`` bounds what a scan holds at once where rows are large.
    """
    from uuid import uuid4

    from plenum.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/plenum-{uuid4().hex}"
    _SETTLED.append(path)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back(df: DataFrame) -> None:
    """Remove one written intermediate ahead of ``release``; what was made from it must have been written."""
    spark = df.sparkSession
    conf, names = spark.sparkContext._jsc.hadoopConfiguration(), {file.split("/")[-2] for file in df.inputFiles()}
    for place in [p for p in _SETTLED if p.rsplit("/", 1)[1] in names]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)
        _SETTLED.remove(place)


def release(spark: SparkSession) -> int:
    """Remove every written intermediate of this process; call it once results that rest on them are written."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _SETTLED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SETTLED.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
