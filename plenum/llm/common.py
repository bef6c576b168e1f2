"""What several operators share: reading, row keys, written intermediates, folds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.skew import give_back, settle, small

__all__ = ["documents", "fresh", "give_back", "held_out", "join_facts", "path_exists", "scratch_path", "settle", "shuffle_partitions", "sorted_ids", "utf8_column", "rounds_for", "with_rows"]

# The six ASCII white-space bytes of the contracts: blank, tab to carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _scans_files(df: DataFrame) -> bool:
    """Whether ``df`` is a file scan, at most filtered and with its columns computed: then its rows have places."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def with_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a long ``name`` that tells its rows apart and is the same in every scan, however files are split.

    The number is a row's place: its file, in the order of paths, and its index there. What is not a scan of Parquet
    files is written once and numbered as written; numbers given in passing would change from scan to scan.
    """
    spark = df.sparkSession
    place = lambda some: some.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
    path, index = fresh(df, "file_path"), fresh(df, "row_index")
    try:
        placed = place(df if _scans_files(df) else settle(df))
    except AnalysisException:  # files of a kind whose rows have no index
        placed = place(settle(df))
    files = sorted(row[0] for row in placed.select(path).distinct().collect())
    # as an Arrow table: a list of Python rows would keep a second set of Python workers alive on every executor
    numbers = spark.createDataFrame(pa.table({name: pa.array(range(len(files)), pa.int64()), path: pa.array(files, pa.string())}))
    joined = placed.join(small(numbers), path)
    # never null, and said to be so: joins by it need no filter of their own and share one exchange of the rows
    number = F.coalesce(F.shiftleft(F.col(name), 36).bitwiseOR(F.col(index)), F.lit(-1).cast("long"))
    return joined.select(*df.columns, number.alias(name))


def held_out(doc_id: Column) -> Column:
    """The fold no model may learn from; a null id is in the learning part of no model and held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Written table of ``df`` with integers that follow the sort order of ``keys``.

    A range partitioning and a sort inside each partition: no task sees more than its range, and the
    numbers are fixed once written.
    """
    return settle(df.orderBy(*keys).withColumn(name, F.monotonically_increasing_id()))


def utf8_column(column) -> tuple[bytes, np.ndarray]:
    """Concatenated bytes and offsets (n + 1) of an Arrow string or binary column; null counts as empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    column = column.fill_null(b"")
    if column.offset or len(column) == 0:
        column = pa.concat_arrays([column, pa.array([], kind)]) if len(column) else pa.array([], kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1) if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = data.to_pybytes()[at[0]: at[-1]] if data is not None else b""
    return raw, at - at[0]


def rounds_for(n: int) -> int:
    """How often a list of ``n`` must be halved until one is left."""
    return max(0, math.ceil(math.log2(max(1, n))))


HOT_SHARE = 1000


def join_facts(rows: DataFrame, facts: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``facts`` (one row per ``key``) where no key may be null and one key may hold most rows.

    ``held(key, rows_held)`` says how many rows each key has. Keys with more than a thousandth of all rows are fewer
    than a thousand, whatever the input: their facts are broadcast. The rest is joined by key.
    """
    total = held.agg(F.sum("rows_held")).first()[0] or 0
    hot = settle(facts.join(held.where(F.col("rows_held") * HOT_SHARE > total).select(key), key))
    spread = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts, key)
    return spread.unionByName(rows.join(F.broadcast(hot), key))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names."""
    from uuid import uuid4

    from plenum.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
