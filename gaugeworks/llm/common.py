"""What the operators of this subpackage share: tables, scratch folders, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python function takes from an Arrow batch at a time.
SLICE_BYTES = 4 << 20
#: For functions that make several arrays of each byte: so few that these stay in a core's cache.
CACHE_BYTES = 1 << 18


#: Rows of an Arrow batch, where the session has Spark's default: texts may be long, and a batch is held whole.
BATCH_ROWS = 1_000


def modest(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where it is unset, a temporary one, and only
    if driver and executors are one machine: elsewhere that is an error, as each executor would write to a disk of its own."""
    try:
        base = spark.conf.get("spark.checkpoint.dir")
    except Exception as error:
        if "spark.checkpoint.dir" not in str(error):
            raise
        base = None
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not base and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        sc.setCheckpointDir(base)
    return base or own.get()


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Tables:
    """Tables of one operator's run in the shared folder, compressed, which go when it is done with them. What it returns mustn't read them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, scratch(spark, "tables"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.base)
        tidy(self.spark)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in the shared store, whatever store that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder, its lineage ended there; in ``files`` files at most. A checkpoint has a file for each partition,
    empty ones too, and a local store starts processes for each file, in which an executor's memory shows a second time until they run their program."""
    shared_folder(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint()


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle and checkpoint files of plans that nobody holds any longer; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def counts_before(counts: DataFrame, number: str, count: str, by: tuple[str, ...] = (), block: int = 1_000) -> DataFrame:
    """``counts`` with ``before``, the sum of ``count`` over the rows of smaller ``number`` among those with equal ``by``.

    Two levels: sums within blocks of ``block`` numbers, and of whole blocks, so that no task sorts all numbers.
    """
    rows = counts.withColumn("gw_block", F.floor(F.col(number) / block))
    within = Window.partitionBy(*by, "gw_block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy("gw_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = rows.groupBy(*by, "gw_block").agg(F.sum(count).alias("gw_sum"))
    blocks = blocks.select(*by, "gw_block", F.coalesce(F.sum("gw_sum").over(ahead), zero).alias("gw_ahead"))
    inner = rows.withColumn("gw_within", F.coalesce(F.sum(count).over(within), zero))
    return inner.join(blocks, [*by, "gw_block"]).withColumn("before", F.col("gw_ahead") + F.col("gw_within")).drop("gw_block", "gw_ahead", "gw_within")


def one_id_a_row(rows: DataFrame, tables: Tables) -> DataFrame:
    """rows(id, text) with ``key``, a number of the row in the order of id, then of the text's hash: the id itself where
    no id repeats. Rows of equal id and text are one; rows without an id go."""
    rows = rows.where("id is not null")
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return rows.withColumn("key", F.col("id"))
    rows = rows.withColumn("hash", F.xxhash64("text")).dropDuplicates(["id", "hash"])
    # numbers of a range partition follow those of the one before
    ordered = rows.select("id", "hash").repartitionByRange("id", "hash").sortWithinPartitions("id", "hash")
    numbers = tables.keep(ordered.withColumn("key", F.monotonically_increasing_id()))
    return rows.join(numbers, ["id", "hash"]).drop("hash")


def trim() -> None:
    """Gives memory that a finished task no longer uses back to the system: workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of whole rows, each of about ``most`` bytes in ``column`` or of one row."""
    col = batch.column(column)
    if batch.num_rows == 0:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def whole_row(names: list[str]) -> Column:
    """Columns of any names as one struct, so that they pass through steps that have names of their own."""
    return F.struct(*(F.col(f"`{n}`") for n in names))


def unpacked(names: list[str], row: str = "row", **instead: Column) -> list[Column]:
    """The columns that ``whole_row`` has put together, some replaced."""
    return [instead.get(n, F.col(row).getField(n)).alias(n) for n in names]


def schema_of(schema: str | StructType) -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return schema if isinstance(schema, StructType) else _parse_datatype_string(schema)


def per_row(df: DataFrame, schema: str | StructType, column: str, f: Callable[[dict[str, list]], Iterable[list]], most: int = SLICE_BYTES, done: Callable[[], None] | None = None) -> DataFrame:
    """Applies ``f`` to slices of ``df``, given as lists by column; ``f`` returns lists in the order of ``schema``.

    Memory is bounded by a slice and what ``f`` makes of it. What ``f`` keeps in the worker from one slice to the next, ``done`` lets go at the task's end.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    modest(df.sparkSession)
    target = to_arrow_schema(schema_of(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                lists = f({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(lists, target, strict=True)], schema=target)
                del lists
        if done:
            done()
        trim()

    return df.mapInArrow(run, schema)
