"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of per-source or per-host rows up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: And no broadcast table is larger than this.
BROADCAST_BYTES = 64 << 20


def by_value(module: str) -> None:
    """Ship this module's functions inside the task, so executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over tasks."""
    return sys.__dict__.setdefault("_tissuequery_cache", {})


def worker_tables(owner: str) -> dict:
    """The tables that one kind of operator keeps in a Python worker; those of another kind make way for them."""
    cache = process_cache()
    if cache.get("owner") != owner:
        cache["owner"], cache["tables"] = owner, {}
    return cache["tables"]


class Shipped:
    """A value broadcast as bytes that hold its classes too, so workers need not have the package. A worker unpacks it
    once: values are named by the driver, and the last few are kept."""

    KEPT = 4

    def __init__(self, spark: SparkSession, value):
        self.name, self.box = uuid.uuid4().hex, spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        kept = process_cache().setdefault("shipped", {})
        if self.name not in kept:
            while len(kept) >= self.KEPT:
                kept.pop(next(iter(kept)))
            kept[self.name] = cloudpickle.loads(self.box.value)
        return kept[self.name]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder; only in
    plain local mode, where neither is set, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    made = process_cache().setdefault("shared", {})
    app = spark.sparkContext.applicationId
    if app not in made:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made[app] = tempfile.mkdtemp(prefix="tissuequery-")
        atexit.register(shutil.rmtree, made[app], True)
    return made[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is still there when the driver's Python ends, is deleted then."""
    path = f"{shared_dir(spark).rstrip('/')}/tissuequery/{uuid.uuid4().hex}/{name}"
    _FOLDERS.append((spark, path))
    return path


_FOLDERS: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of new_folder, on whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        try:
            if spark.sparkContext._jsc is None:
                break
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing to delete it with
            break


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def unspool(*tables: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for df in tables:
        path = df.__dict__.pop("_spooled", None)
        if path is not None:
            remove(df.sparkSession, path)
            _FOLDERS[:] = [f for f in _FOLDERS if f[1] != path]


def table_bytes(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes at most in memory) of a table, by one aggregation over it."""
    fixed, lengths = 8, []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            lengths.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType):
            lengths.append(8 * F.greatest(F.size(c), F.lit(0)))
        elif isinstance(f.dataType, T.StructType):
            fixed += 16 * len(f.dataType.fields)
        fixed += 16
    extra = sum(lengths[1:], lengths[0]).cast("long") if lengths else F.lit(0).cast("long")
    rows, more = df.agg(F.count("*"), F.coalesce(F.sum(extra), F.lit(0))).first()
    return rows, rows * fixed + more


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a (spooled) table if its counted rows and bytes are within the limits; otherwise leave the join to a
    shuffle."""
    rows, size = table_bytes(df)
    return F.broadcast(df) if rows <= limit and size <= most else df


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df spooled, with its rows' places (0, 1, ...) in the given order: a range-partitioned sort, then a count by
    partition, whose sums are over as many rows as there are partitions."""
    at = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    at = spool(at.withColumn("_part", F.shiftright("_mid", 33)), name)
    parts = at.groupBy("_part").agg(F.count("*").alias("_many"))
    before = F.coalesce(F.sum("_many").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", before.alias("_before"))
    return at.join(F.broadcast(parts), "_part").select(*df.columns, (F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("_at"))


def bound_batches(spark: SparkSession, mb: int = 3) -> None:
    """Arrow batches are bounded by bytes, so very long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def pieces(batch, names: list[str], step: int = 256):
    """The batch's columns as Python lists, some rows at a time."""
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield [part.column(n).to_pylist() for n in names]


def prefix_sums(df: DataFrame, group: list[str], block: str, values: list[str], span: int = 1024) -> DataFrame:
    """Add <value>_before: the sum over the group's smaller blocks.

    df has one row per group and block (a non-negative long). Two levels, so that no window holds more than about
    span rows or the number of blocks divided by span. Group columns must not be null.
    """
    coarse = df.withColumn("_coarse", F.floor(F.col(block) / span))
    over = Window.partitionBy(*group).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    base = coarse.groupBy(*group, "_coarse").agg(*(F.sum(v).alias(v) for v in values))
    base = base.select(*group, "_coarse", *(F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"_{v}_base") for v in values))
    inside = Window.partitionBy(*group, "_coarse").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    out = coarse.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_{v}_in") for v in values)).join(base, [*group, "_coarse"])
    return out.select(*df.columns, *((F.col(f"_{v}_base") + F.col(f"_{v}_in")).alias(f"{v}_before") for v in values))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
