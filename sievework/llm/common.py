"""Shared pieces of the corpus operators: table access, staging in the shared folder, array prefix sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space that separates words, as a Java regex class body.
SPACE = r"\x20\x09-\x0D"
_CHUNK = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sievework-")
        spark.sparkContext.setCheckpointDir(path)
        return jsc.getCheckpointDir().get()
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the files are then the cluster's to expire
        return


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_sums(lengths: Column) -> Column:
    """Exclusive running totals of an array of longs. Two levels, so that long arrays don't cost their square."""
    grow = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    zero = lambda: F.array(F.lit(0).cast("long"))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")),
        lambda c: F.aggregate(F.slice(lengths, c * _CHUNK + 1, _CHUNK), zero(), grow),
    )
    offset = lambda: F.aggregate(chunks, zero(), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(x, -1))))
    shifted = F.transform(
        F.arrays_zip(chunks.alias("c"), F.slice(offset(), 1, F.size(chunks)).alias("o")),
        lambda z: F.transform(F.slice(z["c"], 1, F.size(z["c"]) - 1), lambda v: v + z["o"])
    )
    return F.when(F.size(lengths) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<bigint>"))


#: Bytes of texts that go to Python in an Arrow batch, and that a slice of one holds.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 1 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python are bounded by bytes, since texts differ in size: unless the session sets another bound, it
    gets this one. Both the JVM and Python hold some batches a task."""
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def in_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _trim() -> Callable[[], None]:
    """Gives memory that was freed back to the system, where the C library can: workers live on between tasks, and what
    their allocators keep would count against the executor."""
    import ctypes

    import pyarrow as pa

    pool, trim = pa.default_memory_pool(), getattr(ctypes.CDLL(None), "malloc_trim", None)

    def run() -> None:
        pool.release_unused()
        if trim:
            trim(0)

    return run


def slices(batches: Iterator, text: str, rows: int = 1_000) -> Iterator:
    """Batches cut to bounded bytes of text, one row at least. What a slice has taken is given back after it."""
    import pyarrow.compute as pc

    trim = _trim()
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if i > start and (size + n > SLICE_BYTES or i - start >= rows):
                yield batch.slice(start, i - start)
                trim()
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
        trim()


#: Bits of the filter that stands before joins of whole texts: so many for an id, within these bounds (32 MB at most).
ID_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def packed(df: DataFrame, **others: Column) -> DataFrame:
    """df's columns in one struct, row, beside others, so that no name of df meets one of these."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in others.items()])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns out of row again; those in changed are given anew."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns])


def maybe_among(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """df with maybe: whether its key may be among ids. A bitmap of hashed ids, of bounded size, is broadcast, so no row moves."""
    size = min(MOST_BITS, max(LEAST_BITS, ID_BITS << ids.count().bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size)) + 1
    bits = ids.select(place(F.col(f"`{id_col}`")).alias("p")).select(F.bitmap_bucket_number("p").alias("at"), F.bitmap_bit_position("p").alias("b"))
    maps = bits.groupBy("at").agg(F.bitmap_construct_agg("b").alias("bits"))
    placed = df.withColumn("place", place(F.col(key))).withColumns({"at": F.bitmap_bucket_number("place"), "bit": F.bitmap_bit_position("place")})
    byte = F.conv(F.hex(F.substr("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0
    joined = placed.join(F.broadcast(maps), "at", "left").withColumn("maybe", F.coalesce(hit, F.lit(False)))
    return joined.select(*df.columns, "maybe")


def _listed(ids: DataFrame, id_col: str) -> DataFrame:
    return ids.select(F.col(f"`{id_col}`").alias("id")).distinct()


def among(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of df whose key is among ids (null equals null). Rows that the filter rules out aren't shuffled."""
    few = maybe_among(packed(df, key=F.col(f"`{key}`")), "key", ids, id_col).where("maybe")
    return unpacked(few.join(_listed(ids, id_col), F.col("key").eqNullSafe(F.col("id")), "left_semi"), df.columns)


def without(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of df whose key isn't among ids (null equals null). Rows that the filter rules out aren't shuffled."""
    marked = maybe_among(packed(df, key=F.col(f"`{key}`")), "key", ids, id_col)
    few = marked.where("maybe").join(_listed(ids, id_col), F.col("key").eqNullSafe(F.col("id")), "left_anti")
    return unpacked(marked.where("not maybe").unionAll(few), df.columns)


#: Keys of a table that are so frequent that they are broadcast: those of this share of all rows or more, so no more than its inverse.
FREQUENT = 1e-3


def with_table(df: DataFrame, table: DataFrame, on: str, n: str, total: int | None = None) -> DataFrame:
    """df with the columns of table but n, by a left join on a column; null keys find nothing. table has one row for each
    key, n how many rows of df the key has. Frequent keys are broadcast, so that no task gets all rows of one; others are
    shuffled. total: the sum of n, where it is known; else table, which should be a written one then, is looked at."""
    columns = [c for c in table.columns if c not in (on, n)]
    least = ((table.agg(F.sum(n)).first()[0] or 0) if total is None else total) * FREQUENT
    often, rarely = table.where(F.col(n) >= least).drop(n), table.where(F.col(n) < least).drop(n)
    if total is None and rarely.isEmpty():
        return df.join(F.broadcast(often), on, "left").select(*df.columns, *columns)
    marked = df.join(F.broadcast(often.withColumn("_often", F.lit(True))), on, "left")
    rest = marked.where("_often IS NULL").select(*df.columns).join(rarely, on, "left")
    return marked.where("_often").select(*df.columns, *columns).unionAll(rest.select(*df.columns, *columns))
