"""What the operators of this subpackage share: reading, cutting lineage, checked broadcasts, two-level running sums."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compliq.sources.documents import spread

#: A word: a run of anything but ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in local mode where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="compliq-")
        spark.sparkContext.setCheckpointDir(root)
    return str(root).rstrip("/")


#: Folders, inside the application's own, of the scratches that are open.
_SCRATCHES: list[str] = []


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs no recomputation. ``keep``: outside the innermost scratch."""
    spark = df.sparkSession
    path = "/".join([_own_folder(spark), *(_SCRATCHES[:-1] if keep else _SCRATCHES), uuid.uuid4().hex])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_by(df: DataFrame, col: str, size: int, per_bucket: int = 128 << 20) -> DataFrame:
    """As ``materialize``, bucketed by a column: joins on it then shuffle only the other side. ``size``: bytes, about; a bucket holds ``per_bucket``."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_bucket))
    name = f"compliq_{uuid.uuid4().hex}"
    df.repartition(n, col).write.bucketBy(n, col).option("path", "/".join([_own_folder(spark), *_SCRATCHES, name])).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved, so that the files are known when the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside, and not kept, is deleted at the end; nothing that reads it may be used after that."""
    _SCRATCHES.append("scratch-" + uuid.uuid4().hex)
    try:
        yield
    finally:
        delete(spark, "/".join([_own_folder(spark), *_SCRATCHES]))
        _SCRATCHES.pop()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/compliq/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes what this application has materialized. For when its results are written: they read those tables until then."""
    delete(spark, _own_folder(spark))


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow and cheap to count) with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves remainder 0; a null id counts as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def uniform(*cols: Column) -> Column:
    """A double in (0, 1) that depends on the values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def bins_for(rows: int) -> int:
    """Bins for two-level sums: both levels then hold about the square root of the rows."""
    return max(1, math.isqrt(max(rows, 1)))


def running_before(df: DataFrame, part: list[str], bin_col: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``part`` that come before, by ``bin_col`` and then ``order``.

    Sums by bin are added up first, then each bin by itself, so that no task sorts a whole part, however large.
    ``part`` and ``bin_col`` must not be null. ``df`` should be materialized: it is read twice.
    """
    valued = df.withColumn("_rb_value", value)
    sums = valued.groupBy(*part, bin_col).agg(F.sum("_rb_value").alias("_rb_sum"))
    upto = Window.partitionBy(*part).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*part, bin_col, F.coalesce(F.sum("_rb_sum").over(upto), F.lit(0)).alias("_rb_offset"))
    within = Window.partitionBy(*part, bin_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = valued.join(offsets, [*part, bin_col])
    before = F.coalesce(F.sum("_rb_value").over(within), F.lit(0)) + F.col("_rb_offset")
    return joined.withColumn(out, before).drop("_rb_value", "_rb_offset")


def slices(texts: list[str | bytes], rows: int = 256, length: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """(position of the first, texts): runs of at most ``rows`` texts and about ``length`` characters, so that few objects are made at a time."""
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and (k - at == rows or size + len(t) > length):
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def bits_of(hashes: DataFrame, col: str, bits: int) -> np.ndarray:
    """One bit for each value of the first ``bits`` bits of a long, set where a row has it, in longs of 64: of fixed size, built by an aggregate."""
    at = F.shiftrightunsigned(col, 64 - bits)
    rows = hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({col}, {64 - bits}) & 63 as int))").alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2^(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out
