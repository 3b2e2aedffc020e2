"""Shared plumbing: lineage cuts in the cluster's shared folder, word rules, Arrow maps."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master without that setting gets a folder of its own (tests); a cluster
    without it is refused, since its nodes share no temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if (held := sc._jsc.sc().getCheckpointDir()).isDefined():
        return held.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagelake-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut, nothing is recomputed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._pagelake_path = path
    return back


def drop_written(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._pagelake_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch of whole texts that goes to Python: what a worker and its JVM hold at once.
TEXT_ROWS = 500


def text_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold at most TEXT_ROWS rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


def release() -> None:
    """Give memory that a worker has freed back to the system: workers outlive tasks, and what one stage's held would stay beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run):
    """A function over Arrow batches that releases memory once its task is over."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores: a single small file is a single task otherwise.

    A plan that shuffles stays as it is, since counting its partitions would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: At most so many keys can each hold more than one part in HOT_KEYS of all rows.
HOT_KEYS = 10_000


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row per key, whose column ``n`` tells how many of ``total`` rows hold the key.

    Keys with more than total / HOT_KEYS rows are fewer than HOT_KEYS by counting, so they are broadcast and their
    rows aren't shuffled; the other keys can't fill a partition. ``n`` isn't in the result.
    """
    limit = max(total // HOT_KEYS, 1_000)
    hot = F.broadcast(unique.where(F.col(n) > limit).drop(n))
    rest = unique.where(F.col(n) <= limit).drop(n)
    cold = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(rest, keys))


#: Bits of the filter that tells which rows may have to move: 4 MB at every size of the input.
FILTER_BITS = 1 << 25
_CHUNK_BITS = 1 << 15


def split_by(rows: DataFrame, key: str, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose BIGINT ``key`` may be among the keys of ``moved`` (one column), and those whose key surely isn't.

    A Bloom filter of FILTER_BITS bits, built by a bitmap aggregate and broadcast, decides in place: what it clears needs no shuffle.
    It never misses a key. When ``moved`` outgrows it, more rows count as maybe, and the caller's exact join takes them all.
    """
    k = F.col(moved.columns[0])
    spots = F.array(*(F.shiftrightunsigned(k, n).bitwiseAND(F.lit(FILTER_BITS - 1)) for n in (0, 32)))
    bits = moved.select(F.explode(spots).alias("_spot"))
    chunks = bits.groupBy(F.shiftright("_spot", 15).alias("chunk")).agg(F.bitmap_construct_agg(F.col("_spot") % _CHUNK_BITS).alias("bits"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for at, piece in chunks.collect():  # at most FILTER_BITS / 2^15 rows of 4 KB
        table[at * _CHUNK_BITS // 8 : (at + 1) * _CHUNK_BITS // 8] = np.frombuffer(piece, np.uint8)
    shipped = rows.sparkSession.sparkContext.broadcast(table.tobytes())

    @F.arrow_udf("boolean")
    def may(keys: pa.Array) -> pa.Array:
        bits, x = np.frombuffer(shipped.value, np.uint8), keys.to_numpy(zero_copy_only=False).view(np.uint64)
        hit = np.ones(len(x), bool)
        for n in (0, 32):
            spot = (x >> np.uint64(n)) & np.uint64(FILTER_BITS - 1)
            hit &= (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return pa.array(hit)

    return rows.where(may(F.col(key))), rows.where(~may(F.col(key)))


def row_key(doc_id: Column | str, mark: Column | str) -> Column:
    """A hash of a document's id and its text's hash."""
    return F.xxhash64(doc_id, mark)


def word_count(text: Column) -> Column:
    """Words of a text as BIGINT, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
