"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are packed into blocks of rows; every candidate block is scored against every query block of its
length (a stated query set against all rows) by matrix products, exact in double precision. A pass counts every score inside a query's range in
a histogram of ``BINS`` bins: the first range holds all scores there can be, by Cauchy and Schwarz. A task adds up the histograms of all its candidate
blocks and sends them from the top down to where it alone has counted k, since no lower bin can hold the kth score. The
summed histograms tell which bin holds a query's kth score, and the next pass counts the scores of that bin in finer ones, until a bin is a single integer. The
last pass keeps what lies above the kth score and, of the ties at it, the k smallest ids of each block.

A task is a cell of a grid: one query block, whose histograms it holds, and one of several shares of the candidate blocks, which
it streams. So a query block is copied to few shares and a candidate block once for each ``QUERY_BLOCK`` queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, text_batches, written

K = 10
EVERY = 100
SCALE = 1024
BINS = 2048
QUERY_BLOCK, ROW_BLOCK, AT_ONCE = 16_384, 1_024, 256
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); vectors that are null or hold null or non-finite components go."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("double"))
    return vectors.where(F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long"), whole.alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows as blocks (block, d, ids, data) of about ``size`` vectors of one length; data in single precision where that is exact."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def block(d):
            ids, data = held.pop(d)
            x = np.concatenate(data)
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            if (short == x).all():
                x = short
            return pa.RecordBatch.from_arrays(
                [pa.array([d]), pa.array([np.concatenate(ids).tobytes()]), pa.array([x.tobytes()])], ["d", "ids", "data"]
            )

        for b in batches:
            ids, v = b.column(0).to_numpy(), b.column(1)
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy()
            ends = np.cumsum(sizes)
            for d in np.unique(sizes):
                of = np.flatnonzero(sizes == d)
                rows = flat[(ends[of, None] - d + np.arange(d)).ravel()]
                for a in range(0, len(of), size):
                    part = held.setdefault(int(d), ([], []))
                    part[0].append(ids[of[a : a + size]])
                    part[1].append(rows[a * d : (a + size) * d])
                    if sum(map(len, part[0])) >= size:
                        yield block(int(d))
        for d in list(held):
            yield block(d)

    packed = rows.select("vec_id", "v").mapInArrow(run, "d long, ids binary, data binary")
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _vectors(ids: bytes, data: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(data) == 4 * d * len(ids) else np.float64
    return ids, np.frombuffer(data, kind).astype(np.float64).reshape(len(ids), d)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (BIGINT) of each query's k best candidates by inner product.

    A query is never its own candidate (rows that share its vec_id are left out); ties go to the smaller
    vec_id; with fewer candidates all are returned. Vectors that are null or hold null or non-finite
    components, and rows without a vec_id, take no part; vectors of another length than the query's aren't
    its candidates; a vec_id that repeats is a candidate as often as it occurs (as a query it counts
    once, by its largest vector in array order); empty tables give an empty result; other columns are ignored.
    Scores beyond 2^53 aren't exact in double precision: vectors that long raise a ValueError.
    """
    spark = vectors.sparkSession
    text_batches(spark)
    rows = quantised(vectors, scale).where("vec_id is not null")
    asked = written(quantised(queries, scale).where("vec_id is not null").groupBy("vec_id").agg(F.max("v").alias("v")), "asked")
    c, q = _packed(rows, ROW_BLOCK), _packed(asked, QUERY_BLOCK)

    # a first range from the norms, by Cauchy and Schwarz
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    most = rows.agg(F.max(norm)).first()[0] or 0.0
    reach = F.ceil(norm * most + 1).cast("double")
    state = written(
        asked.select(
            F.col("vec_id").alias("query_id"), (-reach).alias("low"), (2 * reach).alias("width"),
            F.lit(0).cast("long").alias("above"),
        ),
        "ranges",
    )
    drop_written(asked)
    while True:
        # the range of a query: [low, low + width); ``above`` scores lie beyond it
        widest = state.agg(F.max("width")).first()[0]
        if widest is None or widest <= 1:
            break
        if widest >= EXACT:
            raise ValueError("vectors are too long for exact scores")
        counts = _cells(q, c, state).mapInArrow(_histogram(k), "query_id long, bin long, n long, step double")
        sums = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"), F.max("step").alias("step"))
        down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
        run = sums.withColumn("upto", F.sum("n").over(down)).join(state, "query_id")
        run = run.withColumn("upto", F.col("upto") + F.col("above"))
        # the bin in which the kth score lies; with fewer than k scores, the lowest that holds one
        last = run.groupBy("query_id").agg(
            F.max(F.when(F.col("upto") >= k, F.struct("bin", "upto", "n", "low", "step"))).alias("hit"),
            F.min(F.struct("bin", "upto", "n", "low", "step")).alias("end"),
        ).select("query_id", F.coalesce("hit", "end").alias("x"))
        finer = written(
            last.select(
                "query_id", (F.col("x.low") + F.col("x.bin") * F.col("x.step")).alias("low"),
                F.col("x.step").alias("width"), (F.col("x.upto") - F.col("x.n")).alias("above"),
            ),
            "ranges",
        )
        drop_written(state)
        state = finer
    found = _cells(q, c, state).mapInArrow(_chosen(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _cells(q: DataFrame, c: DataFrame, state: DataFrame) -> DataFrame:
    """(cell, share, d, ids, data, ranges): in each cell a query block, with its queries' ranges, then a share of the row blocks of its length."""
    member = _unpacked(q.select("block", "ids"))
    mine = member.join(state, "query_id").groupBy("block").agg(
        F.collect_list(F.struct("query_id", "low", "width")).alias("ranges")  # as bounded as the block
    )
    asked = q.join(mine, "block").withColumnRenamed("block", "cell")
    spark = q.sparkSession
    shares = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, q.count())))
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    # one row for every QUERY_BLOCK queries
    cells = q.select(F.col("block").alias("cell"), F.col("d").alias("_d"))
    dealt = c.join(cells, F.col("d") == F.col("_d")).withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)))
    none = F.lit(None).cast(mine.schema["ranges"].dataType)
    names = ["cell", "share", "d", "ids", "data", "ranges"]
    both = asked.select(*names).unionByName(dealt.withColumn("ranges", none).select(*names))
    order = F.col("ranges").isNull()
    return both.repartition("cell", "share").sortWithinPartitions("cell", "share", order)


def _unpacked(blocks: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], ["block", "query_id"])

    return blocks.mapInArrow(run, "block long, query_id long")


class _Cell:
    """A query block with its ranges; queries without a range are left out."""

    def __init__(self, row):
        ids, x = _vectors(row["ids"], row["data"], row["d"])
        of = {r["query_id"]: (r["low"], r["width"]) for r in row["ranges"]}
        mine = np.array([i in of for i in ids.tolist()], bool)
        self.ids, self.x = ids[mine], x[mine]
        ranges = np.array([of[i] for i in self.ids.tolist()]).reshape(-1, 2)
        self.low, self.width = ranges[:, 0], ranges[:, 1]
        self.step = np.maximum(1.0, np.ceil(self.width / BINS))
        self.counts = None

    def scores(self, row):
        """Yields (first query, candidate ids, scores) for AT_ONCE queries at a time; a query's own rows score minus infinity."""
        cids, x = _vectors(row["ids"], row["data"], row["d"])
        for a in range(0, len(self.ids), AT_ONCE):
            s = self.x[a : a + AT_ONCE] @ x.T
            s[self.ids[a : a + AT_ONCE, None] == cids[None, :]] = -np.inf
            yield a, cids, s

    def count(self, row):
        if self.counts is None:
            self.counts = np.zeros((len(self.ids), BINS), np.int32)
        for a, _, s in self.scores(row):
            z = a + len(s)
            inside = (s >= self.low[a:z, None]) & (s < (self.low + self.width)[a:z, None])
            which, at = np.nonzero(inside)
            bins = ((s[which, at] - self.low[a + which]) / self.step[a + which]).astype(np.int64)
            self.counts[a:z] += np.bincount(which * BINS + bins, minlength=len(s) * BINS).reshape(len(s), BINS)

    def sent(self, k: int):
        """Yields the histograms as rows, down to the bin at which k are counted."""
        for a in range(0, 0 if self.counts is None else len(self.ids), AT_ONCE):
            counts = self.counts[a : a + AT_ONCE].astype(np.int64)
            down = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
            which, bins = np.nonzero((counts > 0) & (down - counts < k))
            cols = [self.ids[a + which], bins, counts[which, bins], self.step[a + which]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["query_id", "bin", "n", "step"])


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _histogram(k: int):
    def run(batches):
        cell = None
        for row in _rows(batches):
            if row["ranges"] is None:
                if cell is not None and at == (row["cell"], row["share"]):
                    cell.count(row)
                continue
            if cell is not None:
                yield from cell.sent(k)
            cell, at = _Cell(row), (row["cell"], row["share"])
        if cell is not None:
            yield from cell.sent(k)

    return run


def _chosen(k: int):
    def run(batches):
        cell = None
        for row in _rows(batches):
            if row["ranges"] is not None:
                cell, at = _Cell(row), (row["cell"], row["share"])
            elif cell is not None and at == (row["cell"], row["share"]):
                for a, cids, s in cell.scores(row):
                    which, col = np.nonzero((s >= cell.low[a : a + len(s), None]) & np.isfinite(s))
                    score = s[which, col].astype(np.int64)
                    order = np.lexsort((cids[col], -score, which))
                    which, col, score = which[order], col[order], score[order]
                    turn = np.arange(len(which)) - np.searchsorted(which, which)
                    keep = turn < k
                    cols = [cell.ids[a + which[keep]], cids[col[keep]], score[keep]]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["query_id", "vec_id", "score"])

    return run


def query(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
