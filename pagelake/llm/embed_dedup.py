"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

Equal vectors are first reduced to one class. A filter is the cap around a code word; code words are
all concatenations of one word from each of two random codes on the halves of a randomly rotated space
(``TURNS`` independent ones), so a vector's list of filters is decoded from two short inner-product lists, without visiting all code words.
Into a filter goes a class's sketch, its components in 8 bits with the error that makes, not its vector. A cosine of sketches that lies
further from the threshold than their errors allow decides a pair; where it doesn't, the two memberships (not the pair) come back with exact
vectors, and double precision decides. A pair counts in the first filter
it shares, so nothing is found twice and no pair table is kept: a filter yields each member's number of links
and its local root. Code sizes follow from the number of classes and the threshold: the cap's measure keeps
filters at about ``BUCKET`` unrelated members, and ``SHARED`` filters are expected to hold both ends of a
pair that lies exactly at the threshold (tests measure how many such pairs meet; closer ones meet more surely).
A filter with more than ``CHUNK`` members is split by hash into chunks, compared two by two.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_written, join_unique, written

THRESHOLD = 0.9
BUCKET = 96
SHARED = 10.0
TURNS = 6
CHUNK = 2_048
SEED = 20_240


class Code:
    """Two random codes for dimension d, sized for n classes."""

    def __init__(self, d: int, n: int, threshold: float):
        self.d = max(8, d)
        self.cap, both = self._measures(min(0.02, BUCKET / max(n, 1)), threshold)
        self.words = max(2, int(np.ceil(np.sqrt(SHARED / both / TURNS))))
        rng, half = np.random.default_rng(SEED + d), self.d // 2
        self.codes = [
            (
                np.linalg.qr(rng.standard_normal((self.d, self.d)))[0],
                self._unit(rng.standard_normal((self.words, half))),
                self._unit(rng.standard_normal((self.words, self.d - half))),
            )
            for _ in range(TURNS)
        ]

    @staticmethod
    def _unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def _measures(self, p: float, threshold: float) -> tuple[float, float]:
        """Height of the cap of measure p, and the measure of two such caps' meeting seen from a pair at the threshold."""
        u = np.linspace(-1, 1, 20_001)
        density = (1 - u * u) ** ((self.d - 3) / 2)
        tail = np.cumsum(density[::-1])[::-1] / density.sum()
        cap = float(u[np.searchsorted(-tail, -p)])
        inner = (1 - u * u) ** ((self.d - 4) / 2)
        inner_tail = np.append(np.cumsum(inner[::-1])[::-1] / inner.sum(), 0.0)
        above = u >= cap
        need = (cap - threshold * u[above]) / np.sqrt((1 - threshold**2) * np.maximum(1 - u[above] ** 2, 1e-12))
        return cap, float((density[above] * inner_tail[np.searchsorted(u, need)]).sum() / density.sum())

    def filters(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filters of unit vectors, sorted for each, one vector after another, and where each vector's start (and the last's end)."""
        if x.shape[1] < self.d:
            x = np.pad(x, ((0, 0), (0, self.d - x.shape[1])))
        need = 2 * self.cap  # halves have length 1, not 1 / sqrt 2
        w, every, half, found = self.words, TURNS * self.words**2, self.d // 2, []
        vector = np.arange(len(x))
        for t, (turn, left, right) in enumerate(self.codes):
            y = x @ turn
            a, b = self._unit(y[:, :half]) @ left.T, self._unit(y[:, half:]) @ right.T
            order = np.argsort(-b, axis=1)
            down = np.take_along_axis(b, order, axis=1)
            # of each left word that some right word can complete, how many do: all lists searched as one ascending sequence
            k, i = np.nonzero(a >= need - down[:, :1])
            least = need - a[k, i]
            n = np.searchsorted((4 * vector[:, None] - down).ravel(), 4 * k - least, "right") - k * w
            n = np.where(n > 0, n - (down[k, np.maximum(n - 1, 0)] < least), n)
            n = np.where(n < w, n + (down[k, np.minimum(n, w - 1)] >= least), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            k, i = np.repeat(k, n), np.repeat(i, n)
            found.append(k * every + (t * w + i) * w + order[k, at])
            # the best filter of each code, whatever its height: no vector is left without
            found.append(vector * every + (t * w + a.argmax(axis=1)) * w + order[:, 0])
        key = np.unique(np.concatenate(found))
        return key % every, np.searchsorted(key, np.arange(len(x) + 1) * every)


@lru_cache(8)
def code(d: int, n: int, threshold: float) -> Code:
    return Code(d, n, threshold)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sketches(x: np.ndarray) -> np.ndarray:
    """A record for each unit vector: scale, length of the error, components in 8 bits."""
    out = np.zeros(len(x), _sketch_type(x.shape[1]))
    out["scale"] = np.abs(x).max(axis=1) / 127
    q = np.round(x / out["scale"].astype(np.float64)[:, None])
    out["v"] = np.clip(q, -127, 127)
    out["error"] = np.linalg.norm(x - out["v"] * out["scale"].astype(np.float64)[:, None], axis=1) + 1e-6
    return out


def _sketch_type(d: int) -> np.dtype:
    return np.dtype([("scale", "<f4"), ("error", "<f4"), ("v", "i1", (d,))])


def _vectors(raw, start: int, n: int, d: int, size: int) -> np.ndarray:
    """n rows of d components from a buffer whose rows take ``size`` bytes."""
    return np.frombuffer(raw, np.float32 if size == 4 * d else np.float64, n * d, start).reshape(n, d)


def _kind(n: int) -> str:
    """The type of a filter's number among n classes."""
    return "<u4" if n < 100_000_000 else "<u8"


def _filtered(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, n, d, data, sketch, filters) of each class; data holds its components, in single precision where that is exact."""
    kind = _kind(n)

    def run(batches):
        for b in batches:
            node, count, v = b.column(0), b.column(1), b.column(2)
            sizes = np.diff(v.offsets.to_numpy())
            flat, ends = v.flatten().to_numpy().astype(np.float64), np.cumsum(sizes)
            for d in np.unique(sizes):
                of = np.flatnonzero(sizes == d)
                for a in range(0, len(of), 1024):
                    some = of[a : a + 1024]
                    raw = flat[(ends[some, None] - d + np.arange(d))]
                    x = _units(raw)
                    with np.errstate(over="ignore"):
                        short = raw.astype(np.float32)
                    exact = (short == raw).all(axis=1)
                    data = [(r if e else w).tobytes() for r, w, e in zip(short, raw, exact)]
                    take = pa.array(some)
                    found, edge = code(int(d), n, threshold).filters(x)
                    found = found.astype(kind)
                    yield pa.RecordBatch.from_arrays(
                        [
                            node.take(take), count.take(take), pa.array(np.full(len(some), d, np.int32)), pa.array(data),
                            pa.array([r.tobytes() for r in _sketches(x)]), pa.array([found[f:z].tobytes() for f, z in zip(edge, edge[1:])]),
                        ],
                        ["node", "n", "d", "data", "sketch", "filters"],
                    )

    schema = "node long, n long, d int, data binary, sketch binary, filters binary"
    return classes.select("node", "n", F.col("_v").alias("v")).mapInArrow(run, schema)


def _filters_of(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The filters of all rows, and where each row's start (and the last row's end)."""
    at, raw = _offsets(column), column.buffers()[2]
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].view(kind) if raw is not None else np.zeros(0, kind)
    return flat, (at - at[0]) // size


def _members(listed: DataFrame, kind: str) -> DataFrame:
    """(d, f, node): a row for each filter of a class; map-only."""

    def run(batches):
        for b in batches:
            f, at = _filters_of(b.column(2), kind)
            node, d, n = b.column(0).to_numpy(), b.column(1).to_numpy(), np.diff(at)
            cols = [np.repeat(d, n), f.astype(np.int64), np.repeat(node, n)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["d", "f", "node"])

    return listed.select("node", "d", "filters").mapInArrow(run, "d int, f long, node long")


def _exploded(listed: DataFrame, kind: str) -> DataFrame:
    """(d, f, node, n, sketch, filters): a class's sketch in each of its filters; map-only."""

    def run(batches):
        for b in batches:
            f, at = _filters_of(b.column("filters"), kind)
            row = pa.array(np.repeat(np.arange(b.num_rows), np.diff(at)))
            for a in range(0, len(f), 20_000):
                some = row[a : a + 20_000]
                mine = [b.column(c).take(some) for c in ("d", "node", "n", "sketch", "filters")]
                yield pa.RecordBatch.from_arrays([mine[0], pa.array(f[a : a + 20_000].astype(np.int64)), *mine[1:]], ["d", "f", "node", "n", "sketch", "filters"])

    return listed.select("d", "node", "n", "sketch", "filters").mapInArrow(run, "d int, f long, node long, n long, sketch binary, filters binary")


def _offsets(column) -> np.ndarray:
    """Where the values of each row of a string-like or list column start, and the last end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_list(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _first_shared(lists: np.ndarray, i: np.ndarray, j: np.ndarray, f: int) -> np.ndarray:
    """Whether f is the least filter that rows i and j share; lists: sorted filters, padded by -1."""
    ok = np.ones(len(i), bool)
    for k in range(lists.shape[1]):
        mine = lists[i, k]
        on = np.flatnonzero(ok & (mine >= 0) & (mine < f))
        if not len(on):
            break
        ok[on] = ~(lists[j[on]] == mine[on, None]).any(axis=1)
    return ok


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(threshold: float, kind: str, exact: bool):
    """Compares the members of each (d, f, p, q) group.

    By sketches it gives (node, links, root) for every member with sure links, and (node, n, d, f, p, q, part) for every member of a pair
    left open; with ``exact``, among those and their vectors, the links of pairs that sketches leave open.
    """

    def group(key, node, n, part, sketch, x, lists):
        d, f, p, q = (int(k) for k in key)
        own = np.flatnonzero(part == p)
        rest = own if p == q else np.flatnonzero(part == q)
        s = sketch["v"] * sketch["scale"][:, None]
        error = sketch["error"]
        pi, pj, open_ = [own[:0]], [own[:0]], np.zeros(len(node), bool)
        for a in range(0, len(own), 512):
            mine = own[a : a + 512]
            near = s[mine] @ s[rest].T - threshold
            room = error[mine, None] + error[None, rest] + 3 * error[mine, None] * error[None, rest] + 1e-5
            for sure in (False,) if exact else (True, False):
                i, j = np.nonzero(near >= room if sure else np.abs(near) < room)
                i, j = mine[i], rest[j]
                if p == q:
                    i, j = i[i < j], j[i < j]
                keep = _first_shared(lists, i, j, f)
                i, j = i[keep], j[keep]
                if exact:
                    keep = np.einsum("ij,ij->i", x[i], x[j]) >= threshold if len(i) < 4096 else _close(x, i, j, threshold)
                    i, j = i[keep], j[keep]
                if sure or exact:
                    pi.append(i)
                    pj.append(j)
                else:
                    open_[i] = open_[j] = True
        i, j = np.concatenate(pi), np.concatenate(pj)
        if len(i):
            links = np.bincount(i, n[j], len(node)) + np.bincount(j, n[i], len(node))
            got = np.flatnonzero(links)
            yield _linked(node=node[got], links=links[got].astype(np.int64), root=node[_roots(len(node), i, j)[got]])
        if len(got := np.flatnonzero(open_)):
            same = {c: np.full(len(got), v) for c, v in zip(("d", "f", "p", "q"), (d, f, p, q))}
            yield _linked(node=node[got], n=n[got], part=part[got], **same)

    def run(batches):
        held = None

        def found(t):
            keys = np.stack([t.column(c).to_numpy() for c in ("d", "f", "p", "q")], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
            node, n, part = (t.column(c).to_numpy() for c in ("node", "n", "part"))
            data, filters = t.column("data" if exact else "sketch").combine_chunks(), t.column("filters").combine_chunks()
            starts, raw = _offsets(data), data.buffers()[2]
            flat, at = _filters_of(filters, kind)
            for a, z in zip(cuts, cuts[1:]):
                if z - a > 1:
                    d = int(keys[a][0])
                    if exact:
                        x = _units(np.concatenate([_vectors(raw, starts[k], 1, d, starts[k + 1] - starts[k]).astype(np.float64) for k in range(a, z)]))
                        sketch = _sketches(x)
                    else:
                        x, sketch = None, np.frombuffer(raw, _sketch_type(d), z - a, starts[a])
                    sizes = np.diff(at[a : z + 1])
                    lists = np.full((z - a, sizes.max()), -1, np.int64)
                    lists[np.arange(lists.shape[1]) < sizes[:, None]] = flat[at[a] : at[z]]
                    yield from group(keys[a], node[a:z], n[a:z], part[a:z], sketch, x, lists)

        for batch in batches:
            t = pa.Table.from_batches(([] if held is None else held.to_batches()) + [batch])
            if not len(t):
                continue
            last = np.ones(len(t), bool)
            for c in ("d", "f", "p", "q"):
                v = t.column(c).to_numpy()
                last &= v == v[-1]
            cut = len(t) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = t.slice(cut)
            if cut:
                yield from found(t.slice(0, cut).combine_chunks())
        if held is not None and len(held):
            yield from found(held.combine_chunks())

    return run


def _close(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65_536]], x[j[a : a + 65_536]]) >= threshold for a in range(0, len(i), 65_536)])


_FOUND = ("node", "links", "root", "n", "d", "f", "p", "q", "part")


def _linked(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns["node"])
    arrays = [pa.array(columns[c].astype(np.int64)) if c in columns else pa.nulls(n, pa.int64()) for c in _FOUND]
    return pa.RecordBatch.from_arrays(arrays, list(_FOUND))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; links are pairs of rows with cosine >= threshold.

    Copies of a vector link with one another and share the links of their class. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, as do vectors of different length;
    such a row is its own component. Rows without a vec_id take part, but give no component its name and are never
    kept; repeated rows are copies; an empty table gives an empty result; other columns are ignored.
    """
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("_e"), F.coalesce(fine, F.lit(False)).alias("_ok"))
    good = base.where("_ok").withColumn("_v", F.transform("_e", lambda x: x.cast("double")))
    # equal vectors meet by a hash of 128 bits, so vectors are shuffled once and never compared as keys
    keys = [F.xxhash64("_v").alias("h"), F.xxhash64(F.lit(SEED), "_v").alias("g")]
    hashed = written(good.select("vec_id", *keys), "hashed")
    groups = good.select("vec_id", "_e", *keys).groupBy("h", "g").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("_e").alias("_v"))
    classes = written(groups.withColumn("node", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    kind, listed = _kind(total), written(_filtered(classes, total, threshold), "filters")
    small = classes.drop("_v")
    sizes = _members(listed, kind).groupBy("d", "f").count()
    split = written(
        sizes.where(F.col("count") > CHUNK).select(
            F.col("d").alias("_d"), F.col("f").alias("_f"), F.ceil(F.col("count") / CHUNK).alias("_k")
        ),
        "split",
    )
    member = _exploded(listed, kind)
    if not split.isEmpty():
        member = member.join(split, (F.col("d") == F.col("_d")) & (F.col("f") == F.col("_f")), "left")
        k = F.coalesce("_k", F.lit(1))
        member = member.withColumn("part", F.pmod(F.xxhash64("node"), k)).withColumn(
            "_o", F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
        )
        member = member.withColumn("p", F.least("part", "_o")).withColumn("q", F.greatest("part", "_o"))
    else:
        zero = F.lit(0).cast("long")
        member = member.withColumns({"part": zero, "p": zero, "q": zero})
    key = ["f", "d", "p", "q"]
    found = _grouped(member.select(*key, "part", "node", "n", "sketch", "filters"), key, _compare(threshold, kind, False))
    sure = written(found, "links")
    again = sure.where("links is null").select(*key, "part", "node", "n")
    exact = again.join(listed.select("node", "data", "filters"), "node").select(*key, "part", "node", "n", "data", "filters")
    checked = written(_grouped(exact, key, _compare(threshold, kind, True)), "links")
    found = sure.where("links is not null").unionByName(checked).select("node", "links", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "_node")
    known = small.join(links, "node", "left").join(roots, F.col("node") == F.col("_node"), "left")
    known = written(known.select("h", "g", "n", "low", "links", F.coalesce("root", "node").alias("root")), "known")
    names = known.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("size"))
    named = join_unique(known, names, ["root"], "size", known.count())
    facts = written(
        named.select("h", "g", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "facts"
    )
    drop_written(classes, listed, split, sure, checked, known)
    out = join_unique(hashed, facts, ["h", "g"], "n", hashed.count()).select("vec_id", "n_links", "component_id")
    alone = base.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _grouped(rows: DataFrame, key: list[str], run) -> DataFrame:
    """``run`` over rows of which each group by ``key`` stands together."""
    schema = ", ".join(f"{c} long" for c in _FOUND)
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM v WHERE list_inner_product(v, v) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM n p JOIN n q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  AND list_inner_product(p.v, q.v) >= 0.9 * p.norm * q.norm),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a), r AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN l ON l.a = vec_id LEFT JOIN r ON r.a = vec_id
"""
