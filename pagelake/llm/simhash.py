"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are first reduced to distinct values with their counts, so copies cost nothing later.
For links of at most two differing bits the 64 bits are cut into three parts: two linked fingerprints
agree on at least one, which routes every fingerprint to three groups. A group that is still large
is cut again on its remaining bits, so no task ever holds an unbounded group. Inside a group, of
whatever size, fingerprints sorted by Gray rank form an index: each leaf holds a few neighbours, each upper node
the bits that everything below it shares and its own parent lacks; a search adds up differences on
the way down and drops a node once they exceed the limit. All groups of a batch are one forest, searched
together. Every link comes out of the index; a pair that meets in several groups counts
in the first only, so links are found once and without loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_written, join_unique, releasing, row_key, split_by, spread, text_batches, written

SEED = 42
LIMIT = 2
GROUP = 8_192
FRONTIER = 1 << 19
LEAF, FAN = 4, 4
FULL = (1 << 64) - 1
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# fingerprints


def fingerprint(text: str | None, shingle: int = 3, part: int = 1 << 17) -> int:
    """The 64-bit fingerprint of a whole text, unsigned; 0 without words."""
    words = (text or "").encode().lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if n <= 1:
        return int.from_bytes(digest(b" ".join(words), SEED), "big")
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[shingle - 1 :].tolist()
    counts = np.zeros((8, 256), np.int64)
    for k in range(0, n, part):
        hashes = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[k : min(n, k + part)], ends[k : k + part])])
        octets = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[j] += np.bincount(octets[:, j], minlength=256)
    return int.from_bytes(np.packbits((counts @ _BITS).ravel() * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, mark: str | None = None) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint as a signed BIGINT) of every document; map-only.

    ``mark`` names a further column: the text's hash, as Spark's xxhash64 gives it.
    """

    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps, marks = [], []
            for t in b.column(1):
                t = t.as_py()
                fps.append(fingerprint(t))
                if mark:
                    marks.append(SEED if t is None else xxhash.xxh64_intdigest(t, SEED))
            columns = [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))]
            if mark:
                columns.append(pa.array(np.array(marks, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "mark"][: len(columns)])

    texts = spread(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    return texts.mapInArrow(releasing(run), "doc_id long, fp long" + (f", {mark} long" if mark else ""))


# routing


def parts(mask: int, n: int = LIMIT + 1) -> list[int]:
    """The set bits of a mask, from the highest, cut into n nearly equal parts."""
    bits = [b for b in range(63, -1, -1) if mask >> b & 1]
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[a:c]) for a, c in zip(cuts, cuts[1:])]


def path_masks(path: int) -> tuple[int, list[int], int]:
    """(bits a route agrees on, parts that come before it, bits left) of a route number.

    Route numbers are base-4 digits after a leading 1, a digit for the part chosen at each cut.
    """
    digits = []
    while path > 1:
        digits.append(path & 3)
        path >>= 2
    same, before, left = 0, [], FULL
    for c in reversed(digits):
        cut = parts(left)
        before += cut[:c]
        same |= cut[c]
        left &= ~cut[c]
    return same, before, left


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the Gray-code order (as signed BIGINT)."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def _routes(rows: DataFrame, above: int) -> DataFrame:
    """rows (fp, n) with route and key, three for each, below the route ``above``."""
    choices = []
    for c in range(LIMIT + 1):
        path = above << 2 | c
        key = F.col("fp").bitwiseAND(F.lit(_signed(path_masks(path)[0])))
        choices.append(F.struct(F.lit(path).cast("long").alias("path"), key.alias("key")))
    return rows.select("fp", "n", F.inline(F.array(*choices)))


def _routed(distinct: DataFrame) -> DataFrame:
    """(path, key, fp, n) such that no (path, key) group exceeds GROUP fingerprints by much."""
    done, level = None, [(1, distinct)]
    while level:
        after = []
        for above, rows in level:
            routed = _routes(rows, above)
            hot = written(routed.groupBy("path", "key").count().where(F.col("count") > GROUP).drop("count"), "hot")
            # one row for each group that needs another cut
            paths = sorted(r[0] for r in hot.select("path").distinct().collect())
            small = routed.join(hot, ["path", "key"], "left_anti") if paths else routed
            for path in paths:
                if bin(path_masks(path)[2]).count("1") > 12:
                    mine = routed.where(F.col("path") == path).join(hot, ["path", "key"], "left_semi")
                    after.append((path, written(mine.select("fp", "n"), "hot")))
                else:
                    small = small.unionByName(routed.where(F.col("path") == path).join(hot, ["path", "key"], "left_semi"))
            done = small if done is None else done.unionByName(small)
        level = after
    return done


# the index


class GrayIndex:
    """Hierarchical index over fingerprints sorted by Gray rank inside each of many groups: a tree for each group.

    ``first`` holds where each group starts. No node reaches over a group's edge; a group of few fingerprints is a tree
    of one leaf. ``compared`` counts the fingerprints that searches reached at the bottom.
    """

    def __init__(self, fps: np.ndarray, first: np.ndarray | None = None):
        self.fps, n, self.compared = fps, len(fps), 0
        first = np.zeros(min(n, 1), np.int64) if first is None else np.asarray(first, np.int64)
        self.sizes = np.diff(np.append(first, n))
        starts, self.levels, width = self._cut(first, self.sizes, LEAF), [], LEAF
        ends = np.append(starts[1:], n)
        low, high = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
        self.levels.append((low, ~(low ^ high), starts, ends, ends - 1))
        roots, count = first, self.sizes  # of nodes one level down
        while True:
            count = -(-count // width)
            roots = np.cumsum(count) - count
            if (count <= 1).all():
                break
            v, m, _, _, last = self.levels[-1]
            s = self._cut(roots, count, FAN)
            e = np.append(s[1:], len(v))
            low, high, both = np.bitwise_and.reduceat(v, s), np.bitwise_or.reduceat(v, s), np.bitwise_and.reduceat(m, s)
            self.levels.append((low, both & ~(low ^ high), s, e, last[e - 1]))
            width = FAN
        self.root = np.repeat(np.arange(len(first)), self.sizes)  # a fingerprint's topmost node

    @staticmethod
    def _cut(first: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
        """Starts of nodes of ``width`` members that begin anew with each group."""
        parts = -(-sizes // width)
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(first, parts) + place * width

    def pairs(self, limit: int = LIMIT):
        """Yields (i, j), i < j, of all pairs of a group within ``limit`` bits; the queries of a block have at most FRONTIER places."""
        if not len(self.fps):
            return
        reach = np.cumsum(self.sizes.repeat(self.sizes))
        a = 0
        while a < len(self.fps):
            z = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + FRONTIER, "right")))
            query = np.arange(a, z)
            a = z
            node = self.root[query]
            above, diff = np.zeros(len(query), np.uint64), np.zeros(len(query), np.int64)
            for value, mask, starts, ends, last in reversed(self.levels):
                new = mask[node] & ~above
                diff = diff + np.bitwise_count((self.fps[query] ^ value[node]) & new)
                keep = (diff <= limit) & (last[node] > query)
                query, node, diff = query[keep], node[keep], diff[keep]
                above = mask[node]
                sizes = ends[node] - starts[node]
                child = np.repeat(starts[node] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                query, diff, above = np.repeat(query, sizes), np.repeat(diff, sizes), np.repeat(above, sizes)
                node = child
            self.compared += len(node)
            near = (node > query) & (np.bitwise_count(self.fps[query] ^ self.fps[node]) <= limit)
            yield query[near], node[near]


def _group_pairs(path: np.ndarray, key: np.ndarray, fps: np.ndarray):
    """Yields (i, j) of near pairs inside the (path, key) groups of rows sorted by path, key, Gray rank."""
    new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])]))
    yield from GrayIndex(fps, new).pairs()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): each pair of distinct fingerprints within two bits, once, from (fp, n)."""

    def run(batches):
        masks: dict[int, np.ndarray] = {}
        held = None

        def found(path, key, fps, n):
            if not len(path):
                return
            for i, j in _group_pairs(path, key, fps):
                ok = np.ones(len(i), bool)
                for p in np.unique(path[i]):
                    if p not in masks:
                        masks[p] = np.array(path_masks(int(p))[1], np.uint64)
                    for m in masks[p]:
                        ok &= (path[i] != p) | (((fps[i] ^ fps[j]) & m) != 0)
                i, j = i[ok], j[ok]
                if len(i):
                    cols = [fps[i].view(np.int64), fps[j].view(np.int64), n[i], n[j]]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["a", "b", "n_a", "n_b"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            cols[2] = cols[2].view(np.uint64)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            path, key = cols[0], cols[1]
            if not len(path):
                continue
            other = np.flatnonzero((path != path[-1]) | (key != key[-1]))
            cut = other[-1] + 1 if len(other) else 0  # the last group may go on in the next batch
            held = [c[cut:] for c in cols]
            yield from found(*(c[:cut] for c in cols))
        if held is not None:
            yield from found(*held)

    routed = _routed(distinct).withColumn("gray", gray_rank(F.col("fp")))
    spread = routed.repartition("path", "key").sortWithinPartitions("path", "key", "gray")
    return spread.select("path", "key", "fp", "n").mapInArrow(releasing(run), "a long, b long, n_a long, n_b long")


def _facts(marked: DataFrame) -> DataFrame:
    """(fp, n, n_near, component_id, component) of each fingerprint among rows (doc_id, fp); n counts its rows."""
    distinct = written(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), "distinct")
    edges = written(links(distinct.select("fp", "n")), "links")
    around = (
        edges.select(F.col("a").alias("fp"), F.col("n_b").alias("m"))
        .unionByName(edges.select(F.col("b").alias("fp"), F.col("n_a").alias("m")))
        .groupBy("fp").agg(F.sum("m").alias("m"))
    )
    roots = components(edges.select("a", "b"))
    known = distinct.join(around, "fp", "left").join(roots, distinct["fp"] == roots["node"], "left")
    known = written(known.select("fp", "n", "low", "m", F.coalesce("root", "fp").alias("root")), "known")
    names = known.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("size"))
    named = join_unique(known, names, ["root"], "size", known.count())
    near = F.col("n") - 1 + F.coalesce("m", F.lit(0))
    facts = written(named.select("fp", "n", near.alias("n_near"), "component_id", F.col("root").alias("component")), "facts")
    drop_written(distinct, edges, known)
    return facts


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), n_near and component_id of every document.

    n_near counts the other rows within two bits; component_id is the smallest doc_id reachable over
    such links. Null and empty texts have fingerprint zero and are linked like any other; rows without
    a doc_id take part, but give no component its name (null where none has one); repeated rows are
    near one another; an empty table gives an empty result; other columns are ignored.
    """
    marked = written(fingerprints(docs), "fingerprints")
    facts = _facts(marked).drop("component")
    return join_unique(marked, facts, ["fp"], "n", marked.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of smallest doc_id (nulls last), then least text hash.

    Rows are told apart by doc_id and text, so different texts under one doc_id are judged each by its own component. Of
    rows that repeat both, one stays, the one whose columns hash least. Only rows that may go are shuffled with their texts: a Bloom
    filter of fixed size, over the ids and hashes of rows that aren't kept or repeat, lets the others pass where they are.
    """
    marked = written(fingerprints(docs, "mark"), "fingerprints")
    facts = _facts(marked)
    rooted = join_unique(marked, facts.select("fp", F.col("n").alias("held"), "component"), ["fp"], "held", marked.count())
    rows = written(rooted.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n")), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = rows.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("held"))
    judged = join_unique(rows, first, ["component"], "held", rows.count()).withColumn("stays", place == F.col("first"))
    judged = written(judged.select("doc_id", "mark", "n", "stays"), "judged")
    drop_written(marked, facts, rows)

    moved = judged.where("not stays or n > 1").select(row_key("doc_id", "mark"))
    packed = docs.select(
        F.struct(*docs.columns).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(docs["text"].cast("string")).alias("_hash")
    ).withColumn("_key", row_key("_doc", "_hash"))
    maybe, clear = split_by(packed, "_key", moved)
    kept = judged.where("stays").select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"))
    one = maybe.join(kept, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_m")), "left_semi")
    one = one.groupBy("_doc", "_hash").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return clear.select("_row.*").unionByName(one.select("_row.*"))


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
