"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by a small network from
counts over its bytes and words; gated attention, learnt from document labels alone, weighs the passages;
the weighted representation gives the document's score. All passages of a batch are encoded together in
numpy, so scoring is one map over whole texts. Fitting uses a bounded sample of rows: the ``TRAIN_DOCS`` labelled
documents whose id hashes are smallest, each with all its passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release, releasing, spread, text_batches

PASSAGE = 64
TRAIN_DOCS = 4_000
HIDDEN, GATE = 24, 12
EPOCHS, STEP, SEED = 40, 0.01, 7

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


_CLASSES = [
    _class(lambda b: 65 <= b <= 90),  # upper case
    _class(lambda b: 97 <= b <= 122),
    _class(lambda b: 48 <= b <= 57),
    _class(lambda b: b >= 128),
    _class(lambda b: b in b".,;:?'\"-()"),
    _class(lambda b: b == 33),
    _class(lambda b: b == 124),
    _class(lambda b: 33 <= b < 127 and not chr(b).isalnum() and b not in b".,;:?'\"-()!|"),
    _class(lambda b: b == 10),
]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SMALL = np.uint64(0x9E3779B97F4A7C15)
FEATURES = len(_CLASSES) + 9


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, the same wherever the word stands."""
    n = len(raw)
    power = np.full(n, _SMALL, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n, np.uint64(pow(int(_SMALL), -1, 1 << 64)), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
    h = (sums[ends] - sums[starts]) * back[starts]
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def passages(texts: list[bytes], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(bag, x): the text number of every passage, in order, and its features; texts without words have none."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    word = ~space
    starts = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, FEATURES))
    ends = np.flatnonzero(word & np.concatenate([space[1:], [True]])) + 1
    text_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    doc = np.searchsorted(text_at, starts, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    within = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    head = np.flatnonzero(within % size == 0)  # first word of each passage
    bag = doc[head]
    words = np.diff(np.append(head, len(starts))).astype(np.float64)
    begin = starts[head]
    stop = np.minimum(np.append(begin[1:], len(raw)), text_at[bag + 1])
    size_ = (stop - begin).astype(np.float64)
    cols = []
    for c in _CLASSES:
        total = np.concatenate([[0], np.cumsum(c[raw], dtype=np.int32)])
        cols.append((total[stop] - total[begin]) / size_)
    low = _LOWER[raw]
    h = _hashes(low, starts, ends)
    n = np.repeat(np.arange(len(head)), words.astype(np.int64))
    length = (ends - starts).astype(np.float64)
    per = lambda v: np.add.reduceat(np.asarray(v, np.float64), head)
    mean = per(length) / words
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (n[1:] == n[:-1])])
    key = np.sort((n.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(head))
    last, upper = raw[ends - 1], _CLASSES[0]
    cols += [
        mean / 10, np.sqrt(np.maximum(per(length**2) / words - mean**2, 0)) / 10, distinct / words, per(same) / words,
        per(upper[raw[starts]]) / words, per(upper[raw[starts]] & upper[last]) / words,
        per(~(_CLASSES[0] | _CLASSES[1] | _CLASSES[3])[last]) / words, per(length <= 3) / words, np.log1p(words) / 5,
    ]
    return bag, np.stack(cols, axis=1)


class Model:
    """Encoder, gated attention and scoring layer; plain numpy arrays, small enough to ship with a task."""

    def __init__(self, d: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
        self.mean, self.scale = np.zeros(d), np.ones(d)
        self.p = {
            "w": init(d, HIDDEN), "wb": np.zeros(HIDDEN), "v": init(HIDDEN, GATE), "u": init(HIDDEN, GATE),
            "a": init(GATE, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray):
        """Log-odds of each bag; ``first`` holds each bag's first row."""
        p, count = self.p, np.diff(np.append(first, len(x)))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["wb"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        w = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(w[:, None] * h, first)
        return z @ p["c"] + p["b"][0], (x, h, t, g, w, z, count)

    def gradients(self, first, out, saved, y):
        p, (x, h, t, g, w, z, count) = self.p, saved
        d = (1 / (1 + np.exp(-out)) - y) / len(y)
        grad = {"c": z.T @ d, "b": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * p["c"], count, axis=0)
        dw = (dz * h).sum(axis=1)
        de = w * (dw - np.repeat(np.add.reduceat(w * dw, first), count))
        grad["a"] = (t * g).T @ de
        dtg = de[:, None] * p["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        grad["v"], grad["u"] = h.T @ dt, h.T @ dg
        dh = (dz * w[:, None] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        grad["w"], grad["wb"] = x.T @ dh, dh.sum(axis=0)
        return grad

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64) -> Model:
        """Adam on the logistic loss, with a little weight decay; the order of bags is seeded."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            rate = STEP * (1 - epoch / epochs)
            order = rng.permutation(len(bags))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                sizes = [len(bags[i]) for i in some]
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                out, saved = self.forward(np.concatenate([bags[i] for i in some]), first)
                step += 1
                for name, g in self.gradients(first, out, saved, y[some]).items():
                    g = g + 1e-4 * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.999 * s[name] + 0.001 * g * g
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Score of each whole text; 0 without words."""
        bag, x = passages(texts)
        score = np.zeros(len(texts))
        if len(bag):
            first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
            out = self.forward(x, first)[0]
            score[bag[first]] = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
        return score


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _parts(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[tuple[int, int, list[bytes]]]:
    part, size, start = [], 0, 0
    for k, t in enumerate(batch.column(1)):
        raw = (t.as_py() or "").encode()
        part.append(raw)
        size += len(raw)
        if size > most or k == batch.num_rows - 1:
            yield start, k + 1, part
            part, size, start = [], 0, k + 1


def train(docs: DataFrame, labels: DataFrame, docs_most: int = TRAIN_DOCS) -> Model | None:
    """A model fitted on labelled documents that are not held out; None without usable labels.

    Labels that are null are ignored; a document with several takes their mean, rounded up at a half; of
    documents that repeat an id any may serve. At most ``docs_most`` documents reach the driver, as the features of
    all their passages (72 bytes for every PASSAGE words).
    """
    spark = docs.sparkSession
    text_batches(spark)
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    by = usable.groupBy("doc_id").agg(F.avg("quality").alias("y")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")))
    y = {r["doc_id"]: float(r["y"] >= 0.5) for r in by.limit(docs_most).collect()}
    if not y:
        return None
    # docs_most ids at the most
    ids = F.broadcast(spark.createDataFrame([(i,) for i in y], "_id long"))
    some = spread(docs.select("doc_id", "text")).join(ids, F.col("doc_id") == F.col("_id"), "left_semi").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches):
        for b in batches:
            for start, end, texts in _parts(b):
                bag, x = passages(texts)
                edge = np.searchsorted(bag, np.arange(len(texts) + 1))
                rows = [x[a:z].astype(np.float32).tobytes() for a, z in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), pa.array(rows)], ["doc_id", "x"])

    rows = some.mapInArrow(releasing(run), "doc_id long, x binary").collect()
    bags = {r[0]: np.frombuffer(r[1], np.float32).reshape(-1, FEATURES).astype(np.float64) for r in rows}
    order = sorted(i for i, x in bags.items() if len(x))
    if not order:
        return None
    return Model().fit([bags[i] for i in order], np.array([y[i] for i in order]))


def classify(docs: DataFrame, model: Model | None, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; with ``carry``, ``docs``' columns and ``_score``.

    Empty and null texts score 0; without a model (no labels) every text with words scores 1; null ids and
    repeated rows stay as they are; an empty table gives an empty result; other columns pass with ``carry``
    and are ignored otherwise. Map-only.
    """

    text_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out, part, size = [], [], 0
        for t in text:
            raw = (t.as_py() or "").encode()
            part.append(raw)
            size += len(raw)
            if size > 1 << 19:
                out.append(_score(part))
                part, size = [], 0
        out.append(_score(part))
        release()
        return pa.array(np.concatenate(out))

    def _score(texts):
        if not texts:
            return np.zeros(0)
        return np.array([float(bool(t.split())) for t in texts]) if model is None else model.score(texts)

    docs = spread(docs)
    value = score(docs["text"].cast("string"))
    if carry:
        return docs.withColumn("_score", value)
    scored = docs.select("doc_id", value.alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"), F.col("doc_id"))
    scored = classify(packed.select("_row", "text"), train(docs, labels), carry=True)
    return scored.where("_score >= 0.5").select("_row.*")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
