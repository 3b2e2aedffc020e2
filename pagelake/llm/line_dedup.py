"""Line dedup: winnowing over line hashes, joined positions, matches extended both ways.

A document is its sequence of lines with words. A window is a shortest run of lines that holds
``min_words`` words, seen from its first line or from its last; its fingerprint is its line of least hash, the
leftmost of equals. Only lines that are the minimum of some window are kept, one row each, whatever the number of their
windows. Which line that is depends on the window's content alone, so a repeated run of at least ``min_words``
words shares a fingerprint wherever it stands (the winnowing guarantee).

Positions whose fingerprint occurs once in the whole corpus end here. The others are joined on it and extended both ways, to
the ends of each window that has its minimum there: a window whose lines on both sides, as a hash, stand at an earlier position too repeats
it. Windows that overlap or follow one another on the same text make up the maximal run, and its lines are deleted.

Any two positions are compared through the first occurrence of their extended content, not pair by pair,
so a passage that a third of all documents share costs one row per occurrence; the minimum is
pre-aggregated before its shuffle. Texts move only if they may lose a line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_written, join_unique, release, releasing, row_key, split_by, spread, text_batches, written

MIN_WORDS = 50
SEED = 42
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def windows(first: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray, least: int):
    """Windows of concatenated line sequences.

    first: where each sequence starts, ending with the total; count: words a line; a, b: two hashes
    a line. Returns (sequence, start, end, line of least hash, content hash), line numbers inclusive and global, by that line.
    """
    n = len(count)
    total = np.concatenate([[0], np.cumsum(count)])
    seq = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lines = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least) - 1  # from each first line
    start = np.searchsorted(total, total[1:] - least, "right") - 1  # from each last line
    fore = end < first[seq + 1] if n else np.zeros(0, bool)
    back = (start >= first[seq]) if n else np.zeros(0, bool)
    s = np.concatenate([lines[fore], start[back]])
    e = np.concatenate([end[fore], lines[back]])
    s, e = np.unique(np.stack([s, e]), axis=1) if len(s) else (s, e)
    # the least line of each window by a sparse table over powers of two
    lower = lambda i, j: np.where(a[j] < a[i], j, i)
    table, width = [lines], 1
    longest = int((e - s + 1).max(initial=1))
    while 2 * width <= longest:
        last = table[-1]
        table.append(lower(last[: n - 2 * width + 1], last[width : n - width + 1]))
        width *= 2
    level = np.floor(np.log2(np.maximum(e - s + 1, 1))).astype(np.int64)
    at = np.zeros(len(s), np.int64)
    for k, row in enumerate(table):
        of = level == k
        at[of] = lower(row[s[of]], row[e[of] + 1 - (1 << k)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * _powers(_BASE, n), dtype=np.uint64)])
    content = (sums[e + 1] - sums[s]) * _powers(_BACK, n)[s]
    content ^= content >> np.uint64(29)
    content = content * np.uint64(0xBF58476D1CE4E5B9) + (e - s).astype(np.uint64)
    order = np.argsort(at, kind="stable")
    s, e, at, content = s[order], e[order], at[order], content[order]
    return seq[s], s, e, at, content


def _positions(docs: DataFrame, least: int, part: int = 1 << 22) -> DataFrame:
    """(print, doc_id, mark, spans): a row for every line that is a window's minimum.

    print is its hash; spans holds, for each window with its minimum there, the hash of all that the window extends over and its first
    and last line within the text. About ``part`` bytes of text are worked on at once.
    """
    text_batches(docs.sparkSession)

    def rows(texts, ids):
        digest = xxhash.xxh3_128_digest
        first, counts, hashes, at, marks = [0], [], [], [], []
        for raw in texts:
            for k, line in enumerate(raw.split(b"\n")):
                if words := line.split():
                    counts.append(len(words))
                    hashes.append(digest(b" ".join(words)))
                    at.append(k)
            first.append(len(counts))
            marks.append(xxhash.xxh64_intdigest(raw, SEED))
        pair = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
        a, b = np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])
        seq, s, e, least_at, content = windows(np.array(first), np.array(counts, np.int64), a, b, least)
        line, marks = np.array(at, np.int32), np.array(marks, np.uint64)
        new = np.flatnonzero(np.concatenate([[True], least_at[1:] != least_at[:-1]])) if len(s) else np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays(
            [pa.array(content.view(np.int64)), pa.array(line[s]), pa.array(line[e])], ["content", "s", "e"]
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array(a[least_at[new]].view(np.int64)), ids.take(pa.array(seq[new])), pa.array(marks[seq[new]].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.append(new, len(s)).astype(np.int32)), spans),
            ],
            ["print", "doc_id", "mark", "spans"],
        )

    def run(batches):
        for batch in batches:
            texts, size, start = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size > part or k == batch.num_rows - 1:
                    yield rows(texts, batch.column(0).slice(start, len(texts)))
                    texts, size, start = [], 0, k + 1

    schema = "print long, doc_id long, mark long, spans array<struct<content:long,s:int,e:int>>"
    return spread(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))).mapInArrow(releasing(run), schema)


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))
def _without(text: pa.Array, runs: pa.Array) -> pa.Array:
    """A text without the lines of the runs (start * 2^32 + end), and how many lines with words went."""
    texts, counts = [], []
    for t, spans in zip(text, runs):
        t, n = t.as_py(), 0
        if t is not None:
            lines = t.split("\n")
            spans = spans.values.to_numpy()
            edge = np.zeros(len(lines) + 1, np.int64)
            np.add.at(edge, spans >> 32, 1)
            np.add.at(edge, (spans & 0xFFFFFFFF) + 1, -1)
            gone = (np.cumsum(edge[:-1]) > 0).tolist()
            n = sum(1 for line, g in zip(lines, gone) if g and line.encode().split())
            t = "\n".join([line for line, g in zip(lines, gone) if not g])
        texts.append(t)
        counts.append(n)
    release()
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["text", "n"])


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, _runs): for each text with later repeats, its windows that repeat, as first line * 2^32 + last line."""
    found = written(_positions(docs, min_words), "positions")
    again = found.groupBy("print").count().where("count > 1").select("print")
    met = split_by(found, "print", again)[0]
    met = written(met.select("print", "doc_id", "mark", F.inline("spans")), "met")
    place = F.struct("doc_id", "mark", "s", "e")
    first = met.groupBy("print", "content").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    first = written(first.where("first <> last").drop("last"), "first")
    later = join_unique(met, first, ["print", "content"], "n", met.count()).where(place > F.col("first"))
    run = F.shiftleft(F.col("s").cast("long"), 32) + F.col("e")
    runs = written(later.groupBy("doc_id", "mark").agg(F.collect_set(run).alias("_runs")), "runs")
    drop_written(found, met, first)
    return runs


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, counted: str = "_removed_lines") -> DataFrame:
    """``docs`` with later repeats deleted from ``text``, and how many lines with words went, as ``counted`` (BIGINT).

    A line goes if it belongs to a run of lines of at least ``min_words`` words that also stands earlier,
    in order of (doc_id, text hash, line); lines compare by their words, so white space doesn't
    matter, and lines without words neither count nor break a run (those inside a deleted window go with it).
    Of a run that overlaps its own repeat the first period stays.

    Null text stays null and empty text empty; a null doc_id sorts first; rows that repeat both doc_id and
    text are one document and all get its result; a text whose every line goes becomes empty, the row stays;
    an empty table gives an empty result. Other columns pass unchanged, whatever their names, but for one named as
    ``counted``, which gives way to the count.
    """
    columns = [c for c in docs.columns if c != counted]
    runs = later_runs(docs, min_words)
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_runs")
    packed = docs.select(
        F.struct(*columns).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(docs["text"].cast("string")).alias("_hash")
    ).withColumn("_key", row_key("_doc", "_hash"))
    maybe, clear = split_by(packed, "_key", runs.select(row_key("_id", "_mark")))
    joined = maybe.join(runs, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_mark")), "left")
    cut = joined.withColumn("_new", _without(F.when(F.col("_runs").isNotNull(), F.col("_row.text")), F.col("_runs")))
    changed = [
        F.coalesce("_new.text", "_row.text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in columns
    ]
    cut = cut.select(*changed, F.coalesce("_new.n", F.lit(0)).cast("long").alias(counted))
    return clear.select("_row.*", F.lit(0).cast("long").alias(counted)).unionByName(cut)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_runs(docs, counted="n_removed")


SQL = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i - 1 AS ln, regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+') AS words
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM raw)),
n AS (SELECT doc_id, ln, array_to_string(words, ' ') AS line, len(words) AS c,
        row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS r,
        sum(len(words)) OVER (PARTITION BY doc_id ORDER BY ln) AS t FROM l WHERE len(words) > 0),
p AS (SELECT a.doc_id, a.r AS s, b.r AS e, b.t - a.t + a.c AS w FROM n a JOIN n b
        ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + 49 WHERE b.t - a.t + a.c >= 50),
f AS (SELECT doc_id, s, min(e) AS e FROM p GROUP BY doc_id, s
      UNION SELECT doc_id, max(s), e FROM p GROUP BY doc_id, e),
k AS (SELECT f.doc_id, f.s, f.e, min(n.ln) AS a, max(n.ln) AS z, string_agg(n.line, chr(10) ORDER BY n.r) AS content
      FROM f JOIN n ON n.doc_id = f.doc_id AND n.r BETWEEN f.s AND f.e GROUP BY f.doc_id, f.s, f.e),
g AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) AS o FROM k),
d AS (SELECT DISTINCT l.doc_id, l.ln FROM g JOIN l ON l.doc_id = g.doc_id AND l.ln BETWEEN g.a AND g.z WHERE g.o > 1),
x AS (SELECT l.doc_id, l.ln, len(l.words) > 0 AS full_line, d.ln IS NOT NULL AS gone
      FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.ln = d.ln)
SELECT raw.doc_id,
  CASE WHEN raw.text IS NULL THEN NULL ELSE
    coalesce(string_agg(raw.lines[x.ln + 1], chr(10) ORDER BY x.ln) FILTER (WHERE NOT x.gone), '') END AS text,
  CAST(count(*) FILTER (WHERE x.gone AND x.full_line) AS BIGINT) AS n_removed
FROM raw LEFT JOIN x ON raw.doc_id = x.doc_id GROUP BY raw.doc_id, raw.text
"""
