"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]: rate(t) = target x (1 + tilt x (2t - 1)).
Its integral is the source's cumulative demand in words; a document that follows c words of its
source (in a fixed pseudo-random order, epoch after epoch) is due where the demand reaches c, which
inverting the quadratic gives in closed form. Documents are range-sorted by that position.

Scale: one pass reads the texts (for the sizes); per-source totals are pre-aggregated; the running
sum inside a source is split into hash buckets of about ``BUCKET_DOCS`` documents, so a source that
holds a third of all rows is still many small windows; sources are ranked by a range sort.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import HOT_KEYS, join_unique, word_count, written

BUCKET_DOCS = 5_000
WEIGHTS = (5, 2, 1)
TILTS = (0.5, 0.0, -0.5)


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``_rank`` (from 0) in code-point order, nulls last, without a single-task window."""
    ordered = written(
        sources.orderBy(F.col("_source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()),
        "sources",
    )
    part = F.shiftright("_at", 33)
    # one row a sort partition, whatever the number of sources
    counts = sorted(ordered.groupBy(part.alias("p")).count().collect())
    before, start = [], 0
    for p, n in counts:
        before += [F.lit(p), F.lit(start)]
        start += n
    base = F.create_map(*before)[part] if before else F.lit(0)
    return ordered.withColumn("_rank", (base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def source_targets(sized: DataFrame, weights=WEIGHTS, tilts=TILTS, cap: float = 3.0) -> DataFrame:
    """(_source, _docs, source_size, target, _tilt) from rows (_source, _size).

    All sizes are shared by weight; a share above ``cap`` times its source's size stops there and
    the excess is shared again by weight, until none is above. Each round is one aggregate.
    """
    sources = sized.groupBy("_source").agg(F.count("*").alias("_docs"), F.sum("_size").alias("source_size"))
    pick = lambda values: F.element_at(
        F.array(*map(F.lit, values)), (F.col("_rank") % len(values) + 1).cast("int")
    )
    ranked = written(
        _ranked(sources).select(
            "_source", "_docs", "source_size", pick(weights).alias("_w"), pick(tilts).alias("_tilt")
        ),
        "sources",
    )
    most = F.col("source_size") * F.lit(cap)
    total, level = ranked.agg(F.sum("source_size")).first()[0] or 0, None
    while True:
        above = most < F.lit(level) * F.col("_w") if level is not None else F.lit(False)
        capped, open_w = ranked.agg(
            F.sum(F.when(above, most).otherwise(0.0)), F.sum(F.when(above, 0).otherwise(F.col("_w")))
        ).first()
        rest = float(total) - (capped or 0.0)
        after = rest / open_w if open_w else 0.0
        if level is not None and after <= level:
            break
        level = after
    share = F.lit(rest) * F.col("_w") / F.lit(float(open_w or 1))
    return ranked.withColumn("target", F.when(above, most).otherwise(share)).drop("_w")


def mix(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, cap: float = 3.0, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, first_position.

    ``copies`` is how often the mix takes the document (at most ceil(cap)), ``taken`` the words that
    makes, ``first_position`` where in training (0 to 1) its first copy is due (null if never).
    With ``carry``, ``docs``' own columns follow under their names and the digest columns are
    prefixed with ``_mix_``.

    Null text has size 0; null source is a source of its own, last; null doc_ids and repeated rows
    are documents like any other (ties in the order fall to doc_id and size); a source without words has
    target 0; an empty table gives an empty result; other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").alias("_doc"),
        F.col("source").alias("_source"),
        word_count(F.col("text")).alias("_size"),
        F.md5(key.cast("binary")).alias("_hash"),
        *([F.struct(*docs.columns).alias("_row")] if carry else []),
    )
    sized = written(base.drop("_row"), "sizes")
    if not carry:
        base = sized
    # sources by a key that is never null, so that a hot one can be joined by broadcast
    named = lambda df: df.withColumn("_s", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")))
    targets, total_docs = named(source_targets(sized, weights, tilts, cap)).drop("_source"), sized.count()
    targets = targets.withColumn("_held", F.col("_docs"))
    few = targets.count() <= HOT_KEYS

    def aimed(rows):
        rows = named(rows).drop("_source")
        return rows.join(F.broadcast(targets.drop("_held")), "_s") if few else join_unique(rows, targets, ["_s"], "_held", total_docs)

    unit = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / float(1 << 32)
    parts = F.greatest(F.lit(1), F.ceil(F.col("_docs") / BUCKET_DOCS))
    bucket = F.floor(unit * parts).cast("long")
    placed = aimed(base).withColumn("_bucket", bucket).drop("_docs")
    sums = aimed(sized).withColumn("_bucket", bucket).groupBy("_s", "_bucket").agg(F.sum("_size").alias("_sum"))
    # one row for every BUCKET_DOCS documents of a source
    over = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select("_s", "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start")), "starts")
    inner = (
        Window.partitionBy("_s", "_bucket").orderBy("_hash", "_doc", "_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    size, total, target = F.col("_size"), F.col("source_size"), F.col("target")
    room = (target - F.col("_before") - size * 0.5) / total
    out = (
        placed.join(starts, ["_s", "_bucket"])
        .withColumn("_before", F.col("_start") + F.coalesce(F.sum("_size").over(inner), F.lit(0)))
        .withColumn("_copies", F.when(total > 0, F.greatest(F.ceil(room), F.lit(0))).otherwise(0).cast("long"))
    )
    first = F.when(F.col("_copies") > 0, position(F.col("_before") + size * 0.5, target, F.col("_tilt")))
    names = {
        "doc_id": F.col("_doc"), "size": size, "source_size": total, "target": target,
        "taken": size * F.col("_copies"), "copies": F.col("_copies"), "first_position": F.round(first, 9),
    }
    if carry:
        return out.select(
            "_row.*", *(c.alias(f"_mix_{n}") for n, c in names.items()),
            F.col("_before").alias("_mix_before"), F.col("_tilt").alias("_mix_tilt"),
        )
    return out.select(*(c.alias(n) for n, c in names.items()))


def position(due, target, tilt):
    """The t at which target x (t (1 - tilt) + tilt t^2) = due."""
    share = due / target
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - tilt) * (1 - tilt) + 4 * tilt * share))
    return F.when(tilt == 0, share).otherwise((root - (1 - tilt)) / (2 * tilt))


def training_order(docs: DataFrame, **options) -> DataFrame:
    """``docs``' columns, each document as often as the mix takes it, range-sorted by position.

    The order is that of the rows: written, that of the files and of the rows in each (see :func:`training_place`).
    """
    mixed = mix(docs, carry=True, **options)
    turn = mixed.where("_mix_copies > 0").withColumn(
        "_mix_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_copies") - 1))
    )
    due = F.col("_mix_turn") * F.col("_mix_source_size") + F.col("_mix_before") + F.col("_mix_size") * 0.5
    at = position(due, F.col("_mix_target"), F.col("_mix_tilt"))
    return turn.withColumn("_mix_at", at).orderBy("_mix_at", "_mix_doc_id", "_mix_turn").select(*docs.columns)


def training_place(docs: DataFrame) -> DataFrame:
    """``docs``' columns, then ``part`` and ``row`` (BIGINT): where a row stands among the files of the table it is read from.

    For a table that was written from :func:`training_order`, sorting by (part, row) gives the training order again. Rows that
    don't come straight from files have null in both. Columns of these names give way.
    """
    kept = [c for c in docs.columns if c not in ("part", "row")]
    try:
        placed = docs.select(*kept, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:
        none = F.lit(None).cast("long")
        return docs.select(*kept, none.alias("part"), none.alias("row"))
    number = lambda mark: F.coalesce(F.regexp_extract("_file", rf"{mark}(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    row = F.shiftleft(number(r"-c(?=\d+\.)"), 40) + F.col("_index")
    return placed.select(*kept, number("^part-").alias("part"), row.alias("row"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][r % 3 + 1] AS w, [0.5, 0.0, -0.5][r % 3 + 1]::DOUBLE AS tilt,
        CAST(source_size AS DOUBLE) * 3.0 AS most FROM s),
x AS (SELECT a.source, a.source_size, a.w, a.tilt, a.most,
        (SELECT CAST(sum(source_size) AS DOUBLE) FROM s)
          - coalesce((SELECT sum(b.most) FROM w b WHERE b.most * a.w < a.most * b.w), 0.0) AS rest,
        (SELECT CAST(sum(b.w) AS DOUBLE) FROM w b WHERE b.most * a.w >= a.most * b.w) AS open_w
      FROM w a),
c AS (SELECT *, most * open_w < rest * w AS capped FROM x),
l AS (SELECT (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(most) FILTER (WHERE capped), 0.0) AS rest,
        CAST(sum(w) FILTER (WHERE NOT capped) AS DOUBLE) AS open_w FROM c),
t AS (SELECT c.source, source_size, tilt,
        CASE WHEN capped THEN most ELSE l.rest * w / l.open_w END AS target FROM c, l),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                               ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(greatest(ceil((target - before - size * 0.5::DOUBLE) / source_size), 0) AS BIGINT)
                     ELSE 0 END AS copies, (before + size * 0.5::DOUBLE) / nullif(target, 0) AS share FROM b)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
  round(CASE WHEN copies > 0 THEN CASE WHEN tilt = 0 THEN share ELSE
    (sqrt(greatest(0.0::DOUBLE, (1 - tilt) * (1 - tilt) + 4 * tilt * share)) - (1 - tilt)) / (2 * tilt) END END, 9) AS first_position
FROM k
"""
