"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that one task renders and parses: some 200,000 narrow rows.
RENDERED = 4 << 20


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` on at least as many partitions as there are cores: a single small file is a single task otherwise.

    With ``most``, also on one for each so many bytes of its files, for narrow rows that cost far more than their reading.
    A plan that shuffles stays as it is, since counting its partitions would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    parts = df.sparkSession.sparkContext.defaultParallelism
    if most is not None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = max(parts, min(-(-size // most), 10_000))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table, spread over the cores before pages are parsed."""
    return spread(table(spark, sf_dir, "pages"))


def cat(*parts) -> Column:
    """Concatenation of columns and literal strings."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def escaped(text: Column) -> Column:
    """Text as it stands in HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sql_any(text: str, patterns) -> str:
    """SQL of urls.any_match."""
    plain = "|".join(f"(?:{p})" for p in patterns if not p.startswith("(?i)"))
    folded = "|".join(f"(?:{p[4:]})" for p in patterns if p.startswith("(?i)"))
    tests = [f"regexp_matches({text}, '{flag}{p}')" for flag, p in (("", plain), ("(?i)", folded)) if p]
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def sql_words(text: str, rules, otherwise: str = "other") -> str:
    """SQL of kinds.by_words."""
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules
    )
    return f"CASE {cases} ELSE '{otherwise}' END"
