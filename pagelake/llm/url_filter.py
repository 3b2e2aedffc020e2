"""URL filters with redirect equivalence.

A page's own rule decides first. Pages that redirect to, or name as canonical, one another form
connected components; a component that holds a URL with a block rule is blocked, except for the
pages that a rule allows. Only URLs that have such an edge enter the component rounds.
"""

from __future__ import annotations

import re
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.url_join import _clean, _dots
from ..operators.dom import _attribute
from .components import components
from .shared import drop_written, join_unique, written

#: (verdict, host, path); a configuration.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Up to so many rules are one expression; more are a table that candidates are joined with.
IN_EXPRESSION = 500
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; an allow rule goes before a block rule of its length."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1]))
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in ranked
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def with_rule(urls: DataFrame, rules=RULES, most: int = IN_EXPRESSION) -> DataFrame:
    """``urls`` (host, path and more) with ``_rule``, the struct that :func:`rule_of` gives, for any number of rules.

    Beyond ``most`` the distinct (host, path) pairs are expanded to what a rule for them can look like, a suffix of whole labels of the
    host with a prefix of the path as long as some rule's, and joined with the rules on equality.
    """
    if len(rules) <= most:
        return urls.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    spark = urls.sparkSession
    table = spark.createDataFrame(list(rules), "verdict string, h string, p string")
    lengths = sorted({len(p) for _, _, p in rules})
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = distinct.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(heads))
    # longest first, an allow rule before a block rule of its length, as in rule_of
    order = F.struct(-F.length(F.concat("h", "p")), "verdict", "h")
    best = tried.join(table, ["h", "p"]).groupBy("host", "path").agg(
        F.min_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), order).alias("_rule")
    )
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "_rule")


def _key(url: Column) -> Column:
    """A URL as a node: without its fragment, its host lower-cased."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = F.lower(F.substring_index(bare, "://", 1))
    return F.concat(scheme, F.lit("://"), host_of(bare), F.regexp_extract(_rest(bare), r"(?s)^[^/?#]*(.*)$", 1))


_PARTS = re.compile(r"([^/?#]*)([^?#]*)(\?[^#]*)?", re.DOTALL)
_ABSOLUTE = re.compile(r"(https?:)?//([^/?#]*)([^?#]*)", re.DOTALL | re.IGNORECASE)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def resolved(url: str, hrefs: list[str]) -> list[str]:
    """Hrefs as HTML writes them as URLs: entities, base and dot segments as browsers take them, all else as written."""
    scheme, _, rest = url.partition("://")
    host, base, query = _PARTS.match(rest).groups("")
    out = []
    for href in map(_clean, map(_attribute, hrefs)):
        if not href:
            continue
        slashed = href.replace("\\", "/")
        if m := _ABSOLUTE.match(slashed):
            path = _dots(m[3]) if m[3] else ""
            out.append(f"{m[1] or scheme + ':'}//{m[2]}{path}{href[m.end() :]}")
            continue
        if _SCHEME.match(href):
            out.append(href)
            continue
        path = re.match(r"[^?#]*", slashed)[0]
        tail = href[len(path) :]
        if path:
            path = _dots(path if path.startswith("/") else (base[: base.rfind("/") + 1] or "/") + path)
        elif tail.startswith("?"):
            path = base or "/"
        else:
            path, tail = base, query + tail
        out.append(f"{scheme}://{host}{path}{tail}")
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _resolved(url: pa.Array, hrefs: pa.Array) -> pa.Array:
    return pa.array([resolved(u.as_py(), h.as_py()) for u, h in zip(url, hrefs)], pa.list_(pa.string()))


# so that no optimizer rule evaluates it a second time for the filter that explode implies
_resolved = _resolved.asNondeterministic()


def _targets(url: Column, html: Column) -> Column:
    """Absolute URLs that a page's canonical links and refresh redirects name."""
    tags = F.regexp_extract_all(html, F.lit(_TAGS), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b") & t.rlike(r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"))
    hrefs = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)),
    )
    return F.coalesce(_resolved(url, hrefs), F.array().cast("array<string>"))


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Edges come from ``pages.html`` (canonical links, refresh redirects) and from ``redirects`` (src, dst), if
    given. A page without a rule is blocked if its component holds a URL that a rule blocks, else allowed.

    A null url, or one without ://, has empty host and path, no rule and no edges; null html has no edges; null
    page_ids and repeated rows stay as they are; an empty table gives an empty result; other columns are ignored.
    """
    base = pages.select("page_id", F.col("url").alias("_url"))
    url = F.col("_url")
    found = (
        pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|refresh"))
        .select(F.col("url").alias("src"), F.explode(_targets(F.col("url"), F.col("html"))).alias("dst"))
    )
    if redirects is not None:
        found = found.unionByName(redirects.select("src", "dst"))
    both = F.col("src").contains("://") & F.col("dst").contains("://")
    edges = written(
        found.where(both).select(_key(F.col("src")).alias("src"), _key(F.col("dst")).alias("dst"))
        .where("src <> dst").distinct(),
        "aliases",
    )
    nodes = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("dst").alias("key"))).distinct()
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    a, b = nodes.toDF("src", "a"), nodes.toDF("dst", "b")
    roots = components(edges.join(a, "src").join(b, "dst").select("a", "b"))
    judged = nodes.join(roots, "node").withColumn("host", host_of(F.col("key"))).withColumn("path", path_of(F.col("key")))
    judged = with_rule(judged, rules).withColumn("_blocks", F.coalesce(F.col("_rule.verdict") == "block", F.lit(False)))
    judged = written(judged.select("key", "root", "_blocks"), "judged")
    bad = judged.groupBy("root").agg(F.max("_blocks").alias("_bad"), F.count("*").alias("n")).where("_bad")
    drop_written(edges, nodes)
    aliases = join_unique(judged, bad, ["root"], "n", judged.count()).select(F.col("key").alias("_key"), "_bad")
    own = with_rule(base.select("page_id", "_url", host_of(url).alias("host"), path_of(url).alias("path")), rules)
    # only pages without a rule, and with an address, ask for their component; the others get keys that no alias has and that spread
    asks = F.col("_rule").isNull() & url.contains("://")
    spare = F.concat(F.lit("-"), F.pmod(F.xxhash64("page_id"), F.lit(10_000)))
    own = own.withColumn("_at", F.when(asks, _key(url)).otherwise(spare))
    passed = F.when(F.coalesce("_bad", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return own.join(aliases, own["_at"] == aliases["_key"], "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", passed).alias("verdict")
    )


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


SQL = r"""
WITH RECURSIVE raw AS (SELECT page_id, url, html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM raw),
rules(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
e AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS src, regexp_replace(regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1), '#.*$', '') AS dst
      FROM p WHERE html LIKE '%<link rel="canonical" href="%'),
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a),
bad AS (SELECT DISTINCT reach.a FROM reach WHERE
    (SELECT arg_max(r.verdict, length(r.h || r.pre)) FROM rules r WHERE
       (lower(regexp_extract(reach.b, '://([^/?#]*)', 1)) = r.h OR ends_with(lower(regexp_extract(reach.b, '://([^/?#]*)', 1)), '.' || r.h))
       AND starts_with(regexp_extract(reach.b, '://[^/?#]*([^?#]*)', 1), r.pre)) = 'block'),
m AS (SELECT p.page_id, p.url, p.host, p.path, arg_max(r.h || r.pre, length(r.h || r.pre)) AS rule, arg_max(r.verdict, length(r.h || r.pre)) AS v
      FROM p LEFT JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre)
      GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_replace(url, '#.*$', '') IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""
