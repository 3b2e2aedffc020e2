"""SimHash, embeddings, top-k, URL filters, components, pipeline: brute force and odd input."""

import random

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from pagelake.llm import components, embed_dedup, simhash, topk, url_filter


def closure(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("n,m,seed", [(60, 40, 1), (200, 150, 2), (50, 300, 3)])
def test_components(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(0, 20)]
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    want = closure(n, edges)
    assert all(got[x] == want[x] for e in edges if e[0] != e[1] for x in e)
    assert components.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("n,bits", [(400, 64), (2500, 14), (3000, 20), (40, 6)])
def test_gray_index_equals_all_pairs(n, bits):
    rng = np.random.default_rng(bits)
    fps = np.unique(rng.integers(0, 1 << min(bits, 63), n, dtype=np.uint64) * np.uint64(0x10001 if bits < 64 else 1))
    rank = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    fps = fps[np.argsort(rank)]
    got = {(i, j) for a, b in simhash.GrayIndex(fps).pairs() for i, j in zip(a.tolist(), b.tolist())}
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    assert got == set(zip(i.tolist(), j.tolist()))


def slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def check_simhash(df):
    rows = df.select("doc_id", "text").collect()
    got = simhash.near_duplicates(df).collect()
    fps = np.array([slow_fingerprint(r.text) for r in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    root = closure(len(rows), zip(*np.nonzero(near)))
    names = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            names[root[k]] = min(names.get(root[k], r.doc_id), r.doc_id)
    want = sorted((repr(r.doc_id), format(int(f), "016x"), int(near[k].sum() - 1), names.get(root[k])) for k, (r, f) in enumerate(zip(rows, fps)))
    assert sorted((repr(r.doc_id), r.fingerprint, r.n_near, r.component_id) for r in got) == want


def test_simhash_equals_brute_force(spark, sf_dir, odd_docs, no_docs, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_simhash(docs)
    check_simhash(odd_docs)
    assert simhash.near_duplicates(no_docs).count() == 0
    monkeypatch.setattr(simhash, "GROUP", 3)  # every group is cut again
    check_simhash(docs)


def test_simhash_keeps_one_of_each_group(spark, odd_docs, no_docs):
    base = " ".join(f"w{k}" for k in range(400))
    df = spark.range(300).selectExpr("id AS doc_id", f"CASE WHEN id < 200 THEN '{base}' ELSE concat('own ', id, ' text ', id * 7, ' x') END AS text")
    kept = simhash.keep_one(df)
    assert kept.where("doc_id < 200").count() == 1 and kept.where("doc_id >= 200").count() == 100
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 1").count() == 1
    assert simhash.keep_one(odd_docs.where("doc_id = 5")).count() == 1  # repeated rows
    assert simhash.keep_one(no_docs).count() == 0


def embed_rows(seed, groups=12, each=15, d=64, noise=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    x = np.concatenate([c + noise * np.sqrt(d) * rng.standard_normal((each, d)) for c in centres] + [rng.standard_normal((200, d))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("chunk", [2_048, 6])
def test_embeddings_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    x = embed_rows(1)
    x = np.concatenate([x, x[:3], np.zeros((1, 64))])
    rows = [(k, [float(v) for v in r], "clash", 1) for k, r in enumerate(x)]
    rows += [(900, None, None, None), (901, [None] * 64, None, None), (902, [float("nan")] * 64, "", 2), (None, [float(v) for v in x[0]], "", 3), (903, [1.0, 2.0], "", 1), (904, [], "", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, f int")
    got = embed_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    y = np.concatenate([x, x[:1]])
    n = np.linalg.norm(y, axis=1)
    s = (y @ y.T) / np.maximum(np.outer(n, n), 1e-300) >= 0.9
    np.fill_diagonal(s, False)
    s[n == 0] = s[:, n == 0] = False
    root = closure(len(y), zip(*np.nonzero(s)))
    mine = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id < 900}
    assert all(mine[k].component_id == root[k] for k in range(len(x)))
    assert all(mine[k].n_links <= s[k].sum() for k in range(len(x)))  # never a link below the threshold
    assert sum(r.n_links for r in mine.values()) >= 0.98 * s[: len(x)].sum()
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id is not None and r.vec_id >= 900)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("d,n", [(64, 50_000), (64, 5_000_000), (64, 100_000_000), (768, 50_000), (768, 100_000_000)])
def test_embedding_recall_at_the_threshold(d, n):
    rng = np.random.default_rng(1)
    code = embed_dedup.Code(d, n, 0.9)
    x, y = rng.standard_normal((200, d)), rng.standard_normal((200, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.9 * x + np.sqrt(1 - 0.81) * y
    (f, at), (g, to) = code.filters(x), code.filters(z)
    met = [len(np.intersect1d(f[a:b], g[c:e])) > 0 for a, b, c, e in zip(at, at[1:], to, to[1:])]
    assert np.mean(met) >= 0.9


def test_embedding_filters_are_those_above_the_cap():
    code, rng = embed_dedup.Code(12, 5_000, 0.9), np.random.default_rng(3)
    x = rng.standard_normal((40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got, at = code.filters(x)
    for k in range(len(x)):
        want = set()
        for t, (turn, left, right) in enumerate(code.codes):
            y = x[k] @ turn
            a, b = left @ (y[:6] / np.linalg.norm(y[:6])), right @ (y[6:] / np.linalg.norm(y[6:]))
            high = a[:, None] + b[None, :]
            for i, j in [*zip(*np.nonzero(high >= 2 * code.cap)), divmod(int(high.argmax()), code.words)]:
                want.add((t * code.words + int(i)) * code.words + int(j))
        assert got[at[k] : at[k + 1]].tolist() == sorted(want)


def test_topk_sql_and_ties(spark, sf_dir, same):
    same(topk.query(spark, sf_dir), topk.SQL)


def test_topk_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((80, 4)), 1)
    rows = [(k, [float(v) for v in r], "q") for k, r in enumerate(x)] + [(k, [1.0] * 4, "q") for k in range(100, 140)]
    rows += [(200, None, ""), (201, [float("inf"), 0.0, 0.0, 0.0], ""), (None, [1.0] * 4, ""), (202, [None, 1.0, 1.0, 1.0], ""), (300, [2.0, 1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ok = [(i, np.floor(1024 * np.array(v))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:7]
            assert got.get(i, {}) == {k + 1: (j, -s) for k, (s, j) in enumerate(best)}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_url_sql(spark, sf_dir, same):
    same(url_filter.query(spark, sf_dir), url_filter.SQL)


def test_url_redirects_and_odd_rows(spark):
    rows = [
        (1, "http://a.net/x", '<link rel="canonical" href="http://b.com/de/1">'), (2, "http://c.net/", '<meta http-equiv="refresh" content="0; url=http://a.net/x#f">'),
        (3, "http://b.com/fr/2", "<LINK href=/de/1 rel=canonical>"), (4, None, None), (5, "nohost", "<link>"), (6, "http://B.com/de/1", None),
        (6, "http://B.com/de/1", None), (7, "http://example.org/en/1", ""), (8, "http://sub.example.org/en/2", ""), (None, "http://x.net", "y"), (9, "http://org/", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    verdicts = {k: r.verdict for k, r in got.items()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", None: "allow", 9: "allow"}
    assert got[7].rule == "example.org/en/1" and got[9].rule == "org/" and got[5].host == "" and got[6].host == "b.com"
    hops = spark.createDataFrame([("http://x.net", "http://c.net/"), (None, "http://a.net/x")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, hops).collect()}[None] == "block"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_targets_are_resolved(spark):
    base = "http://a.net/q/r/s?old=1"
    want = {
        "/x?a=1&amp;b=2": "http://a.net/x?a=1&b=2", "../../x?a=1&amp;b=2": "http://a.net/x?a=1&b=2", "?page=2": "http://a.net/q/r/s?page=2",
        "./t": "http://a.net/q/r/t", "..": "http://a.net/q/", "/a/./b/../c": "http://a.net/a/c", "//b.com/../y": "http://b.com/y", "https://b.com/z/../y?c=/../": "https://b.com/y?c=/../", "ftp://x/..": "ftp://x/..", "#f": base + "#f",
        "http://b.com/é?u=1&copy=2": "http://b.com/é?u=1&copy=2", "t?to=http://z/&#38;k": "http://a.net/q/r/t?to=http://z/&k", "../../../../é": "http://a.net/é",
    }
    assert dict(zip(want, url_filter.resolved(base, list(want)))) == want
    assert url_filter.resolved("http://b.com", ["?x", "y", ""]) == ["http://b.com/?x", "http://b.com/y"]
    link = '<link rel="canonical" href="{}">'.format
    rows = [(1, "http://a.net/x?a=1&b=2", link("http://b.com/de/1")), (2, "http://c.net/", link("http://a.net/x?a=1&amp;b=2")), (3, "http://a.net/q/r/s", link("../../x?a=1&amp;b=2")),
            (4, "http://a.net/x", link("?a=1&amp;b=2")), (5, "http://a.net/z", link("?a=1"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, sf_dir), "t")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2]
    got = p.run(spark, sf_dir)
    assert got.count() == sizes[-1] and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "part", "row"]


def test_stages_take_odd_documents(spark, sf_dir, odd_docs, no_docs):
    import corpus_pipeline as p

    for docs in (odd_docs, no_docs):
        for _, stage in p.STAGES:
            stage(spark, docs, sf_dir).count()


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


def test_hot_keys_are_joined_once(spark):
    from pyspark.sql import functions as F

    from pagelake.llm.shared import join_unique

    rows = spark.range(6_000).selectExpr("CASE WHEN id < 3000 THEN 0 ELSE id END AS k", "id AS v")
    unique = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    got = join_unique(rows, unique, ["k"], "n", 6_000)
    assert got.columns == ["k", "v", "low"] and got.count() == 6_000 and got.where("k = 0 AND low = 0").count() == 3_000
    assert got.where("k <> 0 AND low <> v").count() == 0
