"""Whole queries and the whole pipeline against plain, slow versions of themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagelake.llm import bpe, line_dedup, mixing, pii, quality_mil, secrets, simhash, topk, url_filter

from .test_search import closure, slow_fingerprint
from .test_texts import brute_lines, naive_pii, naive_secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())


def test_bpe_query(spark, sf_dir, docs, library):
    want = {r.doc_id: digests(library, r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(spark, sf_dir).collect()} == want


def test_bpe_caches_are_bounded_by_size(docs, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 40)
    coder = bpe.Bpe(open(bpe.vocabulary(), encoding="utf-8").read())
    for r in docs.limit(60).collect():
        raw = next(coder.encode_texts([r.text]))
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids
    list(coder.encode_texts(["x" * 64 * 50]))
    assert coder.held["chunks"] > 50
    list(coder.encode_texts(["y"]))
    assert len(coder.chunks) <= 10


# quality


def slow_passages(text):
    """Features of each passage, word by word."""
    low, out = text.lower(), []
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    upper, lower_, other = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set(b"abcdefghijklmnopqrstuvwxyz"), set(range(128, 256))
    digit, stop = set(b"0123456789"), set(b".,;:?'\"-()")
    rest = {b for b in range(33, 127) if not chr(b).isalnum()} - stop - set(b"!|")
    for k in range(0, len(spans), 64):
        words = spans[k : k + 64]
        a, z = words[0][0], spans[k + 64][0] if k + 64 < len(spans) else len(text) + 1
        raw = (text + b" ")[a:z]
        row = [sum(b in c for b in raw) / len(raw) for c in (upper, lower_, digit, other, stop, {33}, {124}, rest, {10})]
        n, sizes = len(words), [e - s for s, e in words]
        mean = sum(sizes) / n
        said = [low[s:e] for s, e in words]
        row += [mean / 10, math.sqrt(max(sum(x * x for x in sizes) / n - mean**2, 0)) / 10, len(set(said)) / n]
        row += [sum(x == y for x, y in zip(said, said[1:])) / n, sum(text[s] in upper for s, _ in words) / n]
        row += [sum(text[s] in upper and text[e - 1] in upper for s, e in words) / n, sum(text[e - 1] not in upper | lower_ | other for _, e in words) / n]
        row += [sum(x <= 3 for x in sizes) / n, math.log1p(n) / 5]
        out.append(row)
    return out


def slow_score(model, text):
    """Gated attention over the passages, one after another."""
    rows, p = slow_passages(text), model.p
    if not rows:
        return 0.0
    codes, weights = [], []
    for row in rows:
        x = np.clip((np.array(row) - model.mean) / model.scale, -8, 8)
        h = np.array([math.tanh(sum(x * p["w"][:, j]) + p["wb"][j]) for j in range(len(p["wb"]))])
        gate = [math.tanh(h @ p["v"][:, j]) / (1 + math.exp(-(h @ p["u"][:, j]))) for j in range(p["v"].shape[1])]
        codes.append(h)
        weights.append(math.exp(float(np.dot(gate, p["a"]))))
    z = sum(w * h for w, h in zip(weights, codes)) / sum(weights)
    return 1 / (1 + math.exp(-(float(z @ p["c"]) + p["b"][0])))


@pytest.fixture(scope="module")
def model(spark, sf_dir, docs):
    return quality_mil.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def test_quality_query(spark, sf_dir, docs, model):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = quality_mil.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == (r.score >= 0.5)
        assert abs(r.score - slow_score(model, texts[r.doc_id])) < 1e-6, r.doc_id


def test_quality_fits_all_passages_of_a_long_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_mil.Model, "fit", lambda self, bags, y: seen.extend(bags) or self)
    df = spark.createDataFrame([(1, "w " * 64 * 700), (2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4, 5, 6)], "doc_id long, quality int")
    quality_mil.train(df, labels)
    sizes = sorted(len(b) for b in seen)
    assert sizes and sizes[-1] in (1, 700)
    held = {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in (1, 2)}
    assert sizes == sorted(n for k, n in ((1, 700), (2, 1)) if not held[k])


# personal data and secrets


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def slow_more_pii(text):
    """Account numbers by trying every end, social-security numbers by pattern, each with its words nearby."""
    out, done = [], 0
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}", text):
        if m.start() < done:
            continue
        ends, end, n = [], m.end(), 0
        while n < 30:
            nxt = end + 1 if text[end : end + 1] == " " and re.match("[A-Z0-9]", text[end + 1 : end + 2]) else end
            if not re.match("[A-Z0-9]", text[nxt : nxt + 1]):
                break
            end, n = nxt + 1, n + 1
            if n >= 11 and not re.match("[A-Za-z0-9]", text[end : end + 1]):
                ends.append(end)
        good = [e for e in ends if pii.mod97(text[m.start() : e].replace(" ", ""))]
        known = pii._IBAN_LENGTH.get(m[0][:2])
        fits = [e for e in good if known is None or len(text[m.start() : e].replace(" ", "")) == known or e == ends[-1]]
        if fits:
            best = next((e for e in reversed(fits) if len(text[m.start() : e].replace(" ", "")) == known), fits[-1])
            out.append(("iban", m.start(), best))
            done = best
    for m in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", text):
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
            near = re.findall("[a-z]+", (text[max(0, m.start() - 40) : m.start()] + " " + text[m.end() : m.end() + 40]).lower())
            score = 0.4 + 0.3 * any(w in near for w in "ssn social security taxpayer".split()) - 0.2 * any(w in near for w in "part serial invoice".split())
            if round(score, 2) >= 0.5:
                out.append(("ssn", *m.span()))
    return out


PLANTED = [
    "pay DE89370400440532013000 BIC COBADEFF", "GB82 WEST 1234 5698 7654 32 2024-01-01", "GB82WEST12345698765432 USD 500", "my ssn 123-45-6789" + " and so on" * 9 + " part 123-45-6788",
    "mail a.b@c.example.org or +49 30 123456-7, card 4111 1111 1111 1111", "AUTH=wJalrXUtnFEMI7K7MDENGbPxRfiCYzz9Qk2 password: hunter2hunter2 " + "0123456789abcdef" * 2, "", None,
]


def test_pii_query(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(-k, t) for k, t in enumerate(PLANTED, 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    for i, t in texts:
        base, r = naive_pii(t or ""), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert r.base_sha256 == sha(joined(base).encode()) and r.spans == joined(base + slow_more_pii(t or ""))
        assert len(r.scores.split(",")) == len(r.spans.split(",")) and all(not s or 0 <= float(s) <= 1 for s in r.scores.split(","))
    assert sum("iban" in got[-k].spans for k in (1, 2, 3)) == 3 and got[-4].spans.count("ssn") == 1


def slow_entropy(text, taken):
    """Windows one by one, each with its own counts, joined where they touch."""
    out = []
    for pattern, least in secrets.CLASSES.values():
        new = []
        for m in pattern.finditer(text):
            bare = m[0].rstrip("=")
            short = len(bare) < secrets.WINDOW
            if any(a.fullmatch(bare if short else m[0]) for a in (secrets.ALLOW_SHORT if short else secrets.ALLOW)):
                continue
            size, bar, s = (12, least * math.log2(12) / math.log2(24), bare) if short else (24, least, m[0])
            cover = set()
            for k in range(len(s) - size + 1):
                n = Counter(s[k : k + size])
                if -sum(c / size * math.log2(c / size) for c in n.values()) >= bar - 1e-9:
                    cover.update(range(k, k + size))
            runs = [k for k in sorted(cover) if k - 1 not in cover]
            for a in runs:
                z = a
                while z in cover:
                    z += 1
                a, z = a + m.start(), z + m.start()
                if all(z <= x or a >= y for x, y in taken):
                    new.append((a, z))
        out += new
        taken = taken + new
    return [("entropy", a, z) for a, z in out]


def test_secrets_query(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(-k, t) for k, t in enumerate(PLANTED, 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.digest(df).collect()}
    for i, t in texts:
        base, r = naive_secrets(t or ""), got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in secrets.BASE]
        assert r.base_sha256 == sha(joined(base).encode())
        more = slow_entropy(t or "", [s[1:] for s in base])
        assert r.spans == joined(sorted(base + more, key=lambda s: (s[1], secrets.KINDS.index(s[0]))))
    assert "entropy" in got[-6].spans and got[-6].n_assign == 1 and got[-6].n_hex == 1


def test_secrets_are_linear_in_spans():
    import time

    text = "password=abcdefghijkl wJalrXUtnFEMI7K7MDENGbPxRfiCYzz9Qk2 " * 35_000
    began = time.process_time()
    assert len(secrets.find(text)) == 70_000
    assert time.process_time() - began < 20


# search


def test_every_link_comes_out_of_the_index(spark, monkeypatch):
    """All links of the table are among what searches of Gray trees reach, group by group, and nothing else yields links."""
    large = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")  # smaller ones hold no near copies that differ
    rows = simhash.fingerprints(large).select("fp").distinct().toPandas()["fp"].to_numpy().view(np.uint64)
    want = {tuple(sorted((int(a), int(b)))) for k, a in enumerate(rows) for b in rows[:k][np.bitwise_count(rows[:k] ^ a) <= 2]}
    found, trees = set(), []
    for c in range(3):
        key = rows & np.uint64(simhash.path_masks(4 | c)[0])
        rank = rows.copy()
        for k in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(k)
        order = np.lexsort((rank, key))
        fps, key = rows[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        index = simhash.GrayIndex(fps, first)
        for i, j in index.pairs():
            assert (key[i] == key[j]).all()
            found |= {tuple(sorted((int(fps[a]), int(fps[b])))) for a, b in zip(i, j)}
        trees.append(index.compared)
    assert found == want and want and all(trees)
    monkeypatch.setattr(simhash.GrayIndex, "pairs", lambda self: iter(()))
    empty = [x for x in simhash._group_pairs(np.zeros(9, np.int64), np.zeros(9, np.int64), np.arange(9, dtype=np.uint64))]
    assert empty == []


def test_forest_equals_all_pairs_in_groups():
    rng = np.random.default_rng(8)
    sizes = [1, 2, 3, 40, 700, 1, 5, 17, 16, 4]
    groups = [np.unique(rng.integers(0, 1 << 12, n, dtype=np.uint64)) for n in sizes]
    rank = []
    for g in groups:
        r = g.copy()
        for k in (1, 2, 4, 8, 16, 32):
            r ^= r >> np.uint64(k)
        rank.append(g[np.argsort(r)])
    fps, first = np.concatenate(rank), np.cumsum([0] + [len(g) for g in rank])[:-1]
    got = [(int(i), int(j)) for a, b in simhash.GrayIndex(fps, first).pairs() for i, j in zip(a, b)]
    group = np.repeat(np.arange(len(rank)), [len(g) for g in rank])
    i, j = np.nonzero(np.triu((np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2) & (group[:, None] == group[None, :]), 1))
    assert sorted(got) == sorted(zip(i.tolist(), j.tolist()))


def test_keep_one_goes_by_row_not_id(spark):
    words = lambda s: " ".join(f"{s}{k}" for k in range(50))
    a, b, d = words("a"), words("b"), words("d")
    rows = [(1, a, "x"), (2, b, "x"), (2, d, "x"), (3, d, "y"), (2, b, "y"), (None, a, "z"), (None, "only here", "z"), (None, "only here", "z"), (5, None, "n"), (6, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(df).collect())
    assert kept == sorted([(1, a), (2, b), (2, d), (0, "only here"), (5, None)], key=lambda r: (r[0], r[1] or ""))
    again = sorted((r.doc_id or 0, r.text, r.source) for r in simhash.keep_one(df.repartition(7)).collect() if r.text)
    assert again == sorted((r.doc_id or 0, r.text, r.source) for r in simhash.keep_one(df).collect() if r.text)


@pytest.mark.parametrize("n", [1, 3, 6, 11])
def test_topk_with_few_candidates_and_repeated_ids(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k % max(1, n - 1)), [float(v) for v in rng.standard_normal(5)]) for k in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = {}
    for i, v in rows:
        v = [math.floor(1024 * x) for x in v]
        asked[i] = max(asked.get(i, v), v)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df).collect())
    want = []
    for i, q in asked.items():
        best = sorted((-sum(x * math.floor(1024 * y) for x, y in zip(q, v)), j) for j, v in rows if j != i)[:10]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_topk_histograms_count_every_score(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS vec_id", "transform(sequence(1, 4), k -> double(pmod(hash(id, k), 97)) / 97) AS embedding")
    seen = []
    real = topk._Cell.count

    def count(self, row):
        real(self, row)
        seen.append(self.counts.sum())

    cell = {"d": 4, "ranges": [{"query_id": 7, "low": -1e7, "width": 2e7}]}
    v = topk.quantised(df).toPandas()
    x = np.stack(v["v"].to_numpy())
    q = topk._Cell(cell | {"ids": np.array([7]).tobytes(), "data": x[7:8].tobytes()})
    count(q, {"d": 4, "ids": v["vec_id"].to_numpy().tobytes(), "data": x.tobytes()})
    assert seen == [299]  # all but itself
    assert 10 <= sum(sum(part.column(2).to_pylist()) for part in q.sent(10))
    with pytest.raises(ValueError):
        big = spark.createDataFrame([(1, [1e9] * 4), (2, [1e9] * 4)], "vec_id long, embedding array<double>")
        topk.top_k(big, big).collect()


# URLs


def test_rules_beyond_an_expression(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    some = pages.select(url_filter.host_of(pages.url).alias("h"), url_filter.path_of(pages.url).alias("p")).distinct().collect()
    rules = list(url_filter.RULES) + [("block", r.h, r.p[: 1 + k % 5]) for k, r in enumerate(some)] + [("allow", r.h.split(".", 1)[-1], r.p[:3]) for r in some[::3]]
    rules = sorted(set(rules))
    few = url_filter.with_rule(pages.select("page_id", url_filter.host_of(pages.url).alias("host"), url_filter.path_of(pages.url).alias("path")), rules)
    many = url_filter.with_rule(few.drop("_rule"), rules, most=3)
    key = lambda df: sorted((r.page_id, r._rule and tuple(r._rule)) for r in df.collect())
    assert key(few) == key(many) and sum(r is not None for _, r in key(many)) > 10
    assert url_filter.judge(pages, rules=[("block", f"h{k}.net", "/") for k in range(3_000)]).where("verdict = 'block'").count() == 0


def test_url_components_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    rules = (("block", "bad.net", "/x"), ("allow", "good.net", "/"))
    hosts = ["bad.net", "good.net", "a.net", "b.net", "c.net"]
    rows = []
    for k in range(300):
        url = f"http://{rng.choice(hosts)}/{rng.choice('xyz')}{k}"
        rows.append([k, url, "<p>"])
    for k in rng.sample(range(300), 220):
        to = rows[rng.randrange(300)][1].replace("&", "&amp;")
        mark = f'<link href="{to}" rel=canonical>' if rng.random() < 0.6 else f'<meta content="3;URL={to}" http-equiv=Refresh>'
        rows[k][2] = mark
        rows[k].append(rows[[r[1] for r in rows].index(to)][0])
    edges = [(r[0], r[3]) for r in rows if len(r) > 3]
    root = closure(300, edges)
    own = {r[0]: "block" if r[1].startswith("http://bad.net/x") else "allow" if "good.net" in r[1] else None for r in rows}
    bad = {root[k] for k, v in own.items() if v == "block" and any(k in e for e in edges)}
    want = {k: v or ("block" if root[k] in bad else "allow") for k, v in own.items()}
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, rules=rules).collect()} == want and len(set(want.values())) == 2


# line dedup


def test_line_rows_stay_below_one_a_line(spark):
    df = spark.range(50).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 400), k -> concat('w', hash(id, k), ' x y')), '\\n') AS text")
    n = line_dedup._positions(df, 50).count()
    assert n < 0.25 * 50 * 400


def test_line_count_gives_way_to_its_own_name(spark):
    df = spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, _removed_lines int")
    got = line_dedup.drop_repeated_runs(df)
    assert got.columns == ["doc_id", "text", "_removed_lines"] and got.first()._removed_lines == 0


# the pipeline


def slow_mix(rows):
    """doc_ids in training order."""
    sized = [(r["source"], hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"], len(WORD.findall(r["text"]))) for r in rows]
    names = sorted({s[0] for s in sized}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    tilt = {s: (0.5, 0.0, -0.5)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(x[3] for x in sized if x[0] == s) for s in names}
    capped = set()
    while True:
        rest = float(sum(total.values())) - sum(3.0 * total[s] for s in sorted(capped, key=str))
        level = rest / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and 3.0 * total[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    target = {s: 3.0 * total[s] if s in capped else level * weight[s] for s in names}
    out = []
    for s in names:
        before = 0
        for _, _, i, size in sorted(x for x in sized if x[0] == s):
            copies = max(0, math.ceil((target[s] - before - size * 0.5) / total[s]))
            for turn in range(copies):
                share = (turn * total[s] + before + size * 0.5) / target[s]
                t = tilt[s]
                at = share if t == 0 else (math.sqrt(max(0.0, (1 - t) ** 2 + 4 * t * share)) - (1 - t)) / (2 * t)
                out.append((at, i, turn))
            before += size
    return [i for _, i, _ in sorted(out)]


def test_pipeline_equals_brute_force(spark, sf_dir, docs, model, library):
    import corpus_pipeline as p

    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if slow_score(model, (r["text"] or "").encode()) >= 0.5]
    texts = brute_lines([(r["doc_id"], r["text"]) for r in rows], 50)
    rows = [r | {"text": texts[r["doc_id"]]} for r in rows if texts[r["doc_id"]] == r["text"] or WORD.search(texts[r["doc_id"]])]
    fps = np.array([slow_fingerprint(r["text"]) for r in rows], np.uint64)
    root = closure(len(rows), zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)))
    first = {}
    for k, r in enumerate(rows):
        first[root[k]] = min(first.get(root[k], r["doc_id"]), r["doc_id"])
    rows = [r for k, r in enumerate(rows) if first[root[k]] == r["doc_id"]]
    by = {r["doc_id"]: digests(library, r["text"]) for r in rows}
    want = [(i, *by[i]) for i in slow_mix(rows)]
    got = p.run(spark, sf_dir).orderBy("part", "row").collect()
    assert [tuple(r)[:4] for r in got] == want
    assert len({(r.part, r.row) for r in got}) == len(got)


def test_training_place(spark, docs, tmp_path):
    order = [r.doc_id for r in mixing.training_order(docs).collect()]
    path = str(tmp_path / "mixed")
    mixing.training_order(docs).write.parquet(path)
    back = mixing.training_place(spark.read.parquet(path).withColumnRenamed("lang", "part"))
    assert back.columns.count("part") == 1 and [r.doc_id for r in back.orderBy("part", "row").collect()] == order
    loose = mixing.training_place(spark.createDataFrame([(1,)], "doc_id long"))
    assert loose.first().part is None
