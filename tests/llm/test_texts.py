"""BPE, personal data, secrets, line dedup, mixing, quality: brute force and odd input."""

import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagelake.llm import bpe, line_dedup, mixing, pii, quality_mil, secrets


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(open(bpe.vocabulary(), encoding="utf-8").read())


ODD = [
    "", "  ", "It's I'LL dOn't", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ ΟΔΟΣ", "İstanbul ǅ ﬁ", "x\x1cy z\x85w　q", "²³ Ⅷ १२ 한국어 é",
    "aaaaaaaaaaaa" * 40, "%%%%###" * 50, "<|endoftext|", "😀👨‍👩‍👧 t", "a​b", "'S 'Re  ''s", "\x00\x01a", "̀a ́",
]


def test_bpe_equals_the_library(coder):
    library = Tokenizer.from_file(bpe.vocabulary())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abeinthr .,!é") for _ in range(rng.choice([3, 30, 70, 300]))) for _ in range(200)]
    for text, raw in zip(texts, coder.encode_texts(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == want, text
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False) == coder.decode_bytes(raw).decode()


def test_bpe_long_word_is_n_log_n(coder):
    ids, _ = coder.symbols([b"inthe" * 20_000])
    assert len(coder.merge_one(ids.tolist())) > 0


def test_bpe_batch_and_single_trees_agree(coder):
    for w in ("internationalisation", "aaaa", "a", "ththththth"):
        ids, _ = coder.symbols([w.encode()])
        assert coder.merge_one(ids.tolist()) == coder.encode(w)


def test_bpe_odd_input(spark, odd_docs, no_docs):
    got = bpe.encode_documents(odd_docs, bpe.vocabulary(), digest=True)
    assert got.count() == odd_docs.count() and got.where("doc_id = 2").first().n_tokens == 0
    assert bpe.encode_documents(no_docs, bpe.vocabulary(), digest=True).count() == 0
    ids = bpe.encode_documents(odd_docs, bpe.vocabulary())
    back = bpe.decode_documents(ids, bpe.vocabulary())
    assert back.where("doc_id = 7").first().text == "x</w>"
    assert back.count() == odd_docs.count()


def naive_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def naive_secrets(t):
    words = "password passwd secret token api_?key".split()
    cased = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)
    out = []
    for m in re.finditer(rf"""({cased})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))


def test_spans_equal_naive_patterns():
    rng = random.Random(2)
    parts = ["a@", "b.", "1.", "25", "0-", "4 ", "+1", "(3", ".", "@", "9", "é", "token", '="', "AKIA", "ABCDEF123", "deadbeef",
             "Password: ", "api_key=", "'", '"', "5105105105105100", "abc.def", "ſecret:", "toKen:"]
    for _ in range(5_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t) == naive_pii(t), t
        assert secrets.base_spans(t) == naive_secrets(t), t


def test_added_spans():
    t = "pay to GB82 WEST 1234 5698 7654 32 now, ssn 123-45-6789" + " and so on" * 9 + " part 123-45-6788"
    assert [s.kind for s in pii.find(t)] == ["iban", "ssn"]
    assert pii.find("GB82 WEST 1234 5698 7654 33") == []
    t = 'k "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzz9Qk2" 123e4567-e89b-12d3-a456-426614174000 ' + "ab" * 20
    assert [s[0] for s in secrets.find(t)] == ["entropy", "hex"]


def test_iban_before_capitals_and_numbers():
    german, british = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    other = "ZZ" + next(f"{k:02d}" for k in range(98) if pii.mod97(f"ZZ{k:02d}12345678901")) + "12345678901"  # of no country
    for code in (german, british, other, "NO9386011117947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for before in ("", "AB12 CDEF 3456 7890 ", "IBAN "):
            for after in ("", " BIC COBADEFF", " 12 times", " USD 500", " EUR", " Bank", ", 7", " " + german):
                t = before + code + after
                want = [code] + [german] * after.endswith(german)
                assert [t[s.start : s.end] for s in pii.find(t) if s.kind == "iban"] == want, t
    assert pii.find(german[:-1] + "1 BIC COBADEFF") == []


def test_entropy_after_equals_and_in_short_strings():
    long_, short = "wJalrXUtnFEMI7K7MDENGbPxRfiCYzz9Qk2", "x7Kq9Lm2Zt4w"
    for value in (long_, short, long_ + "==", "A7F09C3E51BD", "Zk3vQ8pL1nXw5RtY7bHs2Dc"):
        bare = value.rstrip("=")
        for before, after in (("AUTH=", ""), ("GH_PAT=", "\n"), ("https://h/p?a=1&sig=", "&z"), ('x="', '"'), ("AUTH: ", " "), ("k=", "=1")):
            if after == "=1" and value != bare:
                continue
            (kind, a, b), = secrets.find(t := before + value + after)
            assert kind == "entropy" and t[a:b].startswith(bare), t
    for t in ("copyright2024", "k=covid-19-vaccine", "configuration=", "2024-01-15T10", "x=/2024/01/post-7", "NAME=x86_64-linux-gnu", "k=Zz1Zz1Zz1Zz1"):
        assert secrets.find(t) == [], t
    assert [s[0] for s in secrets.find(f"password={short} sig={short}")] == ["assign", "entropy"]


def test_entropy_is_that_of_the_window():
    import math
    from collections import Counter

    rng = random.Random(3)
    for _ in range(50):
        t = "".join(rng.choice("abcdefgh01234567") for _ in range(60))
        for least in (2.5, 3.2):
            want = set()
            for k in range(len(t) - secrets.WINDOW + 1):
                n = Counter(t[k : k + secrets.WINDOW])
                h = -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in n.values())
                if h >= least - 1e-9:
                    want.update(range(k, k + secrets.WINDOW))
            got = {x for a, b in secrets.entropy_runs(t, least) for x in range(a, b)}
            assert got == want


def test_span_operators_on_odd_input(odd_docs, no_docs):
    for m in (pii, secrets):
        assert m.digest(odd_docs).count() == odd_docs.count()
        assert m.digest(no_docs).count() == 0
    assert pii.personal_data(odd_docs).count() == odd_docs.count()
    assert secrets.secrets(odd_docs).count() == odd_docs.count()


def brute_lines(docs, least):
    """Deleted lines by comparing every run with every earlier run."""
    seqs = [(i, [(k, tuple(x.split())) for k, x in enumerate(t.split("\n")) if x.split()]) for i, t in docs]
    seen, gone = {}, {i: set() for i, _ in docs}
    runs = []
    for i, seq in seqs:
        for a in range(len(seq)):
            words = 0
            for b in range(a, len(seq)):
                words += len(seq[b][1])
                if words >= least:
                    inner = words - len(seq[a][1]) < least or words - len(seq[b][1]) < least
                    if inner:
                        runs.append((tuple(x for _, x in seq[a : b + 1]), (i, seq[a][0]), i, seq[a][0], seq[b][0]))
    for key, place, *_ in runs:
        seen[key] = min(seen.get(key, place), place)
    for key, place, i, s, e in runs:
        if place > seen[key]:
            gone[i].update(range(s, e + 1))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(12)] + ["", "  "]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_runs(df, min_words=10).collect()}
    assert got == brute_lines(docs, 10)


def test_line_dedup_odd_input(odd_docs, no_docs):
    got = line_dedup.drop_repeated_runs(odd_docs)
    assert got.columns == [*odd_docs.columns, "_removed_lines"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert [r.text for r in rows if r.doc_id == 5] == ["own two", "own two"]
    assert next(r for r in rows if r.doc_id == 1).text.endswith("own one") and next(r for r in rows if r.doc_id == 2).text is None
    assert all(r.score == "clash" for r in rows)
    assert line_dedup.drop_repeated_runs(no_docs).count() == 0


def test_line_dedup_shared_by_many(spark):
    shared = " ".join(f"p{k}" for k in range(60))
    df = spark.range(500).selectExpr("id AS doc_id", f"concat('head ', id, '\\n{shared}\\ntail ', id) AS text")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_runs(df).collect()}
    assert shared in got[0] and not any(shared in t for i, t in got.items() if i)
    assert all(f"head {i}" in t and f"tail {i}" in t for i, t in got.items())


def test_mixing_sql(spark, sf_dir, same):
    same(mixing.query(spark, sf_dir), mixing.SQL)


def test_mixing_totals(spark):
    df = spark.range(3_000).selectExpr(
        "id AS doc_id", "repeat('w ', int(id % 17)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source"
    )
    rows = mixing.mix(df).collect()
    by = {}
    for r in rows:
        t = by.setdefault(r.source_size, [r.target, 0])
        t[1] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(taken - target) <= 17 for target, taken in by.values())
    assert sorted(map(tuple, mixing.mix(df).collect())) == sorted(map(tuple, rows))


def test_mixing_odd_input(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.size for r in rows if r.doc_id == 2} == {0}
    assert mixing.mix(no_docs).count() == 0
    order = mixing.training_order(odd_docs)
    assert order.columns == odd_docs.columns
    assert order.where("text <> ''").count() == sum(r.copies for r in rows if r.size or r.doc_id == 6)
    assert mixing.training_order(no_docs).count() == 0


def test_quality_gradients():
    rng = np.random.default_rng(0)
    m, x, first, y = quality_mil.Model(5), rng.standard_normal((9, 5)), np.array([0, 3, 4]), np.array([1.0, 0, 1])
    grad = m.gradients(first, *m.forward(x, first), y)

    def loss():
        o = m.forward(x, first)[0]
        return np.mean(np.log1p(np.exp(o)) - y * o)

    for k, v in m.p.items():
        i = tuple(0 for _ in v.shape)
        v[i] += 1e-6
        up = loss()
        v[i] -= 2e-6
        down = loss()
        v[i] += 1e-6
        assert abs((up - down) / 2e-6 - grad[k][i]) < 1e-6


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_mil.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 80 and np.mean([r.predicted == r.quality for r in got]) >= 0.95


def test_quality_passages_are_exact():
    texts = [b"One two THREE\n four", b"", b"  ", b"a " * 150]
    bag, x = quality_mil.passages(texts)
    assert bag.tolist() == [0, 3, 3, 3] and x.shape == (4, quality_mil.FEATURES)
    again = quality_mil.passages([texts[3]])[1]
    assert np.allclose(x[1:], again)


def test_quality_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 0), (None, 1), (5, None), (4, 1)], "doc_id long, quality int")
    model = quality_mil.train(odd_docs, labels)
    rows = quality_mil.classify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (2, 3, 6)} == {0.0}
    assert quality_mil.train(odd_docs, labels.limit(0)) is None
    assert quality_mil.classify(no_docs, model).count() == 0
    kept = quality_mil.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert quality_mil.keep_good(no_docs, labels).count() == 0
