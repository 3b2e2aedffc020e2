import pytest

CLASH = "_row _size _hash _source size score taken fp n node path key spans ids target _score _id _runs _mix_at root".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ties, extra columns with clashing names."""
    long_ = " ".join(f"w{k % 977}" for k in range(60_000)) + "\n" + "z" * 50_000
    line = " ".join(["alpha", "beta", "gamma"] * 20)
    rows = [
        (1, line + "\nown one", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id here", "en", None, 3),
        (4, long_, "de", "b", 9), (5, line + "\nown two", "en", "a", 5), (5, line + "\nown two", "en", "a", 5), (6, "  \n\t ", "en", "ü", 1),
        (None, None, None, "a", None), (7, "x", "fr", "b", 1), (8, "Café \U0001f600 <|endoftext|> ΣΑΣ", "fr", "b", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASH:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
