import random

import pytest

#: Names that the operators use inside themselves, by exact name and by case only.
CLASHING = ["shard", "fp", "h1", "c0_", "n_words", "kept", "base", "spans", "row_key", "s_", "new_text", "exact", "component", "DOC_ID", "Text", "first", "ids", "part"]


def words(rng, n, size=400):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, wordless, very long, tied and repeated texts; null and repeated ids."""
    rng = random.Random(7)
    plain = words(rng, 120)
    long = "\n".join(words(rng, 40) for _ in range(300))
    rows = [
        (1, None), (2, ""), (3, " \n\t\n "), (4, "..."), (5, plain), (6, plain), (6, plain), (7, plain + " end"), (None, plain), (None, None),
        (8, long), (9, "x" * 50_000), (10, "one"), (11, "two words"), (12, "日本語 😀   a b"), (13, "a\r\nb\r\n\r\nc"), (14, "#" * 300 + " a b c"),
        (6, "another text under a known id"), (15, "\n".join(["same line of several words here and there again and again"] * 5)),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with lang, source, n_chars and columns of clashing names around them."""
    kinds = ", ".join(f"`{c}` string" for c in CLASHING[:9]) + ", doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING[9:])
    rows = [(*["?"] * 9, i, t, "en", "src", len(t or ""), *["?"] * (len(CLASHING) - 9)) for i, t in odd_rows]
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame(rows, kinds)
    spark.conf.set("spark.sql.caseSensitive", "false")
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def texts(data):
    """id and text of the small table."""
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{data}/documents.parquet')").fetchall()
