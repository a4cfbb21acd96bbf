import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case: nulls, empty and long texts, repeated rows and ids, clashing extra columns."""
    en, de = "the and of in that with for this is are ", "der die das und ist nicht mit auf ein eine "
    rows = [
        (0, en * 8, "en", "a"), (1, de * 8, "de", "a"), (2, None, "en", None), (3, "", None, "b"), (4, "12345 !!", "en", "b"),
        (5, en * 8, "en", "a"), (5, en * 8, "en", "a"), (None, "words without an id", "en", "a"), (6, "x" * 5000 + " " + en * 3000, "en", "a"),
        (7, "tabs\tand\x0bnew\nlines\r\n\n  many   spaces ", "en", "c"), (8, "日本語 と ▁ \U0001f600 é", None, "c"), (9, en * 8 + "word", "en", "a"),
        (10, "Mail a.b@c.org or call +49 (030) 1234-567, host 10.0.0.1, card 4111 1111 1111 1111.", "en", "a"), (11, "A B C", "en", "c"), (12, "a b c", "de", "c"),
    ]
    extra = ", fp long, shard int, k long, score double, _t string, rank int"
    return spark.createDataFrame([(*r, 0 if r[1] is None else len(r[1]), 1, 2, 3, 0.5, "x", 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + extra)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
