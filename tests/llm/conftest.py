import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{k % 997} and{k}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, null ids, and columns named like the operators' own."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
        (4, LONG, "en", "b", len(LONG)),
        (5, LONG, "en", "b", len(LONG)),
        (6, "Ünïcode 漢字 😀 mixed <|endoftext|> text", "xx", "c", 5),
        (6, "Ünïcode 漢字 😀 mixed <|endoftext|> text", "xx", "c", 5),
        (None, "no identifier here", "en", "a", 1),
        (-7, "negative identifier", "en", "a", -1),
        (8, "x" * 200_000, "en", "a", 200_000),
        (9, "a" * 70 + "\x00b c", "en", "a", 3),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    extra = {c: "clash" for c in ("block_id", "fp", "shard", "at", "data", "hash", "label", "text_hash", "component_id", "spans", "kept", "plain")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r.doc_id, r.text or "") for r in odd.collect()]
