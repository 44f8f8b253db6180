import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopspark.functions import text as T
from hopspark.functions import vector as V


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(("n", "count"), [(0, 0), (1, 1), (500, 1), (501, 2), (950, 2), (951, 3)])
def test_chunk_counts(spark, n, count):
    text = " ".join(f"w{k}" for k in range(n))
    found = one(spark, T.chunk_texts(F.col("t")), t=text)
    assert len(found) == count
    if count > 1:
        assert found[0].split()[450:] == found[1].split()[:50]
        assert found[-1].split()[-1] == f"w{n - 1}"


def test_chunks_cover_all_words(spark):
    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.text("abc", min_size=1, max_size=3), max_size=60), st.integers(2, 9), st.integers(0, 1))
    def check(words, size, overlap):
        found = one(spark, T.chunk_texts(F.col("t"), size, overlap), t=" \n".join(words))
        whole = [w for k, c in enumerate(found) for w in c.split()[(overlap if k else 0) :]]
        assert whole == words

    check()


@pytest.mark.parametrize(
    ("given_text", "expected"),
    [("One two. Three. Four", "One two."), ("No break.", "No break.."), ("", "."), (None, "")],
)
def test_first_sentence(spark, given_text, expected):
    assert spark.createDataFrame([(given_text,)], "t string").select(T.first_sentence(F.col("t"))).first()[0] == expected


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.col("t")), t="  a\t\t b\x00\n\n\n\nc \n") == "a b\n\nc"


def test_html_to_text(spark):
    page = "<html><script>var a='</p>';</script><p>One &amp; two</p><!-- x --><br/>three &lt;b&gt;</html>"
    assert one(spark, T.html_to_text(F.col("t")), t=page).split() == ["One", "&", "two", "three", "<b>"]


@pytest.mark.parametrize(("name", "expected"), [("  Café-Au  Lait! ", "café-au lait"), ("A (b) ", "a b"), ("x !", "x "), ("!!", "")])
def test_normalize_entity(spark, name, expected):
    assert one(spark, T.normalize_entity(F.col("t")), t=name) == expected


def test_names_without_content_share_an_entity(spark):
    assert one(spark, T.entity_id(F.col("t")), t="?!") == one(spark, T.entity_id(F.col("t")), t="Unknown")


def test_short_title(spark):
    assert one(spark, T.short_title(F.col("t")), t="x" * 60) == "x" * 60
    assert one(spark, T.short_title(F.col("t")), t="x" * 61) == "x" * 57 + "..."


def test_code_fence(spark):
    assert one(spark, T.strip_code_fence(F.col("t")), t="```json\n[1]\n ```\nx") == "[1]\nx"
    assert one(spark, T.strip_code_fence(F.col("t")), t="a\n```") == "a\n```"


def test_supported_claim_overlaps(spark):
    found = one(spark, T.lexical_overlap(F.col("c"), F.array(F.col("a"), F.col("b"))), c="The engine prunes hub nodes quickly", a="hub nodes are pruned; the engine prunes", b="it works quickly")
    assert found == 1.0
    assert one(spark, T.lexical_overlap(F.col("c"), F.array(F.col("a"))), c="Whales sing in deep oceans", a="a compiler emits code") < 0.4
    assert one(spark, T.lexical_overlap(F.col("c"), F.array(F.col("a"))), c="it is the", a="nothing") == 1.0


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert math.isclose(one(spark, V.cosine(a, b)), 0.96)
    assert one(spark, V.normalize(a)) == [0.6, 0.8]
    assert one(spark, V.normalize(F.array(F.lit(0.0)))) == [0.0]


def vectors(spark, n, d=8, name="item_id"):
    import random

    rng = random.Random(n)
    return spark.createDataFrame([(k, [round(rng.gauss(0, 1), 3) for _ in range(d)]) for k in range(n)], f"{name} long, embedding array<float>")


def test_blocked_search_equals_broadcast_search(spark, monkeypatch):
    corpus, asked = vectors(spark, 300), vectors(spark, 30, name="query_id")
    whole = V.nearest(asked, corpus, 7).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(V, "MAX_BROADCAST_BYTES", 1000)
    assert V.nearest(asked, corpus, 7).orderBy("query_id", "rank").collect() == whole


def test_equal_vectors_rank_by_id(spark):
    corpus = spark.createDataFrame([(k, [1.0, 0.0]) for k in (5, 3, 9)] + [(1, [0.0, 1.0]), (2, None)], "item_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.item_id for r in V.nearest(asked, corpus, 3).orderBy("rank").collect()] == [3, 5, 9]
