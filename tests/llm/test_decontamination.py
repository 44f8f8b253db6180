import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopspark.llm import decontamination as D

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4))


def best_window(text, item):
    """The best similarity of any window as long as the item."""
    w, v = words(text), words(item)
    if len(v) < 5 or len(w) < 5:
        return 0.0
    b, best = shingles(v), 0.0
    for s in range(max(1, len(w) - len(v) + 1)):
        a = shingles(w[s : s + len(v)])
        best = max(best, sum((a & b).values()) / sum((a | b).values()))
    return best


def brute(docs, items):
    return {(k, i, round(s, 6)) for k, t in docs for i, x in items if (s := best_window(t, x)) >= 0.8}


def found(df, items):
    return {(r.doc_id, r.item_id, r.similarity) for r in D.contaminations(df, items).collect()}


def test_documents_equal_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert want and found(docs, items) == want


def made(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate([5, 6, 15, 30, 60, 130, 40])] + [(90, " ".join(["a b c d e f g"] * 6)), (91, "too short")]
    docs = []
    for k, (_, item) in enumerate(items[:-1]):
        w = item.split()
        variants = [w, w[1:], w[:-1], [x.upper() + "," for x in w], w[: len(w) // 2] + ["zz"] + w[len(w) // 2 :], [*w[:3], "zz", *w[4:]], w[: len(w) // 2], ["zz", *w[1:-1], "zz"]]
        for v, body in enumerate(variants):
            docs.append((100 * k + v, " ".join(text(rng.randrange(40)) + body + text(rng.randrange(40)))))
        docs.append((100 * k + 50, item))
        docs.append((100 * k + 51, " ".join(w + w)))
    docs += [(9000 + k, " ".join(text(100))) for k in range(20)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_edited_passages_equal_brute_force(spark, seed):
    docs, items = made(seed)
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(docs, items)


def test_shuffled_and_parted_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", 60)
    monkeypatch.setattr(D, "ROW_BYTES", 1)
    docs, items = made(5)
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(docs, items)


def test_windows_meet_few_items(spark):
    """Of two hundred items, all with a common passage, a window meets its own and hardly another."""
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(3000)]
    common = "please read the following passage and answer the question below".split()
    items = [(k, " ".join(common + [rng.choice(vocab) for _ in range(30)])) for k in range(200)]
    docs = [(k, " ".join([rng.choice(vocab) for _ in range(20)] + common + [rng.choice(vocab) for _ in range(30)])) for k in range(300)]
    docs += [(1000 + k, "before " + text + " after") for k, text in items[:40]]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    met = D.seeded_windows(D._keyed(a, "doc_id", "text"), D._items(b, "item_id", "text"))
    per_window = met.groupBy(*D.KEY, "start", "m").count().agg({"count": "avg"}).first()[0]
    assert met.select("id").distinct().count() == 40 and per_window < 2
    assert found(a, b) == brute(docs, items) != set()


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "no identifier here at all but more words than five"), (2, None), (None, "one two three four five six")], "item_id long, text string")
    assert found(odd, items) == set()
    assert found(none, items) == set()
    docs = spark.createDataFrame([(None, "x one two three four five six y"), (3, "one two three four five six"), (3, "one two three four five six")], "doc_id long, text string")
    assert found(docs, items) == {(None, None, 1.0), (3, None, 1.0)}
    assert D.contaminations(docs, items).count() == 2
    assert found(docs, spark.createDataFrame([], "item_id long, text string")) == set()


def test_decontaminate_keeps_the_rest_whole(spark, odd):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    kept = D.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    docs = spark.createDataFrame([(1, "x one two three four five six y", 5), (1, "clean", 5), (None, "one two three four five six", 5)], "doc_id long, text string, hash int")
    assert [r.text for r in D.decontaminate(docs, items).collect()] == ["clean"]
    named = docs.withColumnRenamed("hash", "_hit0_id").withColumn("_hit_id", F.lit(1)).withColumn("_hit2", F.lit(1))
    assert [r.text for r in D.decontaminate(named, items).collect()] == ["clean"]


def test_fingerprints_are_majorities(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 60, 126):
        hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
        want = sum(1 << b for b in range(64) if 2 * sum((h & (1 << 64) - 1) >> b & 1 for h in hashes) > n)
        for longest in (126, 4000, 40_000):
            got = spark.createDataFrame([(hashes,)], "h array<long>").select(D.simhash("h", longest).alias("fp")).first().fp
            assert got & (1 << 64) - 1 == want


@pytest.mark.parametrize("radius", [0, 3, 23, 31])
def test_blocks_cover_all_bits(spark, radius):
    value = 0x123456789ABCDEF0
    got = spark.range(1).selectExpr(f"{value}L AS fp").select(D.blocks("fp", radius).alias("b")).first().b
    ends = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    assert sum(b.value << ends[b.no] for b in got) == value and len(got) == radius + 1


def test_no_python_on_the_executors(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = D.contaminations(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
