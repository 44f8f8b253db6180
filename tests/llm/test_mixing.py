import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from hopspark.llm import mixing

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "size", "source_size", "target", "taken", "copies")


def targets(rows, weights=(5, 2, 1), cap=3):
    """Exact targets by sharing, capping and sharing the excess anew until none is above."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, left = {}, set(order), Fraction(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not above:
            return sizes, out | {s: left * weight[s] / total for s in free}
        out |= {s: Fraction(cap * sizes[s]) for s in above}
        left -= sum(out[s] for s in above)
        free -= above
    return sizes, out


def check(df, **how):
    rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    got = mixing.mix_sources(df, **how).select(*COLUMNS).collect()
    sizes, target = targets(rows, **{k: v for k, v in how.items() if k != "seed"})
    words = [(k, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for k, t, s in rows]
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 3)) for r in got) == Counter((k, n, sizes[s], round(float(target[s]), 3)) for k, n, s in words)
    cap = how.get("cap", 3)
    for r in got:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size and int(rate - 1e-9) <= r.copies <= int(rate + 1 + 1e-9) and r.copies <= cap
    # sources that look alike are told apart by their size only where it is their own
    taken, most = Counter(), Counter()
    for r in got:
        taken[r.source_size] += r.taken
        most[r.source_size] = max(most[r.source_size], r.size)
    for s, n in sizes.items():
        if list(sizes.values()).count(n) == 1:
            assert abs(taken[n] - float(target[s])) <= most[n] + 1e-6, s
    return got


def test_sources_meet_their_targets(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len({r.copies for r in got}) > 1


def test_odd_rows(odd, none):
    check(odd)
    assert mixing.mix_sources(none).collect() == []


def test_several_levels_keep_the_words_of_each_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    rows = [(k, "w " * (1 + k * k % 37), f"s{k % 3 if k % 10 else 3}") for k in range(700)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7))


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    assert a == sorted(map(tuple, mixing.mix_sources(docs.repartition(9)).collect()))
    assert a != sorted(map(tuple, mixing.mix_sources(docs, seed=7).collect()))


def test_rows_that_are_alike_share_a_fraction(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE", 100)
    rows = [(None, "one two three", None)] * 1000 + [(k, "four", "b") for k in range(500)] + [(9, None, "c"), (9, "", "c")]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert len(got) == 1502


def test_many_sources_are_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(k, "w " * (k % 50), f"s{k % 40}" if k % 11 else None) for k in range(900)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1), cap=2)


def test_each_document_is_rounded_up_as_often_as_its_fraction_says(spark):
    rows = [(k, "w " * (1 + k % 5), "a" if k < 30 else "b") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    runs, ups, want = 8, Counter(), {}
    for seed in range(runs):
        for r in mixing.mix_sources(df, seed=seed).collect():
            ups[r.doc_id] += r.copies
            want[r.doc_id] = r.target / r.source_size
    for side in (range(30), range(30, 60)):
        for size in range(5):
            same = [k for k in side if k % 5 == size]
            assert abs(sum(ups[k] for k in same) / runs / len(same) - want[same[0]]) < 0.2


def test_the_plan_is_native(spark):
    plan = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("u, rises", [(0.01, True), (0.99, False)])
def test_a_fold_passes_words_and_keeps_their_sum(spark, u, rises):
    from pyspark.sql import functions as F

    df = spark.sql(f"SELECT array(named_struct('size', 4L, 'p', 0.5D, 'u', 0.5D), named_struct('size', 10L, 'p', 0.4D, 'u', {u}D)) AS items")
    acc = df.select(F.expr(mixing._FOLD).alias("acc")).first().acc
    if rises:  # 2 words fill the first, which leaves 2 of the second's 4
        assert (acc.open, acc.up, acc.p) == (1, [0], pytest.approx(0.2))
    else:  # the first's 2 words go to the second
        assert (acc.open, acc.up, acc.p) == (1, [], pytest.approx(0.6))
