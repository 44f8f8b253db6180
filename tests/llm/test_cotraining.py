import zlib

import numpy as np
import pytest

from hopspark.llm import cotraining as C

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    scores = {r.doc_id: r.score for r in C.score_documents(docs, train).collect()}
    assert len(scores) == docs.count()
    right = sum((scores[k] >= 0.5) == (q == 1) for k, q in test.items())
    assert right / len(test) > 0.95


def logistic(x, y, weight, w, steps, ridge=1.0):
    """Newton's method on weighted rows, written out."""
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = np.diag(penalty).astype(float)
        for row, v in zip(x, weight * p * (1 - p), strict=True):
            at = np.flatnonzero(row)
            h[np.ix_(at, at)] += v * np.outer(row[at], row[at])
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + penalty * w)
    return w


def restated(rows, labels):
    """The whole procedure over plain arrays: given and exchanged labels as weighted rows of one table."""
    given = {}
    for k, q in labels:
        given[k] = max(q, given.get(k, 0))
    text = np.array([np.r_[C.text_features((r.text or "").encode()).astype(np.float16).astype(float), 1] for r in rows])
    meta = np.zeros((len(rows), C.META_WIDTH + 1))
    for n, r in enumerate(rows):
        s, g, z = C.meta_codes(r.source, r.lang, r.n_chars)
        meta[n, [s, C.SOURCES + g, C.SOURCES + C.LANGS + z, C.META_WIDTH]] = 1
    y = np.array([given.get(r.doc_id, -1) for r in rows])
    fold = np.array([zlib.crc32(r.doc_id.to_bytes(8, "little", signed=True)) % 10 if v >= 0 else -1 for r, v in zip(rows, y, strict=True)])
    train, calib, last, pool = (y >= 0) & (fold < 6), (fold == 6) | (fold == 7), fold >= 8, y < 0
    line = lambda o: np.c_[o, np.ones(len(o))]
    sig = lambda o: 1 / (1 + np.exp(-np.clip(o, -35, 35)))
    x = (text, meta)
    views = [logistic(v[train], y[train], np.ones(train.sum()), np.zeros(v.shape[1]), 12) for v in x]
    scale = lambda: [logistic(line(v[calib] @ w), y[calib], np.ones(calib.sum()), np.zeros(2), 12, 1e-3) for v, w in zip(x, views, strict=True)]
    taught = 0
    for _ in range(3):
        said = [sig(line(v @ w) @ s) for v, w, s in zip(x, views, scale(), strict=True)]
        tables = []
        for me, other in ((0, 1), (1, 0)):
            weight, want = train.astype(float), np.where(train, y, 0)
            for c, p in ((0, 1 - said[other]), (1, said[other])):
                sure = pool & (p >= 0.95)
                weight[sure], want[sure] = min(1.0, (y[train] == c).sum() / max(1, sure.sum())), c
                taught += sure.sum()
            tables.append((want, weight))
        views = [logistic(v[m > 0], q[m > 0], m[m > 0], w, 2) for v, w, (q, m) in zip(x, views, tables, strict=True)]
    odds = np.column_stack([line(v @ w) @ s for v, w, s in zip(x, views, scale(), strict=True)])
    join = logistic(line(odds[last]), y[last], np.ones(last.sum()), np.zeros(3), 12, 0.1)
    assert taught > 0
    return sig(odds[:, 0]), sig(odds[:, 1]), sig(line(odds) @ join)


def test_query_equals_restatement(spark):
    from hopspark.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = restated(rows, [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()])
    got = {r.doc_id: r for r in QUERIES["op1_quality_cotraining"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r, *p in zip(rows, *want, strict=True):
        g = got[r.doc_id]
        assert np.allclose((g.p_text, g.p_meta, g.score), p, atol=2e-3), (r.doc_id, g, p)
        assert g.kept == (g.score >= 0.5)


def test_sums_are_added_up_in_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = C.features(docs, labels).repartition(7)
    pool = table.where("label IS NULL").select("text", "meta")
    model = C.train(table, rounds=0)
    at_once = C.pool_sums(pool)(model, model.views)
    monkeypatch.setattr(C, "FAN_IN", 2)
    assert np.allclose(C.pool_sums(pool)(model, model.views), at_once, rtol=1e-4, atol=1e-2)
    whole = pool.collect()
    alone = C.teach(model, model.views, C.matrices([bytes(r.text) for r in whole], [bytes(r.meta) for r in whole]))
    assert np.allclose(alone, at_once, rtol=1e-3, atol=1e-1)


def made(n=2000, known=200, seed=0):
    """Two views that each see the class through noise, a column of ones in each."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    view = lambda d, gap: np.c_[rng.normal(size=(n, d)) + gap * (2 * y - 1)[:, None] / np.sqrt(d), np.ones(n)]
    return view(20, 1.5), view(10, 1.3), y, known, rng.integers(0, 10, n)


def fit(a, b, y, known, fold, rounds=C.ROUNDS):
    pool = (a[known:], b[known:])
    return C.co_train((a[:known], b[:known]), y[:known].astype(float), fold[:known], lambda judge, views: C.teach(judge, views, pool), rounds)


def test_views_teach_each_other():
    gain = []
    for seed in range(12):
        a, b, y, known, fold = made(known=150, seed=seed)
        acc = lambda m: ((m.score(a, b)[0][known:] >= 0.5) == y[known:]).mean()  # noqa: B023, E731
        taught = fit(a, b, y, known, fold)
        assert taught.pseudo > 0
        gain.append(acc(taught) - acc(fit(a, b, y, known, fold, rounds=0)))
    assert np.mean(gain) > 0


def test_a_blind_view_does_no_harm():
    a, b, y, known, fold = made(known=600)
    b = np.c_[np.random.default_rng(5).normal(size=(len(b), 10)), np.ones(len(b))]
    p, _, s = fit(a, b, y, known, fold).score(a, b)
    assert ((s[known:] >= 0.5) == y[known:]).mean() >= ((p[known:] >= 0.5) == y[known:]).mean() - 0.02


def test_scores_are_calibrated():
    a, b, y, known, fold = made(n=6000, known=2000)
    s = fit(a, b, y, known, fold).score(a, b)[2][known:]
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (s >= low) & (s < low + 0.25)
        if part.sum() > 100:
            assert abs(s[part].mean() - y[known:][part].mean()) < 0.12


def test_nothing_to_learn(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in C.score_documents(odd, labels).collect()} == {0.5}
    assert C.score_documents(odd, labels).count() == odd.count()
    assert C.score_documents(none, labels).collect() == []
    one = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 7), (77, 0)], "doc_id long, quality int")
    assert {r.score for r in C.score_documents(odd, one).collect()} == {1.0}


def test_odd_rows_are_scored(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = C.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in rows)


def test_missing_columns_count_as_null(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert C.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet")).count() == 1000


@pytest.mark.parametrize("data", [b"", b"a", b"ab", "é漢".encode() * 50])
def test_features_are_finite(data):
    assert np.isfinite(C.text_features(data)).all()


def test_a_repeated_id_displaces_no_other(spark, monkeypatch):
    """However many rows a labelled doc_id has, each doc_id counts once; ties in the features change nothing."""
    seen, real = [], C.co_train
    monkeypatch.setattr(C, "co_train", lambda *a, **k: seen.append(a) or real(*a, **k))
    docs = spark.createDataFrame([(0, f"text {k}") for k in range(500)] + [(k, f"text {k}") for k in range(1, 60)] + [(k, f"text {k}") for k in range(1, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(41)], "doc_id long, quality int")
    C.train(C.features(docs, labels))
    assert [len(a[1]) for a in seen] == [41]
    many = spark.createDataFrame([(k, f"text {k}") for k in range(9000)], "doc_id long, text string")
    C.train(C.features(many, many.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")), max_labelled=500)
    first = sorted((r.h, r.doc_id) for r in many.selectExpr("xxhash64(doc_id, 11) AS h", "doc_id").collect())[:500]
    assert sorted(seen[1][1]) == sorted(k % 2 for _, k in first)
