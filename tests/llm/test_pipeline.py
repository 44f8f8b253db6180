import hashlib
import subprocess
import sys
from pathlib import Path

import public_tokenizers as P
import pytest

import corpus_pipeline
from hopspark.llm import secret_links
from hopspark.llm.queries import ORACLE_SQL, QUERIES
from oracle import assert_same
from test_decontamination import best_window
from test_rules_and_secrets import brute
from test_simhash import expected
from test_tokens import MULTI

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def restated(rows, items):
    """The pipeline in plain Python."""
    rows = [(k, t) for k, t in rows if brute(t)[6]]
    component = {k: c for k, _, c in expected(rows)}
    rows = [(k, t) for k, t in rows if component[k] == k]
    rows = [(k, t) for k, t in rows if not any(best_window(t, x) >= 0.8 for x in items)]
    out = []
    for k, t in rows:
        t = secret_links.cover(t, "[REDACTED]")
        ids = MULTI.encode_ordinary(t)
        out.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == restated([(r.doc_id, r.text) for r in docs], items)


def test_stages_return_the_columns_of_documents(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, none):
            out = stage(spark, docs, SF)
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()


def test_one_row_of_each_component_with_shared_and_missing_ids(spark):
    """Compared with plain Python, where components are sets of rows."""
    from hopspark.llm.simhash import RADIUS, fingerprint

    prose = [" ".join(f"w{k}x{(j * j + 7 * k) % 101}" for j in range(60)) for k in range(9)]
    a, b, c, d, e, f, g, h, i = prose
    rows = [(3, a), (5, a), (5, b), (7, b), (7, c), (7, d), (9, c), (9, c), (None, e), (None, e), (None, f), (11, f), (None, None), (12, g), (12, h), (None, h), (None, i)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()]

    groups = []
    for row in set(rows):
        near = [x for x in groups if any((fingerprint((row[1] or "").encode()) ^ fingerprint((t or "").encode())).bit_count() <= RADIUS for _, t in x)]
        groups = [x for x in groups if x not in near] + [[row, *(r for x in near for r in x)]]
    assert len(groups) == 10
    want = [min(x, key=lambda r: (r[0] is None, r[0] or 0)) for x in groups]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rows_meet_chosen_numbers_without_a_shuffle_and_by_one_alike(spark, monkeypatch):
    from hopspark.llm import simhash

    rows = [(k, " ".join(f"w{(k // 3) * 50 + j}" for j in range(40))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = simhash.one_of_each(docs)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(simhash, "BROADCAST_BITMAPS", 0)
    assert got == sorted(map(tuple, simhash.one_of_each(docs).collect())) and 100 <= len(got) < 400


def test_no_document_is_lost_for_its_identifier(spark, tmp_path):
    """Null ids and ids that several texts share, through all five stages, against plain Python over sets of rows."""
    import random

    from hopspark.llm.simhash import RADIUS, fingerprint

    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(500)]
    prose = lambda n=60: " ".join(rng.choice(vocab) for _ in range(n))
    items = [prose(30) for _ in range(3)]
    plain = [prose() for _ in range(12)]
    leaks = [f"{prose(20)} {x} {prose(20)}" for x in items]
    secret = [f"{prose()} password = hunter2hunter2 {prose(5)}" for _ in range(3)]
    junk = [" ".join(["same words again and again"] * 20), "too short"]
    rows = [(None, t) for t in plain[:5]] + [(1, t) for t in plain[5:9]] + [(2, plain[0]), (3, plain[5]), (None, plain[9]), (9, plain[9]), (9, plain[10]), (10, plain[11]), (10, plain[11])]
    rows += [(None, leaks[0]), (1, leaks[1]), (20, leaks[2]), (None, secret[0]), (1, secret[1]), (21, secret[2]), (None, junk[0]), (1, junk[1]), (None, None)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], ddl).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = {r for r in rows if brute(r[1] or "")[6]}
    groups = []
    for row in good:
        near = [x for x in groups if any((fingerprint(row[1].encode()) ^ fingerprint(t.encode())).bit_count() <= RADIUS for _, t in x)]
        groups = [x for x in groups if x not in near] + [[row, *(r for x in near for r in x)]]
    one = [min(x, key=lambda r: (r[0] is None, r[0] or 0)) for x in groups]
    clean = [(k, secret_links.cover(t, "[REDACTED]")) for k, t in one if not any(best_window(t, x) >= 0.8 for x in items)]
    want = []
    for k, t in clean:
        ids = MULTI.encode_ordinary(t)
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(got) == 15 and sum(r[0] is None for r in got) == 5 and sum(r[0] == 1 for r in got) == 5


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 13)}
    assert set(QUERIES) | {"pipeline"} <= names
    assert P.PATTERN


def test_entry_works_without_the_optional_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT / "hopspark", tmp_path / "hopspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


@pytest.mark.parametrize("query", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, query):
    assert_same(spark, QUERIES[query], ORACLE_SQL[query])


@pytest.mark.parametrize("query", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_run(spark, query):
    assert QUERIES[query](spark, SF).count() > 0
