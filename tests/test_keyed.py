"""Keys, upserts of stored tables, and the runner of models."""

import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hopspark.operators import models
from hopspark.plans import ingest, systems
from hopspark.schema import CHUNKS, EDGES, ENTITIES, PAPERS
from hopspark.sources import keys, parted, sinks


def tables(spark):
    return {
        "papers": spark.createDataFrame([("a", "t", "x", None), ("b", "t", "x", None), ("b", "t", "x", None), (None, "t", None, None)], PAPERS),
        "chunks": spark.createDataFrame([("a#1", "a", 0, "x", [1.0]), ("b#1", "b", 0, "x", [1.0]), ("c#1", "c", 0, "x", None), ("c#1", "c", 1, "x", None)], CHUNKS),
        "entities": spark.createDataFrame([("e1", "n", None), ("e2", "n", None)], ENTITIES),
        "edges": spark.createDataFrame([("e1", "r", "e2", "a#1"), ("e1", "r", "e3", "b#1"), ("e2", "r", "e2", "b#1"), ("e2", "r", None, "z#1")], EDGES),
    }


def test_violations_are_named(spark):
    got = sorted(map(tuple, keys.violations(tables(spark)).collect()), key=repr)
    assert got == sorted(
        [
            ("papers", "not null", "paper_id", None, 1), ("papers", "not null", "abstract", None, 1), ("papers", "primary key", "paper_id", "b", 2),
            ("chunks", "not null", "embedding", None, 2), ("chunks", "primary key", "chunk_id", "c#1", 2), ("chunks", "foreign key", "paper_id", "c", 2),
            ("edges", "not null", "target_entity_id", None, 1), ("edges", "foreign key", "target_entity_id", "e3", 1), ("edges", "foreign key", "source_chunk_id", "z#1", 1),
        ],
        key=repr,
    )
    assert keys.violations({"entities": tables(spark)["entities"].limit(0)}).collect() == []


def test_deletes_follow_the_keys(spark):
    of = lambda left: {n: sorted(map(str, (r[0] if n != "edges" else r[3] for r in df.collect()))) for n, df in left.items()}
    some = tables(spark)
    assert of(keys.delete(some, "papers", spark.createDataFrame([("b",), ("none",)], "paper_id string"))) == {"papers": ["None", "a"], "chunks": ["a#1", "c#1", "c#1"], "entities": ["e1", "e2"], "edges": ["a#1", "z#1"]}
    assert of(keys.delete(some, "entities", spark.createDataFrame([("e1",)], "entity_id string")))["edges"] == ["b#1", "z#1"]
    assert of(keys.delete(some, "chunks", spark.createDataFrame([("a#1",)], "chunk_id string")))["edges"] == ["b#1", "b#1", "z#1"]


def test_an_upsert_rewrites_the_partitions_it_touches(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "paper_id string, title string")
    table = parted.store_parted(make([(f"p{k}", "old") for k in range(100)]), str(tmp_path / "t"), "paper_id", 10)
    files = lambda: {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in Path(tmp_path).glob("t/rows/part=*/*.parquet")}
    before = files()
    touched = table.upsert(make([("p3", "new"), ("q1", "new"), ("p3", "newer")]), sinks.upsert_papers)
    after = files()
    assert len(before) == 10 and 1 <= len(touched) <= 2
    assert {p for p in before if before[p] != after[p]} == {f"part={k}" for k in touched}
    again = parted.open_parted(spark, table.path)
    assert {r.paper_id: r.title for r in again.rows().collect()} == {f"p{k}": "old" for k in range(100)} | {"p3": "newer", "q1": "new"}
    assert again.upsert(make([]), sinks.upsert_papers) == [] and files() == after


def client(place, broken):
    """A client that notes each call, and fails on prompts while their name is among the broken."""

    def connect():
        def call(prompt):
            Path(place, f"{os.getpid()}-{os.urandom(6).hex()}").write_text(prompt)
            if (Path(broken) / prompt).exists():
                raise TimeoutError("no answer")
            return f"said {prompt}"

        return call

    return connect


@pytest.fixture
def noted(tmp_path):
    places = [tmp_path / "calls", tmp_path / "broken"]
    for p in places:
        p.mkdir()
    return *map(str, places), lambda: Counter(f.read_text() for f in places[0].iterdir())


def test_a_run_asks_only_what_has_no_reply(spark, tmp_path, noted):
    calls, broken, count = noted
    runner = models.Runner(client(calls, broken), str(tmp_path / "replies"), attempts=3, first_wait=0.01)
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z"), (5, None)], "id long, q string")
    (Path(broken) / "z").touch()
    replies = lambda: {r.id: r.reply for r in runner.ask(rows, "id", F.col("q")).collect()}
    assert replies() == {1: "said x", 2: "said y", 3: "said x", 4: None, 5: None}
    assert count() == {"x": 1, "y": 1, "z": 3}
    (Path(broken) / "z").unlink()
    assert replies() == {1: "said x", 2: "said y", 3: "said x", 4: "said z", 5: None}
    assert replies()[4] == "said z" and count() == {"x": 1, "y": 1, "z": 4}


def test_waits_grow_up_to_the_longest(monkeypatch):
    waits = []
    monkeypatch.setattr(models.time, "sleep", waits.append)

    def fails(prompt):
        raise OSError

    assert models.Runner(lambda: fails, "", attempts=6, first_wait=5, longest_wait=30)._call(fails, "x") is None
    assert waits == [5, 10, 20, 30, 30]


def test_operators_take_a_runner_and_fall_back_without_a_reply(spark, tmp_path):
    def connect():
        def call(prompt):
            if "fail" in prompt:
                raise OSError
            if prompt.startswith("extract"):
                return '[{"source": "A", "relation": "uses", "target": "B"}]'
            if prompt.startswith("plan"):
                return '["first part", "second part"]'
            if prompt.startswith("judge"):
                return '{"correct": true, "reasoning": "same"}'
            return '{"claims": [{"text": "The cat sat.", "source_numbers": [1]}]}'

        return call

    runner = models.Runner(connect, str(tmp_path / "replies"), attempts=1)
    papers = spark.createDataFrame([("p1", "good"), ("p2", "fail")], "paper_id string, abstract string")
    chunks = spark.createDataFrame([("p1#abstract", "p1", 0, "x"), ("p2#abstract", "p2", 0, "x")], "chunk_id string, paper_id string, chunk_index int, text string")
    extract = models.extractor(runner, papers, F.concat(F.lit("extract "), "abstract"))
    entities, edges = ingest.build_graph(chunks, extract=extract)
    assert entities.count() == 2 and [r.source_chunk_id for r in edges.collect()] == ["p1#abstract"]
    questions = spark.createDataFrame([(1, "what"), (2, "fail")], "question_id long, question string")
    plans = systems.parse_plans(models.planner(runner, F.concat(F.lit("plan "), "question"))(questions), 1)
    assert [tuple(r) for r in plans.collect()] == [(1, 1, "first part")]
    sources = spark.createDataFrame([(1, 1, "c#1", "t", "The cat sat on a mat."), (2, 1, "c#2", "t", "A dog ran. Far.")], "question_id long, rank int, chunk_id string, title string, text string")
    said = models.writer(runner, F.concat("question", "block"))(questions, sources)
    from hopspark.operators.synthesis import synthesize

    answers = {r.question_id: (r.answer, len(r.citations)) for r in synthesize(questions, sources, said).collect()}
    assert answers == {1: ("The cat sat.", 1), 2: ("A dog ran.", 0)}
    judged = models.verdicts(runner, questions, "question_id", F.concat(F.lit("judge "), "question"))
    assert {r.question_id: r.correct for r in judged.collect()} == {1: True, 2: False}
