import hashlib
import json
import re
import sys
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, str(Path(ROOT) / "tests"))

from jobs import evaluate_systems, graph_build, queries  # noqa: E402
from oracle import SF, assert_same  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def add(spark, source, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(source)


FIRST = [(1, "The Alpha Beta method. It beats Gamma.", "en"), (2, None, "en"), (3, "", "en"), (None, "Lost Name", "en"), (4, "Delta Beta and alpha", "en"), (4, "Delta Alpha", "en")]
SECOND = [(1, "Changed Text", "en"), (5, "Beta Epsilon BETA", "fr"), (6, "word " * 600 + "Zeta Alpha", "fr")]


def tables(spark, out):
    return {name: sorted(map(tuple, graph_build.stored(spark, out, name).drop("batch", "embedding").collect())) for name in ("ledger", "chunks", "edges", "entities")}


@pytest.fixture
def place(tmp_path):
    return {k: str(tmp_path / k) for k in ("source", "out", "checkpoint")}


def test_a_second_run_takes_only_what_is_new(spark, place):
    config = graph_build.load_config()
    add(spark, place["source"], FIRST)
    first = graph_build.build(spark, **place, config=config)
    assert (first["batches"], first["read"], first["ledger"]) == (1, 6, 4)
    before = tables(spark, place["out"])
    assert graph_build.build(spark, **place, config=config)["batches"] == 0
    assert tables(spark, place["out"]) == before
    add(spark, place["source"], SECOND)
    second = graph_build.build(spark, **place, config=config)
    assert (second["batches"], second["read"], second["ledger"]) == (1, 3, 2)
    after = tables(spark, place["out"])
    assert [p for (p,) in after["ledger"]] == ["d1", "d2", "d3", "d4", "d5", "d6"]
    assert {n for _, n in after["entities"]} == {"The", "It", "Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta"}
    assert len({e for e, _ in after["entities"]}) == len(after["entities"])
    assert set(before["edges"]) <= set(after["edges"]) and ("Changed Text",) not in {(t[3],) for t in after["chunks"]}


def test_a_batch_that_was_cut_off_is_repeated_whole(spark, place, tmp_path, monkeypatch):
    config = graph_build.load_config()
    add(spark, place["source"], FIRST)
    graph_build.build(spark, **place, config=config)
    add(spark, place["source"], SECOND)
    write = graph_build._write
    for broken in ("entities", "ledger"):

        def fails(rows, out, name, batch, broken=broken):
            n = write(rows, out, name, batch)
            if name == broken:
                raise OSError("lost")
            return n

        monkeypatch.setattr(graph_build, "_write", fails)
        with pytest.raises(StreamingQueryException):
            graph_build.build(spark, **place, config=config)
    monkeypatch.setattr(graph_build, "_write", write)
    graph_build.build(spark, **place, config=config)
    whole = {k: str(tmp_path / "whole" / k) for k in place} | {"source": place["source"] + "2"}
    add(spark, whole["source"], FIRST)
    graph_build.build(spark, **whole, config=config)
    add(spark, whole["source"], SECOND)
    graph_build.build(spark, **whole, config=config)
    assert tables(spark, place["out"]) == tables(spark, whole["out"])


def vector(name):
    counts = [0.0] * 64
    for word in re.findall("[a-z0-9]+", name.lower()):
        counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
    size = sum(x * x for x in counts) ** 0.5
    return [x / size if size else 0.0 for x in counts]


def test_names_join_entities_of_earlier_batches(spark, place):
    """Names of two batches against one after another: arrival by chunk, then place in it, source before target."""
    first = [(1, "Graph-Net uses Net-Graph and Alpha"), (2, "Beta Graph-net Delta-Delta-Alpha")]
    second = [(3, "Net-Graph Alpha Gamma"), (4, "Delta-Alpha-Delta Beta Alpha-Delta")]
    config = graph_build.load_config() | {"resolve_threshold": 0.87}
    founders, want_edges = [], []
    for batch in (first, second):
        add(spark, place["source"], [(k, t, "en") for k, t in batch])
        graph_build.build(spark, **place, config=config)
        old, names, triples = list(founders), {}, []
        for k, text in batch:
            found = re.findall(r"[A-Z][\w-]+", text)
            pairs = list(dict.fromkeys(p for p in zip(found[:-1], found[1:], strict=True)))
            for chunk in (f"d{k}#abstract", f"d{k}#chunk0"):
                for a, b in pairs:
                    if a != b:
                        triples.append((a, b, chunk))
                        names.setdefault(a.lower(), a)
                        names.setdefault(b.lower(), b)
        lead = {n: n for n, _ in old}
        for name in names:
            if name in lead:
                continue
            sims = [(-round(sum(x * y for x, y in zip(vector(name), vector(other), strict=True)), 9), j) for j, (other, _) in enumerate(founders)]
            best = min(sims, default=(0, 0))
            if -best[0] >= 0.87:
                lead[name] = founders[best[1]][0]
            else:
                lead[name] = name
                founders.append((name, names[name]))
        want_edges += [(lead[a.lower()], lead[b.lower()], c) for a, b, c in triples]
    key = lambda n: "e_" + hashlib.sha1(n.encode()).hexdigest()[:12]
    got = tables(spark, place["out"])
    assert got["entities"] == sorted((key(n), name) for n, name in founders) and 3 <= len(founders) < 8
    assert sorted((a, b, c) for a, _, b, c in got["edges"]) == sorted((key(a), key(b), c) for a, b, c in want_edges)


def test_files_can_be_taken_a_few_at_a_time(spark, place):
    for row in FIRST[:3]:
        add(spark, place["source"], [row])
    done = graph_build.build(spark, **place, config=graph_build.load_config() | {"files_per_batch": 1})
    assert (done["batches"], done["ledger"]) == (3, 3)


def test_systems_are_added_and_repeated_one_by_one(spark, tmp_path):
    out, config = str(tmp_path / "out"), evaluate_systems.load_config()
    read = lambda: {r.system: tuple(r) for r in spark.read.parquet(f"{out}/reports").collect()}
    evaluate_systems.evaluate_systems(spark, SF, out, config | {"systems": ["flat"]})
    one = read()
    wrote = evaluate_systems.evaluate_systems(spark, SF, out, config | {"systems": ["hybrid"]})
    both = read()
    assert set(one) == {"flat"} and set(both) == {"flat", "hybrid"} and both["flat"] == one["flat"]
    assert wrote == {"questions": 25, "predictions": 25, "scores": 25, "reports": 1}
    evaluate_systems.evaluate_systems(spark, SF, out, config | {"systems": ["hybrid"]})
    assert read() == both
    with pytest.raises(ValueError):
        evaluate_systems.evaluate_systems(spark, SF, out, config | {"systems": ["other"]})


@pytest.mark.parametrize("job, args", [("graph_build", ("source", "out", "checkpoint")), ("evaluate_systems", ("tables", "out"))])
def test_command_line_reads_a_config_file(monkeypatch, tmp_path, job, args):
    module, called = {"graph_build": graph_build, "evaluate_systems": evaluate_systems}[job], []
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"k": 3}))
    monkeypatch.setattr(sys, "argv", [job, *(x for a in args for x in (f"--{a}", a)), "--config", str(own)])
    monkeypatch.setattr(module, {"graph_build": "build", "evaluate_systems": "evaluate_systems"}[job], lambda spark, *a: called.append(a))

    class Session:
        builder = property(lambda self: self)
        appName = lambda self, _: self
        getOrCreate = stop = lambda self: self

    monkeypatch.setattr(module, "SparkSession", Session())
    module.main()
    assert called[0][: len(args)] == args and called[0][-1]["k"] == 3
