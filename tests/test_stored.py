import random

import pytest
from pyspark.sql import functions as F

from hopspark.operators import graph, retrieve
from hopspark.schema import EDGES
from hopspark.sources import stored


def some_edges(spark, n, seed=1):
    rng = random.Random(seed)
    name = lambda: f"e{min(rng.randrange(80), rng.randrange(80))}"
    return spark.createDataFrame([(name(), "r", name(), f"p{rng.randrange(60)}#abstract") for _ in range(n)], EDGES)


def shuffled_tables(df):
    """Stored tables that are exchanged: with nothing above them below the exchange but what reads no other table, or a semi join."""
    plan = df._jdf.queryExecution().executedPlan()
    found, lines = [], plan.toString().replace("AdaptiveSparkPlan isFinalPlan=false", "").splitlines()
    for k, line in enumerate(lines):
        if "FileScan" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        for above in reversed(lines[:k]):
            at = len(above) - len(above.lstrip(" :+-*(0123456789)"))
            if at < depth:
                depth, node = at, above.strip(" :+-*(0123456789)")
                if node.startswith("Exchange"):
                    found.append(line)
                if node.startswith("SortMergeJoin") and "LeftSemi" in node and "struct<chunk_id" not in line:
                    continue  # what is left of it may still be the whole table
                if node.startswith(("Exchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastExchange", "Union")):
                    break
    return found


@pytest.fixture
def quiet(spark):
    """Joins as with tables that are too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_neighbours_over_a_stored_graph(spark, tmp_path, quiet):
    first, more = some_edges(spark, 60), some_edges(spark, 40, 2)
    kept = stored.store_graph(first, str(tmp_path / "g"), 6)
    kept.append(more)
    again = stored.open_graph(spark, kept.path)
    edges = first.unionAll(more)
    assert sorted(map(tuple, again.degrees().collect())) == sorted(map(tuple, graph.degrees(edges).collect()))
    seeds = spark.createDataFrame([("p1#abstract",), ("p5#abstract",), ("none",)], "chunk_id string")
    for some in (None, seeds):
        found = graph.stored_neighbors(again, some, 4)
        assert shuffled_tables(found) == []  # as planned, before it runs
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.neighbors(edges, some, 4).collect()))
    # the same over a plain table
    assert shuffled_tables(graph.neighbors(spark.read.parquet(str(tmp_path / "g/adjacency")).select(F.col("entity").alias("source_entity_id"), F.lit("r").alias("relation"), F.col("other").alias("target_entity_id"), F.col("chunk_id").alias("source_chunk_id")), None, 4)) != []
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("hopspark")] == []


def test_lookup_over_stored_texts(spark, tmp_path, quiet):
    chunks = spark.createDataFrame([(f"p{k % 7}#chunk{k}", f"p{k % 7}", f"text {k}") for k in range(50)], "chunk_id string, paper_id string, text string")
    papers = spark.createDataFrame([(f"p{k}", f"title {k}") for k in range(7)], "paper_id string, title string")
    kept = stored.open_texts(spark, stored.store_texts(chunks, papers, str(tmp_path / "t"), 5).path)
    ranked = spark.createDataFrame([(1, "p3#chunk3", 1), (1, "gone", 2), (2, "p1#chunk8", 1)], "question_id long, chunk_id string, rank int")
    found = retrieve.lookup(ranked, kept.chunks(), kept.papers())
    assert shuffled_tables(found) == []
    assert sorted(map(tuple, found.select("question_id", "rank", "text", "title").collect())) == [(1, 1, "text 3", "title 3"), (2, 1, "text 8", "title 1")]


@pytest.mark.parametrize("as_stored", [False, True])
def test_reach_counts_the_fewest_hops(spark, tmp_path, as_stored):
    edges = some_edges(spark, 90, 3)
    near = {}
    for r in graph.neighbors(edges, None, 6).collect():
        near.setdefault(r.seed, set()).add(r.chunk_id)
    want = []
    for seed in ("p1#abstract", "p2#abstract"):
        seen = last = {seed}
        for hop in (1, 2, 3):
            last = set().union(*(near.get(c, set()) for c in last)) - seen
            seen = seen | last
            want += [(seed, c, hop) for c in last]
    given = stored.store_graph(edges, str(tmp_path / "g"), 3) if as_stored else edges
    seeds = spark.createDataFrame([("p1#abstract",), ("p2#abstract",)], "chunk_id string")
    assert sorted(map(tuple, graph.reach(given, seeds, 3, 6).collect())) == sorted(want)


def test_buckets_follow_the_bytes_of_texts(spark, tmp_path, monkeypatch):
    """A few long texts aren't one bucket, which one task would read."""
    from hopspark.sources import stored

    monkeypatch.setattr(stored, "BUCKET_BYTES", 1000, raising=False)
    chunks = spark.createDataFrame([(f"p{k}#chunk0", f"p{k}", "é" * 100) for k in range(40)], "chunk_id string, paper_id string, text string")
    papers = chunks.select("paper_id", F.lit("t").alias("title"))
    kept = stored.store_texts(chunks, papers, str(tmp_path / "texts"))
    assert kept.buckets == 8 and stored.open_texts(spark, kept.path).buckets == 8
    assert sorted(map(tuple, kept.chunks().select(*chunks.columns).collect())) == sorted(map(tuple, chunks.collect()))


def test_edges_are_worked_out_once(spark, tmp_path):
    """Three tables and a count of them come from one pass, and repeats leave without a shuffle of their own."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = some_edges(spark, 60)
    edges = edges.unionAll(edges).mapInArrow(look, edges.schema)
    n = edges.count()
    seen.value = 0
    kept = stored.store_graph(edges, str(tmp_path / "graph"), None)
    assert seen.value == n
    kept.append(edges)
    assert seen.value == 2 * n
    assert kept.ends().count() == 2 * kept.ends().distinct().count()
