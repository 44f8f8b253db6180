"""Incremental graph build: texts that weren't seen before become chunks, entities and edges.

    python -m jobs.graph_build --source DIR --out DIR --checkpoint DIR [--config FILE]

``source`` is a folder of Parquet files of texts, or one file.  A folder may grow between runs; files are
added, not changed.  A run takes the files that no run has taken before, as the query's checkpoint
remembers, and of these the papers that the ledger doesn't have yet.  ``out`` gets four
tables, each partitioned by ``batch``:

    chunks    chunk_id, paper_id, chunk_index, text
    entities  entity_id, canonical_name, embedding: the names that no earlier batch brought
    edges     source_entity_id, relation, target_entity_id, source_chunk_id
    ledger    paper_id of the papers that are done; written last

A batch replaces its own partitions only, and takes for stored what other batches wrote.
So one that was cut off anywhere is run again by the next call, under the same number and
over the same files, and no edge is doubled and no entity lost.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from hopspark.functions.text import words
from hopspark.functions.vector import hashed_embedding
from hopspark.operators.extract import cooccurrence_triples
from hopspark.plans.ingest import build_graph, ingest
from hopspark.sources.scratch import scratch_table

log = logging.getLogger("jobs.graph_build")
CONFIG = Path(__file__).with_suffix(".json")
SCHEMAS = {
    "chunks": "chunk_id string, paper_id string, chunk_index int, text string, batch long",
    "entities": "entity_id string, canonical_name string, embedding array<double>, batch long",
    "edges": "source_entity_id string, relation string, target_entity_id string, source_chunk_id string, batch long",
    "ledger": "paper_id string, batch long",
}


def load_config(path: str | None = None) -> dict:
    return json.loads(CONFIG.read_text()) | (json.loads(Path(path).read_text()) if path else {})


def stored(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the output; empty where nothing was written yet."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{out}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def _write(rows: DataFrame, out: str, name: str, batch: int) -> int:
    """Replace the table's partition of this batch; how many rows it has now."""
    rows.withColumn("batch", F.lit(batch).cast("long")).select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
    return stored(rows.sparkSession, out, name).where(F.col("batch") == batch).count()


def build(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """One run to its end: rows read and written by it, table by table.

    ``config``: ``id`` and ``text`` name the columns of identifier and text, ``prefix``
    makes an identifier a paper's, ``abstract_words`` of the text are its abstract,
    ``chunk_words`` and ``chunk_overlap`` cut the rest, ``longest_name`` bounds names (null:
    none), ``files_per_batch`` bounds a batch (null: all files that are new).  With
    ``resolve_threshold`` a name joins the most similar entity that was there before it, if
    that is so similar, be it this batch's or an earlier one's; null: names are entities.
    Texts without an identifier, or with one seen before, aren't taken; of several new
    ones with one identifier the smallest by text is.  A null text is an empty one.
    """
    done = dict.fromkeys(["batches", "read", *SCHEMAS], 0)

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        others = {name: stored(spark, out, name).where(F.col("batch") != number) for name in ("ledger", "entities")}
        rows = batch.select(F.concat(F.lit(config["prefix"]), F.col(config["id"]).cast("string")).alias("paper_id"), F.coalesce(config["text"], F.lit("")).alias("body")).where("paper_id IS NOT NULL")
        fresh = rows.groupBy("paper_id").agg(F.min("body").alias("body")).join(others["ledger"], "paper_id", "left_anti")
        # one fixed set of papers, however often what follows reads it
        fresh = scratch_table(fresh.withColumn("abstract", F.array_join(F.slice(words(F.col("body")), 1, config["abstract_words"]), " ")), "papers")
        chunks = scratch_table(ingest(fresh, config["chunk_words"], config["chunk_overlap"]), "chunks")
        extract = lambda c: cooccurrence_triples(c, config["longest_name"])
        if config["resolve_threshold"] is None:
            entities, edges = build_graph(chunks, extract=extract)
            entities = entities.withColumn("embedding", F.lit(None).cast("array<double>"))
        else:
            before = others["entities"].select("entity_id", "canonical_name", "embedding")
            entities, edges = build_graph(chunks, extract=extract, embed=hashed_embedding, stored=before, threshold=config["resolve_threshold"])
        wrote = {"read": batch.count()}
        wrote["chunks"] = _write(chunks, out, "chunks", number)
        wrote["edges"] = _write(edges, out, "edges", number)
        wrote["entities"] = _write(entities.join(others["entities"], "entity_id", "left_anti"), out, "entities", number)
        wrote["ledger"] = _write(fresh.select("paper_id"), out, "ledger", number)
        for name, n in wrote.items():
            done[name] += n
        done["batches"] += 1
        log.info("batch %d of %s: %s", number, source, ", ".join(f"{k} {v}" for k, v in wrote.items()))

    given = spark.read.parquet(source).select(config["id"], config["text"])
    schema, path = given.schema, source.rstrip("/")
    if [f.rpartition("/")[2] for f in given.inputFiles()] == [path.rpartition("/")[2]]:
        path = f"{path[:-1]}[{path[-1]}]"  # one file: streams read folders and patterns
    reader = spark.readStream.schema(schema)
    if config["files_per_batch"]:
        reader = reader.option("maxFilesPerTrigger", config["files_per_batch"])
    running = reader.parquet(path).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    log.info("run over %s into %s: %s", source, out, ", ".join(f"{k} {v}" for k, v in done.items()))
    return done


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "out", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("graph build").getOrCreate()
    try:
        build(spark, given.source, given.out, given.checkpoint, load_config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
