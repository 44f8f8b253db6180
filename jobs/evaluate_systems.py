"""Evaluation of answering systems over labelled questions, kept by system.

    python -m jobs.evaluate_systems --tables DIR --out DIR [--config FILE]

``tables`` holds the Parquet tables ``documents`` and ``embeddings``.  Every system of the
configuration answers every question; ``out`` gets three tables, each partitioned by
``system``:

    predictions  question_id, predicted_answer, retrieved_chunk_ids
    scores       question_id, precision_at_k, recall_at_k, correct
    reports      n_questions, mean_accuracy, mean_precision, mean_recall

A run replaces the partitions of the systems it ran and leaves those of others, so
systems can be added one by one, and a run that was cut off is repeated with the same
result.
"""

from __future__ import annotations

import argparse
import json
import logging
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopspark.config import Settings
from hopspark.operators import evaluate
from hopspark.plans import systems
from hopspark.sources import testdata
from hopspark.sources.scratch import scratch_table

log = logging.getLogger("jobs.evaluate_systems")
CONFIG = Path(__file__).with_suffix(".json")


def load_config(path: str | None = None) -> dict:
    return json.loads(CONFIG.read_text()) | (json.loads(Path(path).read_text()) if path else {})


def _write(rows: DataFrame, out: str, name: str) -> DataFrame:
    """Replace the partitions of the systems in ``rows``, and read them back."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("system").parquet(f"{out}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{out}/{name}")


def evaluate_systems(spark: SparkSession, tables: str, out: str, config: dict) -> dict[str, int]:
    """One run: how many questions it read and rows it wrote.

    ``config``: ``systems`` names those to run, ``k`` is the cut of precision and recall,
    ``settings`` overrides the engine's defaults by name.
    """
    known = set(systems.SYSTEMS)
    names = list(dict.fromkeys(config["systems"]))
    if not names or set(names) - known:
        raise ValueError(f"systems must be some of {sorted(known)}")
    settings = Settings(**config["settings"])
    corpus = systems.Corpus(*(scratch_table(f(spark, tables), f.__name__) for f in (testdata.vec_chunks, testdata.vec_papers, testdata.vec_edges, testdata.vec_entities)), settings)
    questions = scratch_table(testdata.vec_questions(spark, tables), "questions")
    wrote = {"questions": questions.count()}
    log.info("read %d questions of %s", wrote["questions"], tables)
    # the systems that build on hybrid retrieval share one
    base = scratch_table(systems.hybrid_list(questions, corpus), "hybrid") if set(names) - {"flat"} else None
    for name in names:
        began = time.time()
        said = systems.predictions(name, questions, corpus, base=base).drop("latency_ms")
        _write(said, out, "predictions")
        log.info("%s answered in %.1f s", name, time.time() - began)
    mine = F.col("system").isin(names)
    said = spark.read.schema(said.schema).parquet(f"{out}/predictions").where(mine).withColumn("latency_ms", F.lit(0.0))
    scores = _write(evaluate.score(questions, said, config["k"]).select("question_id", "precision_at_k", "recall_at_k", "correct", "system"), out, "scores").where(mine)
    order = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "system string, pos long")
    reports = _write(evaluate.report(order, scores.withColumn("latency_ms", F.lit(0.0))).select("n_questions", "mean_accuracy", "mean_precision", "mean_recall", "system"), out, "reports")
    wrote |= {"predictions": said.count(), "scores": scores.count(), "reports": reports.where(mine).count()}
    log.info("wrote to %s: %s", out, ", ".join(f"{k} {v}" for k, v in wrote.items()))
    return wrote


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("tables", "out"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("evaluate systems").getOrCreate()
    try:
        evaluate_systems(spark, given.tables, given.out, load_config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
