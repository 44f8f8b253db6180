"""The jobs as queries: each runs twice over the whole tables into a folder of its own, and gives what stands there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopspark.plans import oracle
from hopspark.sources.scratch import scratch_path
from jobs import evaluate_systems, graph_build


def job1_graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and edges of all documents, in one table of parts."""
    place = scratch_path(spark, "job1")
    for _ in range(2):
        graph_build.build(spark, f"{sf_dir}/documents.parquet", f"{place}/out", f"{place}/checkpoint", graph_build.load_config())
    edges, entities = (graph_build.stored(spark, f"{place}/out", name) for name in ("edges", "entities"))
    none = F.lit(None).cast("string")
    rows = edges.select(F.lit("edge").alias("part"), "source_entity_id", "relation", "target_entity_id", "source_chunk_id", none.alias("canonical_name"))
    return rows.unionByName(entities.select(F.lit("entity").alias("part"), F.col("entity_id").alias("source_entity_id"), "canonical_name"), allowMissingColumns=True)


def job2_evaluate_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of all systems."""
    out = scratch_path(spark, "job2")
    for _ in range(2):
        evaluate_systems.evaluate_systems(spark, sf_dir, out, evaluate_systems.load_config())
    rows = spark.read.schema("n_questions long, mean_accuracy double, mean_precision double, mean_recall double, system string").parquet(f"{out}/reports")
    return rows.select("system", "n_questions", *(F.round(c, 6).alias(c) for c in ("mean_accuracy", "mean_precision", "mean_recall")))


QUERIES = {f.__name__: f for f in (job1_graph_build, job2_evaluate_systems)}
ORACLE_SQL = {
    "job1_graph_build": oracle.OFFLINE_GRAPH,
    "job2_evaluate_systems": f"SELECT system, n_questions, mean_accuracy, mean_precision, mean_recall FROM ({oracle.ORACLE['system_report']})",
}
