"""Triples from model replies, with a deterministic extractor for use without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopspark.functions.text import STRICT_JSON, json_objects, unfenced


def parse_triples(replies: DataFrame) -> DataFrame:
    """(paper_id, pos, source, relation, target, source_chunk_id) from replies with a JSON list of objects.

    ``replies``: paper_id, reply.  A code fence is removed, text after the first JSON value
    ignored; items that lack a field, or have null in one, are dropped one by one; replies
    that aren't strict JSON yield nothing; of a repeated field the last counts.  Every triple is attributed to the paper's abstract.
    """
    rows = replies.select("paper_id", F.posexplode(json_objects(unfenced(F.col("reply")))).alias("pos", "item"))
    read = F.from_json("item", "source string, relation string, target string", STRICT_JSON)
    out = rows.select("paper_id", "pos", read.alias("v")).select("paper_id", "pos", "v.*")
    return out.where("source IS NOT NULL AND relation IS NOT NULL AND target IS NOT NULL").withColumn("source_chunk_id", F.concat("paper_id", F.lit("#abstract")))


def cooccurrence_triples(chunks: DataFrame, longest: int | None = None) -> DataFrame:
    """The offline extractor: capitalised words of a chunk that follow one another are related.

    A row per distinct pair of consecutive names of two or more characters, and at most
    ``longest`` where that is given; ``pos`` is its place among those of its chunk.
    """
    runs = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))
    fits = (lambda n: F.length(n) >= 2) if longest is None else (lambda n: F.length(n).between(2, longest))
    names = F.filter(runs, lambda n: fits(n) & F.rlike(n, F.lit(r"^\p{Lu}")))
    rows = chunks.select("chunk_id", names.alias("n")).where("size(n) > 1")
    pairs = F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.struct(F.get("n", i - 1).alias("source"), F.get("n", i).alias("target")))
    return rows.select("chunk_id", F.posexplode(F.array_distinct(pairs)).alias("pos", "p")).where("p.source <> p.target").select(F.col("p.source").alias("source"), F.lit("related_to").alias("relation"), F.col("p.target").alias("target"), F.col("chunk_id").alias("source_chunk_id"), "pos")
