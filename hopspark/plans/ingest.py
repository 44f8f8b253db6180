"""Batch ingestion: raw texts to papers and chunks; graph build over papers not yet done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopspark.functions.text import chunk_texts, clean_text, entity_id, normalize_entity, strip
from hopspark.functions.vector import hashed_embedding
from hopspark.operators.extract import cooccurrence_triples
from hopspark.operators.resolve import resolve_greedy
from hopspark.sources.scratch import scratch_table


def clean_metadata(papers: DataFrame) -> DataFrame:
    """(paper_id, title, abstract, published): blanks around title and abstract gone, newlines in the abstract as spaces, the time cut to a date."""
    abstract = strip(F.replace("abstract", F.lit("\n"), F.lit(" ")))
    return papers.select("paper_id", strip(F.col("title")).alias("title"), abstract.alias("abstract"), F.to_date("published").alias("published"))


def ingest(papers: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(chunk_id, paper_id, chunk_index, text) of papers (paper_id, abstract, body).

    A null body (one that couldn't be read) leaves the abstract alone.
    """
    body = F.coalesce(chunk_texts(clean_text(F.col("body")), size, overlap), F.array().cast("array<string>"))
    abstract = strip(F.replace(F.coalesce("abstract", F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = papers.select("paper_id", F.posexplode(F.concat(F.array(abstract), body)).alias("chunk_index", "text"))
    name = F.when(F.col("chunk_index") == 0, F.lit("#abstract")).otherwise(F.concat(F.lit("#chunk"), F.col("chunk_index") - 1))
    return rows.select(F.concat("paper_id", name).alias("chunk_id"), "paper_id", "chunk_index", "text")


def body_excerpt(chunks: DataFrame, n: int = 2, most: int = 3000) -> DataFrame:
    """(paper_id, excerpt): a paper's first ``n`` body chunks joined by a space, cut at ``most`` characters."""
    rows = chunks.where(F.col("chunk_index").between(0, n)).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    body = F.transform(F.filter("c", lambda x: x["chunk_index"] >= 1), lambda x: x["text"])
    return rows.select("paper_id", F.substring(F.array_join(body, " "), 1, most).alias("excerpt"))


def build_graph(
    chunks: DataFrame,
    done: DataFrame | None = None,
    extract: Callable[[DataFrame], DataFrame] = cooccurrence_triples,
    embed: Callable[[Column], Column] | None = None,
    stored: DataFrame | None = None,
    threshold: float = 0.87,
) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of chunks whose paper isn't in ``done`` (paper_id).

    ``extract`` makes triples (source, relation, target, source_chunk_id, pos) of chunks.
    Names are one entity where they are alike once normalised.  With ``embed`` (vector of
    a text column) a name that is new also joins the most similar entity that came before
    it, if that reaches ``threshold``: one of ``stored`` (entity_id, canonical_name,
    embedding) or a name that arrived earlier, in order of chunk, triple, source before
    target.  Entities (entity_id, canonical_name, and their vector with ``embed``) are the
    new ones alone.
    """
    todo = chunks if done is None else chunks.join(done, "paper_id", "left_anti")
    triples = extract(todo)
    if embed is None:
        edges = triples.select(entity_id(F.col("source")).alias("source_entity_id"), "relation", entity_id(F.col("target")).alias("target_entity_id"), "source_chunk_id")
        names = triples.select(F.col("source").alias("name")).unionAll(triples.select(F.col("target").alias("name")))
        return names.groupBy(entity_id(F.col("name")).alias("entity_id")).agg(F.min("name").alias("canonical_name")), edges
    triples = scratch_table(triples, "triples")
    end = lambda name, k: triples.select(F.col(name).alias("name"), F.struct("source_chunk_id", "pos", F.lit(k).alias("end")).alias("at"))
    plain = F.coalesce(F.nullif(normalize_entity(F.col("name")), F.lit("")), F.lit("unknown"))
    names = end("source", 0).unionAll(end("target", 1)).groupBy(plain.alias("normalized")).agg(F.min("at").alias("at"), F.min_by("name", "at").alias("name"))
    names = names.withColumn("entity_id", entity_id(F.col("normalized")))
    if stored is not None:
        names = names.join(stored.select("entity_id"), "entity_id", "left_anti")
    # A text that sorts by arrival; what is stored sorts before all.
    arrival = F.concat(F.lit("1"), F.rpad("at.source_chunk_id", 64, " "), F.lpad(F.col("at.pos").cast("string"), 9, "0"), F.col("at.end").cast("string"), F.lit("|"), "entity_id")
    items = scratch_table(names.select(arrival.alias("item_id"), embed(F.col("normalized")).alias("embedding"), "entity_id", "name"), "names")
    founders = None if stored is None else stored.where("embedding IS NOT NULL").select(F.concat(F.lit("0|"), "entity_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    led = resolve_greedy(items.select("item_id", "embedding"), threshold, founders)
    of = scratch_table(led.where("item_id LIKE '1%'").select(F.substring_index("item_id", "|", -1).alias("entity_id"), F.substring_index("founder_id", "|", -1).alias("founder")), "leads")
    fresh = items.join(of.where("entity_id = founder").select("entity_id"), "entity_id", "left_semi")
    entities = fresh.select("entity_id", F.col("name").alias("canonical_name"), embed(F.col("name")).alias("embedding"))
    for side in ("source", "target"):
        lead = of.select(F.col("entity_id").alias(f"_{side}"), F.col("founder").alias(f"{side}_entity_id"))
        triples = triples.withColumn(f"_{side}", entity_id(F.col(side))).join(lead, f"_{side}", "left").withColumn(f"{side}_entity_id", F.coalesce(f"{side}_entity_id", f"_{side}"))
    return entities, triples.select("source_entity_id", "relation", "target_entity_id", "source_chunk_id")


def offline_graph(chunks: DataFrame, done: DataFrame | None = None, stored: DataFrame | None = None, threshold: float = 0.87) -> tuple[DataFrame, DataFrame]:
    """:func:`build_graph` with the offline extractor and embedder."""
    return build_graph(chunks, done, embed=hashed_embedding, stored=stored, threshold=threshold)
