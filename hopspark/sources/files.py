"""Readers of question files, pinned papers, and raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopspark.functions.text import clean_text, html_to_text
from hopspark.schema import PINNED, QUESTIONS


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions from JSON lines; blank lines are skipped, hop_count defaults to 2; a bad line is an error."""
    rows = spark.read.schema(QUESTIONS).option("mode", "FAILFAST").json(path)
    return rows.withColumn("hop_count", F.coalesce("hop_count", F.lit(2)))


def pinned_ids(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, pos) of a file of JSON lines; ``pos`` grows in order of the lines, with gaps.

    A missing file has none; a line that isn't JSON or has no paper_id is an error when it is read.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "paper_id string, pos long")
    rows = spark.read.schema(PINNED).option("mode", "FAILFAST").json(path)
    named = F.coalesce("paper_id", F.raise_error(F.lit("a pinned line without paper_id")).cast("string"))
    return rows.select(named.alias("paper_id"), F.monotonically_increasing_id().alias("pos"))


def fill_corpus(sources: DataFrame, target: int) -> DataFrame:
    """Papers of ranked sources (paper_id, source_rank, pos, and more): all of rank 0, then others up to ``target``.

    Sources are gone through in order of (source_rank, pos, paper_id) until ``target``
    papers are found; what comes after isn't looked at, but rank 0 is read whole however
    many it has.  A paper keeps the place where it came first, and the other columns of
    where it came last before the end.
    """
    order = ("source_rank", "pos", "paper_id")
    place = F.struct(*order)
    firsts = sources.groupBy("paper_id").agg(F.min(place).alias("first"))
    pinned = firsts.where("first.source_rank = 0")
    n = pinned.count()
    more = firsts.where("first.source_rank > 0").orderBy("first").limit(max(0, target - n))
    # the place where the last paper came in; nothing behind it is looked at
    found, last = more.agg(F.count("*"), F.max("first")).first()
    seen = sources
    if n >= target:
        seen = sources.where("source_rank = 0")
    elif n + found >= target:
        seen = sources.where(place <= F.struct(*(F.lit(last[c]).cast(sources.schema[c].dataType).alias(c) for c in order)))
    kept = pinned.unionByName(more).select("paper_id", "first")
    rest = [c for c in sources.columns if c not in order]
    values = seen.groupBy("paper_id").agg(F.max_by(F.struct(*rest, F.lit(1).alias("_")), place).alias("last"))
    rows = values.join(kept, "paper_id").orderBy("first")
    return rows.select("paper_id", *(F.col(f"last.{c}").alias(c) for c in rest), "first.source_rank", "first.pos")


def html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text) of raw pages."""
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files, cleaned."""
    return spark.read.format("binaryFile").load(path).select("path", clean_text(F.decode("content", "UTF-8")).alias("text"))
