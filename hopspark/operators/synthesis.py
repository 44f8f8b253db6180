"""Grounded answers: claims are kept only with cited sources that support them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopspark.functions.text import STRICT_JSON, alnum_tokens, content_tokens, coverage, first_sentence, json_objects, json_value

# Fixed value: what is said when nothing supports an answer.
NO_EVIDENCE = "I don't have enough grounded evidence in the retrieved sources to answer this confidently."

_CITATIONS = "array<struct<pos:int,claim:string,chunk_ids:array<string>>>"


def claims_of(reply: Column) -> Column:
    """``claims`` of a model's reply ``{"claims": [{"text", "source_numbers"}]}`` as an array of JSON texts, null for what isn't an object.

    A code fence is removed and text after the first JSON value ignored; of a repeated
    field the last counts.  Null where the reply is null, isn't strict JSON, isn't an object
    or has no claims; empty where its claims aren't a list.
    """
    written, kind = json_value(reply, "claims string")["claims"], F.schema_of_variant(json_value(reply, "claims variant")["claims"])
    listed = F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(True))  # no kind is known where a field is repeated inside
    return F.when(written.isNotNull(), F.coalesce(F.when(listed, json_objects(written)), F.array().cast("array<string>")))


def parse_claims(replies: DataFrame) -> DataFrame:
    """(question_id, pos, claim, source_numbers) from replies (question_id, reply).

    Items without text or a list of numbers are dropped one by one; numbers that aren't
    whole are dropped from their list.
    """
    rows = replies.select("question_id", F.posexplode(claims_of(F.col("reply"))).alias("pos", "item"))
    rows = rows.select("question_id", "pos", F.from_json("item", "text string, source_numbers array<variant>", STRICT_JSON).alias("v"))
    text, numbers = F.col("v.text"), F.col("v.source_numbers")
    whole = F.filter(F.transform(numbers, lambda n: F.when(F.schema_of_variant(n) == "BIGINT", F.try_variant_get(n, "$", "int"))), lambda n: n.isNotNull())
    return rows.select("question_id", "pos", text.alias("claim"), whole.alias("source_numbers")).where("claim IS NOT NULL AND source_numbers IS NOT NULL")


def extractive_replies(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """The offline claim writer: each source's first sentence, citing that source, as a reply in JSON."""
    claim = F.struct(F.col("rank").alias("rank"), first_sentence(F.col("text")).alias("text"), F.array("rank").alias("source_numbers"))
    said = sources.groupBy("question_id").agg(F.array_sort(F.collect_list(claim)).alias("c"))
    listed = F.transform("c", lambda c: F.struct(c["text"].alias("text"), c["source_numbers"].alias("source_numbers")))
    return said.select("question_id", F.to_json(F.struct(listed.alias("claims"))).alias("reply"))


def grounded_claims(claims: DataFrame, sources: DataFrame, min_overlap: float = 0.4) -> DataFrame:
    """(question_id, pos, claim, chunk_ids, overlap): claims whose content words their sources cover.

    ``sources``: question_id, rank (the number a claim cites), chunk_id, text.  Numbers out
    of range are dropped, and claims left without any.  Repeated numbers stay repeated.
    """
    cited = claims.select("question_id", "pos", "claim", F.posexplode("source_numbers").alias("nth", "number"))
    found = cited.join(sources.select("question_id", F.col("rank").alias("number"), "chunk_id", "text"), ["question_id", "number"])
    grouped = found.groupBy("question_id", "pos", "claim").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"),
        F.array_distinct(F.flatten(F.collect_list(alnum_tokens(F.col("text"))))).alias("seen"),
    )
    overlap = coverage(content_tokens(F.col("claim")), F.col("seen"), 1.0)
    return grouped.withColumn("overlap", overlap).where(F.col("overlap") >= min_overlap).drop("seen")


def synthesize(questions: DataFrame, sources: DataFrame, replies: DataFrame, min_overlap: float = 0.4) -> DataFrame:
    """(question_id, answer, citations): the claims of each reply that their sources support, joined by a space.

    ``sources``: question_id, rank, chunk_id, text; ``replies``: question_id, reply.  A
    question without sources gets ''.  Where the reply is missing or can't be read, the
    answer is the first sentence of the first source, without citations.  Nothing is
    verified here: a question none of whose claims hold gets ''.
    """
    kept = grounded_claims(parse_claims(replies), sources, min_overlap)
    rows = kept.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "claim", "chunk_ids"))).alias("kept"))
    read = replies.where(claims_of(F.col("reply")).isNotNull()).select("question_id", F.lit(True).alias("readable")).distinct()
    top = sources.groupBy("question_id").agg(F.min_by("text", "rank").alias("top"), F.count("*").alias("n_sources"))
    every = questions.select("question_id").join(top, "question_id", "left").join(read, "question_id", "left").join(rows, "question_id", "left")
    every = every.withColumn("kept", F.coalesce("kept", F.array().cast(_CITATIONS)))
    joined = F.array_join(F.transform("kept", lambda c: c["claim"]), " ")
    return every.select(
        "question_id",
        F.when(F.col("n_sources").isNull(), "").when(F.col("readable").isNull(), first_sentence(F.col("top"))).otherwise(joined).alias("answer"),
        F.transform("kept", lambda c: F.struct(c["claim"].alias("claim"), c["chunk_ids"].alias("chunk_ids"))).alias("citations"),
    )


def verified(answer: Column, n_citations: Column) -> Column:
    """The answer, or the fixed sentence where nothing was cited or the answer is blank."""
    blank = F.trim(F.coalesce(answer, F.lit(""))) == ""
    return F.when((F.coalesce(n_citations, F.lit(0)) == 0) | blank, F.lit(NO_EVIDENCE)).otherwise(answer)


def verify(said: DataFrame) -> DataFrame:
    """Answers (question_id, answer, citations) after :func:`verified`."""
    return said.withColumn("answer", verified(F.col("answer"), F.size("citations")))
