"""Scoring of retrieval systems against labelled questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopspark.functions.text import json_value, judge_tokens, paper_of


def _papers(ids: Column) -> Column:
    return F.transform(ids, paper_of)


def precision_at_k(retrieved: Column, gold: Column, k: int = 5) -> Column:
    """Share of the first k chunks whose paper is a gold paper; 0.0 without chunks."""
    top = _papers(F.slice(retrieved, 1, k))
    hits = F.size(F.filter(top, lambda p: F.array_contains(_papers(gold), p)))
    return F.when(F.size(top) == 0, 0.0).otherwise(hits / F.size(top).cast("double"))


def recall_at_k(retrieved: Column, gold: Column, k: int = 5) -> Column:
    """Share of distinct gold papers among the first k chunks; 1.0 without gold."""
    want = F.array_distinct(_papers(gold))
    found = F.size(F.array_intersect(want, _papers(F.slice(retrieved, 1, k))))
    return F.when(F.size(want) == 0, 1.0).otherwise(found / F.size(want).cast("double"))


def lexical_judge(gold: Column, predicted: Column, threshold: float = 0.5) -> Column:
    """Whether the answer has enough of the gold answer's words; false without any."""
    want = judge_tokens(gold)
    share = F.size(F.array_intersect(want, judge_tokens(predicted))) / F.size(want).cast("double")
    return F.when(F.size(want) == 0, False).otherwise(share >= threshold)


def parse_verdict(reply: Column) -> Column:
    """(correct, reasoning) of a model's JSON verdict.

    A code fence is removed and text after the first JSON value ignored; the JSON is read
    strictly, and of a repeated field the last counts.  ``correct``
    counts as in Python where it isn't a boolean: zero, null and what is empty are false.
    A reply that can't be read, or has no verdict, is false and says so.
    """
    read = json_value(reply, "correct variant, reasoning variant")
    held = F.to_json(read["correct"])
    number = held.rlike("^-?[0-9]")
    truth = F.when(number, held.cast("double") != 0).otherwise(~held.isin("false", "null", '""', "[]", "{}"))
    plain = F.coalesce(F.try_variant_get(read["reasoning"], "$", "string"), F.lit(""))
    unread = F.concat(F.lit("no verdict in the reply: "), F.coalesce(reply, F.lit("")))
    return F.struct(F.coalesce(truth, F.lit(False)).alias("correct"), F.when(held.isNull(), unread).otherwise(plain).alias("reasoning"))


def score(questions: DataFrame, predictions: DataFrame, k: int = 5, judge: Column | None = None) -> DataFrame:
    """A row per prediction: system, question_id, precision, recall, correct, judge_reasoning, latency_ms.

    ``questions``: question_id, gold_answer, gold_chunk_ids; ``predictions``: system,
    question_id, predicted_answer, retrieved_chunk_ids, latency_ms.  ``judge``: a struct
    (correct, reasoning) over columns of both, as :func:`parse_verdict` makes it; by
    default the lexical judge, which gives no reasons.
    """
    rows = predictions.join(questions, "question_id")
    if judge is None:
        judge = F.struct(lexical_judge(F.col("gold_answer"), F.col("predicted_answer")).alias("correct"), F.lit(None).cast("string").alias("reasoning"))
    at = F.col("retrieved_chunk_ids"), F.col("gold_chunk_ids")
    rows = rows.withColumn("_verdict", judge)
    return rows.select("system", "question_id", precision_at_k(*at, k).alias("precision_at_k"), recall_at_k(*at, k).alias("recall_at_k"), F.col("_verdict.correct").alias("correct"), F.col("_verdict.reasoning").alias("judge_reasoning"), "latency_ms")


#: What a report keeps of each question.
QUESTION_SCORE = ("question_id", "precision_at_k", "recall_at_k", "correct", "judge_reasoning", "latency_ms")


def report(systems: DataFrame, scores: DataFrame, per_question: bool = False) -> DataFrame:
    """A row per system in order of ``pos``: number of questions and four means, 0.0 without questions.

    ``systems``: system, pos.  With ``per_question`` the scores themselves come along as a
    list in order of question_id; it has a row's size per question, so large sets of
    questions had better be read from ``scores``.
    """
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    rows = systems.join(scores, "system", "left").groupBy("pos", "system").agg(
        F.count("question_id").alias("n_questions"),
        mean(F.col("correct").cast("double"), "mean_accuracy"),
        mean("precision_at_k", "mean_precision"),
        mean("recall_at_k", "mean_recall"),
        mean("latency_ms", "mean_latency_ms"),
        *([F.filter(F.array_sort(F.collect_list(F.struct(*QUESTION_SCORE))), lambda q: q["question_id"].isNotNull()).alias("per_question")] if per_question else []),
    )
    return rows.orderBy("pos")


def comparison_lines(reports: DataFrame) -> DataFrame:
    """(pos, line): a header, a rule, and one fixed-width line per report.

    Numbers are rounded by their exact binary value, ties to the even digit.
    """
    number = lambda c, digits: F.expr(f"format_number({c}, '0.{'0' * digits}')")
    percent = lambda c: F.concat(number(f"{c} * 100", 2), F.lit("%"))
    body = F.format_string("%-20s%5d%12s%14s%12s%14s", "system", "n_questions", percent("mean_accuracy"), percent("mean_precision"), percent("mean_recall"), number("mean_latency_ms", 1))
    # fixed value: the header's names and widths
    header = f"{'system':<20}{'n':>5}{'accuracy':>12}{'precision@k':>14}{'recall@k':>12}{'latency(ms)':>14}"
    head = reports.sparkSession.createDataFrame([(-2, header), (-1, "-" * len(header))], "pos long, line string")
    return head.unionByName(reports.select(F.col("pos").cast("long").alias("pos"), body.alias("line"))).orderBy("pos")
