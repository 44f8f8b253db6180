"""Calls of models: one client per task, retries with growing waits, replies kept by prompt.

A client is what ``connect()`` returns in a worker: a function from a prompt to a reply
that raises where it fails.  Replies are rows of a Parquet table, by the prompt's SHA-256,
so a run asks only what no run before it was answered, and one prompt once however many
rows have it.  A prompt that failed every time has no reply: whoever reads the replies
takes its own fallback, and the next run asks again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]
_REPLIES = "prompt_sha256 string, reply string"


def retried(call: Callable, argument, attempts: int, first_wait: float, longest_wait: float):
    """What ``call`` returns, tried up to ``attempts`` times with waits that double; None where all fail."""
    wait = first_wait
    for attempt in range(attempts):
        if attempt:
            time.sleep(wait)
            wait = min(2 * wait, longest_wait)
        try:
            return call(argument)
        except Exception:  # noqa: BLE001 - whatever a client raises is a failed call
            continue
    return None


@dataclass(frozen=True)
class Runner:
    """How a model is asked.

    connect: makes the client in a worker.
    path: the table of replies.
    clients: most clients at a time.
    attempts, first_wait, longest_wait: calls of a prompt at most, and seconds between
        them, which double from the first to the longest.
    pause: seconds between a client's calls.
    """

    connect: Callable[[], Client]
    path: str
    clients: int = 4
    attempts: int = 5
    first_wait: float = 5.0
    longest_wait: float = 65.0
    pause: float = 0.0

    def _known(self, spark) -> DataFrame:
        try:
            rows = spark.read.schema(_REPLIES).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], _REPLIES)
        # runs side by side may have asked the same
        return rows.groupBy("prompt_sha256").agg(F.min("reply").alias("reply"))

    def _call(self, client: Client, prompt: str) -> str | None:
        return retried(client, prompt, self.attempts, self.first_wait, self.longest_wait)

    def ask(self, rows: DataFrame, key: str, prompt: Column) -> DataFrame:
        """(``key``, reply) for each of ``rows``: the reply to its ``prompt``, null where there is none.

        Null prompts aren't asked.
        """
        spark = rows.sparkSession
        asked = rows.select(F.col(key), prompt.alias("prompt")).withColumn("prompt_sha256", F.sha2("prompt", 256))
        new = asked.where("prompt IS NOT NULL").groupBy("prompt_sha256").agg(F.min("prompt").alias("prompt")).join(self._known(spark).select("prompt_sha256"), "prompt_sha256", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = None
            for batch in batches:
                for sha, text in zip(batch["prompt_sha256"].to_pylist(), batch["prompt"].to_pylist(), strict=True):
                    if client is None:
                        client = self.connect()
                    else:
                        time.sleep(self.pause)
                    reply = self._call(client, text)
                    if reply is not None:
                        yield pa.RecordBatch.from_pylist([{"prompt_sha256": sha, "reply": reply}], pa.schema([("prompt_sha256", pa.string()), ("reply", pa.string())]))

        new.repartition(self.clients, "prompt_sha256").mapInArrow(run, _REPLIES).write.mode("append").parquet(self.path)
        return asked.join(self._known(spark), "prompt_sha256", "left").select(key, "reply")


def planner(runner: Runner, prompt: Column) -> Callable[[DataFrame], DataFrame]:
    """A planner for :class:`hopspark.plans.systems.Models`; ``prompt`` is over the columns of questions."""
    return lambda questions: runner.ask(questions, "question_id", prompt)


def writer(runner: Runner, prompt: Column) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A writer of claims for :class:`hopspark.plans.systems.Models`; ``prompt`` is over ``question`` and ``block``, the numbered sources."""
    from hopspark.functions.text import sources_block

    def write(questions: DataFrame, sources: DataFrame) -> DataFrame:
        listed = sources.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "text"))).alias("s"))
        rows = questions.select("question_id", "question").join(listed.select("question_id", sources_block(F.col("s")).alias("block")), "question_id")
        return runner.ask(rows, "question_id", prompt)

    return write


def extractor(runner: Runner, papers: DataFrame, prompt: Column) -> Callable[[DataFrame], DataFrame]:
    """An extractor for :func:`hopspark.plans.ingest.build_graph`: asks once for each paper of the chunks it is given.

    ``prompt`` is over the columns of ``papers`` (paper_id and more).
    """
    from hopspark.operators.extract import parse_triples

    def extract(chunks: DataFrame) -> DataFrame:
        todo = papers.join(chunks.select("paper_id").distinct(), "paper_id", "left_semi")
        return parse_triples(runner.ask(todo, "paper_id", prompt)).drop("paper_id")

    return extract


def verdicts(runner: Runner, rows: DataFrame, key: str, prompt: Column) -> DataFrame:
    """(``key``, correct, reasoning): a model's judgement of each of ``rows``."""
    from hopspark.operators.evaluate import parse_verdict

    said = runner.ask(rows, key, prompt).withColumn("v", parse_verdict(F.col("reply")))
    return said.select(key, "v.correct", "v.reasoning")
