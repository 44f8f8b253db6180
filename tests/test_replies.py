"""Replies of models, filling a corpus, and the printed comparison, against plain Python."""

import json
import random

import pytest

from hopspark.operators import evaluate, extract, synthesis
from hopspark.plans import systems
from hopspark.sources import files

TRIPLE = '{"source": "a", "relation": "r", "target": "t"}'
REPLIES = [
    f"[{TRIPLE}]", f"[{TRIPLE}, 7, null, [1], \"x\", {TRIPLE}] and more", "[{'source': 'a', 'relation': 'r', 'target': 't'}]", '[{"source": "a", "source": "b", "relation": "r", "target": "t"}, 5]',
    f"```json\n[{TRIPLE}]\n```", f"[{TRIPLE}", "", "none", "{}", "5", '"x"', '[{"source": "a", "relation": "r"}]', "[{source: 1}]", f"[{TRIPLE},]",
]


def strict(reply):
    if reply.startswith("```"):
        reply = "\n".join(x for x in reply.splitlines() if not x.strip().startswith("```"))
    try:
        return json.JSONDecoder().raw_decode(reply.strip())[0]
    except json.JSONDecodeError:
        return None


def test_triples_are_read_as_strict_json(spark):
    df = spark.createDataFrame([(str(k), r) for k, r in enumerate(REPLIES)], "paper_id string, reply string")
    want = []
    for k, r in enumerate(REPLIES):
        found = strict(r)
        for pos, x in enumerate(found if isinstance(found, list) else []):
            if isinstance(x, dict) and {"source", "relation", "target"} <= x.keys():
                want.append((str(k), pos, x["source"], x["relation"], x["target"], f"{k}#abstract"))
    assert sorted(map(tuple, extract.parse_triples(df).collect())) == sorted(want) and want


def test_claims_are_read_as_strict_json(spark):
    claim = '{"text": "c", "source_numbers": [1, 2.0, "3", 4]}'
    replies = [f'{{"claims": [{claim}, 5, {{"text": "x"}}, {{"text": "y", "source_numbers": 3}}]}} tail', f"{{'claims': [{claim}]}}", f'{{"claims": [], "claims": [{claim}]}}', '{"claims": [{"text": "a", "text": "b", "source_numbers": [1]}]}', '{"claims": "[1]"}', "{}", "[]", '{"claims": 5}']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "question_id long, reply string")
    got = sorted((r.question_id, r.pos, r.claim, list(r.source_numbers)) for r in synthesis.parse_claims(df).collect())
    assert got == [(0, 0, "c", [1, 4]), (2, 0, "c", [1, 4]), (3, 0, "b", [1])]
    readable = df.where(synthesis.claims_of(df.reply).isNotNull()).select("question_id").collect()
    assert sorted(r.question_id for r in readable) == [0, 2, 3, 4, 7]


def test_plans_and_verdicts_are_read_as_strict_json(spark):
    plans = ['["a", {"k": 1, "k": 2}, 3]', "['a', 'b']", '["a"', '{"a": 1}']
    got = systems.parse_plans(spark.createDataFrame(list(enumerate(plans)), "question_id long, reply string"), 9)
    assert sorted((r.question_id, r.part, r.question) for r in got.collect()) == [(0, 1, "a"), (0, 2, '{"k":1,"k":2}'), (0, 3, "3")]
    verdicts = {'{"correct": true}': True, "{'correct': true}": False, '{"correct": true, "correct": false}': False, '{"correct": false, "correct": true} so': True}
    df = spark.createDataFrame([(r,) for r in verdicts], "reply string")
    assert {r.reply: r.v.correct for r in df.select("reply", evaluate.parse_verdict(df.reply).alias("v")).collect()} == verdicts


def filled(rows, target):
    """Going through the sources as they come."""
    seen = {}
    for rank in range(4):
        if rank and len(seen) >= target:
            break
        for paper, _, pos, value in sorted((r for r in rows if r[1] == rank), key=lambda r: (r[2], r[0])):
            if rank and len(seen) >= target:
                break
            seen[paper] = value, seen.get(paper, (0, (rank, pos)))[1]
    return [(p, v, *at) for p, (v, at) in seen.items()]


@pytest.mark.parametrize("target", [0, 2, 5, 9, 100])
def test_a_corpus_is_filled_as_one_goes_through_its_sources(spark, target):
    rng = random.Random(target)
    rows = [(f"p{rng.randrange(14)}", rank, pos, f"{rank}-{pos}") for rank in range(4) for pos in range(5)]
    df = spark.createDataFrame(rows, "paper_id string, source_rank int, pos long, seen_in string")
    assert [tuple(r) for r in files.fill_corpus(df, target).select("paper_id", "seen_in", "source_rank", "pos").collect()] == filled(rows, target)


def test_pinned_lines_without_an_identifier_are_errors(spark, tmp_path):
    (tmp_path / "a").write_text('{"paper_id": "x"}\n\n{"paper_id": "y"}\n')
    (tmp_path / "b").write_text('{"title": "x"}\n')
    (tmp_path / "c").write_text("no json\n")
    assert [r.paper_id for r in files.pinned_ids(spark, str(tmp_path / "a")).orderBy("pos").collect()] == ["x", "y"]
    for name in "bc":
        with pytest.raises(Exception, match="paper_id|MALFORMED|FAILED_READ"):
            files.pinned_ids(spark, str(tmp_path / name)).collect()


PUBLISHED = [(0, "flat", 3, 0.675, 0.65625, 164.0), (1, "hybrid", 3, 0.475, 0.65625, 101.0), (2, "rerank", 1, 0.575, 0.78125, 304.0), (3, "grounded", 6, 0.575, 0.78125, 1400.0), (4, "full", 5, 0.55, 0.75, 2500.0)]


def test_the_comparison_prints_as_published(spark):
    schema = "pos long, system string, n_questions long, mean_accuracy double, mean_precision double, mean_recall double, mean_latency_ms double"
    rows = [(k, name, 16, right / 16, p, r, ms) for k, name, right, p, r, ms in PUBLISHED] + [(5, "ties", 8, 0.00125, 0.145, 1.0, 304.25), (6, "none", 0, 0.0, 0.0, 0.0, 0.05)]
    lines = [r.line for r in evaluate.comparison_lines(spark.createDataFrame(rows, schema)).collect()]
    assert lines[0].split() == ["system", "n", "accuracy", "precision@k", "recall@k", "latency(ms)"] and lines[1] == "-" * len(lines[0])
    assert lines[2:] == [f"{n:<20}{k:>5}{a:>12.2%}{p:>14.2%}{r:>12.2%}{ms:>14.1f}" for _, n, k, a, p, r, ms in rows]
    assert lines[2].split()[2:] == ["18.75%", "67.50%", "65.62%", "164.0"] and lines[4].split()[4] == "78.12%"


def test_a_report_lists_its_questions_and_takes_systems_of_ones_own(spark):
    questions = spark.createDataFrame([(2, "g w", ["a#1"]), (1, "x", ["b#1"])], "question_id long, gold_answer string, gold_chunk_ids array<string>")

    def own(asked, corpus):
        return asked.selectExpr("question_id", "'a#2' AS chunk_id", "1 AS rank"), asked.selectExpr("question_id", "'g w' AS answer")

    said = systems.predictions("own", questions, None, system=own)
    names = spark.createDataFrame([("own", 0), ("idle", 1)], "system string, pos long")
    own_row, idle = evaluate.report(names, evaluate.score(questions, said), per_question=True).collect()
    assert [(q.question_id, q.precision_at_k, q.correct) for q in own_row.per_question] == [(1, 0.0, False), (2, 1.0, True)]
    assert own_row.mean_accuracy == 0.5 and idle.per_question == []
