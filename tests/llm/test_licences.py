import re

from hopspark.llm import licences as L
from hopspark.llm.queries import ORACLE_SQL, QUERIES
from oracle import assert_same


def matches(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.rule) for r in L.licence_matches(df).collect())


def test_query_equals_its_sql(spark):
    assert_same(spark, QUERIES["op7_licence_rules"], ORACLE_SQL["op7_licence_rules"])


def text_of(rule):
    return "\n".join(L.SENTENCES[s][0] if L.SENTENCES[s][0][-1] in ".:;" else L.SENTENCES[s][0] + "." for s in L.RULES[rule][1])


def settled(sequence):
    """Matches of all rules in a sequence of (sentence number, identifier), in plain Python: (rule, first, last)."""
    tries = []
    for nth, (rule, (_, steps)) in enumerate(L.RULES.items()):
        for start, (_, name) in enumerate(sequence):
            chains = [[start]] if name == steps[0] else []
            for s in steps[1:]:
                chains = [[*c, p] for c in chains for p in range(c[-1] + 1, min(len(sequence), c[-1] + L.GAP + 2)) if sequence[p][1] == s and sequence[p][0] - sequence[c[-1]][0] <= L.FAR]
            if chains:
                tries.append((-len(steps), start, nth, rule, min(chains)))
    used, out = set(), []
    for *_, rule, chain in sorted(tries):
        if not used & set(chain):
            used |= set(chain)
            out.append((rule, sequence[chain[0]][0], sequence[chain[-1]][0]))
    return sorted(out)


def test_every_rule_finds_its_own_text(spark):
    """The longest rule that a text fulfils, and no other over the same sentences."""
    rules = list(L.RULES)
    got = matches(spark, *("Some prose. " + text_of(r) + "\nMore prose." for r in rules))
    assert got == [(k, r) for k, r in enumerate(rules)]


def test_every_rule_with_a_known_sentence_between(spark):
    """A foreign known sentence after each step leaves the rule's match whole, and has one of its own."""
    rules = [r for r, (_, steps) in L.RULES.items() if len(steps) > 1 and not r.startswith("spdx-")]
    foreign = "All rights reserved."
    texts = ["Some prose. " + f"\n{foreign}\n".join(text_of(r).split("\n")) + "\nMore prose." for r in rules]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in L.licence_matches(df).collect():
        got.setdefault(r.doc_id, []).append((r.rule, r.first_sentence, r.last_sentence))
    for k, rule in enumerate(rules):
        n = len(L.RULES[rule][1])
        assert sorted(got[k]) == sorted([(rule, 1, 2 * n - 1)] + [("all-rights-reserved", 2 * m, 2 * m) for m in range(1, n)])


def test_precedence_and_gaps_equal_plain_python(spark):
    """Random sequences of known sentences, some unknown between."""
    import random

    rng = random.Random(7)
    names = ["apache-2-name", "apache-2-compliance", "apache-2-as-is", "mit-grant", "mit-notice", "mit-as-is", "mit-liability", "all-rights-reserved", "mit-name"]
    texts, want = [], []
    for k in range(120):
        sequence, parts = [], []
        for n in range(rng.randrange(1, 40)):
            if rng.random() < 0.25:
                parts += ["Something else."] * rng.choice([1, 1, 30])
            else:
                name = rng.choice(names)
                sequence.append((len(parts), name))
                text = L.SENTENCES[name][0]
                parts.append(text if text[-1] in ".:;" else text + ".")
        texts.append("\n".join(parts))
        want += [(k, *m) for m in settled(sequence)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.rule, r.first_sentence, r.last_sentence) for r in L.licence_matches(df).collect()) == sorted(want)


def test_sql_counterpart_on_random_sequences(spark):
    import random

    import duckdb

    rng = random.Random(9)
    names = [n for n in L.SENTENCES if not n.startswith("spdx")]
    rows = [(k, "\n".join((t if (t := L.SENTENCES[rng.choice(names[:12])][0])[-1] in ".:;" else t + ".") for _ in range(rng.randrange(1, 30)))) for k in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = sorted(map(tuple, L.licence_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(con.execute(L.LICENCE_SQL).fetchall()) and got


def test_header_takes_precedence_over_the_name(spark):
    header = text_of("apache-2-header")
    assert matches(spark, header, header.replace("\n", "\nAll rights reserved.\n", 1)) == [(0, "apache-2-header"), (1, "all-rights-reserved"), (1, "apache-2-header")]


def test_wrapped_lines_and_other_sentences_between(spark):
    wrapped = text_of("bsd-2-text").replace(" ", "\n", 60).replace("copyright notice, this list", "copyright notice,\n   this list")
    assert matches(spark, "x.\n\n" + wrapped.replace("met:", "met: An aside.")) == [(0, "bsd-2-text")]


def test_order_matters(spark):
    steps = [L.SENTENCES[s][0] for s in L.RULES["mit-text"][1]]
    assert matches(spark, "\n\n".join(steps), "\n\n".join(reversed(steps)), steps[0]) == [(0, "mit-text")]


def test_a_notice_below_an_unfinished_line(spark):
    assert matches(spark, "a | b | c\nReleased under the MIT License.\nmore") == [(0, "mit-name")]


def test_prose_about_licences_is_clean(spark):
    assert matches(spark, "The MIT License is short. We compared the Apache License with others.", None, "", "x" * 100_000) == []


def test_odd_rows(spark, odd, none):
    assert L.licence_matches(odd).collect() == [] and L.licence_matches(none).collect() == []
    note = "Released under the MIT License."
    df = spark.createDataFrame([(1, note), (1, note), (1, note + " Really."), (None, note + " " + note)], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in L.licence_matches(df).collect()) == [0, 0, 1, 1]


def test_no_python_on_the_executors(odd):
    assert not re.search("Python|Pandas|Arrow", L.licence_matches(odd)._jdf.queryExecution().executedPlan().toString())


def test_notices_of_the_documents(spark):
    """Texts with a notice, found by a pattern and not by SENTENCES, all give its licence."""
    sf = "/root/testdata/sf0.01"
    notices = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "All rights reserved.": "LicenseRef-all-rights-reserved"}
    found = {(r.doc_id, r.licence) for r in QUERIES["op7_licence_rules"](spark, sf).collect()}
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    for notice, licence in notices.items():
        ids = {k for k, t in texts if notice in t}
        assert ids and ids == {k for k, x in found if x == licence}, notice
    planted = re.compile(r"(?i)^(?:(?:this work is )?licensed|released) under [^\n]*$|^all rights reserved\.$", re.M)
    assert {k for k, t in texts if planted.search(t)} <= {k for k, _ in found}


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""

AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_wordings_of_other_licences(spark):
    said = [
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1-only"),
        (LGPL, "LGPL-2.1-or-later"),
        (LGPL.replace("version 2.1", "version 3"), "LGPL-3.0-or-later"),
        (AGPL, "AGPL-3.0-or-later"),
        ("// SPDX-License-Identifier: AGPL-3.0-only\nimport os", "AGPL-3.0-only"),
        ("# SPDX-License-Identifier: MIT\n", "MIT"),
        ("SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC-4.0"),
        ("MIT", None),
        ("AGPL-3.0-only. SPDX-License-Identifier: unknown", None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(said)], "doc_id long, text string")
    assert sorted((r.doc_id, r.licence) for r in L.licence_matches(df).collect()) == [(k, x) for k, (_, x) in enumerate(said) if x]
