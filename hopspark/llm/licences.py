"""Licence scans: known sentences, then ordered rules over them.

A text is cut into sentences, each is normalised to lower-case letters and digits, and
equi-joined to a fixed table of licence sentences.  The sentences that are recognised in
a text, in order, form a sequence of identifiers; a rule is such a sequence too, and
matches where its identifiers come in order, each within GAP other known sentences and
FAR sentences of any kind of the one before.  Of matches that claim the same sentence the
one of the longest rule counts, then the earliest, then the first in RULES; a known
sentence that stands in another match's gap is matched by its own rules.  Everything is
DataFrame and SQL functions; both tables are constants of this module, so broadcasting
them is safe at any size of corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def _gnu(name: str, version: str) -> list[str]:
    whole = f"GNU {name} General Public License, version {version}"
    return [f"This work is licensed under the {whole}.", f"Licensed under the {whole}.", f"Released under the {whole}.", whole]


def _cc(long: str, short: str) -> list[str]:
    whole = f"Creative Commons {long} 4.0 International License"
    return [f"This work is licensed under a {whole}.", f"This work is licensed under the {whole}.", f"Licensed under {short} 4.0.", f"This work is licensed under {short} 4.0."]


# Identifiers of licence sentences, and their wordings.
SENTENCES = {
    "mit-name": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "This software is released under the MIT License.",
        "MIT License",
    ],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "apache-2-name": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "Released under the Apache License, Version 2.0.",
        "Apache License, Version 2.0",
    ],
    "apache-2-compliance": ["you may not use this file except in compliance with the License."],
    "apache-2-as-is": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ],
    "gpl-3-name": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "GNU General Public License, version 3",
    ],
    "gpl-2-name": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GNU General Public License, version 2.",
    ],
    "gpl-redistribute-3": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "gpl-redistribute-2": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "gpl-version-2": ["either version 2 of the License, or (at your option) any later version."],
    "gpl-no-warranty": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    ],
    "gpl-merchantability": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-3-name": _gnu("Lesser", "3"),
    "lgpl-2.1-name": _gnu("Lesser", "2.1"),
    "agpl-3-name": _gnu("Affero", "3"),
    "lgpl-redistribute-3": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "agpl-redistribute-3": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "lgpl-redistribute": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl-redistribute": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "gpl-version-2.1": ["either version 2.1 of the License, or (at your option) any later version."],
    "gpl-version-3": ["either version 3 of the License, or (at your option) any later version."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ],
    "bsd-as-is": [
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ],
    "bsd-liability": [
        f"IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES"
        for who in ("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS")
    ],
    "bsd-2-name": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."],
    "bsd-3-name": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "isc-as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ],
    "isc-liability": [
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "mpl-2-name": [
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "mpl-2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "epl-2-name": [
        "Licensed under the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "bsl-1-name": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "cc0-1-name": ["Licensed under CC0 1.0 Universal.", "This work is licensed under CC0 1.0 Universal.", "Licensed under CC0 1.0."],
    "cc0-1-dedication": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."
    ],
    "cc0-1-warranty": ["This software is distributed without any warranty."],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain."],
    "cc-by-4-name": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-sa-4-name": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc-4-name": _cc("Attribution-NonCommercial", "CC BY-NC"),
    "cc-by-nc-sa-4-name": _cc("Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA"),
    "cc-by-nd-4-name": _cc("Attribution-NoDerivatives", "CC BY-ND"),
    "cc-by-nc-nd-4-name": _cc("Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND"),
    "all-rights-reserved": ["All rights reserved."],
}

# Rules, their licence, and the sentences that must follow one another.
RULES = {
    "mit-name": ("MIT", ["mit-name"]),
    "mit-text": ("MIT", ["mit-grant", "mit-notice"]),
    "mit-whole-text": ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    "apache-2-name": ("Apache-2.0", ["apache-2-name"]),
    "apache-2-header": ("Apache-2.0", ["apache-2-name", "apache-2-compliance", "apache-2-as-is"]),
    "gpl-3-name": ("GPL-3.0-only", ["gpl-3-name"]),
    "gpl-2-name": ("GPL-2.0-only", ["gpl-2-name"]),
    "gpl-3-header": ("GPL-3.0-or-later", ["gpl-redistribute-3", "gpl-no-warranty", "gpl-merchantability"]),
    "lgpl-3-name": ("LGPL-3.0-only", ["lgpl-3-name"]),
    "lgpl-2.1-name": ("LGPL-2.1-only", ["lgpl-2.1-name"]),
    "agpl-3-name": ("AGPL-3.0-only", ["agpl-3-name"]),
    "lgpl-3-header": ("LGPL-3.0-or-later", ["lgpl-redistribute-3", "gpl-no-warranty", "gpl-merchantability"]),
    "lgpl-3-parted-header": ("LGPL-3.0-or-later", ["lgpl-redistribute", "gpl-version-3", "gpl-no-warranty", "gpl-merchantability"]),
    "lgpl-2.1-header": ("LGPL-2.1-or-later", ["lgpl-redistribute", "gpl-version-2.1", "gpl-no-warranty", "gpl-merchantability"]),
    "agpl-3-header": ("AGPL-3.0-or-later", ["agpl-redistribute-3", "gpl-no-warranty", "gpl-merchantability"]),
    "agpl-3-parted-header": ("AGPL-3.0-or-later", ["agpl-redistribute", "gpl-version-3", "gpl-no-warranty", "gpl-merchantability"]),
    "gpl-2-header": ("GPL-2.0-or-later", ["gpl-redistribute-2", "gpl-version-2", "gpl-no-warranty", "gpl-merchantability"]),
    "bsd-2-text": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    "bsd-3-text": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    "bsd-2-whole-text": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    "bsd-3-whole-text": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability"]),
    "bsd-2-name": ("BSD-2-Clause", ["bsd-2-name"]),
    "bsd-3-name": ("BSD-3-Clause", ["bsd-3-name"]),
    "epl-2-name": ("EPL-2.0", ["epl-2-name"]),
    "bsl-1-name": ("BSL-1.0", ["bsl-1-name"]),
    "zlib-text": ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    "cc0-1-name": ("CC0-1.0", ["cc0-1-name"]),
    "cc0-1-text": ("CC0-1.0", ["cc0-1-dedication", "cc0-1-warranty"]),
    "isc-text": ("ISC", ["isc-grant"]),
    "isc-whole-text": ("ISC", ["isc-grant", "isc-as-is", "isc-liability"]),
    "mpl-2-name": ("MPL-2.0", ["mpl-2-name"]),
    "mpl-2-header": ("MPL-2.0", ["mpl-2-subject", "mpl-2-copy"]),
    "unlicense-text": ("Unlicense", ["unlicense-domain"]),
    "cc-by-4-name": ("CC-BY-4.0", ["cc-by-4-name"]),
    "cc-by-sa-4-name": ("CC-BY-SA-4.0", ["cc-by-sa-4-name"]),
    "cc-by-nc-4-name": ("CC-BY-NC-4.0", ["cc-by-nc-4-name"]),
    "cc-by-nc-sa-4-name": ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4-name"]),
    "cc-by-nd-4-name": ("CC-BY-ND-4.0", ["cc-by-nd-4-name"]),
    "cc-by-nc-nd-4-name": ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4-name"]),
    "all-rights-reserved": ("LicenseRef-all-rights-reserved", ["all-rights-reserved"]),
}

# Names in SPDX tags.  A text is cut after the tag's colon, so tag and name are two sentences.
SPDX = [
    *("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "EPL-2.0", "BSL-1.0", "Zlib", "CC0-1.0"),
    *(f"{name}-{end}" for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("only", "or-later")),
    *(f"CC-{kind}-4.0" for kind in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")),
]
SENTENCES |= {"spdx-tag": ["SPDX-License-Identifier:"]} | {f"spdx-{name}": [name] for name in SPDX}
RULES |= {f"spdx-{name}": (name, ["spdx-tag", f"spdx-{name}"]) for name in SPDX}

#: Most other known sentences, and most sentences of any kind further on, between two that a rule asks for.
GAP, FAR = 3, 25

#: Sentences end at these marks before a blank or the end, and at blank lines.
_ENDS = r"[.!?;:]+([ \t\r\n]+|\z)|\n[ \t\r]*\n"
_OTHER = "[^a-z0-9]+"


def normalised(sentence: str) -> str:
    return re.sub(_OTHER, " ", sentence.lower()).strip()


def _values(rows: list[tuple]) -> str:
    text = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(text, row))})" for row in rows)


def _sentence_rows() -> list[tuple]:
    return sorted({(normalised(s), name) for name, texts in SENTENCES.items() for s in texts})


def _rule_rows() -> list[tuple]:
    return [(rule, licence, k, len(steps), s, nth) for nth, (rule, (licence, steps)) in enumerate(RULES.items()) for k, s in enumerate(steps)]


def _inline(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {_values(rows)} AS t({names})"))


def recognised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, at, line, sentence): known sentences of each distinct (doc_id, text).

    ``at`` numbers the text's sentences from 0.  A sentence that runs over several lines
    is looked up as a whole (``line`` 0) and line by line (from 1), as a notice often
    stands on a line of its own below one without a closing mark.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).where("text IS NOT NULL")
    cut = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", _ENDS)).alias("at", "part"))
    lines = F.when(F.contains("part", F.lit("\n")), F.concat(F.array("part"), F.split("part", "\n"))).otherwise(F.array("part"))
    parts = cut.select("doc_id", "text_hash", "at", F.posexplode(lines).alias("line", "part"))
    plain = parts.select("doc_id", "text_hash", "at", "line", F.trim(F.regexp_replace(F.lower("part"), _OTHER, " ")).alias("plain"))
    return plain.join(_inline(spark, _sentence_rows(), "plain, sentence"), "plain").drop("plain").distinct()


def licence_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per match of a rule: doc_id, rule, licence, first_sentence and last_sentence.

    Sentence numbers are those of :func:`recognised`; they cover the match from its first
    sentence to its last, those in its gaps included.  Of several ways for a rule to go on
    from one sentence the one with the earliest sentences counts.  Null and empty texts
    match nothing.  Repeated rows (same doc_id and text) count once; rows of one doc_id
    and different texts are matched apart; null ids are kept.
    """
    own = ["doc_id", "text_hash"]
    longest = max(len(steps) for _, steps in RULES.values())
    sequence = recognised(docs, doc_id, text).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("at", "line", "sentence"))).alias("q"))
    # What a match that begins at a place can hold: the sequence from there on, as far as gaps allow.
    ahead = F.expr(f"transform(q, (x, i) -> slice(q, i + 1, {(longest - 1) * (GAP + 1) + 1}))")
    starts = sequence.select(*own, F.posexplode(ahead).alias("place", "w")).withColumn("sentence", F.expr("w[0].sentence"))
    steps = F.broadcast(docs.sparkSession.sql(f"SELECT rule, licence, nth, array_sort(collect_list(struct(step, sentence))).sentence AS steps FROM VALUES {_values(_rule_rows())} AS t(rule, licence, step, n_steps, sentence, nth) GROUP BY rule, licence, nth"))
    tried = starts.join(steps, F.col("sentence") == F.col("steps")[0])
    here = "element_at(c, -1)"
    further = f"filter(sequence(0, size(w) - 1), p -> p > {here} AND p <= {here} + {GAP + 1} AND get(w, p).sentence = s AND get(w, p).at - get(w, {here}).at <= {FAR})"
    chains = f"aggregate(slice(steps, 2, size(steps)), array(array(0)), (acc, s) -> flatten(transform(acc, c -> transform({further}, p -> concat(c, array(p))))))"
    found = tried.withColumn("chain", F.expr(f"array_min({chains})")).where("chain IS NOT NULL")
    match = found.select(*own, F.size("steps").alias("n"), "place", "nth", "rule", "licence", F.expr("transform(chain, p -> place + p)").alias("places"), F.expr("w[0].at").alias("first"), F.expr("get(w, element_at(chain, -1)).at").alias("last"))
    # Matches that can't share a sentence are settled apart.
    order = Window.partitionBy(*own).orderBy("place", "nth")
    before = F.max(F.element_at("places", -1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = match.withColumn("new", F.coalesce(F.col("place") > before, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = apart.groupBy(*own, "part").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("pref"), "place", "nth", "rule", "licence", "places", "first", "last"))).alias("ms"))
    kept = rows.withColumn("kept", F.expr("aggregate(ms, slice(ms, 1, 0), (acc, m) -> if(exists(acc, k -> arrays_overlap(k.places, m.places)), acc, concat(acc, array(m))))"))
    return kept.select("doc_id", F.explode("kept").alias("k")).select("doc_id", "k.rule", "k.licence", F.col("k.first").cast("long").alias("first_sentence"), F.col("k.last").cast("long").alias("last_sentence"))


#: The same in DuckDB, with its own cutting and numbering, rules followed step by step and matches settled one by one.
LICENCE_SQL = f"""
    WITH RECURSIVE known(plain, sentence) AS (VALUES {_values(_sentence_rows())}),
    rules(rule, licence, step, n_steps, sentence, nth_rule) AS (VALUES {_values(_rule_rows())}),
    texts AS (SELECT row_number() OVER () AS t, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
    cut AS (SELECT t, regexp_split_to_array(text, '{_ENDS}') AS parts FROM texts),
    sentences AS (SELECT t, generate_subscripts(parts, 1) - 1 AS nth, unnest(parts) AS part FROM cut),
    lined AS (
        SELECT t, nth, CASE WHEN contains(part, chr(10)) THEN list_concat([part], string_split(part, chr(10))) ELSE [part] END AS lines
        FROM sentences
    ),
    parts AS (SELECT t, nth, generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS part FROM lined),
    found AS (
        SELECT DISTINCT t, nth, line, sentence
        FROM parts JOIN known ON trim(regexp_replace(lower(part), '{_OTHER}', ' ', 'g')) = known.plain
    ),
    sequence AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY nth, line, sentence) AS place FROM found),
    chains AS (
        SELECT t, rule, step, place AS start, nth AS first_at, place AS here, nth AS last_at, [place] AS places FROM sequence JOIN rules USING (sentence) WHERE step = 0
        UNION ALL
        SELECT c.t, c.rule, r.step, c.start, c.first_at, s.place, s.nth, list_append(c.places, s.place)
        FROM chains c JOIN rules r ON r.rule = c.rule AND r.step = c.step + 1
        JOIN sequence s ON s.t = c.t AND s.sentence = r.sentence AND s.place > c.here AND s.place <= c.here + {GAP + 1} AND s.nth - c.last_at <= {FAR}
    ),
    matched AS (
        SELECT t, c.rule, start, min(first_at) AS first_at, min(places) AS places, arg_min(last_at, places) AS last_at
        FROM chains c JOIN rules r ON r.rule = c.rule AND r.step = c.step AND r.step = r.n_steps - 1 GROUP BY t, c.rule, start
    ),
    ranked AS (
        SELECT m.*, r.licence, row_number() OVER (PARTITION BY t ORDER BY n_steps DESC, start, nth_rule) AS turn
        FROM matched m JOIN rules r ON r.rule = m.rule AND r.step = 0
    ),
    settled AS (
        SELECT t, turn, rule, licence, first_at, last_at, places AS used, true AS kept FROM ranked WHERE turn = 1
        UNION ALL
        SELECT r.t, r.turn, r.rule, r.licence, r.first_at, r.last_at, CASE WHEN list_has_any(s.used, r.places) THEN s.used ELSE list_concat(s.used, r.places) END, NOT list_has_any(s.used, r.places)
        FROM settled s JOIN ranked r ON r.t = s.t AND r.turn = s.turn + 1
    )
    SELECT doc_id, rule, licence, CAST(first_at AS BIGINT) AS first_sentence, CAST(last_at AS BIGINT) AS last_sentence
    FROM settled JOIN texts USING (t) WHERE kept
"""
