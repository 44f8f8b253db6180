"""The queries of the catalogue in DuckDB's SQL, written independently of the plans."""

from __future__ import annotations

import re

from hopspark.functions.text import STOPWORDS
from hopspark.operators.synthesis import NO_EVIDENCE

_BLANKS = r"[\s\x0b\x1c-\x1f]"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{_BLANKS}+'), lambda w: w <> '')"


def _tokens(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


def _content(c: str) -> str:
    return f"list_filter({_tokens(c)}, lambda w: NOT list_contains([{_STOP}], w))"


def _judged(c: str) -> str:
    return f"list_distinct({_words(f'''regexp_replace(lower({c}), '[^a-z0-9{_BLANKS[1:]}', ' ', 'g')''')})"


def _clean(c: str) -> str:
    c = f"regexp_replace(regexp_replace(regexp_replace({c}, '\\x00', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({c}, '^{_BLANKS}+', ''), '{_BLANKS}+$', '')"


def _entity(c: str) -> str:
    c = f"regexp_replace(regexp_replace(lower({c}), '^{_BLANKS}+', ''), '{_BLANKS}+$', '')"
    return f"regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]', '', 'g'), '{_BLANKS}+', ' ', 'g')"


def _entity_id(c: str) -> str:
    return f"'e_' || substr(sha1(coalesce(nullif({_entity(c)}, ''), 'unknown')), 1, 12)"


def _first(c: str) -> str:
    return f"CASE WHEN instr({c}, '. ') > 0 THEN substr({c}, 1, instr({c}, '. ') - 1) ELSE {c} END || '.'"


def _title(c: str) -> str:
    return f"CASE WHEN length({c}) <= 60 THEN {c} ELSE substr({c}, 1, 57) || '...' END"


def _cos(a: str, b: str) -> str:
    d = lambda x, y: f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"
    return f"round({d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)})), 9)"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


_PAPERS = f"papers AS (SELECT 'd' || doc_id AS paper_id, {_title('text')} AS title, array_to_string(list_slice({_words('text')}, 1, 50), ' ') AS abstract, text FROM documents)"
_CHUNKS = f"""
    worded AS (SELECT paper_id, abstract, {_words("text")} AS w FROM papers),
    counted AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 500 THEN 1 ELSE 1 + CAST(ceil((len(w) - 500) / 450.0) AS INTEGER) END AS n FROM worded),
    chunks AS (
        SELECT paper_id || '#abstract' AS chunk_id, paper_id, 0::BIGINT AS chunk_index, abstract AS text FROM worded
        UNION ALL
        SELECT paper_id || '#chunk' || j, paper_id, (j + 1)::BIGINT, array_to_string(list_slice(w, j * 450 + 1, j * 450 + 500), ' ')
        FROM (SELECT *, unnest(range(n)) AS j FROM counted)
    )"""
_VEC = """
    vec AS (
        SELECT e.vec_id, 'v' || (e.vec_id // 5) || '#chunk' || (e.vec_id % 5) AS chunk_id, 'v' || (e.vec_id // 5) AS paper_id, e.embedding, coalesce(d.text, '') AS text
        FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
    )"""
_ASKED = f"asked AS (SELECT vec_id AS question_id, embedding, {_first('text')} AS question, chunk_id AS gold FROM vec WHERE vec_id % 20 = 0)"
_VPAPERS = f"vpapers AS (SELECT paper_id, {_title('text')} AS title FROM (SELECT paper_id, min_by(text, vec_id) AS text FROM vec GROUP BY paper_id))"


def _hits(k: int, asked: str = "asked") -> str:
    return f"""hits AS (
        SELECT * FROM (
            SELECT question_id, chunk_id, similarity, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank
            FROM (SELECT q.question_id, v.chunk_id, {_cos("q.embedding", "v.embedding")} AS similarity FROM {asked} q, vec v)
        ) WHERE rank <= {k}
    )"""


_OEDGES = """
    edges AS (
        SELECT 'c' || o_custkey AS source_entity_id, 'p' || l_partkey AS target_entity_id, 'o' || o_orderkey || '#abstract' AS source_chunk_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    )"""
_VEDGES = """
    edges AS (
        SELECT 'v' || (vec_id // 5) AS source_entity_id, 'addresses_subtopic' AS relation, 't' || vec_id AS target_entity_id, 'v' || (vec_id // 5) || '#abstract' AS source_chunk_id, embedding FROM embeddings
        UNION ALL
        SELECT 'k' || (vec_id // 8), 'related_to', 't' || vec_id, 'v' || (vec_id // 5) || '#abstract', embedding FROM embeddings
    )"""
_DEGREES = "degrees AS (SELECT entity, count(*) AS degree FROM (SELECT source_entity_id AS entity FROM edges UNION ALL SELECT target_entity_id FROM edges) GROUP BY entity)"
_NEIGHBORS = """
    small AS (SELECT entity FROM degrees WHERE degree <= 8),
    seed_entities AS (
        SELECT source_chunk_id AS seed, source_entity_id AS entity FROM edges WHERE source_entity_id IN (SELECT entity FROM small)
        UNION SELECT source_chunk_id, target_entity_id FROM edges WHERE target_entity_id IN (SELECT entity FROM small)
    ),
    frontier AS (
        SELECT s.seed, e.target_entity_id AS entity FROM seed_entities s JOIN edges e ON e.source_entity_id = s.entity
        UNION SELECT s.seed, e.source_entity_id FROM seed_entities s JOIN edges e ON e.target_entity_id = s.entity
    ),
    reached AS (SELECT * FROM seed_entities UNION SELECT * FROM frontier WHERE entity IN (SELECT entity FROM small)),
    near AS (
        SELECT r.seed, e.source_chunk_id AS chunk_id FROM reached r JOIN edges e ON e.source_entity_id = r.entity WHERE e.source_chunk_id <> r.seed
        UNION SELECT r.seed, e.source_chunk_id FROM reached r JOIN edges e ON e.target_entity_id = r.entity WHERE e.source_chunk_id <> r.seed
    )"""
_BRIDGES = f"""
    sub AS (SELECT source_chunk_id AS chunk_id, target_entity_id, embedding FROM edges WHERE relation = 'addresses_subtopic'),
    matched AS (
        SELECT a.chunk_id AS seed, b.chunk_id, b.similarity
        FROM (SELECT chunk_id, target_entity_id, embedding FROM sub) a,
        LATERAL (
            SELECT o.chunk_id, {_cos("o.embedding", "a.embedding")} AS similarity FROM sub o WHERE o.chunk_id <> a.chunk_id
            ORDER BY {_cos("o.embedding", "a.embedding")} DESC, o.chunk_id LIMIT 3
        ) b
    ),
    bridged AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, chunk_id) AS rank
            FROM (SELECT seed, chunk_id, max(similarity) AS similarity FROM matched WHERE similarity >= 0.30 GROUP BY seed, chunk_id)
        ) WHERE rank <= 2
    )"""
_EXPANSIONS = """
    expansions AS (
        SELECT seed, chunk_id, pos FROM (
            SELECT *, row_number() OVER (PARTITION BY seed ORDER BY kind, spot, chunk_id) AS pos
            FROM (SELECT seed, chunk_id, 0 AS kind, 0 AS spot FROM near UNION ALL SELECT seed, chunk_id, 1, rank FROM bridged)
        ) WHERE pos <= 3
    )"""


def _merged(name: str, rows: str, limit: int | None) -> str:
    """Rows (question_id, chunk_id, a, b, c): first occurrences in this order, numbered."""
    return f"""{name} AS (
        SELECT * FROM (
            SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY spot) AS rank
            FROM (SELECT question_id, chunk_id, min(row(a, b, c)) AS spot FROM ({rows}) GROUP BY question_id, chunk_id)
        ){"" if limit is None else f" WHERE rank <= {limit}"}
    )"""


_HYBRID = _merged(
    "hybrid",
    """
    SELECT question_id, chunk_id, 0 AS a, rank AS b, 0 AS c FROM hits WHERE rank <= 3
    UNION ALL
    SELECT h.question_id, e.chunk_id, 1, h.rank, e.pos FROM hits h JOIN expansions e ON e.seed = split_part(h.chunk_id, '#', 1) || '#abstract' WHERE h.rank <= 3
    UNION ALL
    SELECT question_id, chunk_id, 2, rank, 0 FROM hits
    """,
    20,
)
_RETRIEVAL = (_VEC, _ASKED, _hits(60), _VEDGES, _DEGREES, _NEIGHBORS, _BRIDGES, _EXPANSIONS, _HYBRID)

_TURNS = """
    firsts AS (SELECT conv_id, min(turn) AS asked_at, min_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
    cands AS (
        SELECT c.conv_id AS question_id, f.question, 'c' || c.conv_id || '-' || (c.turn // 4) || '#turn' || c.turn AS chunk_id, c.turn, c.text,
               row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS rank
        FROM conversations c JOIN firsts f USING (conv_id) WHERE c.turn <> f.asked_at
    )"""


def _score(question: str, text: str) -> str:
    return f"round(CASE WHEN len({_tokens(question)}) = 0 THEN 0.0 ELSE len(list_intersect({_tokens(question)}, {_tokens(text)})) / len({_tokens(question)})::DOUBLE END, 6)"


def _reranked(rows: str, cap: bool = True, limit: int | None = 20) -> str:
    """Scored rows in order; ``rows``: question_id, chunk_id, rank, question, text."""
    first = "" if limit is None else f" WHERE rank <= {limit}"
    scored = f"""
    scored AS (
        SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS rank
        FROM (SELECT question_id, chunk_id, rank, {_score("question", "text")} AS score FROM ({rows}){first})
    )"""
    return scored + (", " + _capped("capped", "scored", ", score") if cap else "")


def _capped(name: str, rows: str, more: str = "") -> str:
    return f"""{name} AS (
        SELECT question_id, chunk_id{more}, row_number() OVER (PARTITION BY question_id ORDER BY nth > 2, rank) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY question_id, split_part(chunk_id, '#', 1) ORDER BY rank) AS nth FROM {rows})
    )"""


_SCORED_HYBRID = _reranked("SELECT h.question_id, h.chunk_id, h.rank, a.question, v.text FROM hybrid h JOIN vec v USING (chunk_id) JOIN asked a USING (question_id)")


def _said(top: str, verified: bool = True) -> str:
    """Answers from the first five of ``top`` (question_id, chunk_id, rank); what isn't verified is '' where no claim is kept."""
    none = f"'{NO_EVIDENCE.replace(chr(39), chr(39) * 2)}'" if verified else "''"
    overlap = f"CASE WHEN len({_content('claim')}) = 0 THEN 1.0 ELSE len(list_intersect({_content('claim')}, {_tokens('text')})) / len({_content('claim')})::DOUBLE END"
    return f"""
    claims AS (SELECT question_id, rank, text, {_first("text")} AS claim FROM (SELECT t.question_id, t.rank, v.text FROM {top} t JOIN vec v USING (chunk_id) JOIN vpapers USING (paper_id) WHERE t.rank <= 5)),
    kept AS (SELECT question_id, string_agg(claim, ' ' ORDER BY rank) AS answer, count(*) AS n FROM claims WHERE {overlap} >= 0.4 GROUP BY question_id),
    said AS (
        SELECT question_id, CASE WHEN coalesce(n, 0) = 0 OR trim(answer) = '' THEN {none} ELSE answer END AS answer, coalesce(n, 0) AS n_citations
        FROM asked LEFT JOIN kept USING (question_id)
    )"""


_LABELLED = (
    _TURNS,
    """
    gold AS (SELECT question_id, min(question) AS gold_answer, list_slice(list(chunk_id ORDER BY rank), 1, 2) AS gold FROM cands GROUP BY question_id),
    predicted AS (
        SELECT 'forward' AS system, question_id, list(chunk_id ORDER BY rank) AS ids, min_by(text, rank) AS said, 10.0 AS ms FROM cands GROUP BY question_id
        UNION ALL
        SELECT 'backward', question_id, list(chunk_id ORDER BY rank DESC), max_by(text, rank), 30.0 FROM cands GROUP BY question_id
    )""",
)


def _graded(rows: str) -> str:
    """``rows``: system, question_id, ids, said, ms, gold (chunk ids), gold_answer."""
    paper = lambda c: f"list_transform({c}, lambda x: split_part(x, '#', 1))"
    return f"""
    top AS (SELECT *, {paper("list_slice(ids, 1, 5)")} AS papers, list_distinct({paper("gold")}) AS want FROM ({rows})),
    graded AS (
        SELECT system, question_id, ms,
               CASE WHEN len(papers) = 0 THEN 0.0 ELSE len(list_filter(papers, lambda p: list_contains(want, p))) / len(papers)::DOUBLE END AS precision_at_k,
               CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_filter(want, lambda p: list_contains(papers, p))) / len(want)::DOUBLE END AS recall_at_k,
               CASE WHEN len({_judged("gold_answer")}) = 0 THEN false ELSE len(list_intersect({_judged("gold_answer")}, {_judged("said")})) / len({_judged("gold_answer")})::DOUBLE >= 0.5 END AS correct
        FROM top
    )"""


_GRADED = (*_LABELLED, _graded("SELECT p.*, g.gold, g.gold_answer FROM predicted p JOIN gold g USING (question_id)"))


def _report(systems: list[str]) -> str:
    names = ", ".join(f"('{s}', {k})" for k, s in enumerate(systems))
    mean = lambda c, n: f"round(coalesce(avg({c}), 0.0), 6) AS {n}"
    return f"""
    SELECT CAST(n.pos AS BIGINT) AS pos, n.system, count(question_id) AS n_questions, {mean("correct::INT", "mean_accuracy")}, {mean("precision_at_k", "mean_precision")}, {mean("recall_at_k", "mean_recall")}, {mean("ms", "mean_latency_ms")}
    FROM (VALUES {names}) AS n(system, pos) LEFT JOIN graded USING (system) GROUP BY n.pos, n.system"""


def _hashed(c: str) -> str:
    """Counts of a text's words, dealt into 64 places by their MD5."""
    return f"list_transform(range(64), lambda k: len(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 = k))::DOUBLE)"


#: What is searched for, a question k as 2k, and the first sub-question of its plan, if there is one, as 2k + 1.
_ASKS = f"""
    plans AS (SELECT question_id, list_filter(regexp_split_to_array(question, '[.?!][\\s\\x0b]+'), lambda s: trim(s) <> '') AS parts FROM asked),
    asks AS (
        SELECT question_id * 2 AS question_id, embedding::DOUBLE[] AS embedding FROM asked
        UNION ALL SELECT question_id * 2 + 1, {_hashed("parts[1]")} FROM plans WHERE len(parts) > 1
    )"""
_CANDIDATES = "SELECT m.question_id, m.chunk_id, m.rank, a.question, v.text FROM merged m JOIN vec v USING (chunk_id) JOIN asked a USING (question_id)"
_PASSED = "passed AS (SELECT * FROM capped WHERE question_id IN (SELECT question_id FROM scored GROUP BY question_id HAVING max(score) >= 0.5))"
_ORCHESTRATED = (
    _VEC,
    _ASKED,
    _VPAPERS,
    _VEDGES,
    _DEGREES,
    _NEIGHBORS,
    _BRIDGES,
    _EXPANSIONS,
    _ASKS,
    _hits(60, "asks"),
    _HYBRID,
    _merged("merged", "SELECT question_id // 2 AS question_id, chunk_id, question_id % 2 AS a, rank AS b, 0 AS c FROM hybrid", None),
    _reranked(_CANDIDATES, limit=None),
    _PASSED,
)


#: The orchestrated system without sub-questions.
_ALONE = "merged AS (SELECT question_id, chunk_id, rank FROM hybrid)"


def _html(c: str) -> str:
    c = f"regexp_replace({c}, '(?is)<(script|style)\\b.*?</(script|style)>|<!--.*?-->', ' ', 'g')"
    c = f"regexp_replace({c}, '(?i)</(p|div|h[1-6]|li|tr|article)>|<br[ /]*>', chr(10), 'g')"
    c = f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return _clean(c)




def _other(part: str) -> str:
    """The same with names of its own for what comes after retrieval."""
    for name in ("scored", "capped", "claims", "kept", "said"):
        part = re.sub(rf"\b{name}\b", f"o_{name}", part)
    return part


def _top_sentence(ranked: str) -> str:
    return f"(SELECT {_first('v.text')} FROM {ranked} t JOIN vec v USING (chunk_id) WHERE t.question_id = a.question_id AND t.rank = 1)"


def _answered(system: str, ranked: str, said: str) -> str:
    return f"SELECT '{system}' AS system, a.question_id, coalesce((SELECT list(t.chunk_id ORDER BY t.rank) FROM {ranked} t WHERE t.question_id = a.question_id), []) AS ids, coalesce({said}, '') AS said FROM asked a"


_PREDICTED = "flat AS (SELECT * FROM hits WHERE rank <= 20), predicted AS (" + " UNION ALL ".join(
    (
        _answered("flat", "flat", _top_sentence("flat")),
        _answered("hybrid", "hybrid", _top_sentence("hybrid")),
        _answered("reranked", "capped", _top_sentence("capped")),
        _answered("grounded", "capped", "(SELECT s.answer FROM said s WHERE s.question_id = a.question_id)"),
        _answered("orchestrated", "(SELECT * FROM passed WHERE rank <= 5)", "(SELECT s.answer FROM o_said s WHERE s.question_id = a.question_id)"),
    )
) + ")"

def _greedy(items: str, seeded: str) -> str:
    """Items in order, one by one; those for which ``seeded`` holds are founders whatever came before."""
    return _with(
        f"arriving AS ({items})",
        f"pairs AS (SELECT * FROM (SELECT x.vec_id AS a, y.vec_id AS b, {_cos('x.embedding', 'y.embedding')} AS s FROM arriving x JOIN arriving y ON x.vec_id < y.vec_id) WHERE s >= 0.35)",
        f"arrivals AS (SELECT vec_id, {seeded} AS seeded, row_number() OVER (ORDER BY vec_id) AS nth FROM arriving)",
        """
        steps AS (
            SELECT nth, vec_id AS item_id, vec_id AS founder_id, [vec_id] AS founders FROM arrivals WHERE nth = 1
            UNION ALL
            SELECT nth, item_id, coalesce(best, item_id), CASE WHEN best IS NULL THEN list_append(founders, item_id) ELSE founders END
            FROM (
                SELECT n.nth, n.vec_id AS item_id, g.founders, arg_max(p.a, row(p.s, -p.a)) AS best
                FROM steps g JOIN arrivals n ON n.nth = g.nth + 1 LEFT JOIN pairs p ON p.b = n.vec_id AND NOT n.seeded AND list_contains(g.founders, p.a)
                GROUP BY n.nth, n.vec_id, g.founders
            )
        )""",
    ) + "SELECT item_id, founder_id FROM steps"


_TRIPLES = r"""
    named AS (SELECT chunk_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_-]+'), lambda n: length(n) >= 2 AND regexp_matches(n, '^\p{Lu}')) AS n FROM chunks),
    triples AS (
        SELECT DISTINCT n[i] AS source, 'related_to' AS relation, n[i + 1] AS target, chunk_id AS source_chunk_id
        FROM (SELECT *, unnest(range(1, len(n))) AS i FROM named) WHERE n[i] <> n[i + 1]
    )"""

#: Entities and edges of all documents, in one table of parts.
OFFLINE_GRAPH = (
    _with(_PAPERS, _CHUNKS, _TRIPLES)
    + f"""
        SELECT 'edge' AS part, {_entity_id("source")} AS source_entity_id, relation, {_entity_id("target")} AS target_entity_id, source_chunk_id, NULL::VARCHAR AS canonical_name FROM triples
        UNION ALL
        SELECT 'entity', entity_id, NULL, NULL, NULL, min(name) FROM (
            SELECT {_entity_id("source")} AS entity_id, source AS name FROM triples UNION ALL SELECT {_entity_id("target")}, target FROM triples
        ) GROUP BY entity_id
    """
)

ORACLE = {
    "vector_topk": _with(_VEC, _ASKED, _hits(20)) + "SELECT chunk_id, round(similarity, 6) AS similarity, rank FROM hits WHERE question_id = 0",
    "vector_topk_batch": _with(_VEC, _ASKED, _hits(20)) + "SELECT question_id, chunk_id, round(similarity, 6) AS similarity, rank FROM hits",
    "vector_index_sizes": "SELECT source, count(*) AS n, greatest(1, least(100, count(*) // 100))::BIGINT AS lists FROM documents GROUP BY ROLLUP (source)",
    "vector_normalize": """
        WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings),
        s AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM n)
        SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(CASE WHEN size > 0 THEN e[i] / size ELSE e[i] END, 6) AS value FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM s)
    """,
    "vector_cosine_pairs": f"SELECT a, b, round(s, 6) AS similarity FROM (SELECT x.vec_id AS a, y.vec_id AS b, {_cos('x.embedding', 'y.embedding')} AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE s >= 0.3",
    "first_sentence": f"SELECT doc_id, {_first('text')} AS sentence FROM documents",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "html_to_text": f"SELECT page_id, {_html('html')} AS text FROM pages",
    "chunk_documents": _with(_PAPERS, _CHUNKS) + "SELECT chunk_id, paper_id, chunk_index, text FROM chunks",
    "chunk_stats": _with(_PAPERS, _CHUNKS)
    + """
        SELECT source, lang, count(*) AS n_chunks, CAST(count(*) FILTER (chunk_index > 0) AS BIGINT) AS n_body, CAST(sum(CASE WHEN chunk_index > 0 THEN length(chunks.text) ELSE 0 END) AS BIGINT) AS body_chars
        FROM chunks JOIN documents ON paper_id = 'd' || doc_id GROUP BY source, lang
    """,
    "body_excerpts": _with(_PAPERS, _CHUNKS) + "SELECT paper_id, coalesce(substr(string_agg(text, ' ' ORDER BY chunk_index) FILTER (chunk_index BETWEEN 1 AND 2), 1, 3000), '') AS excerpt FROM chunks GROUP BY paper_id",
    "short_title": _with(_PAPERS) + "SELECT paper_id, title FROM papers",
    "strip_code_fence": f"""
        WITH f AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '```json' || chr(10) || text || chr(10) || '  ```' || chr(10) || 'rest' ELSE text END AS t FROM conversations)
        SELECT conv_id, turn, CASE WHEN starts_with(t, '```') THEN array_to_string(list_filter(string_split(t, chr(10)), lambda s: NOT regexp_matches(s, '^{_BLANKS}*```')), chr(10)) ELSE t END AS text FROM f
    """,
    "entity_ids": f"SELECT name, {_entity('name')} AS normalized, {_entity_id('name')} AS entity_id FROM (SELECT c_name AS name FROM customer UNION SELECT p_name FROM part)",
    "parse_triples_json": """
        WITH r AS (
            SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 2 THEN 'late' ELSE 'c' || o_custkey END AS source, '[{"source": "c' || o_custkey || '", "relation": "placed"}]' AS written FROM orders
        )
        SELECT 'o' || k AS paper_id, 0::BIGINT AS pos, source, 'placed' AS relation, 'o' || k AS target, 'o' || k || '#abstract' AS source_chunk_id
        FROM r WHERE json_valid(CASE WHEN k % 3 = 0 THEN substr(written, 1, 22) WHEN k % 5 = 1 THEN replace(written, '"', chr(39)) ELSE written END)
    """,
    "entity_resolution_exact": f"""
        SELECT {_entity_id("normalized")} AS entity_id, normalized, min(name) AS canonical_name, count(*) AS mentions
        FROM (SELECT p_name AS name, coalesce(nullif({_entity("p_name")}, ''), 'unknown') AS normalized FROM part) GROUP BY normalized
    """,
    "entity_degrees": _with(_OEDGES, _DEGREES) + "SELECT entity, degree FROM degrees",
    "hub_entities": _with(_OEDGES, _DEGREES) + "SELECT entity, degree FROM degrees WHERE degree > 8",
    "neighbor_chunks": _with(_OEDGES, _DEGREES, _NEIGHBORS) + "SELECT seed, chunk_id FROM near",
    "two_hop_neighbors": _with(_VEDGES, _DEGREES, _NEIGHBORS) + "SELECT seed, chunk_id FROM near UNION SELECT a.seed, b.chunk_id FROM near a JOIN near b ON b.seed = a.chunk_id WHERE b.chunk_id <> a.seed",
    "subtopic_bridge": _with(_VEDGES, _BRIDGES) + "SELECT seed, chunk_id, round(similarity, 6) AS similarity, rank FROM bridged",
    "flat_retrieval": _with(_VEC, _ASKED, _hits(20)) + f"SELECT question_id, coalesce({_first('text')}, '') AS answer FROM asked LEFT JOIN (SELECT question_id, text FROM hits JOIN vec USING (chunk_id) WHERE rank = 1) USING (question_id)",
    "hybrid_retrieval": _with(*_RETRIEVAL) + "SELECT question_id, chunk_id, rank FROM hybrid",
    "diversity_cap": _with(_TURNS, _capped("capped", "cands")) + "SELECT question_id, chunk_id, rank FROM capped",
    "rerank_lexical": _with(_TURNS, _reranked("SELECT * FROM cands")) + "SELECT question_id, chunk_id, score, rank FROM capped",
    "reranked_hybrid": _with(*_RETRIEVAL, _SCORED_HYBRID) + "SELECT question_id, chunk_id, score, rank FROM capped",
    "merge_subqueries": _with(_VEC, _ASKED, _hits(10), _merged("merged", "SELECT question_id, chunk_id, 0 AS a, rank AS b, 0 AS c FROM hits UNION ALL SELECT question_id - 20, chunk_id, 1, rank, 0 FROM hits WHERE question_id >= 20", 20)) + "SELECT question_id, chunk_id, rank FROM merged",
    "relevance_gate": _with(_TURNS, _reranked("SELECT * FROM cands", False)) + "SELECT question_id, chunk_id, score, rank FROM scored WHERE question_id IN (SELECT question_id FROM scored GROUP BY question_id HAVING max(score) >= 0.5)",
    "title_lookup": _with(_VEC, _ASKED, _VPAPERS, _hits(5)) + "SELECT question_id, rank, chunk_id, title FROM hits JOIN vec USING (chunk_id) JOIN vpapers USING (paper_id)",
    "lexical_overlap": f"""
        WITH t AS (
            SELECT a.conv_id, a.turn, a.text, coalesce(string_agg(b.text, ' '), '') AS seen
            FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn < a.turn WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn, a.text
        )
        SELECT conv_id, turn, round(CASE WHEN len({_content("text")}) = 0 THEN 1.0 ELSE len(list_intersect({_content("text")}, {_tokens("seen")})) / len({_content("text")})::DOUBLE END, 6) AS overlap FROM t
    """,
    "grounded_claims": _with(_TURNS)
    + f"""
        SELECT question_id, pos, claim, chunk_ids, round(overlap, 6) AS overlap FROM (
            SELECT question_id, pos, claim, chunk_ids, CASE WHEN len({_content("claim")}) = 0 THEN 1.0 ELSE len(list_intersect({_content("claim")}, {_tokens("seen")})) / len({_content("claim")})::DOUBLE END AS overlap
            FROM (
                SELECT a.question_id, a.rank - 1 AS pos, {_first("a.text")} AS claim, string_agg(b.chunk_id, ',' ORDER BY b.rank) AS chunk_ids, string_agg(b.text, ' ') AS seen
                FROM cands a JOIN cands b ON b.question_id = a.question_id AND b.rank IN (a.rank, a.rank + 1) GROUP BY a.question_id, a.rank, a.text
            )
        ) WHERE overlap >= 0.4
    """,
    "verify_answer": f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR turn % 5 = 0 OR trim(text) = '' THEN '{NO_EVIDENCE.replace(chr(39), chr(39) * 2)}' ELSE text END AS answer FROM conversations",
    "sources_block": _with(_TURNS) + """SELECT question_id, string_agg('[' || rank || '] (from "' || chunk_id || '") ' || substr(text, 1, 500), chr(10) || chr(10) ORDER BY rank) AS block FROM cands WHERE rank <= 5 GROUP BY question_id""",
    "precision_recall_at_k": _with(*_GRADED) + "SELECT system, question_id, round(precision_at_k, 6) AS precision_at_k, round(recall_at_k, 6) AS recall_at_k FROM graded",
    "lexical_judge": _with(*_GRADED) + "SELECT system, question_id, correct FROM graded",
    "compare_systems": _with(*_GRADED) + _report(["forward", "backward", "idle"]),
    "upsert_papers": _with(
        _PAPERS,
        "french AS (SELECT paper_id, title, abstract FROM papers JOIN documents ON paper_id = 'd' || doc_id WHERE lang = 'fr')",
    )
    + """
        SELECT paper_id, title, abstract FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM french)
        UNION ALL SELECT paper_id, 'new 2 ' || title, abstract FROM french
        UNION ALL SELECT 'x' || paper_id, 'new 2 ' || title, abstract FROM french
    """,
    "upsert_chunks": _with(_VEC)
    + """
        SELECT chunk_id, paper_id, vec_id % 5 AS chunk_index, CASE WHEN text <> '' THEN 'new 2' ELSE '' END AS text, CAST(len(embedding) AS BIGINT) AS width FROM vec
        UNION ALL SELECT 'x' || chunk_id, 'other 1', vec_id % 5 + 100, 'new 2', CAST(len(embedding) AS BIGINT) FROM vec WHERE text <> ''
    """,
    "insert_entities_if_absent": f"""
        WITH stored AS (SELECT DISTINCT {_entity_id("p_name")} AS entity_id, p_name AS canonical_name FROM part WHERE p_size <= 25),
        new AS (SELECT {_entity_id("p_name")} AS entity_id, min_by('new ' || p_name || ' ' || p_partkey, p_partkey) AS canonical_name FROM part GROUP BY ALL)
        SELECT * FROM stored UNION ALL SELECT entity_id, canonical_name FROM new WHERE entity_id NOT IN (SELECT entity_id FROM stored)
    """,
    "append_edges": _with(_OEDGES) + "SELECT source_entity_id, target_entity_id, CAST(sum(CASE WHEN target_entity_id < 'p2' THEN 2 ELSE 1 END) AS BIGINT) AS n_edges FROM edges GROUP BY source_entity_id, target_entity_id",
    "corpus_fill": """
        WITH r AS (
            SELECT doc_id, 0 AS k FROM documents WHERE source = 'src3' UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'fr'
            UNION ALL SELECT doc_id, 2 FROM documents WHERE lang IN ('fr', 'de') OR source = 'src3'
        ),
        f AS (SELECT *, row_number() OVER (ORDER BY k, doc_id) AS n FROM (SELECT doc_id, min(k) AS k FROM r GROUP BY doc_id)),
        t AS (SELECT * FROM (VALUES (300), (5)) AS v(target)),
        -- until when each target looks: to the end of the pinned, or to the paper that fills it
        e AS (
            SELECT target, CASE WHEN (SELECT count(*) FROM f WHERE k = 0) >= target THEN 0 ELSE coalesce((SELECT k FROM f WHERE n = target), 9) END AS last_k,
                   CASE WHEN (SELECT count(*) FROM f WHERE k = 0) >= target THEN 1000000000 ELSE coalesce((SELECT doc_id FROM f WHERE n = target), 1000000000) END AS last_id
            FROM t
        )
        SELECT 'd' || f.doc_id AS paper_id, 's' || max(r.k) AS seen_in, f.k::BIGINT AS source_rank, f.doc_id AS pos, e.target::BIGINT AS target
        FROM e JOIN f ON f.k = 0 OR f.n <= e.target JOIN r ON r.doc_id = f.doc_id AND (r.k < e.last_k OR r.k = e.last_k AND r.doc_id <= e.last_id)
        GROUP BY f.doc_id, f.k, e.target
    """,
    "grounded_answers": _with(*_RETRIEVAL, _VPAPERS, _SCORED_HYBRID, _said("capped", False)) + "SELECT question_id, answer, n_citations FROM said",
    "end_to_end_answers": _with(*_ORCHESTRATED, _said("passed")) + "SELECT question_id, answer, n_citations FROM said",
    "extract_triples_offline": _with(_PAPERS, _CHUNKS, _TRIPLES) + "SELECT source, relation, target, source_chunk_id FROM triples WHERE NOT ends_with(source_chunk_id, '#abstract')",
    "incremental_graph": _with(_PAPERS, _CHUNKS, _TRIPLES)
    + f"""
        SELECT {_entity_id("source")} AS source_entity_id, relation, {_entity_id("target")} AS target_entity_id, source_chunk_id
        FROM triples WHERE substr(split_part(source_chunk_id, '#', 1), 2)::BIGINT % 2 <> 0
    """,
    "plan_sub_questions": """
        WITH p AS (SELECT conv_id || '-' || turn AS question_id, list_filter(regexp_split_to_array(text, '[.?!][\\s\\x0b]+'), lambda s: trim(s) <> '') AS parts FROM conversations)
        SELECT question_id, CAST(i AS BIGINT) AS part, parts[i] AS question FROM (SELECT *, unnest(range(1, 3)) AS i FROM p WHERE len(parts) > 1) WHERE i <= len(parts)
    """,
    "answer_form": """
        SELECT conv_id || '-' || turn AS question_id, CASE WHEN turn % 7 = 0 OR trim(text) = '' THEN '' ELSE text END AS answer,
               CASE WHEN turn % 7 = 0 OR trim(text) = '' THEN '' WHEN turn % 2 = 0 THEN '1. ' || role || chr(10) || '   `' || conv_id || ', ' || turn || '`' ELSE '_(no citations — see answer above)_' END AS citations
        FROM conversations
    """,
    "parse_verdicts": """
        SELECT conv_id, turn, turn % 14 IN (0, 4, 5, 7, 13) AS correct,
               CASE turn % 14 WHEN 0 THEN 'x' WHEN 2 THEN 'no verdict in the reply: {"reasoning": "x"}' WHEN 3 THEN 'no verdict in the reply: no JSON' WHEN 4 THEN 'y'
               WHEN 6 THEN 'z' WHEN 7 THEN 'w' WHEN 8 THEN 'no verdict in the reply: {"correct": true, "reas'
               WHEN 11 THEN 'no verdict in the reply: {' || chr(39) || 'correct' || chr(39) || ': true}' WHEN 13 THEN 'v' ELSE '' END AS reasoning
        FROM conversations
    """,
    "plan_replies": """
        SELECT conv_id || '-' || turn AS question_id, p.part::BIGINT AS part, CASE WHEN turn % 7 < 2 THEN CASE p.part WHEN 1 THEN role ELSE text END WHEN p.part = 1 THEN 'x' ELSE '{"k":1,"k":2}' END AS question
        FROM conversations, (VALUES (1), (2)) AS p(part) WHERE turn % 7 < 2 OR turn % 7 = 6 OR turn % 7 = 5 AND json_valid('[' || chr(39) || 'a' || chr(39) || ']')
    """,
    "synthesized_answers": _with(
        _TURNS,
        "top AS (SELECT * FROM cands WHERE rank <= 5)",
        f"""
        kept AS (
            SELECT question_id, string_agg({_first("text")}, ' ' ORDER BY rank) AS answer, count(*) AS n FROM top
            WHERE CASE WHEN len({_content(_first("text"))}) = 0 THEN 1.0 ELSE len(list_intersect({_content(_first("text"))}, {_tokens("text")})) / len({_content(_first("text"))})::DOUBLE END >= 0.4
            GROUP BY question_id
        )""",
    )
    + f"""
        SELECT t.question_id, CASE WHEN t.question_id % 9 IN (0, 1, 7) THEN coalesce(k.answer, '') WHEN t.question_id % 9 = 5 THEN '' ELSE {_first("t.text")} END AS answer,
               CASE WHEN t.question_id % 9 IN (0, 1, 7) THEN coalesce(k.n, 0) ELSE 0 END AS n_citations
        FROM top t LEFT JOIN kept k USING (question_id) WHERE t.rank = 1
    """,
    "vector_topk_all_cells": _with(_VEC, _ASKED, _hits(20)) + "SELECT question_id, chunk_id, round(similarity, 6) AS similarity, rank FROM hits",
    "hashed_embeddings": """
        WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM conversations),
        c AS (SELECT conv_id, turn, CAST(('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS BIGINT) AS pos, count(*)::DOUBLE AS n FROM w GROUP BY ALL)
        SELECT conv_id, turn, pos, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM c
    """,
    "metadata_clean": """
        SELECT 'o' || o_orderkey AS paper_id, o_orderpriority AS title, o_orderstatus || ' of ' || o_orderpriority AS abstract, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders
    """,
    "degrees_of_some": _with(_OEDGES, _DEGREES) + "SELECT entity, degree FROM degrees WHERE entity IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "pinned_papers": "SELECT 'd' || doc_id AS paper_id FROM documents",
    "labelled_report": _with(
        _VEC,
        _ASKED,
        _hits(20),
        "flat AS (SELECT * FROM hits), predicted AS (" + _answered("flat", "flat", _top_sentence("flat")) + ")",
        _graded("SELECT p.*, [a.gold] AS gold, a.question AS gold_answer, 0.0 AS ms FROM predicted p JOIN asked a USING (question_id)"),
    )
    + _report(["flat"]),
    "comparison_lines": """
        SELECT -2::BIGINT AS pos, 'system                  n    accuracy   precision@k    recall@k   latency(ms)' AS line
        UNION ALL SELECT -1, repeat('-', 77) UNION ALL
        SELECT pos, printf('%-20s%5d%11.2f%%%13.2f%%%11.2f%%%14.1f', system, n_questions, mean_accuracy * 100, mean_precision * 100, mean_recall * 100, mean_latency_ms) FROM (
    """
    + _with(*_GRADED)
    + _report(["forward", "backward", "idle"])
    + ")",
    "system_report": _with(
        _VEC,
        _ASKED,
        _VPAPERS,
        _hits(60),
        _VEDGES,
        _DEGREES,
        _NEIGHBORS,
        _BRIDGES,
        _EXPANSIONS,
        _HYBRID,
        _SCORED_HYBRID,
        _said("capped", False),
        *(_other(part) for part in (_ALONE, _reranked(_CANDIDATES), _PASSED, _said("passed"))),
        _PREDICTED,
        _graded("SELECT p.*, [a.gold] AS gold, a.question AS gold_answer, 0.0 AS ms FROM predicted p JOIN asked a USING (question_id)"),
    )
    + _report(["flat", "hybrid", "reranked", "grounded", "orchestrated"]),
    "reach_from_seeds": _with(
        _VEDGES,
        _DEGREES,
        _NEIGHBORS,
        "seeds AS (SELECT DISTINCT 'v' || (vec_id // 5) || '#abstract' AS seed FROM embeddings WHERE vec_id % 20 = 0)",
        "h1 AS (SELECT DISTINCT seed, chunk_id FROM near JOIN seeds USING (seed))",
        "h2 AS (SELECT DISTINCT a.seed, b.chunk_id FROM h1 a JOIN near b ON b.seed = a.chunk_id)",
        "h3 AS (SELECT DISTINCT a.seed, b.chunk_id FROM h2 a JOIN near b ON b.seed = a.chunk_id)",
    )
    + """
        SELECT seed, chunk_id, min(hop)::BIGINT AS hop FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3)
        WHERE chunk_id <> seed GROUP BY seed, chunk_id
    """,
    "entity_resolution_greedy": _greedy("SELECT vec_id, embedding FROM embeddings", "false"),
    "entity_resolution_seeded": _greedy("SELECT CASE WHEN label = 0 THEN vec_id - 1000000000 ELSE vec_id END AS vec_id, embedding FROM embeddings", "vec_id < 0"),
}
ORACLE["stored_neighbor_chunks"] = ORACLE["neighbor_chunks"]
ORACLE["stored_title_lookup"] = ORACLE["title_lookup"]
ORACLE["stored_upsert_chunks"] = ORACLE["upsert_chunks"]
_KEYED = (
    """papers AS (
        SELECT 'o' || o_orderkey AS paper_id, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderpriority END AS title, o_orderstatus AS abstract
        FROM orders, range(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END) WHERE o_orderpriority <> '1-URGENT'
    )""",
    "entities AS (SELECT 'c' || c_custkey AS entity_id FROM customer UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size <= 25)",
)
ORACLE["key_violations"] = (
    _with(_OEDGES, *_KEYED)
    + """
        SELECT 'papers' AS table_name, 'not null' AS rule, 'title' AS column_name, NULL AS key, count(*) AS n_rows FROM papers WHERE title IS NULL HAVING count(*) > 0
        UNION ALL SELECT 'papers', 'primary key', 'paper_id', paper_id, count(*) FROM papers GROUP BY paper_id HAVING count(*) > 1
        UNION ALL SELECT 'chunks', 'foreign key', 'paper_id', 'o' || o_orderkey, count(*) FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT paper_id FROM papers) GROUP BY o_orderkey
        UNION ALL SELECT 'edges', 'foreign key', 'source_entity_id', source_entity_id, count(*) FROM edges WHERE source_entity_id NOT IN (SELECT entity_id FROM entities) GROUP BY source_entity_id
        UNION ALL SELECT 'edges', 'foreign key', 'target_entity_id', target_entity_id, count(*) FROM edges WHERE target_entity_id NOT IN (SELECT entity_id FROM entities) GROUP BY target_entity_id
    """
)
ORACLE["cascading_delete"] = (
    _with(_OEDGES, *_KEYED, "gone AS (SELECT paper_id FROM papers WHERE abstract = 'F')")
    + """
        SELECT 'papers' AS table_name, paper_id, count(*) AS n_rows FROM papers WHERE paper_id NOT IN (FROM gone) GROUP BY paper_id
        UNION ALL SELECT 'chunks', 'o' || o_orderkey, 1 FROM orders WHERE 'o' || o_orderkey NOT IN (FROM gone)
        UNION ALL SELECT 'edges', split_part(source_chunk_id, '#', 1), count(*) FROM edges WHERE split_part(source_chunk_id, '#', 1) NOT IN (FROM gone) GROUP BY ALL
    """
)
ORACLE["model_replies"] = "SELECT conv_id || '-' || turn AS id, CASE WHEN role <> 'assistant' THEN reverse(role || ': ' || substr(text, 1, 40)) END AS reply FROM conversations"
ORACLE["download_pages"] = "SELECT page_id, 'page at ' || url AS content FROM pages WHERE url NOT LIKE '%7'"
# Names arrive by chunk, place in it, source before target; those with one vector are held
# against founders as the first of them, which alone can be one.
ORACLE["resolved_graph"] = (
    _with(
        _PAPERS,
        _CHUNKS,
        r"""
        named AS (SELECT chunk_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_-]+'), lambda n: length(n) >= 2 AND regexp_matches(n, '^\p{Lu}')) AS n FROM chunks),
        paired AS (SELECT chunk_id, [struct_pack(s := n[i], t := n[i + 1]) FOR i IN range(1, len(n))] AS p FROM named),
        firsts AS (SELECT chunk_id, p, [i FOR i IN range(1, len(p) + 1) IF list_position(p, p[i]) = i] AS places FROM paired),
        triples AS (SELECT chunk_id, k - 1 AS pos, p[places[k]].s AS source, p[places[k]].t AS target FROM (SELECT *, unnest(range(1, len(places) + 1)) AS k FROM firsts)),
        kept AS (SELECT * FROM triples WHERE source <> target)""",
        f"""
        ends AS (SELECT chunk_id, pos, 0 AS side, source AS name FROM kept UNION ALL SELECT chunk_id, pos, 1, target FROM kept),
        arrived AS (SELECT {_entity_id("name")} AS id, coalesce(nullif({_entity("name")}, ''), 'unknown') AS plain, row(chunk_id, pos, side) AS came, name FROM ends),
        names AS (SELECT id, min(plain) AS plain, min(came) AS came, arg_min(name, came) AS name FROM arrived GROUP BY id),
        measured AS (
            SELECT *, list_transform(range(64), lambda k: len(list_filter(list_transform(regexp_extract_all(plain, '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64), lambda b: b = k))::DOUBLE) AS v,
                   row_number() OVER (ORDER BY came, id) AS vec_id
            FROM names
        ),
        items AS (SELECT min(vec_id) AS vec_id, v AS embedding FROM measured WHERE list_sum(v) > 0 GROUP BY v)""",
        f"pairs AS (SELECT * FROM (SELECT x.vec_id AS a, y.vec_id AS b, {_cos('x.embedding', 'y.embedding')} AS s FROM items x JOIN items y ON x.vec_id < y.vec_id) WHERE s >= 0.87)",
        "arrivals AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS nth FROM items)",
        """
        steps AS (
            SELECT nth, vec_id AS item, true AS founds, [vec_id] AS founders FROM arrivals WHERE nth = 1
            UNION ALL
            SELECT nth, item, best IS NULL, CASE WHEN best IS NULL THEN list_append(founders, item) ELSE founders END
            FROM (
                SELECT n.nth, n.vec_id AS item, g.founders, min(p.a) AS best
                FROM steps g JOIN arrivals n ON n.nth = g.nth + 1 LEFT JOIN pairs p ON p.b = n.vec_id AND list_contains(g.founders, p.a) GROUP BY n.nth, n.vec_id, g.founders
            )
        ),
        founding AS (SELECT item FROM steps WHERE founds),
        near AS (
            SELECT p.b AS of, p.a AS lead, s FROM pairs p JOIN founding ON item = p.a UNION ALL SELECT p.a, p.b, s FROM pairs p JOIN founding ON item = p.b
            UNION ALL SELECT item, item, 1.0 FROM founding
        ),
        led AS (
            SELECT c.vec_id, arg_min(n.lead, row(-n.s, n.lead)) AS lead FROM measured c JOIN items i ON i.embedding = c.v JOIN near n ON n.of = i.vec_id
            WHERE c.vec_id NOT IN (FROM founding) AND n.lead < c.vec_id GROUP BY c.vec_id
        ),
        whose AS (SELECT c.id, c.name, coalesce(f.id, c.id) AS founder FROM measured c LEFT JOIN led USING (vec_id) LEFT JOIN measured f ON f.vec_id = led.lead)""",
    )
    + f"""
        SELECT 'edge' AS part, a.founder AS source_entity_id, b.founder AS target_entity_id, chunk_id AS source_chunk_id, NULL::VARCHAR AS canonical_name
        FROM kept JOIN whose a ON a.id = {_entity_id("source")} JOIN whose b ON b.id = {_entity_id("target")}
        UNION ALL SELECT 'entity', id, NULL, NULL, name FROM whose WHERE id = founder
    """
)
