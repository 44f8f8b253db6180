"""Every query of the engine by name, over the test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopspark.config import Settings
from hopspark.functions import text as T
from hopspark.functions import vector as V
from hopspark.operators import ann, evaluate, extract, graph, models, resolve, retrieve, synthesis
from hopspark.plans import systems
from hopspark.plans.ingest import body_excerpt, build_graph, clean_metadata, offline_graph
from hopspark.sources import acquire, files, keys, parted, sinks, stored, testdata
from hopspark.sources.scratch import dealt, scratch_path, scratch_table

#: The synthetic vectors are further apart than those of a sentence encoder.
SETTINGS = Settings(bridge_threshold=0.30, resolve_threshold=0.35, relevance_gate=0.5)

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _six(name: str):
    return F.round(name, 6).alias(name)


def _corpus(spark: SparkSession, sf_dir: str) -> systems.Corpus:
    return systems.Corpus(testdata.vec_chunks(spark, sf_dir), testdata.vec_papers(spark, sf_dir), testdata.vec_edges(spark, sf_dir), testdata.vec_entities(spark, sf_dir), SETTINGS)


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, systems.Corpus]:
    """Questions and corpus whose texts are joined and written once: systems look them up several times."""
    corpus = _corpus(spark, sf_dir)
    chunks = scratch_table(corpus.chunks, "chunks")
    questions = scratch_table(testdata.questions_of(chunks), "questions")
    return questions, replace(corpus, chunks=chunks, papers=scratch_table(testdata.papers_of(chunks), "papers"))


# Vectors


@query
def vector_topk(spark, sf_dir):
    """The 20 chunks nearest to embedding 0."""
    one = testdata.vec_questions(spark, sf_dir).where("question_id = 0")
    found = retrieve.vector_topk(one, testdata.vec_chunks(spark, sf_dir), 20)
    return found.orderBy("rank").select("chunk_id", _six("similarity"), F.col("rank").cast("long").alias("rank"))


@query
def vector_topk_batch(spark, sf_dir):
    found = retrieve.vector_topk(testdata.vec_questions(spark, sf_dir), testdata.vec_chunks(spark, sf_dir), 20)
    return _long(found, "rank").withColumn("similarity", F.round("similarity", 6))


def _index(spark, sf_dir):
    """A new stored index of all chunks: half of them are there when cells are made, the others are added."""
    rows = testdata.vec_chunks(spark, sf_dir).select(F.col("chunk_id").alias("item_id"), "embedding", (F.col("vec_id") % 2).alias("late"))
    index = ann.build(rows.where("late = 0"), scratch_path(spark, "index"), sinks.balanced_lists(rows.count()))
    ann.append(index, rows.where("late = 1"))
    return index, testdata.vec_questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), "embedding")


@query
def vector_topk_ivf(spark, sf_dir):
    """The batch search through a stored inverted-file index; recall against the exact search is at least 0.9."""
    index, asked = _index(spark, sf_dir)
    return _long(ann.search(asked, index, 20), "rank").withColumn("similarity", F.round("similarity", 6))


@query
def vector_topk_all_cells(spark, sf_dir):
    """The same with every cell probed, which is exact."""
    index, asked = _index(spark, sf_dir)
    found = ann.search(asked, index, 20, 1, 1)
    return _long(found.select(F.col("query_id").alias("question_id"), F.col("item_id").alias("chunk_id"), _six("similarity"), "rank"), "rank")


@query
def vector_index_sizes(spark, sf_dir):
    """How many cells the restated service would give an index over each source's documents, and over all."""
    docs = testdata.table(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("n"))
    return docs.select("source", "n", sinks.index_lists(F.col("n")).alias("lists"))


@query
def hashed_embeddings(spark, sf_dir):
    """Vectors of turns by the offline embedder, their places that aren't zero."""
    talk = testdata.table(spark, sf_dir, "conversations")
    rows = talk.select("conv_id", "turn", F.posexplode(V.hashed_embedding(F.col("text"))).alias("pos", "value"))
    return rows.where("value <> 0").select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), _six("value"))


@query
def vector_normalize(spark, sf_dir):
    vecs = testdata.table(spark, sf_dir, "embeddings")
    rows = vecs.select("vec_id", F.posexplode(V.normalize(F.transform("embedding", lambda x: x.cast("double") * 3))).alias("pos", "value"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), _six("value"))


@query
def vector_cosine_pairs(spark, sf_dir):
    vecs = testdata.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return V.pairs_above(vecs, 0.3).withColumn("similarity", F.round("similarity", 6))


# Texts


@query
def first_sentence(spark, sf_dir):
    return testdata.table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query
def clean_text(spark, sf_dir):
    return testdata.table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query
def html_to_text(spark, sf_dir):
    return files.html_pages(testdata.table(spark, sf_dir, "pages"))


@query
def chunk_documents(spark, sf_dir):
    return _long(testdata.chunks(spark, sf_dir), "chunk_index")


@query
def chunk_stats(spark, sf_dir):
    docs = testdata.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("paper_id"), "source", "lang")
    rows = testdata.chunks(spark, sf_dir).join(docs, "paper_id")
    body = F.col("chunk_index") > 0
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n_chunks"), F.count_if(body).alias("n_body"), F.sum(F.when(body, F.length("text")).otherwise(0)).alias("body_chars"))


@query
def body_excerpts(spark, sf_dir):
    return body_excerpt(testdata.chunks(spark, sf_dir))


@query
def short_title(spark, sf_dir):
    return testdata.papers(spark, sf_dir).select("paper_id", "title")


@query
def strip_code_fence(spark, sf_dir):
    """Texts of turns wrapped in a fence, with a second fence line inside."""
    talk = testdata.table(spark, sf_dir, "conversations")
    fenced = F.when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), "text", F.lit("\n  ```\nrest"))).otherwise(F.col("text"))
    return talk.select("conv_id", "turn", T.strip_code_fence(fenced).alias("text"))


@query
def entity_ids(spark, sf_dir):
    names = testdata.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionAll(testdata.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return names.distinct().select("name", T.normalize_entity(F.col("name")).alias("normalized"), T.entity_id(F.col("name")).alias("entity_id"))


# Extraction and resolution


def _replies(spark, sf_dir):
    """A reply per order: a fenced JSON list with one good triple, one that lacks a field, and text behind.

    Some are cut off, some quote with apostrophes, and in some a field is repeated.
    """
    orders = testdata.table(spark, sf_dir, "orders")
    reply = F.format_string('```json\n[{"source": "c%d", "relation": "placed", "target": "o%d"}, {"source": "x"}, 7] and more\n```', "o_custkey", "o_orderkey")
    reply = F.when(F.col("o_orderkey") % 5 == 1, F.replace(reply, F.lit('"'), F.lit("'"))).when(F.col("o_orderkey") % 5 == 2, F.replace(reply, F.lit('"relation"'), F.lit('"source": "late", "relation"'))).otherwise(reply)
    cut = F.when(F.col("o_orderkey") % 3 == 0, F.substring(reply, 1, 30)).otherwise(reply)
    return orders.select(F.concat(F.lit("o"), "o_orderkey").alias("paper_id"), cut.alias("reply"))


@query
def parse_triples_json(spark, sf_dir):
    return _long(extract.parse_triples(_replies(spark, sf_dir)), "pos")


@query
def extract_triples_offline(spark, sf_dir):
    return extract.cooccurrence_triples(testdata.chunks(spark, sf_dir).where("chunk_index > 0")).drop("pos")


@query
def incremental_graph(spark, sf_dir):
    """Edges of the chunks of papers that an earlier run, which did those of even number, has left."""
    rows = testdata.chunks(spark, sf_dir)
    done = rows.where("substr(paper_id, 2) % 2 = 0").select("paper_id").distinct()
    return build_graph(rows, done)[1]


@query
def resolved_graph(spark, sf_dir):
    """Entities and edges of all documents, names resolved by the offline embedder."""
    entities, edges = offline_graph(testdata.chunks(spark, sf_dir))
    rows = edges.select(F.lit("edge").alias("part"), "source_entity_id", "target_entity_id", "source_chunk_id", F.lit(None).cast("string").alias("canonical_name"))
    return rows.unionByName(entities.select(F.lit("entity").alias("part"), F.col("entity_id").alias("source_entity_id"), "canonical_name"), allowMissingColumns=True)


@query
def metadata_clean(spark, sf_dir):
    """Orders as papers with blanks and newlines in their metadata."""
    orders = testdata.table(spark, sf_dir, "orders")
    raw = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("paper_id"), F.concat(F.lit(" \t"), "o_orderpriority", F.lit("\n")).alias("title"), F.concat(F.lit("\n"), "o_orderstatus", F.lit("\nof "), "o_orderpriority", F.lit(" \n")).alias("abstract"), F.col("o_orderdate").alias("published"))
    return clean_metadata(raw).withColumn("published", F.col("published").cast("string"))


@query
def entity_resolution_seeded(spark, sf_dir):
    """Greedy resolution after an earlier batch: the embeddings of label 0 are founders already."""
    vecs = testdata.table(spark, sf_dir, "embeddings")
    founders = vecs.where("label = 0").select((F.col("vec_id") - 1_000_000_000).alias("item_id"), "embedding")
    items = vecs.where("label <> 0").select(F.col("vec_id").alias("item_id"), "embedding")
    return resolve.resolve_greedy(items, SETTINGS.resolve_threshold, founders)


@query
def entity_resolution_exact(spark, sf_dir):
    return resolve.resolve_exact(testdata.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query
def entity_resolution_greedy(spark, sf_dir):
    items = testdata.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return resolve.resolve_greedy(items, SETTINGS.resolve_threshold)


# Graph


@query
def entity_degrees(spark, sf_dir):
    return graph.degrees(testdata.order_edges(spark, sf_dir))


@query
def degrees_of_some(spark, sf_dir):
    """Degrees of the customers of one market segment."""
    some = testdata.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"))
    return graph.degrees(testdata.order_edges(spark, sf_dir), some)


@query
def hub_entities(spark, sf_dir):
    return graph.hubs(testdata.order_edges(spark, sf_dir), SETTINGS.max_entity_degree)


@query
def neighbor_chunks(spark, sf_dir):
    return graph.neighbors(testdata.order_edges(spark, sf_dir), None, SETTINGS.max_entity_degree)


@query
def stored_neighbor_chunks(spark, sf_dir):
    """The same over a stored graph, a part of whose edges was added later."""
    edges = testdata.order_edges(spark, sf_dir)
    kept = stored.store_graph(edges.where("target_entity_id < 'p5'"), scratch_path(spark, "graph"))
    kept.append(edges.where("target_entity_id >= 'p5'"))
    return graph.stored_neighbors(kept, None, SETTINGS.max_entity_degree)


@query
def reach_from_seeds(spark, sf_dir):
    """Chunks within three hops of the papers of the questions, and after how many."""
    edges = testdata.vec_edges(spark, sf_dir)
    seeds = testdata.vec_questions(spark, sf_dir).select(F.concat(F.lit("v"), F.expr("question_id div 5"), F.lit("#abstract")).alias("chunk_id"))
    return _long(graph.reach(edges, seeds, 3, SETTINGS.max_entity_degree), "hop")


@query
def two_hop_neighbors(spark, sf_dir):
    return graph.neighbors_within(testdata.vec_edges(spark, sf_dir), 2, SETTINGS.max_entity_degree)


@query
def subtopic_bridge(spark, sf_dir):
    found = graph.bridges(testdata.vec_edges(spark, sf_dir), testdata.vec_entities(spark, sf_dir), None, threshold=SETTINGS.bridge_threshold)
    return _long(found, "rank").withColumn("similarity", F.round("similarity", 6))


# Retrieval


@query
def flat_retrieval(spark, sf_dir):
    questions, corpus = testdata.vec_questions(spark, sf_dir), _corpus(spark, sf_dir)
    return systems.flat(questions, corpus)[1]


@query
def hybrid_retrieval(spark, sf_dir):
    return _long(systems.hybrid(testdata.vec_questions(spark, sf_dir), _corpus(spark, sf_dir))[0], "rank")


def _candidates(spark, sf_dir):
    order = Window.partitionBy("question_id").orderBy("turn")
    return testdata.turns(spark, sf_dir).withColumn("rank", F.row_number().over(order))


@query
def diversity_cap(spark, sf_dir):
    return _long(retrieve.diversity_cap(_candidates(spark, sf_dir).select("question_id", "chunk_id", "rank"), SETTINGS.max_per_paper), "rank")


@query
def rerank_lexical(spark, sf_dir):
    return _long(retrieve.rerank(_candidates(spark, sf_dir), systems.lexical_score(), SETTINGS.rerank_top_n, SETTINGS.max_per_paper), "rank")


@query
def reranked_hybrid(spark, sf_dir):
    questions, corpus = _stored(spark, sf_dir)
    return _long(systems.scored(questions, systems.hybrid(questions, corpus)[0], corpus), "rank")


@query
def merge_subqueries(spark, sf_dir):
    """Each question's own list and that of the question 20 further on, ten entries each, merged."""
    hits = retrieve.vector_topk(testdata.vec_questions(spark, sf_dir), testdata.vec_chunks(spark, sf_dir), 10)
    own = hits.select("question_id", F.lit(0).alias("part"), "chunk_id", "rank")
    other = hits.select((F.col("question_id") - 20).alias("question_id"), F.lit(1).alias("part"), "chunk_id", "rank").where("question_id >= 0")
    return _long(retrieve.merge_lists(own.unionByName(other), SETTINGS.rerank_top_n), "rank")


@query
def relevance_gate(spark, sf_dir):
    ranked = retrieve.rerank(_candidates(spark, sf_dir), systems.lexical_score(), SETTINGS.rerank_top_n, None)
    return _long(retrieve.relevance_gate(ranked, SETTINGS.relevance_gate), "rank")


@query
def title_lookup(spark, sf_dir):
    hits = retrieve.vector_topk(testdata.vec_questions(spark, sf_dir), testdata.vec_chunks(spark, sf_dir), SETTINGS.synthesis_top_n)
    found = retrieve.lookup(hits, testdata.vec_chunks(spark, sf_dir), testdata.vec_papers(spark, sf_dir))
    return _long(found.select("question_id", "rank", "chunk_id", "title"), "rank")


@query
def stored_title_lookup(spark, sf_dir):
    """The same over stored chunks and papers."""
    kept = stored.store_texts(testdata.vec_chunks(spark, sf_dir).select("chunk_id", "paper_id", "text"), testdata.vec_papers(spark, sf_dir), scratch_path(spark, "texts"))
    hits = retrieve.vector_topk(testdata.vec_questions(spark, sf_dir), testdata.vec_chunks(spark, sf_dir), SETTINGS.synthesis_top_n)
    return _long(retrieve.lookup(hits, kept.chunks(), kept.papers()).select("question_id", "rank", "chunk_id", "title"), "rank")


# Synthesis


@query
def lexical_overlap(spark, sf_dir):
    """Each assistant turn as a claim about the turns before it."""
    talk = testdata.table(spark, sf_dir, "conversations")
    before = F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rows = talk.select("conv_id", "turn", "role", "text", before.alias("sources")).where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.round(T.lexical_overlap(F.col("text"), F.col("sources")), 6).alias("overlap"))


@query
def grounded_claims(spark, sf_dir):
    """Each turn's first sentence as a claim that cites the turn after it and one that isn't there."""
    sources = _candidates(spark, sf_dir).select("question_id", "rank", "chunk_id", "text")
    claims = sources.select("question_id", (F.col("rank") - 1).alias("pos"), T.first_sentence(F.col("text")).alias("claim"), F.array(F.col("rank"), F.col("rank") + 1, F.lit(99_999)).alias("source_numbers"))
    kept = synthesis.grounded_claims(claims, sources, SETTINGS.min_overlap)
    return kept.select("question_id", F.col("pos").cast("long").alias("pos"), "claim", F.array_join("chunk_ids", ",").alias("chunk_ids"), _six("overlap"))


@query
def verify_answer(spark, sf_dir):
    talk = testdata.table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 5 == 0, F.lit("  ")).otherwise(F.col("text"))
    return talk.select("conv_id", "turn", synthesis.verified(said, F.col("turn") % 3).alias("answer"))


@query
def sources_block(spark, sf_dir):
    sources = _candidates(spark, sf_dir).where("rank <= 5").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").alias("title"), "text"))).alias("s"))
    return sources.select("question_id", T.sources_block(F.col("s")).alias("block"))


@query
def plan_sub_questions(spark, sf_dir):
    talk = testdata.table(spark, sf_dir, "conversations")
    asked = talk.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    return _long(systems.sub_questions(asked, 2), "part")


@query
def plan_replies(spark, sf_dir):
    """Planner's replies: in a fence, with text behind, an object, cut off, none, quoted with apostrophes, and with a repeated field in an entry."""
    talk = testdata.table(spark, sf_dir, "conversations")
    listed = F.to_json(F.array("role", "text", F.lit("third")))
    kind = F.element_at(F.array(F.concat(F.lit(" ```json\n"), listed, F.lit("\n``` "), F.lit("\n")), F.concat(listed, F.lit(" and ] more")), F.to_json(F.struct("role")), F.substring(listed, 1, 20), F.lit(None).cast("string"), F.lit("['a', 'b']"), F.lit('["x", {"k":1,"k":2}]')), (F.col("turn") % 7 + 1).cast("int"))
    return _long(systems.parse_plans(talk.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), kind.alias("reply")), 2), "part")


@query
def synthesized_answers(spark, sf_dir):
    """Answers from writer's replies: in a fence, with text behind, without claims, cut off, empty, no list of claims, none, quoted with apostrophes, and with claims given twice."""
    sources = _candidates(spark, sf_dir).where("rank <= 5").select("question_id", "rank", "chunk_id", "text")
    questions = sources.select("question_id").distinct()
    good = synthesis.extractive_replies(questions, sources)
    kinds = F.array(F.concat(F.lit("```json\n"), "reply", F.lit("\n```\n")), F.concat(F.lit("\n "), "reply", F.lit(" and {more")), F.lit('{"answer": 1}'), F.substring("reply", 1, 40), F.lit(""), F.lit('{"claims": 5}'), F.lit("{'claims': []}"), F.concat(F.lit('{"claims": [], '), F.substring("reply", 2, 1 << 30)))
    replies = good.where("question_id % 9 < 8").select("question_id", F.element_at(kinds, (F.col("question_id") % 9 + 1).cast("int")).alias("reply"))
    return _flat_citations(synthesis.synthesize(questions, sources, replies, SETTINGS.min_overlap))


@query
def answer_form(spark, sf_dir):
    """Turns as answers, every second one with a citation; every seventh question is blank."""
    talk = testdata.table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn").alias("question_id")
    cited = F.array(F.struct(F.col("role").alias("claim"), F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_ids")))
    said = talk.select(key, F.col("text").alias("answer"), F.when(F.col("turn") % 2 == 0, cited).otherwise(F.slice(cited, 1, 0)).alias("citations"))
    return systems.answer_ui(talk.select(key, F.when(F.col("turn") % 7 == 0, F.lit(" ")).otherwise(F.col("text")).alias("question")), said)


# Evaluation


def _labelled(spark, sf_dir):
    """Predictions of two systems for each conversation: turns in order, and in reverse; gold is the paper of turn 1."""
    rows = _candidates(spark, sf_dir)
    ids = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("c"), F.min("question").alias("gold_answer"))
    names = F.transform("c", lambda x: x["chunk_id"])
    gold = ids.select("question_id", "gold_answer", F.slice(F.transform("c", lambda x: x["chunk_id"]), 1, 2).alias("gold_chunk_ids"))
    said = lambda system, order, at, ms: ids.select(F.lit(system).alias("system"), "question_id", F.element_at("c", at)["text"].alias("predicted_answer"), order.alias("retrieved_chunk_ids"), F.lit(ms).alias("latency_ms"))
    return gold, said("forward", names, 1, 10.0).unionAll(said("backward", F.reverse(names), -1, 30.0))


@query
def precision_recall_at_k(spark, sf_dir):
    gold, said = _labelled(spark, sf_dir)
    rows = said.join(gold, "question_id")
    at = F.col("retrieved_chunk_ids"), F.col("gold_chunk_ids")
    return rows.select("system", "question_id", F.round(evaluate.precision_at_k(*at, SETTINGS.score_k), 6).alias("precision_at_k"), F.round(evaluate.recall_at_k(*at, SETTINGS.score_k), 6).alias("recall_at_k"))


@query
def lexical_judge(spark, sf_dir):
    gold, said = _labelled(spark, sf_dir)
    return said.join(gold, "question_id").select("system", "question_id", evaluate.lexical_judge(F.col("gold_answer"), F.col("predicted_answer")).alias("correct"))


@query
def parse_verdicts(spark, sf_dir):
    """Replies of a judge: right, wrong, without a verdict, no JSON, in a fence, with other values than booleans, cut off, quoted with apostrophes, given twice."""
    talk = testdata.table(spark, sf_dir, "conversations")
    replies = [
        '{"correct": true, "reasoning": "x"}', '{"correct": false}', '{"reasoning": "x"}', "no JSON", '```json\n{"correct": true, "reasoning": "y"}\n```', '{"correct": 1} so {',
        '{"correct": "", "reasoning": "z"}', '{"correct": "yes", "reasoning": "w"}', '{"correct": true, "reas', '{"correct": null}', '{"correct": 0.0}', "{'correct': true}", '{"correct": true, "correct": false}', '{"correct": false, "correct": true, "reasoning": "v"}',
    ]
    reply = F.element_at(F.array(*map(F.lit, replies)), (F.col("turn") % len(replies) + 1).cast("int"))
    verdict = evaluate.parse_verdict(reply)
    return talk.select("conv_id", "turn", verdict["correct"].alias("correct"), verdict["reasoning"].alias("reasoning"))


@query
def comparison_lines(spark, sf_dir):
    return evaluate.comparison_lines(compare_systems(spark, sf_dir))


@query
def compare_systems(spark, sf_dir):
    gold, said = _labelled(spark, sf_dir)
    names = spark.createDataFrame([("forward", 0), ("backward", 1), ("idle", 2)], "system string, pos long")
    rows = evaluate.report(names, evaluate.score(gold, said, SETTINGS.score_k))
    return rows.select("pos", "system", "n_questions", *map(_six, ("mean_accuracy", "mean_precision", "mean_recall", "mean_latency_ms")))


# Sinks and sources


def _versions(rows: DataFrame, key: str) -> DataFrame:
    """Every row twice under its own key and twice under a new one, numbered in time by ``version``."""
    twice = rows.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    return twice.unionByName(twice.withColumn(key, F.concat(F.lit("x"), key)))


@query
def upsert_papers(spark, sf_dir):
    """All documents are stored; those of one language come again, and under new keys, in two versions."""
    docs = testdata.papers(spark, sf_dir).select("paper_id", "title", "abstract")
    french = testdata.table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.concat(F.lit("d"), "doc_id").alias("paper_id"))
    new = _versions(docs.join(french, "paper_id", "left_semi"), "paper_id")
    return sinks.upsert_papers(docs, new.withColumn("title", F.concat(F.lit("new "), F.col("version").cast("string"), F.lit(" "), "title")), "version")


@query
def upsert_chunks(spark, sf_dir):
    """All chunks are stored; those with a text come again, and under new keys, in two versions."""
    rows = testdata.vec_chunks(spark, sf_dir).withColumn("chunk_index", F.expr("vec_id % 5")).select("chunk_id", "paper_id", "chunk_index", "text", "embedding")
    named = lambda word: F.concat(F.lit(word), F.col("version").cast("string"))
    new = _versions(rows.where("text <> ''"), "chunk_id").withColumns({"paper_id": named("other "), "chunk_index": F.col("chunk_index") + 100 * F.col("version"), "text": named("new ")})
    return sinks.upsert_chunks(rows, new, "version").select("chunk_id", "paper_id", "chunk_index", "text", F.size("embedding").cast("long").alias("width"))


@query
def stored_upsert_chunks(spark, sf_dir):
    """The same into a stored table in partitions by key."""
    rows = testdata.vec_chunks(spark, sf_dir).withColumn("chunk_index", F.expr("vec_id % 5")).select("chunk_id", "paper_id", "chunk_index", "text", "embedding")
    named = lambda word: F.concat(F.lit(word), F.col("version").cast("string"))
    new = _versions(rows.where("text <> ''"), "chunk_id").withColumns({"paper_id": named("other "), "chunk_index": F.col("chunk_index") + 100 * F.col("version"), "text": named("new ")})
    table = parted.store_parted(rows, scratch_path(spark, "chunks"), "chunk_id", 8)
    table.upsert(new, lambda stored_rows, more: sinks.upsert_chunks(stored_rows, more, "version"))
    return table.rows().select("chunk_id", "paper_id", "chunk_index", "text", F.size("embedding").cast("long").alias("width"))


def _keyed(spark, sf_dir):
    """Orders as papers with a chunk each, customers and parts as entities, what was bought as edges; some papers are missing, some come twice, some entities are missing, some titles are null."""
    orders = testdata.table(spark, sf_dir, "orders")
    paper = F.concat(F.lit("o"), "o_orderkey")
    title = F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderpriority"))
    papers = orders.where("o_orderpriority <> '1-URGENT'").select(paper.alias("paper_id"), title.alias("title"), F.col("o_orderstatus").alias("abstract"))
    twice = papers.unionByName(papers.where("abstract = 'P'"))
    chunks = orders.select(F.concat(paper, F.lit("#abstract")).alias("chunk_id"), paper.alias("paper_id"), F.lit(0).alias("chunk_index"), F.col("o_orderstatus").alias("text"), F.array(F.lit(0.0)).alias("embedding"))
    name = lambda table, column, letter, where: testdata.table(spark, sf_dir, table).where(where).select(F.concat(F.lit(letter), column).alias("entity_id"), F.lit(letter).alias("canonical_name"))
    entities = name("customer", "c_custkey", "c", "true").unionByName(name("part", "p_partkey", "p", "p_size <= 25"))
    return {"papers": twice, "chunks": chunks, "entities": entities, "edges": testdata.order_edges(spark, sf_dir)}


@query
def key_violations(spark, sf_dir):
    # an edge is a line of an order
    return keys.violations(_keyed(spark, sf_dir), {"edges": testdata.table(spark, sf_dir, "lineitem").count()})


@query
def cascading_delete(spark, sf_dir):
    """What is left once the papers of finished orders are deleted: rows by table and paper."""
    tables = _keyed(spark, sf_dir)
    left = keys.delete(tables, "papers", tables["papers"].where("abstract = 'F'").select("paper_id"))
    paper = {"papers": F.col("paper_id"), "chunks": F.col("paper_id"), "edges": T.paper_of(F.col("source_chunk_id"))}
    rows = None
    for name, of in paper.items():
        one = left[name].groupBy(of.alias("paper_id")).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "paper_id", "n_rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _echo():
    """A client that says a prompt backwards, and fails on those of assistants."""

    def say(prompt: str) -> str:
        if prompt.startswith("assistant"):
            raise ConnectionError("busy")
        return prompt[::-1]

    return say


@query
def model_replies(spark, sf_dir):
    """Replies of a stand-in for a model to all turns, by a runner that is asked twice."""
    talk = testdata.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", "text")
    runner = models.Runner(_echo, scratch_path(spark, "replies"), attempts=2, first_wait=0.0)
    prompt = F.concat("role", F.lit(": "), F.substring("text", 1, 40))
    runner.ask(talk.where("role = 'user'"), "id", prompt)
    return runner.ask(talk, "id", prompt)


def _serve(url: str) -> bytes:
    """A stand-in for a server, which fails on some addresses."""
    if url.endswith("7"):
        raise ConnectionError(url)
    return b"page at " + url.encode()


@query
def download_pages(spark, sf_dir):
    """All pages by their addresses, from a stand-in for a server; some fail, and a part is there from an earlier call."""
    pages = testdata.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    path = scratch_path(spark, "pages")
    acquire.download(pages.where("id % 2 = 0"), path, _serve, pause=0.0, attempts=2, first_wait=0.0)
    found = acquire.download(pages, path, _serve, pause=0.0, attempts=2, first_wait=0.0)
    return found.select(F.col("id").cast("long").alias("page_id"), F.decode("content", "UTF-8").alias("content"))


@query
def insert_entities_if_absent(spark, sf_dir):
    """Parts up to a size are stored; all parts come again, the first by number names a new entity."""
    parts = testdata.table(spark, sf_dir, "part")
    stored = parts.where("p_size <= 25").select(T.entity_id(F.col("p_name")).alias("entity_id"), F.col("p_name").alias("canonical_name")).distinct()
    new = parts.select(T.entity_id(F.col("p_name")).alias("entity_id"), F.concat(F.lit("new "), "p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("canonical_name"), "p_partkey")
    return sinks.insert_entities(stored, new, "p_partkey")


@query
def append_edges(spark, sf_dir):
    edges = testdata.order_edges(spark, sf_dir)
    both = sinks.append_edges(edges, edges.where("target_entity_id < 'p2'"))
    ends = dealt(both.select("source_entity_id", "target_entity_id"), 2 * testdata.table(spark, sf_dir, "lineitem").count(), "source_entity_id", "target_entity_id")
    return ends.groupBy("source_entity_id", "target_entity_id").agg(F.count("*").alias("n_edges"))


@query
def corpus_fill(spark, sf_dir):
    """Pinned documents (from one source), then those of two others, until 300 are found, and until 5 are, fewer than are pinned."""
    docs = testdata.table(spark, sf_dir, "documents")
    part = lambda rank, where: docs.where(where).select(F.concat(F.lit("d"), "doc_id").alias("paper_id"), F.lit(rank).alias("source_rank"), F.col("doc_id").alias("pos"), F.lit(f"s{rank}").alias("seen_in"))
    ranked = part(0, "source = 'src3'").unionAll(part(1, "lang = 'fr'")).unionAll(part(2, "lang IN ('fr', 'de') OR source = 'src3'"))
    filled = [files.fill_corpus(ranked, n).withColumn("target", F.lit(n)) for n in (300, 5)]
    return _long(filled[0].unionByName(filled[1]), "source_rank", "pos", "target")


@query
def pinned_papers(spark, sf_dir):
    """Identifiers from JSON lines, written from all documents; blank lines between."""
    path = scratch_path(spark, "pinned")
    docs = testdata.papers(spark, sf_dir)
    docs.select(F.concat(F.to_json(F.struct("paper_id", "title")), F.lit("\n\n")).alias("value")).write.text(path)
    return files.pinned_ids(spark, path).select("paper_id")


# Whole systems


def _flat_citations(df: DataFrame) -> DataFrame:
    return df.select("question_id", "answer", F.size("citations").cast("long").alias("n_citations"))


@query
def grounded_answers(spark, sf_dir):
    return _flat_citations(systems.grounded(*_stored(spark, sf_dir))[1])


@query
def end_to_end_answers(spark, sf_dir):
    """Plan, retrieve, gate, synthesize and verify; the offline planner's sub-questions are searched for by the offline embedder's vectors."""
    questions, corpus = _stored(spark, sf_dir)
    return _flat_citations(systems.orchestrated(questions, replace(corpus, models=systems.Models(embed=V.hashed_embedding)))[1])


@query
def labelled_report(spark, sf_dir):
    """A file of labelled questions, read back and held against the flat system's predictions."""
    path = scratch_path(spark, "questions")
    questions, corpus = testdata.vec_questions(spark, sf_dir), _corpus(spark, sf_dir)
    lines = questions.select(F.col("question_id").cast("string").alias("id"), "question", "gold_answer", "gold_chunk_ids")
    lines.select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value")).write.text(path)
    labelled = files.load_questions(spark, path).withColumn("question_id", F.col("id").cast("long"))
    names = spark.createDataFrame([("flat", 0)], "system string, pos long")
    rows = evaluate.report(names, evaluate.score(labelled, systems.predictions("flat", questions, corpus), SETTINGS.score_k))
    return rows.select("pos", "system", "n_questions", *map(_six, ("mean_accuracy", "mean_precision", "mean_recall", "mean_latency_ms")))


@query
def system_report(spark, sf_dir):
    """All five systems on the vector questions; four of them share one hybrid retrieval."""
    questions, corpus = _stored(spark, sf_dir)
    base = scratch_table(systems.hybrid_list(questions, corpus), "hybrid")
    said = None
    for name in systems.SYSTEMS:
        one = systems.predictions(name, questions, corpus, base=base)
        said = one if said is None else said.unionByName(one)
    names = spark.createDataFrame([(n, k) for k, n in enumerate(systems.SYSTEMS)], "system string, pos long")
    rows = evaluate.report(names, evaluate.score(questions, said, SETTINGS.score_k))
    return rows.select("pos", "system", "n_questions", *map(_six, ("mean_accuracy", "mean_precision", "mean_recall", "mean_latency_ms")))
