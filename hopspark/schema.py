"""Fixed schemas of the engine's tables, as Spark DDL."""

PAPERS = "paper_id string, title string, abstract string, published date"
CHUNKS = "chunk_id string, paper_id string, chunk_index int, text string, embedding array<float>"
ENTITIES = "entity_id string, canonical_name string, embedding array<float>"
EDGES = "source_entity_id string, relation string, target_entity_id string, source_chunk_id string"
QUESTIONS = "id string, question string, gold_answer string, gold_chunk_ids array<string>, hop_count int, notes string"
PINNED = "paper_id string, title string"
CITATIONS = "array<struct<claim: string, chunk_ids: array<string>>>"
PREDICTIONS = f"question_id string, predicted_answer string, retrieved_chunk_ids array<string>, latency_ms double, citations {CITATIONS}"
TRIPLES = "source string, relation string, target string, source_chunk_id string"
PRIMARY_KEYS = {"papers": "paper_id", "chunks": "chunk_id", "entities": "entity_id"}
FOREIGN_KEYS = {
    "chunks": {"paper_id": "papers"},
    "edges": {"source_entity_id": "entities", "target_entity_id": "entities", "source_chunk_id": "chunks"},
}
NOT_NULL = {
    "papers": ("paper_id", "title", "abstract"),
    "chunks": ("chunk_id", "paper_id", "chunk_index", "text", "embedding"),
    "entities": ("entity_id", "canonical_name"),
    "edges": ("source_entity_id", "relation", "target_entity_id", "source_chunk_id"),
}
