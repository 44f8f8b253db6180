"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact check.

Everything here is DataFrame and SQL functions.

1. Texts and items become words (runs of letters and digits, lower-case) and the hashes
   of their five-word shingles.  Places of the texts that hold a shingle of any item are
   kept: the hits.
2. A text can only be similar to an item if it shares one of the item's seeds: its rarest
   shingles by hits, as many as weigh more than what a similar window may lack.  A passage
   that very many texts share is no seed of an item that holds anything rarer.
3. Windows are as long as the item.  Moving one on to its first shared shingle loses
   nothing, so those worth looking at begin at a shared shingle (or end with the text).
   They are taken only for items that the text has a seed of.
4. Each window gets a SimHash fingerprint over its shingles, and so does each item.
5. Fingerprints are cut into RADIUS + 1 blocks.  Two within RADIUS bits of each other
   agree in at least one block, so an equi-join on (item, block number, block value)
   gives every seeded pair within the radius; the distance is then checked.
6. What is left is verified on the shingles themselves: the sum over shingles of the
   smaller count, divided by that of the larger (weighted Jaccard), must reach the
   threshold.

RADIUS is wide because items are short: one changed word alters five of perhaps thirty
shingles.  At a similarity of 0.8 two fingerprints differ in about ten bits, with a
standard deviation of three.  Blocks of two or three bits don't select by themselves,
which is why the item is part of the key: without it nearly every window would meet every
item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopspark.llm.common import scratch_table

SHINGLE = 5
RADIUS = 23
THRESHOLD = 0.8
#: Most bytes that are broadcast at once, as counted beforehand: a row of the index of
#: item shingles or of texts' keys counts as ROW_BYTES.
BROADCAST_BYTES, ROW_BYTES = 48_000_000, 96
#: Most bits of the bitmap that words' places are sifted by before they become rows.
BITMAP_BITS = 1 << 20
KEY = ["no_id", "id", "text_hash"]


def words_of(text: str) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def shingle_hashes(words: str) -> Column:
    """The hash of each five-word shingle, in order; none for fewer words."""
    hashes = f"transform({words}, w -> xxhash64(w))"
    parts = ", ".join(f"get(h, i + {k})" for k in range(SHINGLE))
    return F.expr(f"get(transform(array({hashes}), h -> if(size(h) < {SHINGLE}, array(), transform(sequence(0, size(h) - {SHINGLE}), i -> xxhash64({parts})))), 0)")


def simhash(hashes: str, longest: int) -> Column:
    """The fingerprint of an array of at most ``longest`` hashes.

    Votes are counted many bits at a time: each hash is masked into words of 8- or 16-bit
    lanes, which are summed; a lane can't overflow, as it is wider than the array is long.
    """
    lane = 8 if longest < 128 else 16 if longest < 32768 else 32
    mask = sum(1 << k for k in range(0, 64, lane))
    sums = f"transform(sequence(0, {lane - 1}), k -> aggregate({hashes}, 0L, (acc, h) -> acc + (shiftrightunsigned(h, k) & {mask}L)))"
    vote = f"(shiftrightunsigned(get(s, b % {lane}), {lane} * (b div {lane})) & {(1 << lane) - 1}L)"
    bits = f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * {vote} > size({hashes}), shiftleft(1L, b), 0L))"
    return F.expr(f"get(transform(array({sums}), s -> {bits}), 0)")


def blocks(fp: str, radius: int) -> Column:
    """(number, value) of each of radius + 1 blocks of a fingerprint."""
    n = radius + 1
    ends = [round(64 * k / n) for k in range(n + 1)]
    cut = lambda a, b: f"shiftrightunsigned({fp}, {a})" + (f" & {(1 << (b - a)) - 1}L" if b - a < 64 else "")
    parts = [f"struct({k} AS no, {cut(a, b)} AS value)" for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
    return F.expr(f"array({', '.join(parts)})")


def shingle_texts(words: str) -> str:
    return f"transform(sequence(0, size({words}) - {SHINGLE}), i -> array_join(slice({words}, i + 1, {SHINGLE}), ' '))"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(no_id, id, text_hash, text): what tells rows apart, free of nulls."""
    number = docs[doc_id].cast("long")
    return docs.select(number.isNull().alias("no_id"), F.coalesce(number, F.lit(0).cast("long")).alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))


def _small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, item_id, item_words, item_hashes, m): distinct items with a shingle, numbered, with m shingles."""
    rows = benchmark.select(benchmark[item_id].alias("item_id"), words_of(item_text).alias("item_words")).distinct().where(f"size(item_words) >= {SHINGLE}")
    rows = rows.withColumn("item_hashes", shingle_hashes("item_words")).withColumn("m", F.size("item_hashes"))
    return scratch_table(rows.withColumn("item", F.monotonically_increasing_id()), "items")


def sifted(hashes: str, known: DataFrame, n_known: int) -> Column:
    """(at, hash) for the places of an array whose hash may be one of ``known.hash``: a bitmap tells, a few others pass.

    The bitmap, of BITMAP_BITS at most, is a constant of the plan.
    """
    bits = min(BITMAP_BITS, max(1 << 12, 1 << (64 * n_known).bit_length()))
    place = lambda h: f"cast(shiftrightunsigned({h}, 6) & {bits // 64 - 1} AS int)"
    held = known.groupBy(F.expr(place("hash")).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 AS int))")).alias("word"))
    words = [0] * (bits // 64)
    for row in held.collect():  # no more rows than the bitmap has words
        words[row.place] = row.word
    bitmap = f"cast(split('{','.join(map(str, words))}', ',') AS array<bigint>)"
    here = f"get({hashes}, i)"
    may = f"shiftrightunsigned(get({bitmap}, {place(here)}), cast({here} & 63 AS int)) & 1L = 1L"
    at = f"filter(if(size({hashes}) = 0, array(), sequence(0, size({hashes}) - 1)), i -> {may})"
    return F.expr(f"transform({at}, i -> struct(i AS at, {here} AS hash))")


def seeded_windows(keyed: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(no_id, id, text_hash, item, m, start): the windows of each text that may be similar to an item.

    The index of item shingles is broadcast in parts of at most BROADCAST_BYTES, and the
    texts are read once for each part: words of texts are never shuffled.
    """
    index = scratch_table(items.select("item", "m", F.explode("item_hashes").alias("hash")).groupBy("item", "m", "hash").agg(F.count("*").alias("weight")), "item-shingles")
    known = index.select("hash").distinct()
    n_index, n_known = index.count(), known.count()
    hashed = keyed.withColumn("words", words_of("text")).select(*KEY, shingle_hashes("words").alias("hashes"))
    parts = max(1, -(-n_known * ROW_BYTES // BROADCAST_BYTES))

    def hits_in(part: DataFrame) -> DataFrame:
        # Only places that pass the bitmap become rows; the array of all hashes isn't copied to them.
        places = hashed.select(*KEY, F.size("hashes").alias("len"), sifted("hashes", part, -(-n_known // parts)).alias("p"))
        # The outer form, as Spark would ask of the other, below it, whether there is a place at all, and work out everything twice.
        return places.select(*KEY, "len", F.explode_outer("p").alias("p")).where("p IS NOT NULL").select(*KEY, "len", "p.at", "p.hash").join(F.broadcast(part), "hash")

    found = [hits_in(known.where(F.pmod("hash", F.lit(parts)) == k)) for k in range(parts)]
    hits = scratch_table(reduce(DataFrame.unionAll, found).select(*KEY, "len", "at", "hash"), "hits")

    seen = hits.groupBy("hash").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("item").orderBy("n", "hash").rowsBetween(Window.unboundedPreceding, -1)
    ranked = index.join(seen, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("before", F.coalesce(F.sum("weight").over(rarest), F.lit(0)))
    # A window that reaches the threshold holds so much of the item's weight that the rest can't have all its seeds.
    seeds = scratch_table(ranked.where((F.col("before") <= (1 - threshold) * F.col("m") + 1e-9) & (F.col("n") > 0)).select("item", "m", "hash"), "seeds")
    pairs = hits.join(_small(seeds, seeds.count() * ROW_BYTES), "hash").select(*KEY, "item", "m").distinct()
    wanted = pairs.join(_small(index.select("item", "hash"), n_index * ROW_BYTES), "item")
    # The window begins at the shared shingle, or earlier if the text ends before it does.
    starts = F.greatest(F.lit(0), F.least(F.col("at"), F.col("len") - F.col("m"))).alias("start")
    return scratch_table(hits.join(wanted, [*KEY, "hash"]).select(*KEY, "item", "m", starts).distinct(), "seeded")


def contaminations(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) whose best window reaches ``threshold``.

    Columns: doc_id, text_hash (of the text, which with doc_id names the row of ``docs``),
    item_id, first_word and n_words of the best window (ties: the earliest), its hamming
    distance and similarity.  Texts shorter than an item are one window as a whole.

    Null and empty texts, and texts and items of fewer than five words, have no shingle
    and are in no pair.  Repeated rows of ``docs`` or of items count once; rows of null
    doc_id are kept with a null doc_id, and null item ids likewise.  An empty table on
    either side gives an empty result.
    """
    items = _items(benchmark, item_id, item_text)
    n_items, item_bytes, longest = items.agg(F.count("*"), F.coalesce(F.sum(F.length(F.concat_ws(" ", "item_words")) + 24 * F.size("item_words")), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    keyed = _keyed(docs, doc_id, text)
    seeded = seeded_windows(keyed, items, threshold)

    marked = scratch_table(seeded.groupBy(*KEY).agg(F.collect_set(F.struct("start", "m")).alias("windows")), "marked")
    n_marked = marked.count()
    # Texts without a window are left behind where they are read, if the keys of the others are few.
    again = keyed.join(F.broadcast(marked.select(*KEY)), KEY, "left_semi") if n_marked * ROW_BYTES <= BROADCAST_BYTES else keyed
    cut = again.join(marked, KEY).select(*KEY, "windows", words_of("text").alias("words")).withColumn("hashes", shingle_hashes("words"))
    parts = "transform(windows, w -> struct(w.start AS start, w.m AS m, slice(hashes, w.start + 1, w.m) AS hashes, slice(words, w.start + 1, w.m + 4) AS words))"
    windows = scratch_table(cut.select(*KEY, F.explode(F.expr(parts)).alias("w")).select(*KEY, "w.*").withColumn("fp", simhash("hashes", longest)).drop("hashes"), "windows")

    prints = items.select("item", "item_id", "item_words", simhash("item_hashes", longest).alias("item_fp"))
    probes = seeded.join(windows.select(*KEY, "start", "m", "fp"), [*KEY, "start", "m"]).select(*KEY, "item", "start", "m", "fp", F.explode(blocks("fp", radius)).alias("b")).select("*", "b.no", "b.value").drop("b")
    index = prints.select("item", "item_fp", F.explode(blocks("item_fp", radius)).alias("b")).select("item", "item_fp", "b.no", "b.value")
    near = probes.join(_small(index, n_items * (radius + 1) * ROW_BYTES), ["item", "no", "value"]).where(f"bit_count(fp ^ item_fp) <= {radius}")
    pairs = near.groupBy(*KEY, "start", "m", "item").agg(F.min(F.expr("bit_count(fp ^ item_fp)")).alias("hamming"))

    both = pairs.join(windows.select(*KEY, "start", "m", "words"), [*KEY, "start", "m"]).join(_small(prints.select("item", "item_id", "item_words"), item_bytes + n_items * ROW_BYTES), "item")
    counted = both.withColumns({"a": F.expr(shingle_texts("words")), "b": F.expr(shingle_texts("item_words"))})
    # Where an item repeats no shingle, each shared one weighs 1; counts are compared only for items that do.
    repeats = "aggregate(array_distinct(b), 0, (acc, s) -> acc + least(size(filter(a, x -> x = s)), size(filter(b, x -> x = s))))"
    shared_weight = f"if(size(array_distinct(b)) = size(b), size(array_intersect(b, a)), {repeats})"
    scored = counted.withColumn("both", F.expr(shared_weight)).withColumn("similarity", F.expr("both / cast(size(a) + size(b) - both AS double)"))
    window = F.struct("similarity", (-F.col("start")).alias("at"), F.size("words").alias("n"), "hamming")
    best = scored.where(F.col("similarity") >= threshold).groupBy(*KEY, "item", "item_id").agg(F.max(window).alias("w"))
    number = F.when(~F.col("no_id"), F.col("id")).alias("doc_id")
    return best.select(number, "text_hash", "item_id", (-F.col("w.at")).alias("first_word"), F.col("w.n").alias("n_words"), F.col("w.hamming").alias("hamming"), F.round("w.similarity", 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """``docs`` without the rows that :func:`contaminations` names; all columns kept.

    The rows' keys are written first; where they are few enough to be broadcast, texts
    stay where they are read.
    """
    found = contaminations(docs, benchmark, doc_id=doc_id, text=text, **parameters)
    at = next(n for n in (f"_hit{k}" for k in range(len(docs.columns) + 1)) if not any(c.startswith(n) for c in docs.columns))
    hits = scratch_table(found.select(F.col("doc_id").alias(f"{at}_id"), F.col("text_hash").alias(f"{at}_hash")).distinct(), "contaminated")
    same = docs[doc_id].cast("long").eqNullSafe(hits[f"{at}_id"]) & (F.xxhash64(docs[text]) == hits[f"{at}_hash"])
    return docs.join(_small(hits, hits.count() * ROW_BYTES), same, "left_anti")


#: The result without distances, in DuckDB: every window that begins at a shared shingle, or
#: ends with the text, compared in full.
DECONTAMINATION_SQL = f"""
    WITH texts AS (SELECT row_number() OVER () AS t, * FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
    parted AS (SELECT t, doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM texts),
    asked AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark) WHERE len(w) >= {SHINGLE}),
    wanted AS (SELECT item, len(w) - {SHINGLE - 1} AS m, unnest(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' '))) AS s FROM asked),
    counted AS (SELECT item, m, s, count(*) AS n FROM wanted GROUP BY ALL),
    words AS (SELECT t, len(w) - {SHINGLE - 1} AS size, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS spot FROM parted WHERE len(w) >= {SHINGLE}),
    ahead AS (SELECT t, size, spot, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER w" for k in range(1, SHINGLE))}) AS s FROM words WINDOW w AS (PARTITION BY t ORDER BY spot)),
    hits AS (SELECT t, size, spot, s FROM ahead WHERE spot < size AND s IN (SELECT s FROM counted)),
    met AS (SELECT t, size, spot, s, item, m, n FROM hits JOIN counted USING (s)),
    starts AS (SELECT DISTINCT t, item, m, size, greatest(0, least(spot, size - m)) AS first_word FROM met),
    shared AS (SELECT t, item, m, size, first_word, s, least(count(*), any_value(n)) AS n FROM starts JOIN met USING (t, item, m, size) WHERE spot >= first_word AND spot < first_word + m GROUP BY t, item, m, size, first_word, s),
    scored AS (SELECT t, item, m, size, first_word, sum(n) / (least(m, size) + m - sum(n))::DOUBLE AS similarity FROM shared GROUP BY t, item, m, size, first_word),
    best AS (SELECT *, row_number() OVER (PARTITION BY t, item ORDER BY similarity DESC, first_word) AS nth FROM scored WHERE similarity >= {THRESHOLD})
    SELECT doc_id, item_id, CAST(first_word AS INTEGER) AS first_word, CAST(least(m, size) + {SHINGLE - 1} AS INTEGER) AS n_words, round(similarity, 6) AS similarity
    FROM best JOIN parted USING (t) JOIN asked USING (item) WHERE nth = 1
"""
