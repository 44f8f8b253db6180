import random
import re

import numpy as np
import pytest
import xxhash

from hopspark.llm import simhash as H
from hopspark.operators.components import connected

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, radius=2):
    """Smallest index reachable from each."""
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


def expected(rows):
    ids = [k for k, _ in rows]
    prints = [brute_print(t) for _, t in rows]
    roots = brute_roots(prints)
    first = {}
    for k, r in zip(ids, roots, strict=True):
        if k is not None:
            first[r] = min(k, first.get(r, k))
    return sorted(((k, format(p, "016x"), first.get(r)) for k, p, r in zip(ids, prints, roots, strict=True)), key=repr)


def found(df):
    return sorted(map(tuple, H.near_duplicates(df).collect()), key=repr)


def test_documents_equal_brute_force(spark, odd, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert found(odd) == expected(odd_rows)


def test_no_documents(none):
    assert found(none) == []


def points(n, seed=0):
    """Random points, neighbours of some, chains and a dense ball."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    one = lambda k: np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)
    near = base[: n // 2] ^ one(n // 2)
    ball = base[0] ^ one(n // 4) ^ one(n // 4)
    chain = np.bitwise_xor.accumulate(one(30)) ^ base[1]
    return np.unique(np.concatenate([base, near, near ^ one(n // 2), ball, chain, np.arange(40, dtype=np.uint64)]))


def true_roots(p, radius=2):
    i, j = np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= radius)
    return H.forest(len(p), i, j)


def roots_of(p, member, root):
    low = np.arange(len(p))
    low[np.searchsorted(p, member)] = np.searchsorted(p, root)
    return low


@pytest.mark.parametrize("leaf", [4, 32, 512])
@pytest.mark.parametrize("seed", range(3))
def test_pruned_search_loses_no_link(leaf, seed):
    p = points(400, seed)
    assert (roots_of(p, *H.links(p, 2, leaf)) == true_roots(p)).all()


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_other_radii(radius):
    p = points(200)
    assert (roots_of(p, *H.links(p, radius, 16)) == true_roots(p, radius)).all()


def test_shards_lose_no_link():
    p = points(500, 7)
    top, parts = H.tree(p[::5], 20, 2), []
    for _, part in H.route(p, top, 2):
        parts.append([np.searchsorted(p, x) for x in H.links(part, 2, 16)])
    assert len(parts) > 5
    low = H.forest(len(p), *(np.concatenate(x) for x in zip(*parts, strict=True)))
    assert (low == true_roots(p)).all()


def test_dense_sets_are_looked_up():
    p = np.arange(9000, dtype=np.uint64)  # more than are compared in full
    member, root = H.leaf_links(p, 2)
    assert len(member) == 8999 and (root == 0).all()


@pytest.mark.parametrize(("size", "sample"), [(60, 65536), (40, 128)])
def test_sharded_query_equals_brute_force(spark, monkeypatch, size, sample):
    """Also where samples are so small that shards are split again in further rounds."""
    monkeypatch.setattr(H, "SHARD_SIZE", size)
    monkeypatch.setattr(H, "PER_SHARD", 16)
    monkeypatch.setattr(H, "SAMPLE", sample)
    p = points(300, 3)
    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    edges = H.links_of(df)
    got = {r.node: r.root for r in connected(edges).collect()}
    signed = [int(x) for x in p.view(np.int64)]
    groups = {}
    for k, r in zip(signed, true_roots(p), strict=True):
        groups.setdefault(r, []).append(k)
    assert {k: got.get(k, k) for k in signed} == {k: min(g) for g in groups.values() for k in g}
    shards = H.shards_of(df).groupBy("shard").count()
    assert shards.count() > 5


def test_shards_stay_bounded_at_four_million():
    """The rounds of shards_of in numpy, on points spread evenly, where boundary copies are most frequent."""
    n = 4_000_000
    p = np.random.default_rng(1).integers(0, 1 << 64, n, dtype=np.uint64)
    done, todo, rounds = [], [p], 0
    while todo:
        rounds += 1
        again = []
        for part in todo:
            want = min(H.SAMPLE, -(-len(part) // H.SHARD_SIZE) * H.PER_SHARD)
            top = H.tree(part[:: max(1, len(part) // want)], H.PER_SHARD, 2)
            sizes = {}
            for leaf, x in H.route(part, top, 2):
                sizes[leaf] = x
            done += [len(x) for x in sizes.values() if len(x) <= 2 * H.SHARD_SIZE]
            again += [x for x in sizes.values() if len(x) > 2 * H.SHARD_SIZE]
        todo = again
    assert rounds <= H.MAX_ROUNDS and max(done) <= 2 * H.SHARD_SIZE
    assert sum(done) < 6 * n  # 5.7 copies of a point


def test_long_chains_join(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)], "a long, b long")
    assert {(r.node, r.root) for r in connected(df).collect()} == {(k, 0) for k in range(n)}
