"""Near copies, components and repeated strings against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from quillspark.llm import near, suffixes
from quillspark.llm.graph import components

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    """doc_id -> (class, links, copies) with union-find over all pairs of distinct texts."""
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    keys = list(texts)
    sets = [runs(t) for t in keys]
    parent = list(range(len(keys)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(keys)
    for i in range(len(keys)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i, k in enumerate(keys):
        least[top(i)] = min(least.get(top(i), 1 << 60), *texts[k])
    return sorted((d, least[top(i)], links[i], len(texts[k])) for i, k in enumerate(keys) for d in texts[k])


def corpus(seed=3, groups=6, members=12):
    rnd = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([3, 40, 200]))]
        for _ in range(members):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 3])):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(9999)}"
            rows.append((len(rows), " ".join(words)))
    return [*rows, (1000, None), (1001, ""), (1002, "..."), (1003, "One TWO three, four five six"), (1004, "one two: three four five SIX"), (0, rows[0][1])]


def test_classes_links_and_copies_match_brute_force(spark):
    rows = corpus()
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_near(rows)


def one_group(n=150, words=300):
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        own = list(base) + [f"y{k}" for k in range(rnd.choice([0, 0, 40, 90]))]  # sets of unlike sizes
        own[rnd.randrange(words)] = f"x{i}"
        rows.append((i, " ".join(own)))
    return rows


def test_one_large_group_in_many_blocks_and_classes_of_size(spark):
    rows = one_group()
    ids = spark.createDataFrame([(bytes([i]), b"g", len(runs(t)), t) for i, t in rows], "k binary, label binary, n long, t string")
    brute = {d: n for d, _, n, _ in brute_near(rows)}
    for block in (16, 1000):
        texts = near.sized(ids, block=block)
        assert texts.select("size").distinct().count() == (1 if block > 150 else 2)
        found = near.verified(texts, block=block).groupBy("k").sum("links").collect()
        assert {r[0][0]: r[1] for r in found} == brute


@pytest.mark.parametrize("options", [{"limit": 8}, {"limit": 4, "levels": 2}, {"limit": 4, "levels": 6, "runs": 2, "more": 4}])
def test_many_levels_dense_buckets_and_more_runs(spark, options):
    rows = [*one_group(), *((1000 + i, t) for i, t in corpus(seed=4))]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert sorted(map(tuple, got)) == brute_near(rows)


def test_runs_are_repeated_until_the_measured_recall(spark):
    docs = spark.createDataFrame(corpus(seed=11, groups=30), "doc_id long, text string")
    sets = near.written(near.sketches(docs).filter("sig is not null").groupBy("k").agg({"sig": "first"}).toDF("k", "sig"))
    pairs = near.sampled_pairs(sets, 200)
    assert len(pairs) > 20
    few = near.components(near.candidate_edges(sets, range(1), limit=2)).withColumnRenamed("node", "k")
    candidates, n, recall = near.candidate_components(sets, runs=1, more=3, target=1.0, limit=2)
    assert near.recall_of(few, pairs) < 1 and n > 1 and recall == near.recall_of(candidates, pairs) == 1.0


def test_dense_buckets_are_trees_of_bounded_degree(spark):
    k = [i.to_bytes(2, "big") for i in range(1000)]
    rows = spark.createDataFrame([(j, x) for x in k for j in (1, 2)], "node long, k binary")
    edges = near._tree(rows, 1000, fan=8).filter("a != b").distinct()
    assert edges.groupBy("b").count().agg({"count": "max"}).first()[0] < 100
    assert {bytes(r.label) for r in components(edges).collect()} == {k[0]} and components(edges).count() == 1000


def test_representatives_keep_one_of_each_class_and_all_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s", i, "a", "b") for i, t in rows], "doc_id long, text string, k string, least long, __own string, __K string")
    kept = near.representatives(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c, _, _ in brute_near(rows)})
    assert all((r.k, r.least, r["__own"], r["__K"]) == ("s", r.doc_id, "a", "b") for r in kept)


def test_near_copies_of_over_a_megabyte(spark):
    words = [f"w{i * 7919 % 1_000_003}" for i in range(170_000)]
    other = [w if i % 100 else "x" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:100_000]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows[0][1]) > 1_000_000 and got == {d: (c, n) for d, c, n, _ in brute_near(rows)} and got[1] == (1, 1)


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["b"])

    docs = spark.range(400, numPartitions=1).selectExpr("id doc_id", "repeat('some words ', 4000) || id text")
    near.sketches(docs.limit(1))
    assert docs.mapInArrow(sizes, "b long").agg({"b": "max"}).first()[0] < (4 << 20) + 100_000


def test_large_sets_are_compared_in_bounded_memory():
    rnd = np.random.default_rng(7)
    base = rnd.integers(0, 1 << 64, 20_000, np.uint64, endpoint=False)
    sets = [np.unique(np.concatenate([base[i * 40 :], rnd.integers(0, 1 << 64, i * 40, np.uint64)])) for i in range(160)]
    tracemalloc.start()
    got = near._linked(sets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    shared = lambda i, j: len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    for i, j in [(0, 1), (0, 55), (0, 56), (0, 100), (3, 159), (120, 159), (90, 140)]:
        n = shared(i, j)
        assert got[i, j] == got[j, i] == (n >= 0.8 * (len(sets[i]) + len(sets[j]) - n))
    assert (got == near._linked(sets, 0.8, most=10**9)).all() and got.any() and not got.all()


def test_texts_pass_their_join_unsorted(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    wanted = docs.selectExpr("unhex(md5(text)) k", "doc_id least", "unhex(md5(text)) label", "0 size", "map(0, 2L) sizes")
    plan = near._texts_of(docs, wanted, "text")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_levels_share_one_comparison(spark):
    rows = one_group()
    sets = near.written(near.sketches(spark.createDataFrame(rows, "doc_id long, text string")).select("k", "sig").dropDuplicates(["k"]))
    plan = near.candidate_edges(sets, levels=3, limit=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "zz")], "doc_id long, text string")
    assert sorted((r.class_id is None, r.n_copies) for r in near.near_duplicates(docs).collect()) == [(True, 1), (True, 2), (True, 2)]
    assert near.near_duplicates(docs.limit(0)).count() == 0
    assert near.representatives(docs).count() == 2


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_a_path_and_a_cycle(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(v == (100 if k >= 100 else (5 if k == 5 and n < 5 else 0)) for k, v in got.items())


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = {}
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        a = np.frombuffer(bytes(mark), np.uint8)
        kept = bytes(np.frombuffer(b, np.uint8)[a == 0])
        out.append((len(b), int(a.sum()), int((np.diff(np.concatenate([[0], a.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


P = "abcdefghij klmnop qrstu vwxyz 0123456789 " * 3
REPEATS = ["a" * 500, "a" * 350, None, "", P + "x" * 10 + P, "zz" + P * 2 + "y", "é" * 150, P * 4, "b" * 199, "b" * 199] + [f"u{i} " + P * 2 + f" v{i}" for i in range(20)] + ["same " * 100] * 5


@pytest.mark.parametrize("options", [{}, {"heavy": 10**9, "sample": 1, "least": 5}, {"heavy": 10**9, "sample": 1, "least": 5, "wide": 3}, {"sample": 1, "least": 1, "most": 6}])
def test_removed_bytes_match_brute_force(spark, options):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(REPEATS)], "doc_id int, text string, h int, t int")
    rows = suffixes.without_repeats(docs, **options).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.first for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    assert [got[i] for i in range(len(REPEATS))] == brute_repeats(REPEATS)


def test_texts_of_over_a_megabyte(spark):
    rnd = random.Random(9)
    body = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(150_000))
    shared = " ".join(f"s{rnd.randrange(10**6)}" for _ in range(60))
    docs = spark.createDataFrame([(0, body[:700_000] + shared + body[700_000:]), (1, "x " + shared + " y")], "doc_id int, text string")
    rows = {r.doc_id: r for r in suffixes.without_repeats(docs).collect()}
    assert rows[0].n_bytes > 1_000_000
    for r in rows.values():
        assert [s.end - s.first for s in r.spans] in ([len(shared)], [len(shared) + 1])


def test_random_texts_with_shared_passages(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randrange(2, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rnd.randrange(1, 80)))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            a = rnd.randrange(100)
            parts += [p[a : a + rnd.randrange(100, 300)], " ".join(word() for _ in range(rnd.randrange(1, 20)))]
        texts.append("".join(parts))
    rows = suffixes.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.first for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_no_documents(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id int, text string")).count() == 0
