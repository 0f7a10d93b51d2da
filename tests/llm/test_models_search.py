"""Quality classifier, decontamination, nearest neighbours, tool calls and the pipeline."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import ann, decontaminate, quality, toolcalls

GOOD = ["The quick brown fox jumps over the lazy dog near the old river bank", "A long day ends with quiet rain on the hills and lamps in the windows"]


def labelled(n=400):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        words = rnd.choice(GOOD).split() * rnd.randrange(1, 6)
        rnd.shuffle(words)
        rows.append((i, " ".join(words) if i % 3 else " ".join(w.upper() + "!!" for w in words)))
    return rows, [(i, int(i % 3 > 0), 0) for i in range(n)]


def test_held_out_accuracy_and_ranges(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "x " * 50_000)], "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    scored = {r.doc_id: r for r in quality.score_quality(docs, model).withColumn("out", quality.held_out()).collect()}
    out = [(scored[i].score >= 0.5) == bool(q) for i, q, _ in labels if scored[i].out]
    assert len(out) > 80 and np.mean(out) > 0.95
    assert all(0 <= r.score <= 1 for r in scored.values()) and all(r.out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scored.items())
    kept = {r.doc_id for r in quality.accepted(docs, model).collect()}
    assert kept == {i for i, r in scored.items() if r.score >= 0.5}


def test_flat_traversal_equals_walking_each_row():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    t = quality.fit(x, y, trees=80, depth=3)
    got = t.scores(x)
    for i in range(0, 500, 50):
        raw = t.base
        for f, s, leaf in zip(t.feature, t.split, t.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > s[node])
            raw += leaf[node - len(f)]
        assert abs(1 / (1 + np.exp(-raw)) - got[i]) < 1e-12
    assert np.mean((got >= 0.5) == y) > 0.9


def test_the_quality_query_and_clashing_names(spark, tmp_path):
    rows, labels = labelled()
    spark.createDataFrame([*rows, *[(5, "a repeated id " + "!" * i) for i in range(20)]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = quality.op10_quality_classifier(spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = df.collect()
    assert len(got) == len(rows) + 20 and all(r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in got if r.held_out and r.doc_id != 5]) > 0.95
    clash = spark.createDataFrame([(1, "a b", "old", 3)], "doc_id long, text string, SCORE string, carry int")
    out = quality.score_quality(clash, quality.fit(np.zeros((0, len(quality.STATISTICS)), np.float32), np.zeros(0)))
    assert out.columns == ["doc_id", "text", "carry", "score"] and out.first().score == 0.5


def brute_statistics(text):
    """The statistics by plain Python, for texts of ASCII."""
    data, words = text.encode(), [w for w in "".join(c if c.isalnum() else " " for c in text).split()]
    n = max(len(data), 1)
    out = [sum(b in m for b in data) / n for m in quality.CLASSES.values()]
    lower, each = [w.lower() for w in words], max(len(words), 1)
    lines = [[w for w in "".join(c if c.isalnum() else " " for c in line).lower().split()] for line in text.split("\n")]
    full = [line for line in lines if line]
    n_lines = text.count("\n") + (len(data) > 0)
    sizes = np.array([len(line) for line in full], float)
    out += [np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / each, sum(len(w) > 12 for w in words) / each, sum(len(w) < 4 for w in words) / each, sum(len(w) == 1 for w in words) / each]
    out += [np.log1p(n_lines), np.log1p(len(data) / max(n_lines, 1)), sizes.std() / max(sizes.mean(), 1) if full else 0]
    out += [1 - len({tuple(sorted(line)) for line in full}) / max(len(full), 1) if full else 0, len(set(lower)) / each, np.log1p(len(words) / (1 + text.count(".")))]
    return [*out, max((lower.count(w) for w in lower), default=0) / each, sum(w[0].isupper() for w in words) / each]


def test_statistics_match_plain_counting():
    import pyarrow as pa

    texts = ["", "One line of Words.", "same line\nsame line\n\nother a b c extraordinarily!", "A A a. B? (x) 123 #tag\n" * 4, "...", "tail\n"]
    for _, _, data, offsets in quality.slices(pa.array(texts)):
        got = quality.statistics(data, offsets)
    assert np.allclose(got, np.array([brute_statistics(t) for t in texts]), atol=1e-5)


def test_no_labels_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs, none)).count() == 0


def brute_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_matches_the_recurrence():
    rnd = random.Random(4)
    pairs = [([rnd.randrange(5) for _ in range(rnd.randrange(1, 25))], [rnd.randrange(5) for _ in range(rnd.randrange(0, 60))]) for _ in range(80)]
    best, _ = decontaminate.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert best.tolist() == [brute_alignment(a, b) for a, b in pairs]


@pytest.fixture(scope="module")
def leaked():
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(50, "tiny item"), (51, None), (52, "")]
    docs, truth = [], set()
    for d in range(90):
        words = [word() for _ in range(rnd.randrange(0, 120))]
        if d % 3 == 0:
            i = d % 12
            copy = items[i][1].split()
            for _ in range(rnd.choice([0, 3])):
                copy[rnd.randrange(len(copy))] = word()
            at = rnd.randrange(len(words) + 1)
            words[at:at] = [w.upper() for w in copy]
            truth.add((d, i))
        docs.append((d, " ".join(words)))
    return items, docs, truth


LONE = "an item without any id of its own"


def test_copies_and_edited_copies_are_found_and_clean_documents_stay(spark, leaked):
    items, docs, truth = leaked
    d = spark.createDataFrame([*docs, (500, None), (501, ""), (502, "a tiny, ITEM"), (503, f"{'long ' * 5} a tiny item {'sits' * 9} {LONE} in a long document")], "doc_id long, text string")
    items = [*items, (None, LONE)]
    b = spark.createDataFrame(items, "item_id long, text string")
    for grams in (500_000, 60):  # in one block and in several
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b, block_grams=grams).collect()}
        assert got == truth | {(502, 50), (503, 50), (503, None)}
    kept = {r.doc_id for r in decontaminate.decontaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {x for x, _ in truth} | {500, 501}


def test_a_passage_in_a_third_of_all_documents_keeps_its_seeds(spark):
    item = " ".join(f"q{i}" for i in range(25))
    docs = [(i, item + f" tail{i}" if i % 3 == 0 else f"other words here number {i}") for i in range(240)]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {i for i in range(240) if i % 3 == 0}


def test_one_edited_copy_in_many_documents_is_found(spark):
    words = [f"q{i}" for i in range(30)]
    copy = " ".join(f"z{i}" if i % 5 == 2 else w for i, w in enumerate(words))
    docs = [(i, f"head{i} {copy} tail{i}" if i % 2 else f"other words here number {i}") for i in range(200)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    score = brute_alignment(words, copy.split()) / 60
    assert {(r.doc_id, r.score) for r in decontaminate.leaks(d, b).collect()} == {(i, score) for i in range(1, 200, 2)} and score > 0.6
    assert {r.doc_id for r in decontaminate.decontaminated(d, b).collect()} == set(range(0, 200, 2))


def test_leaks_equal_aligning_every_pair_and_short_items_are_found_in_longer_texts(spark):
    rnd = random.Random(8)
    items = [(n, [f"i{n}x{k % 7 if n == 20 else k}" for k in range(n)]) for n in (1, 2, 3, 4, 9, 20, 30)]
    docs = []
    for d in range(140):
        w = items[d % len(items)][1]
        p = rnd.choice([0.0, 0.15, 0.3])
        copy = [x for k in w for x in rnd.choice([[k, "ins"], ["sub"], []] if rnd.random() < p else [[k]])]
        copy = {0: copy, 1: [x for k in w for x in (k, "ins")], 2: ["sub" if k % 4 == 3 else x for k, x in enumerate(w)]}[d // 7 % 4 % 3]
        docs.append((d, ["a", "b"] * rnd.randrange(4) + copy + ["c"] * rnd.randrange(5)))
    want = set()
    for d, t in docs:
        for i, w in items:
            score = brute_alignment(w, t) / (2 * len(w))
            if score >= (0.5 if len(w) > 2 else 1):
                want.add((d, i, score))
    frame = lambda rows, c: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{c} long, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontaminate.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want and {i for _, i, _ in want} == {i for i, _ in items} and len(want) > 60


def test_common_grams_are_no_seeds_and_lose_nothing(spark):
    """An item of one rare pair among pairs that stand in every text is joined by the rare ones alone."""
    rnd = random.Random(12)
    common = [f"c{k}" for k in range(12)]
    items = [(i, [*common[: i + 4], f"r{i}a", f"r{i}b", *common[i + 4 :]]) for i in range(5)]
    docs = [(d, [*common, f"d{d}"] + (rnd.sample(items[d % 5][1], 3) if d % 4 else items[d % 5][1])) for d in range(60)]
    frame = lambda rows, c: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{c} long, text string")
    block = decontaminate.items_of([(i, " ".join(w)) for i, w in items])
    marked = decontaminate._counted(frame(docs, "doc_id"), block, 0.9, "text")
    assert 0 < marked.rare.sum() < len(marked.rare)
    for least in (0.5, 0.9):
        want = {(d, i) for d, t in docs for i, w in items if brute_alignment(w, t) >= least * 2 * len(w)}
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(docs, "doc_id"), frame(items, "item_id"), least=least).collect()} == want and want


def test_ids_of_any_type_very_long_texts_and_repeated_rows(spark):
    item = " ".join(f"q{k}" for k in range(20))
    docs = spark.createDataFrame([("a", "w " * 600_000 + item, 1), ("a", "w " * 600_000 + item, 1), ("b", "w " * 10, 2)], "doc_id string, text string, item_id int")
    for ids, kind in (([1.5, None], "double"), (["", "x"], "string"), ([3, 4], "short")):
        bench = spark.createDataFrame([(ids[0], item), (ids[1], item), (ids[1], item)], f"item_id {kind}, text string")
        got = sorted((r.doc_id, str(r.item_id), r.score, r.last_word) for r in decontaminate.leaks(docs, bench).collect())
        assert got == sorted(("a", str(i), 1.0, 600_020) for i in [ids[0], ids[1], ids[1]] * 2)
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == ["b"]


def test_columns_of_the_decontamination_query(spark, leaked, tmp_path):
    items, docs, truth = leaked
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, texts, bench = decontaminate.op9_decontamination(spark, str(tmp_path)), dict(docs), dict(items)
    assert df.columns == ["doc_id", "item_id", "score", "n_seeds", "last_word"]
    rows = {(r.doc_id, r.item_id): r.score for r in df.collect()}
    assert rows == {(d, i): brute_alignment(bench[i].lower().split(), texts[d].lower().split()) / (2 * len(bench[i].split())) for d, i in truth}


def test_items_that_share_common_words_take_bounded_memory():
    """The peak of a search follows neither the items nor how many of them hold a pair of words; what is found stays."""
    rnd = np.random.default_rng(5)
    odds = 1 / np.arange(1, 20_001)
    text = lambda n: [f"w{x}" for x in rnd.choice(20_000, n, p=odds / odds.sum())]
    items = [text(30) for _ in range(8_000)]
    texts = [text(1_000) for _ in range(100)]
    for k in range(0, 100, 4):
        texts[k][500:500] = [x if j % 6 else "edited" for j, x in enumerate(items[k * 70])]
    column = pa.array([" ".join(t) for t in texts])
    block = decontaminate.items_of([(i, " ".join(w)) for i, w in enumerate(items)])
    search = decontaminate.Search(block.seeds(np.zeros(len(block.gram), np.int64), 0.5), 0.5)
    tracemalloc.start()
    row, item, score, _, end = search.found(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert {(k, k * 70) for k in range(0, 100, 4)} <= set(zip(row.tolist(), item.tolist(), strict=True))
    for r, i, s, e in zip(row.tolist(), item.tolist(), score.tolist(), end.tolist(), strict=True):
        assert s == brute_alignment(items[i], texts[r][max(e - 80, 0) : e]) / 60


def test_windows_cut_anywhere_find_the_same(monkeypatch):
    rnd = random.Random(3)
    word = lambda: f"w{int(rnd.paretovariate(0.7))}"
    items = [(i, [word() for _ in range(rnd.randrange(1, 40))]) for i in range(30)]
    texts = [[word() for _ in range(rnd.randrange(0, 90))] + items[k][1][: rnd.randrange(40)] + ["x"] * (k % 5) for k in range(30)]
    want = {(r, i, s) for r, t in enumerate(texts) for i, w in items if (s := brute_alignment(w, t) / (2 * len(w))) >= (0.5 if len(w) > 2 else 1)}
    block = decontaminate.items_of([(i, " ".join(w)) for i, w in items])
    column = pa.array([" ".join(t) for t in texts] + [None, ""], pa.string())
    for hits, grams in ((500_000, 100_000), (50, 100_000), (300, 40), (1, 1)):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        monkeypatch.setattr(decontaminate, "PART_GRAMS", grams)
        for often in (np.zeros(len(block.gram), np.int64), np.arange(len(block.gram)) % 7):
            row, item, score, *_ = decontaminate.Search(block.seeds(often, 0.5), 0.5).found(column)
            assert set(zip(row.tolist(), item.tolist(), score.tolist(), strict=True)) == want and want


def test_empty_benchmark_and_documents(spark):
    d, b = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(d, b).count() == 0 and decontaminate.decontaminated(d, b).count() == 1
    assert decontaminate.leaks(d.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def brute_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        best = sorted((-sum(np.float64(a) * np.float64(b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
        out[q] = best[:k]
    return out


def test_search_of_few_vectors_is_exact_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * (1 + i % 3)]) for i in range(60)] + [(100 + i, [1.0] + [0.0] * 7) for i in range(40)]
    bad = [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [float("inf")] * 8), (205, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([*rows, *bad, rows[0]], "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 20 = 0"), k=20).collect()
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    for q, best in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in best] and [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert all(abs(m[2] + s) < 1e-12 for m, (s, _) in zip(mine, best, strict=True))
    assert {r.query_id for r in got} == set(want)


def test_recall_over_many_lists(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.filter("vec_id % 60 = 0"), k=10, list_size=100).collect()
    hits = n = 0
    for q in range(0, 3000, 60):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:10].tolist())
        hits += len(best & {r.vec_id for r in got if r.query_id == q})
        n += 10
    assert hits / n >= 0.9


def test_the_search_query_against_brute_force_and_copies_of_a_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[40] = x[20] = x[21]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = ann.op4_ann_search(spark, str(tmp_path))
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = n = 0
    for q in range(0, 600, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20].tolist()
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        assert all(abs(r[2] - s[r[1]]) < 1e-9 for r in rows)
        hits, n = hits + len({r[1] for r in rows} & set(best)), n + 20
    assert hits / n >= 0.9 and {r[1] for r in got[40][:2]} == {20, 21}


def test_no_usable_query_and_very_long_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 20_000, "a"), (2, [0.5] * 20_000, "b"), (3, [2.0] * 20_000, "c")], "vec_id long, embedding array<double>, list string")
    assert ann.search(df, df.filter("vec_id = 9")).count() == 0
    assert [(r.vec_id, r.score) for r in ann.search(df, df.filter("vec_id = 1")).orderBy("rank").collect()] == [(3, 40_000.0), (2, 10_000.0)]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(df, df).count() == 0


def brute_levels(n, parents):
    level = {}
    while True:
        new = {v: max([level[p] + 1 for p in parents[v]], default=0) for v in range(n) if v not in level and all(p in level for p in parents[v])}
        if not new:
            return level
        level |= new


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_levels_of_random_graphs(spark, seed):
    rnd, n = random.Random(seed), 70
    parents = [[rnd.randrange(v) for _ in range(rnd.choice([0, 1, 1, 1, 2]))] if v else [] for v in range(n)]
    if seed == 2:
        parents[10], parents[20], parents[30] = [20], [10], [30]
    df = spark.createDataFrame([(1, str(v), [str(p) for p in parents[v]]) for v in range(n)], "conv_id int, call_id string, after array<string>")
    assert {int(r.call_id): r.level for r in toolcalls.levels(df).collect()} == brute_levels(n, parents)


def test_calls_are_linked_validated_and_canonical(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "w", '{"city": "x", "n": 2.50, "b":{"z":1,"a":[1,2]}}', None), (1, 1, "b", "w", '{"n":"q"}', ["a", "zz"]), (1, 2, "c", "w", "nope", ["d"]), (1, 3, "d", "w", '{"city":"y","k":true}', ["c"]), (2, 0, "a", "v", None, None), (None, 1, "x", "w", "{}", None), (1, 0, "a", "w", '{"city": "x", "n": 2.50, "b":{"z":1,"a":[1,2]}}', None)],
        "conv_id int, turn int, call_id string, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, 4, "a", "ok"), (1, 0, "b", None)], "conv_id int, turn int, call_id string, content string")
    rows = {(r.conv_id, r.call_id): r for r in toolcalls.link_tool_calls(calls, results, {"w": [("city", "string", True), ("n", "number", False), ("b", "object", False)]}).collect()}
    assert len(rows) == 5
    assert rows[1, "a"].record == '{"arguments":{"b":{"a":[1,2],"z":1},"city":"x","n":2.5},"call_id":"a","errors":[],"level":0,"name":"w","result":"ok"}'
    assert rows[1, "b"].errors == ["after", "missing:city", "order", "type:n"] and rows[1, "b"].level == 1
    assert rows[1, "c"].level is None and "cycle" in rows[1, "c"].errors and "unknown:k" in rows[1, "d"].errors
    assert rows[2, "a"].errors == ["arguments", "result"]


def test_embedded_calls(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"w","arguments":{"x":1},"after":["b"]}]}'), (1, 1, "tool", '{"tool_call_id":"a","content":"r"}'), (1, 2, "assistant", "{broken"), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    calls, results = toolcalls.embedded_calls(turns)
    assert [tuple(r) for r in calls.collect()] == [(1, 0, "a", "w", '{"x":1}', ["b"])] and [tuple(r) for r in results.collect()] == [(1, 1, "a", "r")]


def test_pipeline_keeps_clean_documents(spark, leaked, tmp_path):
    import corpus_pipeline

    items, _, _ = leaked
    rnd = random.Random(8)
    rows, labels = labelled(300)
    rows = [(i, t + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(40))) for i, t in rows]
    good = [i for i, _ in rows if i % 3]
    leak, secret, copy = good[0], good[1], good[2]
    texts = dict(rows)
    texts[leak] += " " + items[0][1]
    texts[secret] += " password = hunter2zz"
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(5000, texts[copy], "en", "s", len(texts[copy]))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = corpus_pipeline.written(stage(spark, table, str(tmp_path)))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r.doc_id: r.text for r in table.collect()}
    assert set(left) == set(good) - {leak} and "hunter2zz" not in left[secret] and left[copy] == texts[copy]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)
