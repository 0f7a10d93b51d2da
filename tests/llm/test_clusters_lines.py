"""Centroid clustering, filter audit and line dedup: SQL over the tables, brute force over awkward rows."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import audit, centroids, lines
from quillspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_filter_audit", "op13_line_dedup"])
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


def exact(v, scale=64):
    return math.floor(math.floor(v) * scale + (v - math.floor(v)) * scale) if abs(v) < 2**53 else int(v) * scale


def brute_clusters(rows, d, k, rounds):
    kept = [(i, [exact(float(x)) for x in e]) for i, e in rows if e is not None and len(e) == d and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x in order[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x: min(range(len(c)), key=lambda j: far(x, c[j]))
    for _ in range(rounds):
        at = [near(x) for _, x in kept]
        c = [[sum(v) // len(m) for v in zip(*m, strict=True)] if (m := [x for (_, x), j in zip(kept, at, strict=True) if j == n]) else c[n] for n in range(len(c))]
    return [(i, near(x), far(x, c[near(x)])) for i, x in kept], c


@pytest.mark.parametrize("size", [1.0, 1e6, 1e12, 1e30, 1e305])
def test_clusters_of_any_magnitude_equal_brute_force(spark, size):
    rnd = random.Random(3)
    vector = lambda: [rnd.uniform(-size, size) * rnd.choice([1, 1, 0.5]) for _ in range(4)]
    rows = [(i, vector()) for i in range(60)] + [(7, vector()), (None, vector()), (70, [0.25, -0.25, 0.0, -0.0])] * 3
    rows += [(80, None), (81, []), (82, [1.0, 2.0, 3.0]), (83, [1.0, None, 2.0, 3.0]), (84, [1.0, math.nan, 0.0, 0.0]), (85, [1.0, math.inf, 0.0, 0.0])]
    want, c = brute_clusters(rows, 4, 5, 3)
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got = centroids.clustered(df, dimensions=4, clusters=5).collect()
    fits = lambda v: v if v < 2**63 else None
    sums = [sum(d for _, j, d in want if j == n) for n in range(5)]
    text = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    expected = [(i, j, fits(d), fits(sums[j]), fits(sum(sums)), text[j]) for i, j, d in want]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_few_or_no_vectors(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = centroids.clustered(some, dimensions=2).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in got] == [(0, 0, 0)] * 2
    assert centroids.clustered(some.limit(0), dimensions=2).count() == 0


def test_each_arithmetic_gives_the_same_distances():
    rng = np.random.default_rng(1)
    x = np.array([[int(v) for v in row] for row in rng.integers(-5000, 5000, (50, 8))], dtype=object)
    c = [[int(v) for v in row] for row in rng.integers(-5000, 5000, (6, 8))]
    for up in (1, 10**6, 10**14, 10**40):
        rows = x * up
        shifted = [[v * up for v in row] for row in c]
        kind = rows.astype(np.int64) if up < 10**10 else rows
        got = np.zeros((50, 6), dtype=object)
        for at, d in centroids.distances(kind, shifted):
            got[at] = d
        assert (got == np.array([[sum((a - b) ** 2 for a, b in zip(r, s, strict=True)) for s in shifted] for r in rows.tolist()], dtype=object)).all()


def brute_audit(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[n] == 1} for n in (0, 1))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = [x for x in t.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if x]
        upper = sum("A" <= ch <= "Z" for ch in t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * upper > 3 * len(t), any(ch in "#$%&*|" for ch in t), i is not None and first[t] < i]
        rows.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        table = {}
        for order in itertools.permutations(range(5)):
            left = mine
            gone: list = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                table[order, step] = (len(left), len(removed), sum(r[1][f] for r in gone), sum(r[1][f] and sum(r[1]) == 1 for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed))
                gone += removed
        for (order, step), v in table.items():
            shapley = sum(x[1] for (o, s), x in table.items() if o[s - 1] == order[step - 1])
            out.append((part, "".join("ABCDE"[f] for f in order), step, *v, shapley))
    return out


def test_audit_equals_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "a b", "X#", "ABC", " "]
    docs = [(i, " ".join(rnd.choices(words[: rnd.choice([5, 405])], k=rnd.choice([0, 3, 199, 200, 260]))).replace(" ", rnd.choice([" ", "\n", "\t\x0b"])), rnd.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[i % 3][1], "en") for i in range(30)] + [(5, docs[5][1], "en")] * 3 + [(None, docs[0][1], "de"), (None, None, None), (200, None, "en"), (201, "", "fr"), (7, docs[9][1], "fr"), (300, "Long " * 60_000, "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(120)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, label int, part string").repartition(3)
    got = audit.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(brute_audit(docs, labels))


def test_audit_of_nothing_and_of_many_parts(spark):
    schema = "doc_id long, text string, lang string"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(spark.createDataFrame([], schema), labels).count() == 0
    many = audit.filter_audit(spark.range(600).selectExpr("id AS doc_id", "'a b' AS text", "CAST(id AS string) AS lang"), labels)  # more parts than a task holds at a time
    assert many.count() == 600 * 600 and many.where("step = 1 AND filter_order LIKE 'A%' AND removed <> 1").count() == 0


def brute_lines(docs, least=40, enough=5):
    strip = "\t\n\x0b\x0c\r "
    key = lambda line: "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in line.strip(strip))
    held = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (i is not None and len(ids := held.get(key(x), ())) >= enough and i < max(ids))]
        out.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def awkward_lines():
    rnd = random.Random(9)
    pool = [f"Line {i} " + rnd.choice(["é", "x", "漢"]) * rnd.choice([20, 33, 34, 60]) for i in range(40)]
    spoil = lambda x: rnd.choice([x, " " + x, x + "\t\r", x.upper() if x.isascii() else x, " " + x])
    docs = [(rnd.randrange(10_000), "\n".join(spoil(rnd.choice(pool)) for _ in range(rnd.randrange(8)))) for _ in range(150)]
    docs += [docs[3]] * 4 + [(docs[5][0], pool[0]), (None, pool[0]), (None, None), (20_000, None), (20_001, ""), (20_002, "\n\n"), (20_003, "\n".join(pool * 200))]
    return docs


def test_lines_equal_brute_force(spark):
    docs = awkward_lines()
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lost string, a int").repartition(5)
    got = lines.deduplicated(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines(docs), key=str)
    assert lines.deduplicated(df.limit(0)).count() == 0


def test_runs_are_levelled_sorted_and_settle_keys(spark):
    batch = lambda hi: spark.range(hi - 10, hi).selectExpr("id", "explode(array(1L, 2L, 100 + id)) AS a", "0L AS b")
    runs = lines.LineRuns(spark, enough=5, fanout=3)
    for i in range(7):
        runs.add(batch(1000 - 10 * i))
    assert [len(level) for level in runs.levels] == [1, 2]
    rows = {(r.a, r.b): (r.docs, r.last) for r in spark.table(runs.levels[1][1]).collect()}
    assert (1, 0) not in rows and len(rows) == 30  # settled by the first batch, so that later runs leave it out
    name = runs.levels[0][0]
    plan = spark.table(name).hint("merge").join(spark.table(runs.levels[1][0]), ["a", "b"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(map(tuple, runs.settled().collect())) == [(1, 0, 999), (2, 0, 999)]
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
