"""Alignment of readings, agreement of orders, overlaps of boxes and joined paragraphs against plain ways of counting."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import readings
from quillspark.operators import layout
from quillspark.operators import text as text_ops
from quillspark.operators.agreement import rank_agreement
from quillspark.plans.readings import heard_words, words_of


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("cells", [readings.CELLS, 400, 60])
def test_alignments_cost_as_much_as_the_full_table(cells):
    rnd = random.Random(cells)
    for _ in range(250):
        a = [rnd.randrange(6) for _ in range(rnd.choice([0, 1, 5, 40]))]
        b = list(a) if rnd.random() < 0.5 else [rnd.randrange(6) for _ in range(rnd.choice([0, 1, 7, 60]))]
        for _ in range(rnd.randrange(6)):
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(9))
        found = readings.blocks(np.array(a, np.int64), np.array(b, np.int64), cells)
        assert sum(max(j - i, m - k) for i, j, k, m in found) == edits(a, b)
        put, at = [], 0
        for i, j, k, m in found:
            put += a[at:i] + b[k:m]
            at = j
        assert put + a[at:] == b


def test_very_long_readings():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 50_000, 200_000)
    b = np.delete(a, [7, 90_000, 150_000])
    b[60_000] = -5
    assert readings.blocks(a, b) == [(7, 8, 7, 7), (60_001, 60_002, 60_000, 60_001), (90_000, 90_001, 89_999, 89_999), (150_000, 150_001, 149_998, 149_998)]
    c, d = rnd.integers(0, 9, 3000), rnd.integers(0, 9, 2500)
    whole = sum(max(j - i, m - k) for i, j, k, m in readings.blocks(c, d, 1 << 24))
    assert sum(max(j - i, m - k) for i, j, k, m in readings.blocks(c, d, 1 << 16)) == whole


def test_swaps_at_any_count_of_words(spark):
    rows = [("a tab calpol 500 mg", "tab crocin 650 mg"), ("take Pan-D now", "take Pan D now"), ("a b", "a b c"), ("a b c d", "a x"), (None, "a"), ("", ""), ("a", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").select("i", words_of("a").alias("a"), words_of("b").alias("b"))
    found = readings.reading_blocks("a", "b")
    got = {r.i: ([tuple(s) for s in r.s], r.n) for r in df.select("i", readings.swaps(found, F.col("b")).alias("s"), readings.edits_of(found).alias("n")).collect()}
    assert got == {0: ([(2, "crocin"), (3, "650")], 3), 1: ([(1, "Pan D")], 2), 2: ([], 1), 3: ([], 3), 4: ([], 1), 5: ([], 0), 6: ([], 1)}


def test_review_hears_words_of_longer_readings(spark):
    def flags(line, other):
        df = spark.createDataFrame([(1, 0, 50, line, other, "x")], "page int, line_number int, conf int, line string, second string, reading_2 string")
        run = text_ops.word_review(notes=heard_words(df, "line", "second"), known=("the", "patient", "has", "pain", "rain", "pan", "no"), drugs=("Pandee",), corrected=(("zz", "z"),), aligned=True)
        return [(r.word, r.first, r.kind, r.suggestions) for r in run.orderBy("first").collect()]

    assert flags("the patient has pain", "patient has (rain)") == [("pain", 16, "ambiguous", "rain")]
    assert flags("patient has Pandee", "patient has Pan no") == [("Pandee", 12, "ambiguous", "Pan no")]
    assert flags("patient has pain", "patient has rxin") == [] and flags("patient has pain", None) == [] and flags(None, "pain") == []
    assert flags("patient has pain", "the no rain pan pan rain no the") == []


def test_rank_agreement_equals_comparing_every_pair(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(40), float(rnd.randrange(30)), "z") for _ in range(700)]
    rows += [("one", 1, 2.0, "z"), ("a", None, 1.0, ""), ("a", 3, None, ""), ("a", 3, math.nan, ""), ("t", 1, 1.0, ""), ("t", 1, 1.0, "")]
    df = spark.createDataFrame(rows, "k string, i int, v double, w string")
    groups = collections.defaultdict(list)
    for k, i, v, _ in rows:
        if i is not None and v is not None and not math.isnan(v):
            groups[k].append((i, v))
    want = {}
    for k, p in groups.items():
        signs = [(p[x][0] - p[y][0]) * (p[x][1] - p[y][1]) for x in range(len(p)) for y in range(x + 1, len(p))]
        want[k] = (len(p), len(signs), sum(s > 0 for s in signs), sum(s < 0 for s in signs))
    for block in (1 << 18, 60):
        got = rank_agreement(df, ["k"], "i", "v", block).collect()
        assert {r.k: (r.n, r.pairs, r.concordant, r.discordant) for r in got} == want
        alone = next(r for r in got if r.k == "one")
        assert (alone.tau, alone.agreement, alone.order_accuracy) == (None, 1.0, None)
        assert next(r.agreement for r in got if r.k == "t") == 0
    assert rank_agreement(df.limit(0), ["k"], "i", "v").count() == 0


def test_rank_agreement_of_a_million_rows_of_one_group(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("x"), ((F.col("id") * 7919) % 1000).alias("y"))
    r = rank_agreement(df, [], "x", "y", 1 << 17).first()
    y = (np.arange(n) * 7919) % 1000
    period = y[:1000]  # the values repeat, so one period counts for all
    inside = sum(int((period[:i] > v).sum()) for i, v in enumerate(period))
    greater = sum(int((period > v).sum()) for v in period)
    periods = n // 1000
    discordant = periods * inside + periods * (periods - 1) // 2 * greater
    assert (r.n, r.pairs, r.discordant) == (n, n * (n - 1) // 2, discordant)


BOX = "page long, idx int, x1 int, y1 int, x2 int, y2 int, conf int, word string"


def test_overlaps_equal_comparing_every_pair(spark):
    rnd = random.Random(5)
    rows = []
    for page in range(4):
        for i in range(80):
            x, y = rnd.randrange(-200, 800), rnd.randrange(0, 300)
            w, h = rnd.choice([(0, 5), (10, 10), (60, 20), (900, 400)] if i % 9 == 0 else [(10, 10), (60, 20)])
            rows.append((page, i, x, y, x + w, y + h, rnd.randrange(100), "a"))
    rows += [(9, 0, 5, 5, 5, 5, 1, None), (9, 1, 5, 5, 5, 5, 1, "a"), (8, 0, 0, 0, 9, 9, 1, "a"), (None, 0, 0, 0, 9, 9, 1, "a"), (None, 1, 0, 0, 9, 9, 1, "a")]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] is not None and a[0] == b[0] and a[1] < b[1]:
                shared = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
                if shared:
                    want[a[0], a[1], b[1]] = round(shared / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - shared), 6)
    got = layout.box_iou_pairs(boxes=spark.createDataFrame(rows, BOX)).collect()
    assert len(got) == len(want) and {(r.page, r.i, r.j): round(r.iou, 6) for r in got} == pytest.approx(want, abs=2e-6)
    assert layout.box_iou_pairs(boxes=spark.createDataFrame([], BOX)).count() == 0


def test_paragraphs_join_wrapped_hyphened_and_broken_words(spark):
    def body(*lines):
        df = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "page int, line_number int, line string")
        words = spark.createDataFrame([("recommendation",), ("the",), ("rest",)], "term string")
        return [(r.body, r.lines, r.parted) for r in text_ops.reflowed_paragraphs(notes=df, ordinary=words).orderBy("paragraph").collect()]

    assert body("We give a recommenda", "tion to  the", " rest of them") == [("We give a recommendation to  the rest of them", 3, False)]
    assert body("the anti-", "biotic", "", None, "dose -", "daily") == [("the antibiotic dose - daily", 4, False)]
    assert body("- take two", "tablets.", "then rest") == [("- take two tablets.", 2, False), ("then rest", 1, True)]
    assert body("Name: Ann", "of Leeds", "and more") == [("Name: Ann", 1, False), ("of Leeds and more", 2, True)]
    assert body("a | b", "goes on", "Next") == [("a | b", 1, False), ("goes on", 1, False), ("Next", 1, False)]
    assert body("the", "rest") == [("the rest", 2, False)] and body(None, "") == []


def test_slant_height_and_length_of_a_sheet(spark):
    from quillspark.operators import strokes

    drawn = {0: [(0, 0), (10, 10), (20, 20)], 1: [(0, 0), (30, 0), (60, 0)], 2: [(0, 5), (3, 9), (0, 5)], 3: [(0, 400), (6, 408)], 30: [(5, 5)]}
    rows = [(k, i, float(x), float(y), 100.0 * i) for k, points in drawn.items() for i, (x, y) in enumerate(points, 1)]
    got = {r.sheet: r for r in strokes.writing_quality(points=spark.createDataFrame(rows, "stroke long, i int, x double, y double, t double")).collect()}
    assert got[0].slant == round(1 - 45 * math.sqrt(0.5) / 45, 4)  # angles of 45 and 0 degrees; the third ends where it began
    assert got[0].compression == 20 / 400 and got[0].mean_length == round((math.hypot(20, 20) + 60 + 10 + 10) / 4, 2)
    assert (got[1].slant, got[1].compression, got[1].mean_length) == (1.0, 0.0, 0.0)


def test_readings_of_a_batch_are_aligned_together():
    import random
    import time

    import pyarrow as pa

    from quillspark.functions.readings import reading_blocks

    rnd = random.Random(5)
    lines = [None, [], *([rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 10))] for _ in range(40_000)), [rnd.choice("ab") for _ in range(200)]]
    a, b = (pa.array(x, pa.list_(pa.string())) for x in (lines, lines[::-1]))
    began = time.process_time()
    together = reading_blocks.func(a, b)
    assert time.process_time() - began < 3  # one by one 9.5 s
    for i in (0, 1, *range(2, 40_002, 1000), len(lines) - 1):
        assert together[i].as_py() == reading_blocks.func(a.slice(i, 1), b.slice(i, 1))[0].as_py()
