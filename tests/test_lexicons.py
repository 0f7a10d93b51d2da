"""Edit-distance joins, dictionary scans and the noisy channel against brute force."""

import itertools
import math
import random
import re
import time
from collections import Counter

import pytest

from quillspark.functions.text import _channel, channel_costs
from quillspark.operators import channel, text
from quillspark.operators.lexicons import dictionary_hits
from quillspark.operators.base import SPARK


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rnd, word, n):
    for _ in range(n):
        i = rnd.randrange(len(word) + 1)
        word = rnd.choice([word[:i] + rnd.choice("abcé") + word[i:], word[:i] + word[i + 1 :], word[:i] + rnd.choice("abcé") + word[i + 1 :]])
    return word


def test_near_pairs_are_all_pairs_within_the_budget(spark):
    rnd = random.Random(8)
    terms = sorted({"".join(rnd.choices("abcdé", k=rnd.randrange(4, 16))) for _ in range(150)})
    words = sorted({w for t in terms for w in (mutated(rnd, t, rnd.randrange(5)) for _ in range(4)) if len(w) >= 4})
    budget = lambda w: 1 if len(w) <= 6 else 2 if len(w) <= 10 else 3
    spark.createDataFrame([(w,) for w in words], "w string").createOrReplaceTempView("near_words")
    spark.createDataFrame([(t,) for t in terms], "w string").createOrReplaceTempView("near_terms")
    got = spark.sql(text.near_pairs(SPARK, "SELECT w FROM near_words", "SELECT w FROM near_terms", text.BUDGETS, text.BUDGET)).collect()
    assert sorted(map(tuple, got)) == sorted((w, t, d) for w in words for t in terms if (d := edits(w, t)) <= budget(w))


def test_very_long_words_cost_little(spark):
    rnd = random.Random(2)
    long = ["".join(rnd.choices("abcdefgh", k=n)) for n in (10_000, 10_001, 9_999, 120, 240)]
    docs = [(1, " ".join([*long, mutated(rnd, long[0], 2), "Kelimar", "KELIMAS", "kelim-ar"])), *[(2 + i, "kelimat " + long[0]) for i in range(6)], (20, None), (21, ""), (None, "kelimet")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    began = time.time()
    ordinary = spark.createDataFrame([("kelimet",), (None,)], "term string")
    got = {r.word: (r.term, r.distance) for r in text.fuzzy_lexicon_match(documents=d, ordinary=ordinary).collect()}
    assert time.time() - began < 40
    near = docs[0][1].split()[5].lower()
    # an acronym, a compound and an ordinary word match nothing
    assert got == {near: (long[0], edits(near, long[0])), "kelimar": ("kelimat", 1)}


@pytest.mark.parametrize("least", ["", "é", "中文字"])
def test_rates_of_letters_outside_ascii(spark, least):
    rows = [(1, f"né thé {least}"), (2, ""), (3, None), (4, "a  b")]
    got = {r.item_id: (r.cer, r.wer, r.exact) for r in text.cer_pairs(benchmark=spark.createDataFrame(rows, "item_id long, text string")).collect()}
    r = f"né thé {least}".strip()
    h = "#" + r.replace("th", "ht")[1:]
    assert got[1] == (round(edits(r, h) / len(r), 6), round(sum(a != b for a, b in zip(r.split(), h.split(), strict=True)) / len(r.split()), 6), False)
    assert got[2] == (0.0, 0.0, True)


def whole(term, text, fold):
    """Occurrences of one term, by comparing it at each place."""
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" and fold else c for c in x)
    wordy = lambda c: c.isalnum() or c == "_"
    at = lambda i: 0 <= i < len(text) and wordy(text[i])
    n = len(term)
    return [(term, i, i + n) for i in range(len(text) - n + 1) if low(text[i : i + n]) == low(term) and at(i - 1) != at(i) and at(i + n - 1) != at(i + n)]


@pytest.mark.parametrize("fold", [True, False])
@pytest.mark.parametrize("chunk", [10, 1 << 20])
def test_dictionary_hits_equal_a_scan_term_by_term(spark, fold, chunk):
    rnd = random.Random(6)
    parts = ["Calpol", "calpol", "Pan-D", "D", "pan", "Vitamin D3", "d3", "é", "née", "naïve", "(x)", "x", "a b", "b a", "İ", "ẞ"]
    texts = [(i, rnd.choice(["", " "]).join(rnd.choice([*parts, ",", "_", " ", "7"]) for _ in range(rnd.randrange(25)))) for i in range(80)]
    texts += [(80, None), (81, ""), (81, "calpol calpol"), (81, "calpol calpol"), (82, "Vitamin D3, " * 5000)]
    lexicon = spark.createDataFrame([(t,) for t in [*parts, *parts[:3], None, ""]], "term string")
    got = dictionary_hits(spark.createDataFrame(texts, "id long, text string").repartition(3), lexicon, fold=fold, chunk_bytes=chunk).collect()
    by_place = lambda h: (h[1], h[2], h[0])
    want = [(i, t, sorted((h for term in dict.fromkeys(parts) for h in whole(term, t or "", fold)), key=by_place)) for i, t in texts]
    assert sorted((r.id, str(r.text), [tuple(h) for h in r.hits]) for r in got) == sorted((i, str(t), h) for i, t, h in want)


def test_fifty_thousand_terms_and_none(spark):
    texts = spark.range(500).selectExpr("id", "concat_ws(' ', transform(sequence(1L, 30L), i -> concat('t', (id * 31 + i * 7) % 60000))) AS text")
    lexicon = spark.range(50_000).selectExpr("concat('t', id) AS term")
    want = sum((i * 31 + k * 7) % 60_000 < 50_000 for i in range(500) for k in range(1, 31))
    assert sum(len(r.hits) for r in dictionary_hits(texts, lexicon).collect()) == want
    assert all(r.hits == [] for r in dictionary_hits(texts, lexicon.limit(0)).collect()) and dictionary_hits(texts.limit(0), lexicon).count() == 0


def brute_corrections(lines, least):
    counts, pairs, firsts, odd = Counter(), Counter(), Counter(), []
    for key, line in lines:
        ws = (line or "").split()
        bare = [re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() or w.lower() for w in ws]
        counts.update(bare)
        for a, b in itertools.pairwise(["\x02", *bare, "\x03"] if ws else []):
            pairs[a, b] += 1
            firsts[a] += 1
        for i, w in enumerate(ws):
            m = re.match(channel._CORE, w)
            beside = ws[max(0, i - 1) : i] + ws[i + 1 : i + 2]
            if len(ws) >= 3 and m and len(m[1]) >= 3 and not m[1].isupper() and not (i and m[1][0].isupper()) and not any(re.match(text.DOSE_OR_FORM, b.strip(",;:")) for b in beside):
                odd.append((key, i, m[1], bare[i - 1] if i else "\x02", bare[i + 1] if i + 1 < len(ws) else "\x03"))
    known = [w for w, c in counts.items() if c >= least and re.fullmatch("[a-z]{3,}", w)]
    total, most = sum(counts.values()), max(counts[w] for w in known)
    score = lambda a, b: math.log(pairs[a, b] / firsts[a] if pairs[a, b] else 0.4 * (counts[b] + 0.5) / total)
    out = []
    for key, i, core, prev, after in odd:
        w = core.lower()
        if w in known:
            continue
        near = sorted((_channel(w, c), -counts[c], c) for c in known if edits(w, c) <= 2)[:8]
        gains = [(round(score(prev, c) + score(c, after) - score(prev, w) - score(w, after) - 2 * cost - 0.3 * max(0, math.log10(most / counts[c]) - 3), 6), -r, c) for r, (cost, _, c) in enumerate(near)]
        if gains and max(gains)[0] > 1.0:
            out.append((key, i, core, max(gains)[2], max(gains)[0]))
    return out


def test_corrections_equal_scoring_every_candidate(spark):
    rnd = random.Random(12)
    phrases = [x.split() for x in ("the fever never went", "rough cough and pain daily", "clear gum paint the modern way", "rain never fell", "dear modem in daily use")]
    said = [rnd.choice(phrases) + rnd.choice([[], rnd.choice(phrases)]) for _ in range(150)]
    lines = [(i, " ".join(rnd.choice([w] * 12 + [mutated(rnd, w, 1), mutated(rnd, w, 2), w.upper(), w.title(), w + ",", "modeni", "5mg", "(" + w + ")"]) for w in ws)) for i, ws in enumerate(said)]
    lines += [(500, None), (501, ""), (502, "  \t "), (503, lines[3][1]), (503, lines[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in lines], "id long, line string, w string").repartition(3)
    got = sorted((r.id, r["at"], r.word, r.correction, r.gain) for r in channel.corrections(df, ["id"], least=6).collect())
    want = sorted(brute_corrections(lines, 6))
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(want) > 20
    assert all(abs(g[4] - w[4]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert channel.corrections(df.limit(0), ["id"]).count() == 0


def test_costs_of_many_pairs_equal_those_of_each():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["rn", "m", "cl", "d", "ii", "u", "ti", "vv", "w", "a", "o", "É", "é", "1", "l", "中"]) for _ in range(rnd.randrange(9)))
    pairs = [(word(), word()) for _ in range(3000)] + [("", ""), ("x" * 60, "x" * 59 + "y"), ("A", "a")]
    assert channel_costs(pairs).tolist() == [_channel(a, b) for a, b in pairs]
    assert channel_costs([]).tolist() == []


def test_whole_values_and_cells_three_spaces_apart(spark):
    lines = ["Address: 12 Main Road Pune", "Patient Name: Ann Lee  Age/Sex: 42 / F   Ref. Dr(s): O'Neil-Roy", "Time: 10:30", "no key", "", None, "Dr's Note (new) : rest", "Hb | 12.1   g/dL  low", "A:", "a: b"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "page long, line_number int, line string")
    got = {r.line_number: (r.keys, r.vals) for r in text.key_values(notes=df).collect()}
    assert got == {0: ("Address", "12 Main Road Pune"), 1: ("Patient Name|Age/Sex|Ref. Dr(s)", "Ann Lee|42 / F|O'Neil-Roy"), 6: ("Dr's Note (new)", "rest")}
    assert {r.line_number: r.cells for r in text.table_cells(notes=df).collect()}[7] == "Hb|12.1|g/dL  low"


def test_words_are_counted_once_for_the_fuzzy_match(spark):
    docs = spark.createDataFrame([(1, "kelimar kelimat")] + [(i, "kelimat") for i in range(2, 8)], "doc_id long, text string")
    found = text.fuzzy_lexicon_match(documents=docs, ordinary=spark.createDataFrame([], "term string"))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("kelimar", "kelimat", 1)]


@pytest.mark.parametrize("same", [True, False])
def test_near_pairs_of_a_first_letter_and_of_short_words(spark, same):
    rnd = random.Random(9)
    terms = sorted({"".join(rnd.choices("abñé", k=rnd.randrange(1, 18))) for _ in range(120)})
    words = sorted({w for t in terms for w in (mutated(rnd, t, rnd.randrange(4)) for _ in range(3)) if w})
    spark.createDataFrame([(w,) for w in words], "w string").createOrReplaceTempView("near_words")
    spark.createDataFrame([(t,) for t in terms], "w string").createOrReplaceTempView("near_terms")
    got = spark.sql(text.near_pairs(SPARK, "SELECT w FROM near_words", "SELECT w FROM near_terms", {2: "{n} >= 1"}, "2", same)).collect()
    assert sorted(map(tuple, got)) == sorted((w, t, d) for w in words for t in terms if (not same or w[0] == t[0]) and (d := edits(w, t)) <= 2)


def test_texts_are_scanned_in_parts_of_bounded_size():
    import pyarrow as pa

    from quillspark.operators.lexicons import parts

    texts = ["é" * 30, None, "", "x" * 500, "a" * 40, "b" * 40, "c" * 41, None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": texts})
    got = list(parts(batch, 1, 100))
    assert [x.to_pydict()["id"] for x in got] == [[0, 1, 2], [3], [4, 5], [6, 7]]
    assert pa.Table.from_batches(got).combine_chunks().to_pydict() == batch.to_pydict()
    assert list(parts(batch.slice(0, 0), 1)) == []
