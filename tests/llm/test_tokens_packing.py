"""Flat token files and packing: round trips, bounds and gapless sequences."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import packing, tokens

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
TEXTS = ["a b c", None, "", "hello world " * 700, "Ünïcode — 日本語 \n\n\t x", "<|endoftext|> in a text", "z"]


def reference(text):
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_ids_equal_those_of_the_other_library(text):
    assert tokens.token_ids(text).tolist() == reference(text)


LONG = {
    "spaces": " " * 2_000_000,
    "newlines": "\n" * 2_000_000,
    "letter": "a" * 2_000_000,
    "no_break": "\xa0" * 500_000,
    "between": "ab" + " " * 50_000 + "cd" + "\n" * 30_000 + "\tx",
    "before_special": "a" + " " * 30_000 + "<|endoftext|>" + " " * 30_000 + "!",
    "mixed": ("x" + " \t\n\u3000" * 9_000 + "y") * 2,
    "edges": " " * 19_999 + "x" + " " * 20_000 + "x" + " " * 20_001,
    "not_quite_space": "\x1c" * 100_000,
}


@pytest.mark.parametrize("name", LONG)
@pytest.mark.parametrize("special", [True, False])
def test_long_runs_give_the_ids_of_the_other_library(name, special):
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = not special
    assert tokens.token_ids(LONG[name], special=special).tolist() == t.encode(LONG[name], add_special_tokens=False).ids


def test_very_long_texts_are_counted_and_packed_whole(spark):
    docs = spark.createDataFrame([(0, LONG["spaces"]), (1, LONG["newlines"]), (2, "a b"), (2, "a b")], "doc_id long, text string")
    blocks, members = tokens.write_flat(docs)
    counts = sorted((r.doc_id, r.n_tokens) for r in members.join(tokens.scan_blocks(blocks), ["shard", "ordinal"]).collect())
    assert counts == [(0, 2_000_000), (1, 1_000_000), (2, 2), (2, 2)]
    report = []
    sizes = {r.doc_id: r.n for r in packing.pack_documents(docs, report=report).groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    assert sizes == {0: 2_000_001, 1: 1_000_001, 2: 6} and report[-1]["certified"] == report[-1]["partitions"] == 1


def test_token_counts_and_starts_of_the_query(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = tokens.op1_token_counts(spark, str(tmp_path)).collect()
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(TEXTS)}
    for shard in {r.shard for r in rows}:  # every document starts behind the end of the one before it
        at = 0
        for r in sorted((r for r in rows if r.shard == shard), key=lambda r: r.start):
            assert r.start == at and r.closed
            at += r.n_tokens + 1


def test_blocks_cut_anywhere_give_the_same_documents(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for size in (5, 64, 1 << 16):
        blocks, members = tokens.write_flat(docs, block_tokens=size)
        got = members.join(tokens.scan_blocks(blocks, block_tokens=size), ["shard", "ordinal"])
        n = {r.doc_id: r.n_tokens for r in got.collect()}
        assert n == {i: len(tokens.token_ids(t or "", special=False)) for i, t in enumerate(TEXTS)}
        assert got.filter("not closed").count() == 0


def test_files_without_an_index_and_an_open_end(spark, tmp_path):
    for name, ids in (("a", [5, tokens.END, 7, 8, tokens.END, 9]), ("b", [tokens.END]), ("c", [])):
        (tmp_path / name).write_bytes(np.array(ids, "<u4").tobytes())
    rows = tokens.scan_blocks(tokens.read_flat(spark, str(tmp_path), block_tokens=2), block_tokens=2).orderBy("shard", "ordinal").collect()
    assert sorted((r.n_tokens, r.closed) for r in rows) == [(0, True), (1, False), (1, True), (2, True)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    blocks, members = tokens.write_flat(docs)
    assert tokens.scan_blocks(blocks).count() == 0 and members.count() == 0
    assert packing.pack_documents(docs).count() == 0


@given(st.lists(st.integers(1, 60), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_is_valid_and_the_bound_holds(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, n = packing.best_fit(lengths, 60)
    used = defaultdict(list)
    for b, o, size in zip(bins, offsets, lengths, strict=True):
        used[b].append((o, size))
    for parts in used.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert at <= 60
    assert packing.lower_bound(lengths, 60) <= n == len(used)


def test_cuts():
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(3) == [(0, 3)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]


def test_packed_documents(spark):
    texts = TEXTS + [f"word{i} " * (i % 37) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, "a b c")], "doc_id long, text string")
    pieces = packing.tokenised_pieces(docs)
    packed, report = packing.pack(pieces, partition_pieces=40)
    rows = packed.collect()
    assert len(rows) == pieces.count() and report[0]["partitions"] > 1
    sequences = defaultdict(list)
    for r in rows:
        ids = np.array([*reference(texts[r.doc_id]), 2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert at <= 1024
    small = np.array([r.length for r in rows if r.length < 1024])
    whole = sum(r.length == 1024 for r in rows)
    assert len(sequences) - whole <= packing.lower_bound(small) + report[0]["partitions"]


def exact_bins(lengths, capacity):
    """The fewest bins, by trying every assignment."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                put(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=150, deadline=None)
def test_bounds_lie_under_and_packings_over_the_exact_count(lengths):
    lengths = sorted(lengths, reverse=True)
    exact, (_, _, n), bound = exact_bins(lengths, 20), packing.best_fit(np.array(lengths, np.int64), 20), packing.lower_bound(np.array(lengths, np.int64), 20)
    assert bound <= exact <= n and (n > bound or n == exact)


def by_part(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id >> 20].append(r)
    return out


def test_certified_partitions_stay_and_only_those_with_a_gap_exchange(spark):
    rng = np.random.default_rng(3)
    lengths = rng.choice([6, 7, 8, 9, 10, 11, 13], 600)  # of 20: best fit leaves gaps to the bound
    pieces = spark.createDataFrame([(i, i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECE)
    first, report = packing.pack(pieces, capacity=20, partition_pieces=20, rounds=0)
    last, rounds = packing.pack(pieces, capacity=20, partition_pieces=20)
    first, last = first.collect(), {r.uid: (r.sequence_id, r.offset) for r in last.collect()}
    certified = {p for p, rows in by_part(first).items() if len({r.sequence_id for r in rows}) == packing.lower_bound(np.array([r.length for r in rows]), 20)}
    assert len(certified) == report[0]["certified"] and 0 < len(certified) < report[0]["partitions"]
    full = {s for s in {r.sequence_id for r in first} if sum(r.length for r in first if r.sequence_id == s) == 20}
    stays = [r for r in first if r.sequence_id >> 20 in certified or r.sequence_id in full]
    assert all(last[r.uid] == (r.sequence_id, r.offset) for r in stays)
    assert rounds[1]["pieces"] == len(first) - len(stays) and rounds[-1]["sequences"] <= report[0]["sequences"]
    assert len({s for s, _ in last.values()}) == rounds[-1]["sequences"]
