"""Removal of repeated strings by prefix-free parsing, distributed.

A rolling hash over every GRAM bytes sets triggers: of the grams of a LENGTH-byte window the least one
(leftmost on ties) is the window's trigger. A trigger's phrase runs from its first window's start to
its last window's end, so that phrases follow from content alone, each window of LENGTH bytes lies in
just one phrase, and equal windows lie at equal places about equal triggers. Distinct phrases are the
dictionary; the parse is the table of their occurrences. Corpus order is needed only down to LENGTH
bytes, and only as classes of equal suffixes:

* a phrase that occurs twice makes all its windows repeated, with no look at their bytes;
* phrases that share a trigger but differ (a repeat begins or ends inside) are contested: the suffixes
  of the dictionary phrases of one trigger, cut to LENGTH bytes, are sorted by their hashes, and those
  in a class with one of another phrase are repeated.

Only contested dictionary phrases, once each, travel as bytes. Triggers that a sample shows to be common
(boilerplate: about MOST occurrences, or a HEAVY-th of all of them where that is less) are counted with
map-side combining instead of as groups, and where one has more than WIDE different phrases, so are their
suffixes. So a group of one trigger stays at about MOST occurrences however large the corpus. Classes are
told apart by 128 bits (trigger and phrase or suffix); documents by a 64-bit hash whose seed is changed if
two texts should share one.

Defined results: null and empty texts keep nothing and have the digest of no bytes; texts of fewer
than LENGTH bytes keep all; repeated rows are repeats of each other; texts of any length are parsed whole;
column names of any kind, of which only doc_id and the text play a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import prepare, read, text_of, written
from quillspark.llm.textbytes import _CODE, _power_tables, mixed, slices

LENGTH, GRAM = 200, 48
#: Dictionary phrases of one trigger up to which their suffixes are sorted in one task.
WIDE = 1 << 14
#: Share of all occurrences, as its inverse, from which a trigger is heavy; and the sample that finds them.
HEAVY, SAMPLE = 2000, 32
#: Occurrences of a trigger from which it is heavy in any case.
MOST = 1 << 18


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that make differences of them hashes."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up[: len(data)], out=total[1:])
    return total, down


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window's start in its row, windows, trigger hash, phrase hash) of each phrase."""
    size = np.diff(offsets)
    windows = np.maximum(size - length + 1, 0)
    if not windows.any():
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    total, down = _sums(data)
    value = mixed((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    own = value.copy()
    place = np.arange(len(value), dtype=np.int32)
    have, want = 1, length - gram + 1
    while have < want:  # the least of ``have`` grams from each place on, doubled
        step = min(have, want - have)
        less = value[step:] < value[:-step]
        value[:-step] = np.where(less, value[step:], value[:-step])
        place[:-step] = np.where(less, place[step:], place[:-step])
        have += step
    row = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows - offsets[:-1], windows)
    trigger = place[start]
    first = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])]))
    n = np.diff(np.concatenate([first, [len(row)]]))
    row, start = row[first], start[first]
    phrase = mixed((total[start + n - 1 + length] - total[start]) * down[start] + n.astype(np.uint64))
    return row, start - offsets[row], n, own[trigger[first]], phrase


def _parse(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, th, eh, at, n): occurrences of phrases. texts: (h, t)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0)
            for lo, _, data, offsets in slices(batch.column(1)):
                row, at, n, th, eh = phrases(data, offsets, length, gram)
                columns = [h.take(pa.array(row + lo)), *(pa.array(x.view(np.int64)) for x in (th, eh)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int16))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "th", "eh", "at", "n"])

    return texts.select("h", "t").mapInArrow(make, "h long, th long, eh long, at int, n short")


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows, where there are as many, that end where the first column changes."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        key = table.column(0).to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1])
        if not len(change):
            continue
        cut = int(change[-1]) + 1
        yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks()
        held, count = rest.to_batches(), rest.num_rows
    if count:
        yield pa.Table.from_batches(held)


def _suffixes(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its phrase, class) of the suffixes of phrases. Columns: th, n, bytes."""
    _, _, data, offsets = next(slices(table.column("bytes").combine_chunks(), 1 << 62))
    n = table.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    total, down = _sums(data)
    start = offsets[row] + place
    return row, place, mixed((total[start + length] - total[start]) * down[start])


def _runs(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of runs of consecutive places."""
    if not len(row):
        return row, place, place
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]))
    return row[first], place[first], place[np.concatenate([first[1:], [len(row)]]) - 1]


SPANS = "h long, first int, last int"


def _light(contested: DataFrame, length: int) -> DataFrame:
    """Repeated windows of contested phrases, group by group of one trigger."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            th, eh = table.column("th").to_numpy(), table.column("eh").to_numpy()
            once = np.concatenate([[True], (th[1:] != th[:-1]) | (eh[1:] != eh[:-1])])  # equal rows of a text's copies
            table = table.filter(pa.array(once))
            row, place, suffix = _suffixes(table, length)
            own = table.column("th").to_numpy().view(np.uint64)[row]
            # One sort by both halves mixed into one; should two classes meet in it, by each in turn.
            key = suffix ^ mixed(own)
            order = np.argsort(key, kind="stable")
            met = key[order][1:] == key[order][:-1]
            same = met & (suffix[order][1:] == suffix[order][:-1]) & (own[order][1:] == own[order][:-1])
            if (met & ~same).any():
                order = np.lexsort((suffix, own))
                same = (suffix[order][1:] == suffix[order][:-1]) & (own[order][1:] == own[order][:-1])
            shared = np.zeros(len(key), bool)
            shared[order[1:]] |= same
            shared[order[:-1]] |= same
            shared &= table.column("single").to_numpy(zero_copy_only=False)[row]
            r, first, last = _runs(row[shared], place[shared])
            at = table.column("at").to_numpy()[r]
            yield pa.RecordBatch.from_arrays([pa.array(table.column("h").to_numpy()[r]), pa.array((at + first).astype(np.int32)), pa.array((at + last).astype(np.int32))], ["h", "first", "last"])

    dealt = contested.select("th", "eh", "h", "at", "n", "single", "bytes").repartition("th").sortWithinPartitions("th", "eh")
    return dealt.mapInArrow(make, SPANS)


def _heavy(contested: DataFrame, length: int) -> DataFrame:
    """As _light, by counting suffix classes: no group of a trigger meets in one task."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                table = pa.Table.from_batches([batch.slice(lo, 512)])
                row, place, suffix = _suffixes(table, length)
                column = lambda c: table.column(c).to_numpy(zero_copy_only=False)[row]  # noqa: B023, E731
                columns = [column("th"), suffix.view(np.int64), column("eh"), column("h"), (column("at") + place).astype(np.int32), column("single")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["th", "suffix", "eh", "h", "first", "single"])

    rows = contested.select("th", "eh", "h", "at", "n", "single", "bytes").mapInArrow(make, "th long, suffix long, eh long, h long, first int, single boolean")
    rows = written(rows)
    shared = rows.groupBy("th", "suffix").agg(F.min("eh").alias("a"), F.max("eh").alias("b")).filter("a != b").select("th", "suffix")
    return rows.filter("single").join(shared, ["th", "suffix"]).select("h", "first", F.col("first").alias("last"))


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """Phrases with their bytes. texts: (h, t, marks: array of (at, n, th, eh, single, heavy))."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            count = marks.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            flat = marks.flatten()
            at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
            texts = [v.as_py().encode() for v in batch.column(1)]
            parts = [texts[r][a : a + m - 1 + length] for r, a, m in zip(row.tolist(), at.tolist(), n.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), *(flat.field(c) for c in ("at", "n", "th", "eh", "single", "heavy")), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "at", "n", "th", "eh", "single", "heavy", "bytes"])

    return texts.select("h", "t", "marks").mapInArrow(make, "h long, at int, n short, th long, eh long, single boolean, heavy boolean, bytes binary")


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with h, a hash of the text that no two different texts share, and t, the text."""
    seed = 0
    while True:
        keyed = docs.withColumn("t", text_of(text)).withColumn("h", F.xxhash64(F.lit(seed), "t"))
        per = keyed.select("h", F.md5("t").alias("m")).groupBy("h").agg(F.min("m").alias("a"), F.max("m").alias("b"))
        if per.filter("a != b").isEmpty():
            return keyed
        seed += 1


def repeated_windows(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY, sample: int = SAMPLE, least: int = 64, wide: int = WIDE, most: int = MOST) -> DataFrame:
    """(h, first, last): starts of windows that occur twice, from first to last. keyed: (h, t), a row per document.

    A trigger is heavy if the sample (one document in ``sample``, by hash) has it ``least`` times and either 1 / ``heavy`` of
    all that it holds or as often as one of ``most`` occurrences would be. The sample settles only how a trigger is
    counted, not whether.
    """
    prepare(keyed.sparkSession)
    # By document, so that what is parsed for it is as small a share.
    sampled = keyed.filter(F.pmod(F.xxhash64("h", *[c for c in keyed.columns if c == "doc_id"]), F.lit(sample)) == 0)
    counts = written(_parse(sampled, length, gram).groupBy("th", "eh").agg(F.count("*").alias("c")))
    total = counts.agg(F.sum("c")).first()[0] or 0
    bar = max(least, min(-(-total // heavy), -(-most // sample)))
    # Written, so that their true size settles how they are joined: as a rule a handful of rows, and never more than
    # one in ``most`` of all occurrences.
    common = written(counts.groupBy("th").agg(F.sum("c").alias("c")).filter(F.col("c") >= bar).select("th", F.lit(True).alias("heavy")))
    twice = written(counts.filter(F.col("c") >= max(2, bar // 8)).select("th", "eh", F.lit(True).alias("sure")))
    rows = _parse(keyed, length, gram).join(common, "th", "left").join(twice, ["th", "eh"], "left")
    rows = written(rows.withColumn("heavy", F.coalesce("heavy", F.lit(False))).withColumn("sure", F.coalesce("sure", F.lit(False))))

    phrase, group = Window.partitionBy("th", "eh"), Window.partitionBy("th")
    light = (
        rows.filter("not heavy")
        .repartition("th")
        .select("*", F.count("*").over(phrase).alias("c"), F.row_number().over(phrase.orderBy("h", "at")).alias("r"), F.min("eh").over(group).alias("lo"), F.max("eh").over(group).alias("hi"))
        .select("h", "at", "n", "th", "eh", "heavy", (F.col("c") == 1).alias("single"), ((F.col("lo") != F.col("hi")) & (F.col("r") == 1)).alias("contested"))
        .filter("not single or contested")
    )
    common_rows = rows.filter("heavy")
    entries = written(common_rows.groupBy("th", "eh").agg(F.count("*").alias("c"), F.min(F.struct("h", "at", "n")).alias("x")))
    groups = entries.groupBy("th").agg(F.count("*").alias("d"))
    first = entries.join(groups, "th").select("x.h", "x.at", "x.n", "th", "eh", (F.col("d") > wide).alias("heavy"), (F.col("c") == 1).alias("single"), (F.col("d") > 1).alias("contested")).filter("contested")
    # What the sample has seen twice needs no count.
    again = common_rows.filter("not sure").join(entries.filter("c > 1").select("th", "eh"), ["th", "eh"])
    more = common_rows.filter("sure").select("h", "at", "n", "th", "eh").unionByName(again.select("h", "at", "n", "th", "eh"))
    more = more.select("*", F.lit(True).alias("heavy"), F.lit(False).alias("single"), F.lit(False).alias("contested"))
    marks = written(light.unionByName(first).unionByName(more))

    whole = marks.filter("not single").select("h", F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last"))
    # The phrases of one text: bounded by its length.
    wanted = marks.filter("contested").groupBy("h").agg(F.collect_list(F.struct("at", "n", "th", "eh", "single", "heavy")).alias("marks"))
    contested = _cut(keyed.join(wanted, "h"), length)
    if marks.filter("contested and heavy").isEmpty():  # as a rule: then one pass needs no table
        return whole.unionByName(_light(contested, length))
    contested = written(contested)
    return whole.unionByName(_light(contested.filter("not heavy"), length)).unionByName(_heavy(contested.filter("heavy"), length))


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """Every row with n_bytes, spans (removed [first, end) in bytes) and kept (the other bytes)."""
    keyed = _hashed(docs, text)
    plain = [c for c in docs.columns if c == "doc_id"]
    found = repeated_windows(keyed.select("h", "t", *plain), length, **options)
    # Copies of a text give the same rows: once each, before those of a text (as many as its length allows) come together.
    single = found.groupBy("h", "first").agg(F.max("last").alias("last"))
    lists = single.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("found"))
    # Once for each text, whatever its copies.
    joined = keyed.join(_merged(lists, length), F.col("h") == F.col("__h"), "left")
    return _removed(joined.select(*plain, "t", "spans"))


_SPANS = "array<struct<first:long,end:long>>"
_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def _merged(lists: DataFrame, length: int) -> DataFrame:
    """(__h, spans): the bytes under a text's windows as runs that don't touch. Windows come in order."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten()
            count = column.value_lengths().to_numpy().astype(np.int64)
            first, end = flat.field("first").to_numpy().astype(np.int64), flat.field("last").to_numpy().astype(np.int64) + length
            row = np.repeat(np.arange(len(count)), count)
            # Rows are set apart so far that a running maximum over all of them never reaches the next.
            apart = row * (int(end.max(initial=0)) + 1)
            reach = np.maximum.accumulate(end + apart)
            new = np.concatenate([[True], (first + apart)[1:] > reach[:-1]]) if len(row) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            stop = (reach - apart)[np.concatenate([at[1:], [len(row)]]) - 1] if len(at) else at
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(count)))]).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(first[at]), pa.array(stop)], fields=list(_SPAN)))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["__h", "spans"])

    return lists.mapInArrow(make, f"__h long, spans {_SPANS}")


def _removed(rows: DataFrame) -> DataFrame:
    kind = dict(rows.dtypes).get("doc_id", "bigint")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept = [], []
            spans = batch.column(2).fill_null([])
            for value, own in zip(batch.column(1), spans, strict=True):
                data = value.as_py().encode()
                edges = [0, *(x for s in own.as_py() for x in (s["first"], s["end"])), len(data)]
                sizes.append(len(data))
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), spans.cast(pa.list_(_SPAN)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(make, f"doc_id {kind}, n_bytes long, spans {_SPANS}, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes and runs removed, and the digest of what is kept."""
    df = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return df.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
