"""File sources and sinks, and streams against batch results."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.plans import streams
from quillspark.registry import REGISTRY
from quillspark.sources import files
from quillspark.streaming import keyed, telemetry

SF = "/root/testdata/sf0.001"


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,n\nx,1\n".encode())
    assert files.csv_with_header(spark, str(tmp_path)).columns == ["name", "n"]


def test_discovery_needs_the_header_and_infers_the_split(spark, tmp_path):
    for path, body in {"a/train_x.csv": "IMAGE,MEDICINE_NAME,z\n1.png,Calpol,0\n", "b/Validation.csv": "medicine_name,image\nCrocin,2.png\n", "c/other.csv": "q\n1\n"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(body)
    rows = files.discovered_csvs(spark, str(tmp_path), ["image", "medicine_name"]).orderBy("image").collect()
    assert [tuple(r) for r in rows] == [("1.png", "Calpol", "train"), ("2.png", "Crocin", "validation")]


def test_pipe_terms(spark, tmp_path):
    row = lambda source, kind, name: "|".join(["x"] * 11 + [source, kind, "c", name, ""])
    (tmp_path / "c.rrf").write_text("\n".join([row("RXNORM", "IN", "aspirin"), row("RXNORM", "IN", "aspirin"), row("RXNORM", "XX", "no"), row("MSH", "IN", "mesh"), row("RXNORM", "BN", "ab")]))
    assert [r.term for r in files.pipe_terms(spark, str(tmp_path)).collect()] == ["aspirin"]


def test_forms_gold_pages_and_bad_lines(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/1.json").write_text(json.dumps({"form": [{"text": "b", "box": [50, 10, 60, 20]}, {"text": "a", "box": [0, 10, 9, 20]}, {"text": " ", "box": [0, 0, 1, 1]}]}, indent=1))
    assert files.form_annotations(spark, str(tmp_path / "f")).first().text == "a b"
    (tmp_path / "g").mkdir()
    for name, lines in (("gnhk_1.json", [{"text": "x", "role": "body"}]), ("mine.json", [])):
        (tmp_path / "g" / name).write_text(json.dumps({"doc_type": "note", "handwritten": True, "lines": lines}, indent=1))
    assert sorted((r.page_group, r.text) for r in files.gold_pages(spark, str(tmp_path / "g")).collect()) == [("gnhk", "x"), ("user_pages", None)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert sorted(r.a for r in files.tolerant_jsonl(spark, str(tmp_path / "j"), "a int").collect()) == [1, 2]


def test_ground_truth_pairs(spark):
    df = spark.createDataFrame([(1, "<s_medications> Calpol 500 - Take one - Crocin 650 - Take two </s_medications>")], "id int, ground_truth string")
    assert [(r.drug.strip(), r.instruction.strip()) for r in files.ground_truth_items(df).orderBy("pair").collect()] == [("Calpol 500", "Take one"), ("Crocin 650", "Take two")]


def test_sniffing_isolates_bad_files(spark, tmp_path):
    for name, body in {"a.pdf": b"%PDF-1.7 x", "b.png": b"\x89PNG\r\n", "c.bin": b"zzzz"}.items():
        (tmp_path / name).write_bytes(body)
    got = files.sniffed_documents(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted((r.kind, r.status, r.error_code) for r in got.collect()) == [("pdf", "ok", None), ("png", "ok", None), ("unknown", "failed", "unsupported")]
    empty = spark.createDataFrame([("d.pdf", 0, bytearray())], "path string, length long, content binary")  # a scan of files leaves these out
    assert files.sniffed_documents(empty).first().error_code == "empty"
    assert files.image_files(spark, str(tmp_path)).count() == 1


def test_sinks_and_shares(spark, tmp_path):
    results = spark.createDataFrame([(1, '{"slant": 2}', '{"overall": 70}'), (2, "{}", '{"overall_score": 80}')], "id int, features string, scores string")
    files.feature_export(results, str(tmp_path / "csv"))
    assert sorted(r.label for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == ["70.0", "80.0"]
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    files.document_sink(docs, str(tmp_path / "out"))
    for _ in range(2):
        files.append_rows(docs, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and spark.read.text(str(tmp_path / "out/txt")).first().value == "a"
    shares = spark.createDataFrame([("t1", 0, "2030-01-01", "r1"), ("t2", 1, "2030-01-01", "r2"), ("t3", 0, "2020-01-01", "r3")], "token_hash string, revoked int, expires_at string, revoke_hash string")
    assert [r.token_hash for r in files.live_shares(shares, "2024-01-01").collect()] == ["t1"]
    assert files.live_shares(files.revoked_shares(shares, "t1", "r1"), "2024-01-01").count() == 0 and files.live_shares(files.revoked_shares(shares, "t1", "bad"), "2024-01-01").count() == 1
    assert files.without_matches(shares, shares.filter("revoked = 1"), "token_hash").count() == 2


def test_lexicons_and_generators(spark):
    a, b = spark.createDataFrame([("Calpol",), (" ",)], "term string"), spark.createDataFrame([("calpol", 1), ("Crocin", 2)], "name string, n int")
    assert sorted(r.term for r in files.lexicon(a, b).collect()) == ["Calpol", "Crocin"]
    assert files.synthetic_sessions(spark, 50).collect() == files.synthetic_sessions(spark, 50).collect()


def dealt(spark, folder, parts):
    """Files of events, read in the order of ``parts``, whatever order they were written in."""
    folder.mkdir()
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(folder / f"w{i}"))
        file = next((folder / f"w{i}").glob("*.parquet"))
        os.utime(file.rename(folder / f"{i}.parquet"), (1_700_000_000 + 60 * i,) * 2)
        shutil.rmtree(folder / f"w{i}")
    return str(folder)


def in_order(spark, folder, order, n=4):
    """The events table in files by time, read in some order of them."""
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("part", F.ntile(n).over(Window.orderBy("ts", "event_id"))).cache()
    places = {"forward": range(n), "reversed": range(n)[::-1], "shuffled": random.Random(4).sample(range(n), n)}[order]
    return dealt(spark, folder, [rows.where(F.col("part") == i + 1).drop("part") for i in places])


def collected(stream, mode, path):
    seen = []
    telemetry.drained(stream, lambda batch, n: seen.extend((n, r) for r in batch.collect()), mode, str(path))
    return seen


@pytest.mark.parametrize("name", ["stateful_attempts_stream", "weekly_window_stream", "stroke_guidance_stream", "daily_xp_stream", "streak_stream"])
@pytest.mark.parametrize("order", ["reversed", "shuffled"])
def test_streams_lose_nothing_in_any_order_of_files(spark, tmp_path, monkeypatch, name, order):
    duckdb = pytest.importorskip("duckdb")
    folder = in_order(spark, tmp_path / "in", order)
    monkeypatch.setattr(streams, "_events", lambda spark, _: telemetry.read_events(spark, folder))
    got = REGISTRY[name].run(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    cursor = con.execute(REGISTRY[name].sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cursor.fetchall())


def some_events(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, at string, event_type string, value double, user_id long")
    return df.selectExpr("event_id", "cast(at as timestamp_ntz) AS ts", "user_id", "event_type", "value", "'{}' AS props")


def test_late_events_are_counted_and_told(spark, tmp_path):
    parts = [[(1, "2024-01-01 08:00:00", "click", 50.0, 1), (2, "2024-01-01 09:00:00", "view", 70.0, 1)], [(3, "2024-01-20 00:00:00", "click", 90.0, 1), (4, "2024-01-20 01:00:00", "error", 1.0, 2)], [(5, "2024-01-20 12:00:00", "click", 90.0, 1)], [(6, "2024-01-01 08:30:00", "error", 1.0, 1), (7, None, "click", 20.0, 3), (8, "2024-01-19 23:00:00", "error", 1.0, 1)]]
    folder = dealt(spark, tmp_path / "late", [some_events(spark, p) for p in parts])
    last = {r.user_id: r for _, r in collected(telemetry.attempts(telemetry.read_events(spark, folder), "1 day"), "update", tmp_path / "c1")}
    # the closed day holds no error for the run, the open one does
    assert (last[1].sessions, last[1].completed, last[1].accuracy, last[1].best_run, last[1].late) == (6, 4, 0.75, 2, 1)
    assert (last[2].completed, last[2].accuracy, last[2].best_run, last[2].late) == (0, None, 0, 0) and (last[3].sessions, last[3].best_run, last[3].late) == (1, 0, 1)
    strokes = telemetry.read_events(spark, folder).selectExpr("*", "0 AS stroke", "CAST(event_id AS int) AS pause")
    seen = [r for _, r in collected(telemetry.stroke_guidance(strokes, "1 day"), "update", tmp_path / "c2")]
    assert [(r.day, r.attempts, r.hesitations) for r in seen if r.late and r.user_id == 1] == [(19723, 1, [6])]
    assert sum(r.attempts for r in seen if r.user_id == 1 and r.day == 19723) == 3


def test_a_closed_day_leaves_a_summary(spark):
    """Days folded one by one give the run of all of them."""
    rnd = random.Random(1)
    for _ in range(200):
        days = [[rnd.random() < 0.8 for _ in range(rnd.randrange(1, 6))] for _ in range(rnd.randrange(6))]
        joined = keyed.Runs.NONE
        for day in days:
            joined = keyed.Runs.joined(joined, keyed.Runs.of(day))
        assert joined == keyed.Runs.of([x for day in days for x in day])


def test_windows_equal_a_batch(spark, tmp_path):
    folder = in_order(spark, tmp_path / "in", "forward", 3)
    seen = collected(telemetry.weekly_accuracy(telemetry.read_events(spark, folder)), "update", tmp_path / "c2")
    assert len({n for n, _ in seen}) == 3
    last = {(r.window.start, r.event_type): r.sessions for _, r in seen}
    at = F.window(F.col("ts").cast("timestamp"), "7 days", "7 days", telemetry.ANCHOR)
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy(at.alias("w"), "event_type").count().collect()
    assert last == {(r.w.start, r.event_type): r["count"] for r in want}


def test_repeats_go_and_bursts_end(spark, tmp_path):
    parts = [[(1, "2024-01-20 00:00:00", "click", 1.0, 1)], [(2, "2024-01-30 00:00:00", "click", 1.0, 1), (4, "2024-01-30 05:00:00", "click", 1.0, 1)], [(3, "2024-01-01 00:00:00", "click", 1.0, 1), (2, "2024-01-30 00:00:00", "click", 1.0, 1)], [(5, "2024-02-20 00:00:00", "click", 1.0, 1)], [(6, "2024-02-21 00:00:00", "click", 1.0, 1)]]
    folder = dealt(spark, tmp_path / "in", [some_events(spark, p) for p in parts])
    seen = [r.event_id for _, r in collected(telemetry.deduplicated(telemetry.read_events(spark, folder)), "append", tmp_path / "c3")]
    assert sorted(seen) == [1, 2, 4, 5, 6]  # 3 is behind the watermark of this operator
    bursts = collected(telemetry.practice_bursts(telemetry.read_events(spark, folder).where("event_id NOT IN (1, 3)"), "6 hours", "1 day"), "append", tmp_path / "c4")
    ends = sorted((str(r.session_window.start), str(r.session_window.end), r.sessions) for _, r in bursts)
    assert ends[0] == ("2024-01-30 00:00:00", "2024-01-30 11:00:00", 3)


def test_guidance_reads_and_writes_state_once_for_many_days():
    from types import SimpleNamespace as Some

    class Value:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    held, timers = Value(), []
    g = keyed.Guidance()
    g.init(Some(getValueState=lambda *_: held, registerTimer=timers.append))
    row = lambda day, stroke, at, pause: Some(day=day, stroke=stroke, us=at, event_id=at, pause=pause)
    now = Some(getCurrentWatermarkInMs=lambda: 33 * keyed.DAY_MS)
    first = list(g.handleInputRows((7, 1), iter([row(d, d % 2, 10 - k, k) for d in range(33, 64) for k in range(3)]), now))
    assert held.calls == 2 and timers == [64 * keyed.DAY_MS] and len(first) == 31 and all(r.hesitations == [2, 1, 0] for r in first)
    more = list(g.handleInputRows((7, 1), iter([row(40, 0, 9, 5), row(32, 0, 1, 8), row(32, 1, 1, None)]), now))
    assert held.calls == 4 and len(timers) == 1
    assert [(r.day, r.stroke, r.attempts, r.hesitations, r.late) for r in more] == [(40, 0, 4, [2, 1, 5, 0], False), (32, 0, 1, [8], True), (32, 1, 1, [None], True)]
