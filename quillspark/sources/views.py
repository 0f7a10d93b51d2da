"""Canonical views over the star-schema tables: practice sessions, lines of text, boxes and strokes.

Each view has a DataFrame for Spark and the same rows as SQL. Accuracies are fixed-point (units of
1e-4), so that sums don't depend on the order of rows; times count from one stated instant.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillspark.runtime import prepare

#: The instant that stands for "now" in every query that is compared.
AS_OF = "2024-01-31 00:00:00"


@dataclass(frozen=True)
class View:
    tables: tuple[str, ...]
    spark: str
    duck: str


_SESSIONS = """
SELECT event_id AS id, user_id, event_type AS module_type, k, chr(65 + k % 26) AS target_item,
       CASE k % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' ELSE 'advanced' END AS difficulty, k % 3 AS difficulty_rank,
       least(10000, CAST(round(value * 100) AS BIGINT)) AS acc, event_type <> 'error' AS completed,
       CASE WHEN event_type = 'error' THEN 'abandoned' ELSE 'completed' END AS status,
       CAST(floor(value) AS BIGINT) AS seconds, ts, {day} AS day, {dow} AS dow, {age} AS age_seconds,
       CAST((k * 37) % 4000 AS BIGINT) AS first_ms, CAST((k * 53) % 3500 AS BIGINT) AS pause_1, CAST((k * 71) % 2500 AS BIGINT) AS pause_2,
       k % 5 AS tries_1, (k * 7) % 6 AS tries_2,
       translate(concat('("time_before_first_stroke_ms":', (k * 37) % 4000, ',"hesitation_ms_per_stroke":[("stroke_id":1,"ms":', (k * 53) % 3500, '),("stroke_id":2,"ms":', (k * 71) % 2500,
                        ')],"stroke_attempt_counts":("1":', k % 5, ',"2":', (k * 7) % 6, '))'), '()', concat(chr(123), chr(125))) AS scores
FROM (SELECT *, {k} AS k FROM {events})
"""
VIEWS = {
    "sessions": View(
        ("events",),
        _SESSIONS.format(day="CAST(unix_date(CAST(ts AS date)) AS BIGINT)", dow="dayofweek(ts) - 1", age=f"CAST(timestampdiff(SECOND, ts, TIMESTAMP_NTZ'{AS_OF}') AS BIGINT)", k="CAST(get_json_object(props, '$.k') AS INT)", events="{events}"),
        _SESSIONS.format(day="CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT)", dow="CAST(dayofweek(ts) AS INT)", age=f"CAST(trunc(epoch(TIMESTAMP '{AS_OF}' - ts)) AS BIGINT)", k="CAST(json_extract_string(props, '$.k') AS INT)", events="events"),
    ),
    "lines": View(
        ("documents",),
        "SELECT doc_id, lang, source, pos AS line_number, line FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) x AS pos, line",
        "SELECT doc_id, lang, source, CAST(pos AS INT) AS line_number, line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos)",
    ),
}
#: Ordinary words: those of benchmark items, in lower case.
VIEWS["ordinary"] = View(
    ("benchmark",),
    r"SELECT DISTINCT lower(token) AS term FROM {benchmark} LATERAL VIEW explode(regexp_extract_all(text, r'\p{{L}}+', 0)) x AS token",
    r"SELECT DISTINCT lower(token) AS term FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}+')) AS token FROM {benchmark})",
)
#: A page is an order, a box a line item: places and sizes follow from keys.
_BOXES = """
SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS idx, x1, y1, x1 + 20 + CAST(l_quantity AS INT) * 3 AS x2, y1 + 12 + CAST(l_suppkey % 9 AS INT) AS y2,
       CAST(l_partkey % 100 AS INT) AS conf, CASE l_partkey % 50 WHEN 9 THEN '>' ELSE concat('w', {text}) END AS word
FROM (SELECT *, CAST((l_partkey * 13) % 760 AS INT) AS x1, CAST((l_suppkey * 17) % 240 AS INT) AS y1 FROM {lineitem})
"""
VIEWS["boxes"] = View(("lineitem",), _BOXES.format(text="cast(l_partkey % 50 AS string)", lineitem="{lineitem}"), _BOXES.format(text="CAST(l_partkey % 50 AS VARCHAR)", lineitem="lineitem"))
#: A stroke is an order, a point a line item; t is in milliseconds.
_POINTS = """
SELECT l_orderkey AS stroke, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS i,
       CAST(l_partkey % 101 AS DOUBLE) AS x, CAST(l_suppkey % 101 AS DOUBLE) AS y, CAST(l_linenumber * 400 + l_quantity AS DOUBLE) AS t
FROM {lineitem}
"""
VIEWS["points"] = View(("lineitem",), _POINTS, _POINTS)

#: Lines of clinical notes: a page is an order, a line a line item; what it says follows from keys.
_NOTES = """
SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_number, CAST(l_partkey % 100 AS INT) AS conf,
       CASE CAST((l_partkey + l_linenumber) % 16 AS INT)
         WHEN 0 THEN concat('Tab. ', drug, ' ', q, '0 mg 1-0-1 x ', n, ' days after food') WHEN 1 THEN concat('Syp. ', drug, ' 5 ml BD for ', n, ' weeks')
         WHEN 2 THEN concat('1-0-', n, ' x ', q, ' days') WHEN 3 THEN concat('Haemoglobin ', n, '.', q, ' g/dL 11.0 - 15.0') WHEN 4 THEN concat('Patient Name: Ann ', word, '  Age: ', q)
         WHEN 5 THEN concat('[x] ', word, ' smoker') WHEN 6 THEN concat('BP: ', q, '5/80 HR ', q, ' SPO2: 9', n, '%') WHEN 7 THEN 'DIAGNOSIS:' WHEN 8 THEN concat(word, ' fever for ', n, ' days, and no') WHEN 9 THEN concat('Inj. Calcium D3 2 ml IV OD x ', n, ' wks') WHEN 10 THEN concat('Syp. Calpol (250/5) ', n, ' ml every 6 hours')
         WHEN 11 THEN 'Adv: Hexigel gum paint topical twice daily' WHEN 12 THEN concat('CRP ', n, '.', q, ' mg/L < 5.0') WHEN 13 THEN concat('C/O pain, Dx ', word, ' Temp: 10', n, '.5 F') WHEN 14 THEN concat('Discharge Summary ', word) ELSE concat('cough. Review after ', n, ' days') END AS line
FROM (SELECT *, {q} AS q, {n} AS n, concat('w', {w}) AS word, CASE l_suppkey % 3 WHEN 0 THEN 'Paracetamol' WHEN 1 THEN 'Amoxicilin' ELSE 'Cetirizne' END AS drug FROM {lineitem})
"""
_cast = lambda kind: {"q": f"CAST(CAST(l_quantity AS INT) AS {kind})", "n": f"CAST(l_suppkey % 9 AS {kind})", "w": f"CAST(l_partkey % 50 AS {kind})"}
VIEWS["notes"] = View(("lineitem",), _NOTES.format(lineitem="{lineitem}", **_cast("string")), _NOTES.format(lineitem="lineitem", **_cast("VARCHAR")))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or plain table as a DataFrame."""
    prepare(spark)
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    v = VIEWS[name]
    return spark.sql(v.spark, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in v.tables})


def subquery(name: str) -> str:
    """The same as SQL to put after FROM."""
    return f"({VIEWS[name].duck.format(**{t: t for t in VIEWS[name].tables})})" if name in VIEWS else name
