"""Boxes on pages: overlaps, gaps, columns, reading order, lines, matches and connected lines.

What is relational is SQL. Greedy and first-fit algorithms go page by page with Arrow, on stably
ordered rows, so that the order in which rows arrive changes nothing. A page is bounded by what fits on
one; a page's rows are one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillspark.operators.base import Operator, Spark, operator

WIDTH, HEIGHT = 1000, 300


@operator("boxes", side=6, doubtful=40)
def micro_noise_filter(d: Spark, boxes: str, side: int, doubtful: int) -> str:
    """Small and doubtful boxes out, unless that leaves a page with none."""
    return f"SELECT page, idx FROM (SELECT *, max(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY page) AS kept FROM (SELECT *, x2 - x1 >= {side} AND y2 - y1 >= {side} AND NOT (conf < {doubtful} AND length(word) <= 2) AS ok FROM {boxes})) WHERE ok OR kept = 0"


@operator("boxes", beyond=45, sure=90)
def outlier_filter(d: Spark, boxes: str, beyond: int, sure: int) -> str:
    """Boxes far above the page's median height go if they are doubtful, where there are three or more."""
    return f"""
    SELECT b.page, b.idx FROM {boxes} b JOIN (SELECT page, median(y2 - y1) AS m, count(*) AS n FROM {boxes} GROUP BY page) p ON b.page = p.page
    WHERE NOT (p.n >= 3 AND b.y2 - b.y1 > p.m + {beyond} AND b.conf < {sure})"""


@operator("boxes")
def confidence_routing(d: Spark, boxes: str) -> str:
    """Which boxes go to the second reader, and pages of which half do."""
    return f"SELECT page, idx, CASE WHEN conf < 85 THEN 'second' ELSE 'first' END AS route, 2 * sum(CASE WHEN conf < 85 THEN 1 ELSE 0 END) OVER (PARTITION BY page) >= count(*) OVER (PARTITION BY page) AS page_unsure FROM {boxes}"


#: Glyphs that stand alone as icons.
ICONS = "<>v^+x-io|•»"


@operator("boxes", square=6, width=25)
def standalone_icons(d: Spark, boxes: str, square: int, width: int) -> str:
    """Boxes of one such glyph that are small and about square."""
    return f"SELECT page, idx FROM {boxes} WHERE length(trim(word)) = 1 AND position(trim(word) IN '{ICONS}') > 0 AND abs((x2 - x1) - (y2 - y1)) < {square} AND x2 - x1 < {width}"


@operator("boxes")
def uncovered_boxes(d: Spark, boxes: str) -> str:
    """New boxes (even idx) that no old one (odd idx) lies within 20 by 15 of: a range anti join on cells of that size."""
    return f"""
    WITH b AS (SELECT *, CAST(floor(x1 / 20.0) AS BIGINT) AS cx, CAST(floor(y1 / 15.0) AS BIGINT) AS cy FROM {boxes}),
    r AS (SELECT page, x1, y1, {d.span('cx - 1', 'cx + 1')} AS xs, {d.span('cy - 1', 'cy + 1')} AS ys FROM b WHERE idx % 2 = 1),
    old AS (SELECT page, x1, y1, cx, cy FROM r {d.rows('xs', 'p', 'cx')} {d.rows('ys', 'q', 'cy')})
    SELECT b.page, b.idx FROM b WHERE b.idx % 2 = 0 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.page = b.page AND o.cx = b.cx AND o.cy = b.cy AND abs(o.x1 - b.x1) <= 20 AND abs(o.y1 - b.y1) <= 15)"""


_IOU = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"


def touching(d: Spark, boxes: str, which: str) -> str:
    """(page, i, j, conf_i, conf_j, shared, ra, rb) of two boxes of a page that share an area, where ``which`` holds of a.idx and b.idx.

    Boxes are dealt to the cells they touch, and a pair is owned by the cell of its shared corner of least x and y, so that each comes once and no page is
    one group. A cell is as wide as the page's boxes on average, and a page has about as many cells as boxes at most: n boxes make at most n^1.5 rows.
    The checking dialect compares all pairs of a page.
    """
    found = f"a.page AS page, a.idx AS i, b.idx AS j, a.conf AS conf_i, b.conf AS conf_j, {_IOU} AS shared, (a.x2 - a.x1) * (a.y2 - a.y1) AS ra, (b.x2 - b.x1) * (b.y2 - b.y1) AS rb"
    if d.name == "duck":
        return f"SELECT * FROM (SELECT {found} FROM {boxes} a JOIN {boxes} b ON a.page = b.page AND {which}) WHERE shared > 0"
    width, height = (f"greatest(1, avg(CAST({c}2 - {c}1 AS DOUBLE)), (max({c}2) - min({c}1)) / sqrt(count(*)))" for c in "xy")
    cell = lambda at, size: f"CAST(floor({at} / {size}) AS BIGINT)"
    cells = f"""(SELECT * FROM (SELECT z.*, s.width, s.height, {d.span(cell('z.x1', 's.width'), cell('z.x2', 's.width'))} AS xs, {d.span(cell('z.y1', 's.height'), cell('z.y2', 's.height'))} AS ys
        FROM {boxes} z JOIN (SELECT page, {width} AS width, {height} AS height FROM {boxes} GROUP BY page) s ON z.page = s.page WHERE z.x1 < z.x2 AND z.y1 < z.y2) {d.rows('xs', 'p', 'cx')} {d.rows('ys', 'q', 'cy')})"""
    return f"""SELECT {found} FROM {cells} a JOIN {cells} b ON a.page = b.page AND a.cx = b.cx AND a.cy = b.cy AND {which} AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2
      AND a.cx = {cell('greatest(a.x1, b.x1)', 'a.width')} AND a.cy = {cell('greatest(a.y1, b.y1)', 'a.height')}"""


@operator("boxes")
def box_iou_pairs(d: Spark, boxes: str) -> str:
    """Overlap of the boxes of a page over what they cover together."""
    return f"SELECT page, i, j, round(CAST(shared AS DOUBLE) / (ra + rb - shared), 6) AS iou FROM ({touching(d, boxes, 'a.idx < b.idx')})"


@operator("boxes", least=0.6)
def best_overlap_lookup(d: Spark, boxes: str, least: float) -> str:
    """For each box the other of greatest overlap (over what both cover), if that is ``least`` or more and surer of itself."""
    return f"""
    SELECT page, i, j, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY page, i ORDER BY iou DESC, j) AS r FROM (
      SELECT page, i, j, conf_j > conf_i AS surer, CAST(shared AS DOUBLE) / (ra + rb - shared) AS iou FROM ({touching(d, boxes, 'a.idx <> b.idx')}))) WHERE r = 1 AND surer AND iou >= {least}"""


@operator("boxes")
def overlaps(d: Spark, boxes: str) -> str:
    """(page, a, b, score) of the boxes of even and odd number that overlap."""
    return f"SELECT page, i AS a, j AS b, CAST(shared AS DOUBLE) / (ra + rb - shared) AS score FROM ({touching(d, boxes, 'a.idx % 2 = 0 AND b.idx % 2 = 1')})"


@operator("boxes")
def scope_join(d: Spark, boxes: str) -> str:
    """The boxes that each separator (a tall box) applies to: those to its right that it overlaps in height."""
    return f"""
    SELECT a.page, a.idx AS separator, {d.listagg(d.text('b.idx'), ',', 'b.y1, b.idx')} AS applies_to FROM {boxes} a JOIN {boxes} b ON a.page = b.page AND b.x1 >= a.x2 AND b.y1 < a.y2 AND b.y2 > a.y1
    WHERE a.y2 - a.y1 >= 17 GROUP BY a.page, a.idx"""


def ordered(boxes: str) -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY floor(y1 / 40.0), x1, idx) AS INT) AS reading_order FROM {boxes}"


@operator("boxes")
def reading_order_bands(d: Spark, boxes: str) -> str:
    """Places in reading order, and dense numbers of lines."""
    return f"SELECT page, idx, reading_order, CAST(dense_rank() OVER (PARTITION BY page ORDER BY floor(y1 / 40.0)) AS INT) AS line_number FROM ({ordered(boxes)})"


@operator("boxes")
def adjacency_values(d: Spark, boxes: str) -> str:
    """The value to the right of a box, within its next three in reading order."""
    return f"""
    SELECT page, idx, v AS value_idx FROM (SELECT a.page, a.idx, b.idx AS v, row_number() OVER (PARTITION BY a.page, a.idx ORDER BY b.reading_order) AS r
      FROM ({ordered(boxes)}) a JOIN ({ordered(boxes)}) b ON a.page = b.page AND b.reading_order BETWEEN a.reading_order + 1 AND a.reading_order + 3 AND b.x1 - a.x2 BETWEEN 0 AND 250 AND abs(a.y1 - b.y1) < 20) WHERE r = 1"""


@operator("boxes")
def row_text(d: Spark, boxes: str) -> str:
    """Words of a band, parted by a bar where the gap is wide."""
    return f"""
    SELECT page, band, {d.listagg("concat(sep, word)", "", "x1, idx")} AS body FROM (
      SELECT page, band, x1, idx, word, CASE WHEN p IS NULL THEN '' WHEN x1 - p > 2.5 * (y2 - y1) THEN ' | ' ELSE ' ' END AS sep
      FROM (SELECT *, lag(x2) OVER (PARTITION BY page, band ORDER BY x1, idx) AS p FROM (SELECT *, CAST(floor(y1 / 40.0) AS BIGINT) AS band FROM {boxes}))) GROUP BY page, band"""


@operator("boxes")
def x_clusters(d: Spark, boxes: str) -> str:
    """Boxes merged where they lie within 8 % of the width of each other: islands over a running maximum."""
    return f"""
    SELECT page, min(x1) AS low, max(x2) AS high, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY x1, idx) AS island FROM (
      SELECT *, CASE WHEN x1 - max(x2) OVER (PARTITION BY page ORDER BY x1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {WIDTH * 8 // 100} THEN 0 ELSE 1 END AS new FROM {boxes})) GROUP BY page, island"""


@operator("boxes")
def line_segments(d: Spark, boxes: str) -> str:
    """Bands split where a gap is wider than 45 and 2.2 heights."""
    return f"""
    SELECT page, band, min(x1) AS low, max(x2) AS high, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY page, band ORDER BY x1, idx) AS segment FROM (
      SELECT page, band, idx, x1, x2, CASE WHEN x1 - max(x2) OVER (PARTITION BY page, band ORDER BY x1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > greatest(45, 2.2 * (y2 - y1)) THEN 1 ELSE 0 END AS new
      FROM (SELECT *, CAST(floor(y1 / 60.0) AS BIGINT) AS band FROM {boxes}))) GROUP BY page, band, segment"""


@operator("boxes")
def occupancy_sweep(d: Spark, boxes: str) -> str:
    """How many boxes lie over each stretch of x, from events of +1 and -1."""
    return f"""
    SELECT page, x, CAST(sum(step) OVER (PARTITION BY page ORDER BY x) AS BIGINT) AS boxes_from_here FROM (
      SELECT page, x, sum(step) AS step FROM (SELECT page, x1 AS x, 1 AS step FROM {boxes} UNION ALL SELECT page, x2, -1 FROM {boxes}) GROUP BY page, x)"""


@operator("boxes")
def column_gutters(d: Spark, boxes: str) -> str:
    """Empty stretches between 22 % and 78 % of the width, at least 3.5 % wide; one still open at the end is dropped."""
    low, high = WIDTH * 22 // 100, WIDTH * 78 // 100
    return f"""
    SELECT page, CAST(greatest({low}, reach) AS INT) AS gutter_start, x AS gutter_end FROM (
      SELECT page, x1 AS x, max(x2) OVER (PARTITION BY page ORDER BY x1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {boxes})
    WHERE reach IS NOT NULL AND x < {high} AND x - greatest({low}, reach) >= {max(24, WIDTH * 35 // 1000)}"""


@operator("boxes")
def largest_gap_split(d: Spark, boxes: str) -> str:
    """Where a page parts in two columns: its largest gap, if that is 1.5 median heights wide and the sides don't lie in common rows
    (the median of the best overlap in height of each box with one across is under a half)."""
    return f"""
    WITH g AS (SELECT page, max(gap) AS gap, max_by(x1, gap * 10000 - x1) AS at FROM (
      SELECT page, x1, x1 - max(x2) OVER (PARTITION BY page ORDER BY x1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM {boxes}) WHERE gap > 0 GROUP BY page),
    m AS (SELECT page, median(y2 - y1) AS h FROM {boxes} GROUP BY page),
    sides AS (SELECT b.page, b.idx, b.y1, b.y2, b.x1 >= g.at AS beyond FROM {boxes} b JOIN g ON b.page = g.page),
    best AS (SELECT a.page, a.idx, max(greatest(CAST(0 AS DOUBLE), CAST(least(a.y2, b.y2) - greatest(a.y1, b.y1) AS DOUBLE) / greatest(1, greatest(a.y2, b.y2) - least(a.y1, b.y1)))) AS iou
             FROM sides a JOIN sides b ON a.page = b.page AND NOT a.beyond AND b.beyond GROUP BY a.page, a.idx),
    rows AS (SELECT page, median(iou) AS iou FROM best GROUP BY page)
    SELECT g.page, g.gap, g.at FROM g JOIN m ON g.page = m.page LEFT JOIN rows r ON r.page = g.page WHERE g.gap >= 1.5 * m.h AND coalesce(r.iou, 0) < 0.5"""


def in_columns(d: Spark, boxes: str) -> str:
    """Boxes with their column: how many gutters lie left of their middle, from 0."""
    return f"""
    SELECT b.*, coalesce(g.col, 0) AS col FROM {boxes} b LEFT JOIN (
      SELECT b.page, b.idx, CAST(count(*) AS INT) AS col FROM {boxes} b JOIN ({column_gutters.sql(d, boxes=boxes)}) g ON g.page = b.page AND b.x1 + b.x2 > g.gutter_start + g.gutter_end GROUP BY b.page, b.idx) g
    ON g.page = b.page AND g.idx = b.idx"""


@operator("boxes")
def column_reading_order(d: Spark, boxes: str) -> str:
    """Column by column between gutters, each in bands."""
    return f"SELECT page, idx, col, CAST(row_number() OVER (PARTITION BY page ORDER BY col, floor(y1 / 40.0), x1, idx) AS INT) AS reading_order FROM ({in_columns(d, boxes)})"


@operator("boxes", head=0.12, foot=0.92, labels=("w7", "w8"))
def layout_roles(d: Spark, boxes: str, head: float, foot: float, labels: tuple) -> str:
    """Headers, footers, signatures (doubtful, after one of ``labels``) and text."""
    return f"""
    SELECT page, idx, CASE WHEN y2 <= {HEIGHT} * {head} THEN 'header' WHEN y1 >= {HEIGHT} * {foot} THEN 'footer' WHEN prev IN ({', '.join(repr(x) for x in labels)}) AND conf < 50 THEN 'signature' ELSE 'text' END AS role
    FROM (SELECT *, lag(word) OVER (PARTITION BY page ORDER BY y1, x1, idx) AS prev FROM {boxes})"""


@operator("boxes")
def coordinate_transforms(d: Spark, boxes: str) -> str:
    """Boxes as shares of the page, back to pixels, and from a region to the whole page."""
    share = lambda c, of: f"greatest(0.0, least(1.0, round({c} / CAST({of} AS DOUBLE), 5)))"
    return f"""
    SELECT page, idx, nx1, ny1, nx2, ny2, CAST(round(nx1 * {WIDTH}) AS INT) AS px1, CAST(round(ny2 * {HEIGHT}) AS INT) AS py2, round(0.25 + nx1 * 0.5, 6) AS gx1, CAST(round(40 + x1 / 2.0) AS INT) AS crop_x1
    FROM (SELECT *, CAST({share('x1', WIDTH)} AS DOUBLE) AS nx1, CAST({share('y1', HEIGHT)} AS DOUBLE) AS ny1, CAST({share('x2', WIDTH)} AS DOUBLE) AS nx2, CAST({share('y2', HEIGHT)} AS DOUBLE) AS ny2 FROM {boxes})"""


@operator("boxes")
def word_gaps(d: Spark, boxes: str) -> str:
    """Positive gaps from the box before on a band, their median and spread."""
    return f"""
    SELECT page, count(*) AS gaps, median(CAST(gap AS DOUBLE)) AS median_gap, round(stddev_pop(CAST(gap AS DOUBLE)), 6) AS spread FROM (
      SELECT page, x1 - lag(x2) OVER (PARTITION BY page, floor(y1 / 60.0) ORDER BY x1, idx) AS gap FROM {boxes}) WHERE gap > 0 GROUP BY page"""


@operator("boxes")
def id_remap(d: Spark, boxes: str) -> str:
    """References to boxes after these were renumbered."""
    o = ordered(boxes)
    return f"SELECT a.page, a.reading_order, b.reading_order AS refers_to FROM ({o}) a JOIN ({o}) b ON a.page = b.page AND b.idx = a.idx + 1"


@operator("boxes")
def projection_segments(d: Spark, boxes: str) -> str:
    """Runs of inked rows of a page's profile, parted by gaps of more than three rows.

    In Spark a box stays one row: it begins a run where it lies that far below all boxes that begin above it.
    """
    if d.name == "spark":
        w = "PARTITION BY page ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND"
        return f"""
    SELECT page, CAST(min(y1) AS INT) AS top, CAST(max(y2) AS INT) AS bottom FROM (SELECT page, y1, y2, sum(new) OVER ({w} CURRENT ROW) AS seg FROM (
      SELECT page, y1, y2, CASE WHEN y1 - max(y2) OVER ({w} 1 PRECEDING) <= 4 THEN 0 ELSE 1 END AS new FROM {boxes} WHERE y2 >= y1)) GROUP BY page, seg"""
    rows = f"SELECT DISTINCT page, y FROM (SELECT page, {d.span('y1', 'y2')} AS ys FROM {boxes}) x {d.rows('ys', 'r', 'y')}"
    return f"""
    SELECT page, CAST(min(y) AS INT) AS top, CAST(max(y) AS INT) AS bottom FROM (SELECT page, y, sum(new) OVER (PARTITION BY page ORDER BY y) AS seg FROM (
      SELECT page, y, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y) <= 4 THEN 0 ELSE 1 END AS new FROM ({rows}))) GROUP BY page, seg"""


# Page by page ------------------------------------------------------------------------------------

Page = dict[str, np.ndarray]


def by_page(df: DataFrame, f: Callable[[Page], Page], schema: str, *order: str) -> DataFrame:
    """``f`` on each page's columns, in the stated order. Many pages go to Python at once, each of them whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for batch in batches:
            rows = pd.concat([held, batch], ignore_index=True) if len(held) else batch
            last = rows["page"].to_numpy()[-1:] if len(rows) else []
            cut = int(np.searchsorted(rows["page"].to_numpy(), last[0])) if len(rows) else 0
            if cut:
                yield pages(rows.iloc[:cut])
            held = rows.iloc[cut:]
        if len(held):
            yield pages(held)

    def pages(rows: pd.DataFrame) -> pd.DataFrame:
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        cuts = [0, *(np.flatnonzero(np.diff(columns["page"])) + 1).tolist(), len(rows)]
        parts = [f({c: v[a:b] for c, v in columns.items()}) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    return df.filter("page IS NOT NULL").repartition("page").sortWithinPartitions("page", *order).mapInPandas(run, schema)


def first_fit_lines(rows: Page, overlap: float = 0.45, middle: float = 0.4, median_band: bool = False) -> np.ndarray:
    """The line of each box, in order of y then x: the first whose band it overlaps by ``overlap`` of the lesser
    height, or whose middle is within ``middle`` of it. A line's band is the union of its boxes, or with
    ``median_band`` the medians of their tops and bottoms."""
    tops, bottoms = [], []
    bands: list[tuple[float, float]] = []
    out = []
    for a, b in zip(np.asarray(rows["y1"]).tolist(), np.asarray(rows["y2"]).tolist(), strict=True):
        for k, (top, bottom) in enumerate(bands):
            least = min(max(1, b - a), max(1, bottom - top))
            if max(0, min(b, bottom) - max(a, top)) / least >= overlap or abs((a + b) / 2 - (top + bottom) / 2) <= middle * least:
                tops[k].append(a)
                bottoms[k].append(b)
                bands[k] = (float(np.median(tops[k])), float(np.median(bottoms[k]))) if median_band else (min(top, a), max(bottom, b))
                break
        else:
            k = len(bands)
            tops.append([a])
            bottoms.append([b])
            bands.append((a, b))
        out.append(k)
    return np.array(out, np.int64)


def merged_fragments(rows: Page, line: np.ndarray, low: float = -0.35, high: float = 2.2) -> np.ndarray:
    """The fragment of each box: boxes of a line whose gap is within those multiples of the greater height."""
    out = np.zeros(len(line), np.int64)
    n, last, reach, height = 0, None, 0, 0
    x1, x2, h = rows["x1"], rows["x2"], rows["y2"] - rows["y1"]
    for i in np.lexsort((rows["idx"], x1, line)).tolist():
        most = max(height, h[i])
        if line[i] == last and low * most <= x1[i] - reach <= high * most:
            reach, height = max(reach, x2[i]), most
        else:
            n, last, reach, height = n + 1, line[i], x2[i], h[i]
        out[i] = n
    return out


def numbered_lines(rows: Page, median_band: bool = False) -> np.ndarray:
    """First-fit lines, numbered by their tops."""
    found = first_fit_lines(rows, median_band=median_band)
    top = np.full(found.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(top, found, rows["y1"])
    return np.argsort(np.argsort(top, kind="stable"))[found]


def column_lines(boxes: DataFrame) -> DataFrame:
    """page, idx, column and line from 1, and place in reading order: column by column, each in lines of its own."""
    whole = Operator("in_columns", ("boxes",), in_columns)(boxes=boxes)

    def f(rows: Page) -> Page:
        line = np.zeros(len(rows["col"]), np.int64)
        for c in np.unique(rows["col"]):
            own = np.flatnonzero(rows["col"] == c)
            line[own] = numbered_lines({k: v[own] for k, v in rows.items()}) + 1
        column = np.unique(rows["col"], return_inverse=True)[1] + 1
        place = np.zeros(len(line), np.int64)
        place[np.lexsort((rows["idx"], rows["x1"], line, column))] = np.arange(1, len(line) + 1)
        return {"page": rows["page"], "idx": rows["idx"], "column": column, "line": line, "reading_order": place}

    return by_page(whole, f, "page long, idx int, column long, line long, reading_order long", "y1", "x1", "idx")


def line_clusters(boxes: DataFrame, median_band: bool = False) -> DataFrame:
    """page, idx, line, fragment and place in reading order; lines are numbered by their tops."""

    def f(rows: Page) -> Page:
        line = numbered_lines(rows, median_band)
        place = np.zeros(len(line), np.int64)
        place[np.lexsort((rows["idx"], rows["x1"], line))] = np.arange(1, len(line) + 1)
        return {"page": rows["page"], "idx": rows["idx"], "line": line, "fragment": merged_fragments(rows, line), "reading_order": place}

    return by_page(boxes, f, "page long, idx int, line long, fragment long, reading_order long", "y1", "x1", "idx")


def greedy_match(pairs: DataFrame, least: float, descending: bool = True) -> DataFrame:
    """One-to-one matches of pairs (page, a, b, score), best score first; ties by a, then b."""

    def f(rows: Page) -> Page:
        ok = rows["score"] >= least if descending else rows["score"] < least
        keep, left, right = [], set(), set()
        for i in np.lexsort((rows["b"], rows["a"], -rows["score"] if descending else rows["score"])).tolist():
            a, b = rows["a"][i], rows["b"][i]
            if ok[i] and a not in left and b not in right:
                left.add(a)
                right.add(b)
                keep.append(i)
        return {c: rows[c][keep] for c in ("page", "a", "b", "score")}

    return by_page(pairs, f, "page long, a int, b int, score double", "a", "b")


def connected_lines(boxes: DataFrame, gap: float = 60.0, drift: float = 10.0, turn: float = 20.0) -> DataFrame:
    """Boxes linked where the next begins within ``gap`` along the first one's line, off it by ``drift`` at most, and their middles
    lie under an angle of ``turn`` degrees; the least idx names a line."""

    def f(rows: Page) -> Page:
        x1, x2, y1, y2 = (rows[c].astype(float) for c in ("x1", "x2", "y1", "y2"))
        across, down = (x1 + x2)[None, :] - (x1 + x2)[:, None], (y1 + y2)[None, :] - (y1 + y2)[:, None]
        angle = np.degrees(np.arctan2(np.abs(down), np.maximum(np.abs(across), 1e-9)))
        near = (np.abs(x1[None, :] - x2[:, None]) <= gap) & (np.abs(y1[None, :] - y1[:, None]) <= drift) & (angle <= turn)
        near |= near.T
        np.fill_diagonal(near, True)
        label = rows["idx"].astype(np.int64)
        while True:
            new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)
            if (new == label).all():
                return {"page": rows["page"], "idx": rows["idx"], "line": label}
            label = new

    return by_page(boxes, f, "page long, idx int, line long", "y1", "x1", "idx")


def table_rows(boxes: DataFrame, depth: int = 60, reach: int = 180, headers: tuple[str, ...] = ("w1",)) -> DataFrame:
    """Rows under each header (a word of ``headers``), with a bound that each row taken moves down."""
    names = headers

    def f(rows: Page) -> Page:
        headers, taken = [], []
        x1, x2, y1, y2 = (rows[c].tolist() for c in ("x1", "x2", "y1", "y2"))
        for h in np.flatnonzero(np.isin(rows["word"].astype(str), names)).tolist():
            bound = y1[h] + depth
            for i in range(h + 1, len(x1)):
                if y1[i] > bound:
                    break
                if abs(x1[i] - x1[h]) < reach or x1[h] <= x1[i] <= x2[h]:
                    headers.append(h)
                    taken.append(i)
                    bound = max(bound, y2[i] + 10)
        headers, taken = np.array(headers, np.int64), np.array(taken, np.int64)
        return {"page": rows["page"][headers], "header": rows["idx"][headers], "idx": rows["idx"][taken]}

    return by_page(boxes, f, "page long, header int, idx int", "y1", "x1", "idx")
