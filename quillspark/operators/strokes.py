"""Strokes as point sequences: lengths, speeds, smoothness, direction, tracing and quality."""

from __future__ import annotations

from quillspark.operators.base import Spark, operator

W = "PARTITION BY stroke ORDER BY i"
#: The reference of a stroke: the straight line of as many points from its first to its last.
_STEPS = "SELECT *, x - (lag(x) OVER w) AS dx, y - (lag(y) OVER w) AS dy, t - (lag(t) OVER w) AS dt, (lead(x) OVER w) - x AS ex, (lead(y) OVER w) - y AS ey FROM {p} WINDOW w AS (" + W + ")"


def steps(points: str) -> str:
    return _STEPS.format(p=points)


def fixed(x: str) -> str:
    """A double as whole millionths, so that sums don't depend on order."""
    return f"CAST(round(({x}) * 1000000) AS BIGINT)"


@operator("points")
def arc_length(d: Spark, points: str) -> str:
    """Length along each stroke up to every point."""
    return f"SELECT stroke, i, CAST(sum(coalesce({fixed('sqrt(dx * dx + dy * dy)')}, 0)) OVER ({W}) AS BIGINT) AS millionths FROM ({steps(points)})"


@operator("points", n=5)
def resampled(d: Spark, points: str, n: int) -> str:
    """Points at equal distances along each stroke, between the ones drawn."""
    return f"""
    WITH a AS (SELECT stroke, i, x, y, CAST(sum(coalesce({fixed('sqrt(dx * dx + dy * dy)')}, 0)) OVER ({W}) AS DOUBLE) AS pos FROM ({steps(points)})),
    s AS (SELECT stroke, pos AS a, lead(pos) OVER w AS b, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM a WINDOW w AS ({W})),
    total AS (SELECT stroke, max(pos) AS total FROM a GROUP BY stroke),
    want AS (SELECT stroke, total * k / {n - 1} AS target, CAST(k AS INT) AS k FROM total CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(n))}) v(k) WHERE total > 0)
    SELECT w.stroke, w.k, round(min_by(x1 + (x2 - x1) * (target - a) / (b - a), a), 3) AS x, round(min_by(y1 + (y2 - y1) * (target - a) / (b - a), a), 3) AS y
    FROM want w JOIN s ON s.stroke = w.stroke AND s.b > s.a AND w.target >= s.a AND w.target <= s.b GROUP BY w.stroke, w.k"""


def metrics(d: Spark, points: str) -> str:
    """Per stroke: direction, coverage, smoothness, path error, overshoot and speed against its straight reference."""
    angle = "acos(greatest(-1.0, least(1.0, (dx * ex + dy * ey) / (sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey)))))"
    speed = "sqrt(dx * dx + dy * dy) / greatest(1.0, dt)"
    return f"""
    SELECT stroke, n, len, far, CASE WHEN m_angle IS NULL THEN 1.0 ELSE greatest(0.0, 1.0 - sqrt(greatest(0.0, q_angle - m_angle * m_angle)) / 3.141592653589793) END AS smoothness,
           CASE WHEN m_speed IS NULL OR n < 3 THEN 0.0 ELSE least(1.0, sqrt(greatest(0.0, q_speed - m_speed * m_speed)) / greatest(m_speed * 3, 0.000000001)) END AS velocity_variance,
           error, overshoot, CASE WHEN len > 0 THEN far / len ELSE 0.0 END AS straightness, heading
    FROM (SELECT stroke, count(*) AS n, CAST(sum({fixed('sqrt(dx * dx + dy * dy)')}) AS DOUBLE) / 1000000 AS len, max(sqrt((lx - fx) * (lx - fx) + (ly - fy) * (ly - fy))) AS far, max(degrees(atan2(ly - fy, lx - fx))) AS heading,
                 CAST(sum({fixed(f'CASE WHEN bends THEN {angle} END')}) AS DOUBLE) / 1000000 / nullif(count(CASE WHEN bends THEN 1 END), 0) AS m_angle,
                 CAST(sum({fixed(f'CASE WHEN bends THEN {angle} * {angle} END')}) AS DOUBLE) / 1000000 / nullif(count(CASE WHEN bends THEN 1 END), 0) AS q_angle,
                 CAST(sum({fixed(speed)}) AS DOUBLE) / 1000000 / nullif(count(dx), 0) AS m_speed, CAST(sum({fixed(f'{speed} * {speed}')}) AS DOUBLE) / 1000000 / nullif(count(dx), 0) AS q_speed,
                 CAST(sum({fixed('sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry))')}) AS DOUBLE) / 1000000 / count(*) AS error,
                 CAST(count_if(proj < -0.05 OR proj > 1.05) AS DOUBLE) / count(*) AS overshoot
          FROM (SELECT *, dx * dx + dy * dy > 0 AND ex * ex + ey * ey > 0 AS bends, fx + (lx - fx) * (i - 1) / greatest(c - 1, 1) AS rx, fy + (ly - fy) * (i - 1) / greatest(c - 1, 1) AS ry,
                       CASE WHEN (lx - fx) * (lx - fx) + (ly - fy) * (ly - fy) > 0 THEN ((x - fx) * (lx - fx) + (y - fy) * (ly - fy)) / ((lx - fx) * (lx - fx) + (ly - fy) * (ly - fy)) ELSE 0.0 END AS proj
                FROM (SELECT *, first_value(x) OVER a AS fx, first_value(y) OVER a AS fy, last_value(x) OVER a AS lx, last_value(y) OVER a AS ly, count(*) OVER a AS c FROM ({steps(points)})
                      WINDOW a AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) GROUP BY stroke)"""


@operator("points")
def stroke_metrics(d: Spark, points: str) -> str:
    names = ("smoothness", "velocity_variance", "overshoot", "straightness")
    return f"SELECT stroke, n, {', '.join(f'round(CAST({x} AS DOUBLE), 3) AS {x}' for x in names)} FROM ({metrics(d, points)})"


@operator("points")
def trace_scores(d: Spark, points: str) -> str:
    """100 less 1.2 for each hundredth that a stroke is off its reference, on average."""
    return f"SELECT stroke, round(greatest(0.0, 100.0 - 1.2 * error), 2) AS score FROM ({metrics(d, points)})"


@operator("points")
def stroke_directions(d: Spark, points: str) -> str:
    """Ovals (closed), curves (turning one way) and else one of eight sectors; exactly half a turn is left."""
    sector = " ".join(f"WHEN heading <= {hi} THEN '{name}'" for hi, name in ((-157.5, "left"), (-112.5, "up-left"), (-67.5, "up"), (-22.5, "up-right"), (22.5, "right"), (67.5, "down-right"), (112.5, "down"), (157.5, "down-left")))
    return f"""
    SELECT m.stroke, CASE WHEN m.n < 2 THEN 'unknown' WHEN m.n >= 6 AND m.straightness < 0.125 THEN 'clockwise-oval' WHEN c.share > 0.7 AND abs(c.turn) > 20 THEN CASE WHEN c.turn > 0 THEN 'curve-right' ELSE 'curve-left' END
           ELSE CASE {sector} ELSE 'left' END END AS direction
    FROM ({metrics(d, points)}) m LEFT JOIN (
      SELECT k.stroke, max(turn) AS turn, CAST(count_if(bend * turn > 0) AS DOUBLE) / count(*) AS share
      FROM (SELECT stroke, dx * ey - dy * ex AS bend FROM ({steps(points)}) WHERE dx IS NOT NULL AND ex IS NOT NULL) k
      JOIN (SELECT stroke, avg(dx * ey - dy * ex) AS turn FROM ({steps(points)}) WHERE dx IS NOT NULL AND ex IS NOT NULL GROUP BY stroke) a ON k.stroke = a.stroke GROUP BY k.stroke) c ON m.stroke = c.stroke"""


@operator("points")
def turn_changes(d: Spark, points: str) -> str:
    """How often a stroke's curvature changes sign: between a fifth and seven tenths makes an s."""
    return f"""
    SELECT stroke, count(*) AS turns, count(CASE WHEN c * p < 0 THEN 1 END) AS changes, count(p) > 0 AND 10 * count(CASE WHEN c * p < 0 THEN 1 END) > 2 * count(p) AND 10 * count(CASE WHEN c * p < 0 THEN 1 END) < 7 * count(p) AS s_curve
    FROM (SELECT stroke, c, lag(c) OVER ({W}) AS p FROM (SELECT stroke, i, dx * ey - dy * ex AS c FROM ({steps(points)}) WHERE dx IS NOT NULL AND ex IS NOT NULL)) GROUP BY stroke"""


@operator("points", ahead=5)
def jitter(d: Spark, points: str, ahead: int) -> str:
    """Steps that go against where the stroke is some points on."""
    return f"SELECT stroke, count_if(dx * (x2 - x) + dy * (y2 - y) < 0) AS reversals, count(*) AS steps FROM (SELECT *, lead(x, {ahead}) OVER ({W}) AS x2, lead(y, {ahead}) OVER ({W}) AS y2 FROM ({steps(points)})) WHERE dx IS NOT NULL AND x2 IS NOT NULL GROUP BY stroke"


@operator("points")
def hesitation_gaps(d: Spark, points: str) -> str:
    """Pauses of over 0.8 s from one stroke's end to the next one's start, in sheets of 25."""
    return f"""
    SELECT sheet, count(gap) AS gaps, count_if(gap > 800) AS hesitations FROM (SELECT sheet, s - lag(e) OVER (PARTITION BY sheet ORDER BY stroke) AS gap FROM (
      SELECT CAST(floor(stroke / 25.0) AS BIGINT) AS sheet, stroke, min(t) + stroke % 25 * 3000 AS s, max(t) + stroke % 25 * 3000 AS e FROM {points} GROUP BY stroke)) GROUP BY sheet"""


@operator("points")
def positional_zip(d: Spark, points: str) -> str:
    """Points drawn beside the reference's by place; what wasn't drawn scores 0, what is too much is ignored."""
    return f"SELECT r.stroke, r.i, coalesce(round(greatest(0.0, 1.0 - abs(p.x - r.x) / 100.0), 6), 0.0) AS score FROM {points} p RIGHT JOIN (SELECT stroke - 1 AS stroke, i, x FROM {points}) r ON p.stroke = r.stroke AND p.i = r.i"


@operator("points", tolerance=30)
def coverage_within(d: Spark, points: str, tolerance: int) -> str:
    """The share of the next stroke's points that some point of this one comes near to."""
    return f"""
    SELECT r.stroke, round(CAST(count(DISTINCT CASE WHEN (p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y) <= {tolerance * tolerance} THEN r.i END) AS DOUBLE) / count(DISTINCT r.i), 6) AS coverage
    FROM (SELECT stroke - 1 AS stroke, i, x, y FROM {points}) r LEFT JOIN {points} p ON p.stroke = r.stroke GROUP BY r.stroke"""


SHEET = "CAST(floor(stroke / 25.0) AS BIGINT)"
#: Weights of a sheet's qualities in hundredths, and the least ten-thousandths of its bands.
QUALITIES = {"smoothness": 30, "steadiness": 15, "confidence": 15, "baseline": 20, "spacing": 15, "canvas": 5}
BANDS = {"exceptional": 8200, "strong": 6500, "building": 4200}


def units(x: str) -> str:
    """A share as whole ten-thousandths."""
    return f"CAST(round(({x}) * 10000) AS BIGINT)"


def evenness(x: str, n: int = 2) -> str:
    """Ten-thousandths of one less the deviation over the range; all where there are under ``n`` values or they are equal."""
    return f"CASE WHEN count({x}) < {n} OR max({x}) - min({x}) < 0.000000001 THEN 10000 ELSE {units(f'1 - least(CAST(1 AS DOUBLE), stddev_samp({x}) / (max({x}) - min({x})))')} END"


def qualities(d: Spark, points: str, width: float, height: float) -> str:
    """Per sheet of 25 strokes, in ten-thousandths: motor and spatial measures, and fatigue from the first to the last third."""
    flat = f"(SELECT {SHEET} AS stroke, CAST(row_number() OVER (PARTITION BY {SHEET} ORDER BY stroke, i) AS INT) AS i, x, y, t + stroke % 25 * 3000 AS t FROM {points})"
    mean = lambda test: f"CAST(sum(CASE WHEN n >= 3 AND {test} THEN {fixed('smoothness')} END) AS DOUBLE) / count(CASE WHEN n >= 3 AND {test} THEN 1 END) / 1000000"
    return f"""
    SELECT m.sheet, m.strokes, m.smoothness, 10000 - v.variance AS steadiness, v.variance, coalesce(h.hesitation, 0) AS hesitation, m.confidence, coalesce(b.baseline, 10000) AS baseline, coalesce(g.spacing, 10000) AS spacing, coalesce(b.canvas, 0) AS canvas, m.fatigue
    FROM (SELECT sheet, max(c) AS strokes, coalesce({units(mean('true'))}, 10000) AS smoothness, {units(f"CAST(sum({fixed('sure')}) AS DOUBLE) / count(*) / 1000000")} AS confidence,
                 CASE WHEN max(c) >= 6 THEN {units(f"least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), 2 * (coalesce({mean('r <= floor(c / 3.0)')}, 0.5) - coalesce({mean('r > c - floor(c / 3.0)')}, 0.5))))")} ELSE 0 END AS fatigue
          FROM (SELECT s.sheet, s.stroke, s.n, s.smoothness, 1 - coalesce(CAST(j.reversals AS DOUBLE) / j.steps, 0) AS sure, row_number() OVER (PARTITION BY s.sheet ORDER BY s.stroke) AS r, count(*) OVER (PARTITION BY s.sheet) AS c
                FROM (SELECT {SHEET} AS sheet, stroke, n, smoothness FROM ({metrics(d, points)})) s LEFT JOIN ({jitter.sql(d, points=points)}) j ON j.stroke = s.stroke) GROUP BY sheet) m
    JOIN (SELECT stroke AS sheet, {units('velocity_variance')} AS variance FROM ({metrics(d, flat)})) v ON v.sheet = m.sheet
    LEFT JOIN (SELECT sheet, {units('CAST(hesitations AS DOUBLE) / gaps')} AS hesitation FROM ({hesitation_gaps.sql(d, points=points)}) WHERE gaps > 0) h ON h.sheet = m.sheet
    LEFT JOIN (SELECT sheet, {evenness('bottom')} AS baseline, {units(f'least(CAST(1 AS DOUBLE), sqrt((max(right_x) - min(left_x)) / {width} * (max(bottom) - min(top)) / {height}))')} AS canvas
               FROM ({_bounds(points)}) GROUP BY sheet) b ON b.sheet = m.sheet
    LEFT JOIN (SELECT sheet, {evenness('gap')} AS spacing FROM (
      SELECT sheet, middle - lag(middle) OVER (PARTITION BY sheet ORDER BY cluster) AS gap FROM (
        SELECT sheet, cluster, sum(left_x + right_x) / (2 * count(*)) AS middle FROM (
          SELECT sheet, left_x, right_x, sum(CASE WHEN left_x - reach > {0.08 * width} THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY left_x, stroke) AS cluster FROM (
            SELECT *, max(right_x) OVER (PARTITION BY sheet ORDER BY left_x, stroke ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({_bounds(points)}))) GROUP BY sheet, cluster)) GROUP BY sheet) g ON g.sheet = m.sheet"""


def _bounds(points: str) -> str:
    return f"SELECT {SHEET} AS sheet, stroke, min(x) AS left_x, max(x) AS right_x, min(y) AS top, max(y) AS bottom FROM {points} GROUP BY stroke HAVING count(*) >= 3"


def shapes(points: str, height: float) -> str:
    """Per sheet: in ten-thousandths how even the slant of its strokes is (the angle from start to end; one drawn back to its start has
    none) and how much of the height they take, and the mean length of strokes of two points or more, in whole hundredths."""
    step = "CAST(round(sqrt((x - px) * (x - px) + (y - py) * (y - py)) * 1000000) AS BIGINT)"
    return f"""
    SELECT sheet, {evenness('angle')} AS slant, {units(f'least(CAST(1 AS DOUBLE), coalesce((max(low) - min(high)) / {height}, 0))')} AS compression, coalesce(CAST(round(CAST(sum(length) AS DOUBLE) / count(length) / 10000) AS BIGINT), 0) AS mean_length
    FROM (SELECT {SHEET} AS sheet, CASE WHEN n >= 3 THEN bottom END AS low, CASE WHEN n >= 3 THEN top END AS high, length, CASE WHEN n >= 3 AND (abs(dx) >= 0.000000001 OR abs(dy) >= 0.000000001) THEN degrees(atan2(dy, dx)) END AS angle
          FROM (SELECT stroke, count(*) AS n, min(y) AS top, max(y) AS bottom, sum({step}) AS length, max_by(x, i) - min_by(x, i) AS dx, max_by(y, i) - min_by(y, i) AS dy
                FROM (SELECT *, lag(x) OVER (PARTITION BY stroke ORDER BY i) AS px, lag(y) OVER (PARTITION BY stroke ORDER BY i) AS py FROM {points}) GROUP BY stroke)) GROUP BY sheet"""


def judged_sheets(d: Spark, points: str, width: float, height: float) -> str:
    """The measures of a sheet with its quality and band, strongest and weakest side (the first and the last of four on ties)."""
    total = " + ".join(f"{w} * {n}" for n, w in QUALITIES.items())
    sides = ("smoothness", "confidence", "spacing", "baseline")
    at = lambda f, names: " ".join(f"WHEN {n} = {f}({', '.join(sides)}) THEN '{n}'" for n in names)
    return f"""
    SELECT *, CASE {' '.join(f"WHEN quality >= {least} THEN '{band}'" for band, least in BANDS.items())} ELSE 'developing' END AS band, CASE {at('greatest', sides)} END AS strength, CASE {at('least', sides[::-1])} END AS weakness
    FROM (SELECT *, least(10000, CAST(floor(({total} + 50) / 100.0) AS BIGINT)) AS quality FROM ({qualities(d, points, width, height)}))"""


@operator("points", width=400.0, height=400.0)
def writing_quality(d: Spark, points: str, width: float, height: float) -> str:
    """A sheet's quality and band, its sides, slant, height and mean length of strokes, and how its writer felt: frustration, confidence, fatigue and focus, from 0 to 1."""
    share = lambda x: f"CAST({x} AS DOUBLE) / 10000"
    tenths = lambda x: share(f"floor(({x} + 5) / 10.0)")
    names = ("smoothness", "variance", "hesitation", "confidence", "baseline", "spacing", "canvas", "fatigue", "quality")
    return f"""
    SELECT q.sheet, strokes, {', '.join(f'{share(n)} AS {n}' for n in names)}, {share('slant')} AS slant, {share('compression')} AS compression, CAST(mean_length AS DOUBLE) / 100 AS mean_length, band, strength, weakness,
           {tenths('6 * hesitation + 4 * variance')} AS frustration, {tenths('5 * confidence + 5 * smoothness')} AS certainty, {tenths('100000 - 5 * variance')} AS focus
    FROM ({judged_sheets(d, points, width, height)}) q JOIN ({shapes(points, height)}) s ON s.sheet = q.sheet"""


#: What is said of a sheet, to an early learner, a child and an adult.
SAID = {
    "developing": ("You're just getting started — and that's amazing! 🌱", "Every session builds your writing foundation 🌱", "Foundation-building session. Consistency is the goal."),
    "building": ("You're building really good writing habits! 🔨", "You're building real writing strength 🔨", "Quality is building steadily. Keep the sessions consistent."),
    "strong": ("Your writing is so strong today! ⭐", "Strong writing session today ⭐", "Strong session. Quality metrics above target."),
    "exceptional": ("WOW! Your writing is amazing today! 🏆", "Exceptional writing today — you should be proud! 🏆", "Exceptional quality. All metrics are high."),
    "smoothness_high": ("Your strokes are so smooth! ✨", "Your writing is flowing really nicely ✨", "Stroke smoothness is strong today."),
    "smoothness_building": ("You're getting smoother! Keep going 🌊", "Your strokes are getting steadier — keep building ✍️", "Smoothness is improving. Maintain steady pen speed."),
    "smoothness_low": ("Try moving your hand slowly like a snail 🐌", "Slow down a little — let your hand glide ✍️", "Reduce pen speed slightly for cleaner strokes."),
    "spacing_high": ("Your letters have nice breathing room! 🌸", "Your spacing looks much more even today 🌱", "Spacing consistency is excellent."),
    "spacing_building": ("Good spacing! You're getting better at it 👍", "Spacing is improving — keep that rhythm going", "Spacing regularity is building well."),
    "spacing_low": ("Try leaving a little gap between your words 💭", "A little more breathing room between words would help 💭", "Work on consistent inter-word spacing."),
    "confidence_high": ("You wrote with so much confidence! 💪", "You wrote with real confidence today 💪", "High stroke confidence detected — excellent session."),
    "hesitation": ("Take your time! No rush at all 🐢", "Take a breath before each stroke — no rush 🍃", "Hesitation detected. Pause, breathe, then commit to the stroke."),
    "baseline_high": ("Your writing stays on the line so well! 📏", "Your writing is staying nice and level 📏", "Baseline alignment is very consistent."),
    "baseline_building": ("You're keeping your letters on the line — great! 📐", "Your baseline alignment is improving 📐", "Baseline consistency is developing well."),
    "improving": ("You're getting better every time! 🚀", "You're improving! Keep building that habit 🔥", "Consistent improvement trend detected."),
    "streak": ("Day {n} of writing — you're doing it! 🎉", "Day {n} in a row — your consistency is your superpower 🏆", "Session {n} this week — excellent consistency."),
}


@operator("points", width=400.0, height=400.0, tone="CAST(sheet % 3 AS INT)", improving="sheet % 2 = 0", streak="CAST(sheet % 5 AS INT)", most=4)
def writing_feedback(d: Spark, points: str, width: float, height: float, tone: str, improving: str, streak: str, most: int) -> str:
    """Up to ``most`` messages on a sheet in the ``tone`` of its writer (0 early learner, 1 child, 2 adult): its band, its strength at
    0.7 or more, the weakest other side under 0.5, hesitation over 0.4, improvement, and a streak of over a day."""
    text = lambda x: "'" + x.replace("'", "''" if d.name == "duck" else "\\'") + "'"
    say = lambda k: f"CASE tone WHEN 0 THEN {text(SAID[k][0])} WHEN 1 THEN {text(SAID[k][1])} ELSE {text(SAID[k][2])} END"
    band = " ".join(f"WHEN '{b}' THEN {say(b)}" for b in (*BANDS, "developing"))
    strong = " ".join(f"WHEN strength = '{n}' AND {n} >= 7000 THEN {say(n + '_high')}" for n in ("smoothness", "confidence", "spacing", "baseline"))
    weak = " ".join(f"WHEN weak = '{n}' THEN CASE WHEN {n} < 4000 THEN {say(n + '_' + low)} ELSE {say(n + '_building')} END" for n, low in (("smoothness", "low"), ("spacing", "low"), ("baseline", "building")))
    rest = {n: f"CASE WHEN strength = '{n}' THEN 20000 ELSE {n} END" for n in ("smoothness", "spacing", "baseline")}
    least = f"least({', '.join(rest.values())})"
    messages = d.array(f"CASE band {band} END", f"CASE {strong} END", f"CASE WHEN low < 5000 THEN CASE {weak} END END", f"CASE WHEN hesitation > 4000 THEN {say('hesitation')} END", f"CASE WHEN improving THEN {say('improving')} END", f"CASE WHEN streak > 1 THEN replace({say('streak')}, '{{n}}', {d.text('streak')}) END")
    return f"""
    SELECT sheet, {d.joined(d.first(d.only(messages, 'm', 'm IS NOT NULL'), most), '|')} AS messages
    FROM (SELECT *, {least} AS low, CASE {' '.join(f"WHEN {x} = {least} THEN '{n}'" for n, x in rest.items())} END AS weak, {tone} AS tone, {improving} AS improving, {streak} AS streak FROM ({judged_sheets(d, points, width, height)}))"""


@operator("points")
def writing_progress(d: Spark, points: str) -> str:
    """Trend of first half against second, growth from first to last in percent, and fatigue of a stroke's later points."""
    return f"""
    SELECT stroke, n, CASE WHEN n < 3 THEN 'stable' WHEN b - a > 5 THEN 'improving' WHEN b - a < -5 THEN 'declining' ELSE 'stable' END AS trend,
           CASE WHEN n >= 2 AND first > 0 THEN round((last - first) / first * 100, 1) ELSE CAST(0 AS DOUBLE) END AS growth, n >= 4 AND a - b > 15 AS fatigue, best
    FROM (SELECT stroke, max(c) AS n, avg(CASE WHEN i <= floor(c / 2.0) THEN x END) AS a, avg(CASE WHEN i > floor(c / 2.0) THEN x END) AS b, max(CASE WHEN i = 1 THEN x END) AS first, max(CASE WHEN i = c THEN x END) AS last,
                 CAST(min(CASE WHEN x = mx THEN i END) AS INT) AS best FROM (SELECT *, count(*) OVER (PARTITION BY stroke) AS c, max(x) OVER (PARTITION BY stroke) AS mx FROM {points}) GROUP BY stroke)"""


@operator("points")
def calibrated_scores(d: Spark, points: str) -> str:
    """Scores put between 40 and 100 by the range so far and blended half and half, after five and a range of ten; smoothed over three."""
    w = "ORDER BY i ROWS UNBOUNDED PRECEDING"
    return f"""
    SELECT stroke, i, round(CASE WHEN n >= 5 AND hi - lo >= 10 THEN 0.5 * x + 0.5 * (40 + 60 * (x - lo) / (hi - lo)) ELSE x END, 4) AS calibrated, round(s, 4) AS smoothed, x > p + 3 AS improved
    FROM (SELECT stroke, i, x, count(*) OVER (PARTITION BY stroke {w}) AS n, max(x) OVER (PARTITION BY stroke {w}) AS hi, min(x) OVER (PARTITION BY stroke {w}) AS lo, avg(x) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, lag(x) OVER ({W}) AS p FROM {points})"""
