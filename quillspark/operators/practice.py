"""Learning analytics over practice sessions: progress, engagement, confidence, difficulty, rewards.

All learners are computed at once from one scan. Sessions are as in ``sources.views``: ``acc`` is
accuracy in units of 1e-4 and ``age_seconds`` counts back from the instant of the report.
"""

from __future__ import annotations

from quillspark.operators.base import Spark, operator

WEEK = 7 * 86400


def mean(units: str, where: str = "") -> str:
    """Mean of fixed-point units to a whole unit, halves up, as a fraction."""
    f = f" FILTER (WHERE {where})" if where else ""
    total, n = f"CAST(sum({units}){f} AS DOUBLE)", f"CAST(count({units}){f} AS DOUBLE)"
    return f"CAST(floor((2 * {total} + {n}) / nullif(2 * {n}, 0)) AS DOUBLE) / 10000"


@operator("sessions", weeks=4)
def weekly_accuracy_by_user(d: Spark, sessions: str, weeks: int) -> str:
    """Mean accuracy of each of the last weeks (oldest first, 0 where idle), and its trend over the weeks that aren't."""
    cols = ", ".join(f"coalesce({mean('acc', f'age_seconds > {i * WEEK} AND age_seconds <= {(i + 1) * WEEK}')}, 0) AS week_{weeks - i}" for i in reversed(range(weeks)))
    names = [f"week_{i + 1}" for i in range(weeks)]
    first = f"coalesce({', '.join(f'nullif({n}, 0)' for n in names)})"
    last = f"coalesce({', '.join(f'nullif({n}, 0)' for n in reversed(names))})"
    busy = " + ".join(f"CASE WHEN {n} > 0 THEN 1 ELSE 0 END" for n in names)
    return f"""
    SELECT *, CASE WHEN {busy} < 2 THEN 'stable' WHEN {last} - {first} > 0.05 THEN 'improving' WHEN {last} - {first} < -0.05 THEN 'declining' ELSE 'stable' END AS trend
    FROM (SELECT user_id, {cols} FROM {sessions} WHERE completed GROUP BY user_id)"""


@operator("sessions")
def learning_velocity(d: Spark, sessions: str) -> str:
    """Completed sessions a week over four weeks, as a class; the trend doesn't enter it."""
    return f"""
    SELECT user_id, n AS sessions_4_weeks, CASE WHEN n / 4.0 >= 3 THEN 'fast' WHEN n / 4.0 < 1 THEN 'slow' ELSE 'steady' END AS velocity
    FROM (SELECT user_id, count_if(completed AND age_seconds <= {4 * WEEK}) AS n FROM {sessions} GROUP BY user_id)"""


@operator("sessions", last=5)
def rolling_accuracy_last_n(d: Spark, sessions: str, last: int) -> str:
    """Mean accuracy of each learner's last completed sessions, and the readiness for promotion it gives."""
    return f"""
    SELECT user_id, {mean('acc')} AS rolling_average, round(least(1.0, CAST(sum(acc) AS DOUBLE) / count(acc) / 10000 / 0.85), 4) AS promotion_readiness, count(*) AS sessions_used
    FROM (SELECT user_id, acc, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS r FROM {sessions} WHERE completed)
    WHERE r <= {last} GROUP BY user_id"""


@operator("sessions")
def rolling_accuracy_series(d: Spark, sessions: str) -> str:
    """The running mean of five at every completed session."""
    return f"""
    SELECT id, user_id, CAST(floor((2 * CAST(sum(acc) OVER w AS DOUBLE) + count(acc) OVER w) / CAST(2 * count(acc) OVER w AS DOUBLE)) AS DOUBLE) / 10000 AS rolling_5
    FROM {sessions} WHERE completed WINDOW w AS (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""


@operator("sessions", top=3)
def best_worst_items(d: Spark, sessions: str, top: int) -> str:
    """Items done at least twice, the best by mean accuracy, and the worst that aren't among them."""
    return f"""
    WITH items AS (SELECT user_id, target_item, {mean('acc')} AS avg_acc, count(*) AS n, CAST(sum(acc) AS DOUBLE) / count(*) AS m FROM {sessions} WHERE completed GROUP BY user_id, target_item HAVING count(*) >= 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, target_item) AS b, row_number() OVER (PARTITION BY user_id ORDER BY m, target_item DESC) AS w FROM items)
    SELECT user_id, target_item, n, avg_acc, CASE WHEN b <= {top} THEN 'best' ELSE 'worst' END AS kind FROM ranked WHERE b <= {top} OR w <= {top}"""


@operator("sessions")
def session_counts(d: Spark, sessions: str) -> str:
    return f"SELECT user_id, count(*) AS total_sessions, count_if(completed) AS completed_sessions, count(DISTINCT module_type) AS modules FROM {sessions} GROUP BY user_id"


@operator("sessions", days=14)
def practice_consistency(d: Spark, sessions: str, days: int) -> str:
    """Active days of the last ``days``, their share, and the pattern of week and weekend."""
    return f"""
    SELECT user_id, active_days, {days} AS total_days, round(active_days / CAST({days} AS DOUBLE), 4) AS consistency_score,
           CASE WHEN active_days = 0 THEN 'irregular' WHEN weekend = 0 THEN 'weekday_only' WHEN active_days = weekend THEN 'weekend_heavy'
                WHEN round(active_days / CAST({days} AS DOUBLE), 4) >= 0.7 THEN 'consistent' ELSE 'irregular' END AS pattern
    FROM (SELECT user_id, count(DISTINCT CASE WHEN recent THEN day END) AS active_days, count(DISTINCT CASE WHEN recent AND dow IN (0, 6) THEN day END) AS weekend
          FROM (SELECT user_id, day, dow, age_seconds <= {days * 86400} AS recent FROM {sessions}) GROUP BY user_id)"""


@operator("sessions", days=30)
def abandon_rate(d: Spark, sessions: str, days: int) -> str:
    return f"""
    SELECT user_id, round(CAST(count_if(status = 'abandoned') AS DOUBLE) / count(*), 4) AS abandon_rate
    FROM {sessions} WHERE age_seconds <= {days * 86400} GROUP BY user_id"""


@operator("sessions", last=20)
def session_durations(d: Spark, sessions: str, last: int) -> str:
    """Mean, least and most seconds of the last completed sessions."""
    return f"""
    SELECT user_id, round(CAST(sum(seconds) AS DOUBLE) / count(*), 1) AS avg_seconds, min(seconds) AS min_seconds, max(seconds) AS max_seconds
    FROM (SELECT user_id, seconds, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS r FROM {sessions} WHERE completed) WHERE r <= {last} GROUP BY user_id"""


@operator("sessions")
def streaks(d: Spark, sessions: str) -> str:
    """Islands of consecutive active days: the current streak, the longest, and whether it is at risk."""
    today = "(SELECT max(day + CAST(floor(age_seconds / 86400) AS BIGINT)) FROM " + sessions + ")"
    return f"""
    WITH days AS (SELECT DISTINCT user_id, day FROM {sessions} WHERE completed),
    runs AS (SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM days) GROUP BY user_id, island)
    SELECT user_id, max(last_day) AS last_active_day, max_by(n, last_day) AS current_streak, max(n) AS longest_streak,
           CASE {today} - max(last_day) WHEN 0 THEN 'active' WHEN 1 THEN 'at_risk' ELSE 'broken' END AS streak_status
    FROM runs GROUP BY user_id"""


@operator("sessions")
def attempt_numbers(d: Spark, sessions: str) -> str:
    return f"SELECT id, user_id, module_type, target_item, CAST(row_number() OVER (PARTITION BY user_id, module_type, target_item ORDER BY ts, id) AS BIGINT) AS attempt_number FROM {sessions}"


@operator("sessions")
def retry_recovery(d: Spark, sessions: str) -> str:
    """How much the second attempt at an item gains on the first (the later of several such rows counts)."""
    return f"""
    WITH tries AS (SELECT user_id, target_item, acc, id, row_number() OVER (PARTITION BY user_id, module_type, target_item ORDER BY ts, id) AS attempt FROM {sessions} WHERE completed),
    items AS (SELECT user_id, target_item, max_by(acc, id) FILTER (WHERE attempt = 1) AS a, max_by(acc, id) FILTER (WHERE attempt = 2) AS b FROM tries GROUP BY user_id, target_item)
    SELECT user_id, count(*) AS items_analyzed, {mean('b - a')} AS avg_improvement, CAST(sum(b - a) AS DOUBLE) / count(*) / 10000 > 0.05 AS recovers_quickly
    FROM items WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY user_id"""


@operator("sessions", last=5)
def difficulty_recommendation(d: Spark, sessions: str, last: int) -> str:
    """The next difficulty from the latest one and the mean of the last sessions."""
    level = lambda x: f"CASE {x} WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' ELSE 'advanced' END"
    return f"""
    SELECT user_id, module_type, {level('rank')} AS current_difficulty, avg_accuracy, sessions_used, up AS promoted, down AS demoted, {level('rank + CASE WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END')} AS difficulty
    FROM (SELECT *, m >= 0.85 AND rank < 2 AS up, m <= 0.5 AND rank > 0 AS down
          FROM (SELECT user_id, module_type, max(CASE WHEN r = 1 THEN difficulty_rank END) AS rank, {mean('acc')} AS avg_accuracy, CAST(sum(acc) AS DOUBLE) / count(*) / 10000 AS m, count(*) AS sessions_used
                FROM (SELECT *, row_number() OVER (PARTITION BY user_id, module_type ORDER BY ts DESC, id DESC) AS r FROM {sessions} WHERE completed) WHERE r <= {last} GROUP BY user_id, module_type))"""


@operator("sessions")
def level_summary(d: Spark, sessions: str) -> str:
    """Sessions and mean accuracy at the difficulty of the latest completed session."""
    return f"""
    WITH latest AS (SELECT user_id, module_type, difficulty FROM (SELECT *, row_number() OVER (PARTITION BY user_id, module_type ORDER BY ts DESC, id DESC) AS r FROM {sessions} WHERE completed) WHERE r = 1)
    SELECT s.user_id, s.module_type, s.difficulty AS current_difficulty, count(*) AS sessions_at_level, {mean('acc')} AS avg_accuracy_at_level
    FROM {sessions} s JOIN latest l ON s.user_id = l.user_id AND s.module_type = l.module_type AND s.difficulty = l.difficulty WHERE s.completed GROUP BY s.user_id, s.module_type, s.difficulty"""


@operator("sessions")
def level_changes(d: Spark, sessions: str) -> str:
    """Promotions and demotions from one completed session to the next, those without a time last."""
    order = "ts NULLS LAST, id NULLS LAST" if d.name == "spark" else "ts, id"  # the other dialect puts nulls last by itself
    return f"""
    SELECT user_id, module_type, count_if(step > 0) AS promotions_count, count_if(step < 0) AS demotions_count
    FROM (SELECT user_id, module_type, difficulty_rank - lag(difficulty_rank) OVER (PARTITION BY user_id, module_type ORDER BY {order}) AS step FROM {sessions} WHERE completed) GROUP BY user_id, module_type"""


@operator("sessions", last=20, order="ASC")
def difficulty_history(d: Spark, sessions: str, last: int, order: str) -> str:
    """The first ``last`` completed sessions; order DESC gives the latest."""
    return f"SELECT user_id, module_type, id, day, difficulty, acc FROM (SELECT *, row_number() OVER (PARTITION BY user_id, module_type ORDER BY ts {order}, id {order}) AS r FROM {sessions} WHERE completed) WHERE r <= {last}"


def _telemetry(d: Spark, s: str, last: int) -> str:
    """(user_id, target_item, t): what the last completed sessions say of their strokes, out of their JSON."""
    return f"SELECT user_id, target_item, {d.telemetry('scores')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS latest FROM {s} WHERE completed AND scores IS NOT NULL) WHERE latest <= {last}"


def _pauses(d: Spark, s: str, last: int) -> str:
    t = _telemetry(d, s, last)
    entries = f"SELECT user_id, target_item, e FROM (SELECT user_id, target_item, t.hesitation_ms_per_stroke AS es FROM ({t})) x {d.rows('es', 'y', 'e')}"
    return f"SELECT user_id, target_item, 1 AS first, t.time_before_first_stroke_ms AS ms FROM ({t}) UNION ALL SELECT user_id, target_item, 0, e.ms FROM ({entries})"


@operator("sessions", last=20)
def hesitation_profile(d: Spark, sessions: str, last: int) -> str:
    """Mean pauses before the first stroke and between strokes of the last sessions, and the items slower than 1.4 times the latter."""
    pauses = _pauses(d, sessions, last)
    return f"""
    WITH p AS (SELECT * FROM ({pauses}) WHERE ms > 0),
    u AS (SELECT user_id, coalesce(round(avg(CASE WHEN first = 1 THEN ms END), 1), 0) AS before_first, coalesce(round(avg(CASE WHEN first = 0 THEN ms END), 1), 0) AS between FROM p GROUP BY user_id),
    i AS (SELECT user_id, target_item, round(avg(ms), 1) AS m FROM p GROUP BY user_id, target_item),
    f AS (SELECT i.user_id, i.target_item, i.m, i.m > CASE WHEN u.between > 0 THEN u.between * 1.4 ELSE 1500 END AS slow FROM i JOIN u ON i.user_id = u.user_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, slow ORDER BY m DESC, target_item) AS hi, row_number() OVER (PARTITION BY user_id, slow ORDER BY m, target_item) AS lo FROM f)
    SELECT u.user_id, u.before_first AS avg_pause_before_first_ms, u.between AS avg_pause_between_ms,
           coalesce(x.high_items, '') AS high_hesitation_items, coalesce(x.low_items, '') AS low_hesitation_items
    FROM u LEFT JOIN (SELECT user_id, {d.listagg("CASE WHEN slow AND hi <= 5 THEN target_item END", ",", "target_item")} AS high_items,
                             {d.listagg("CASE WHEN NOT slow AND lo <= 5 THEN target_item END", ",", "target_item")} AS low_items FROM r GROUP BY user_id) x ON u.user_id = x.user_id"""


def _tries(d: Spark, s: str, last: int) -> str:
    counts = f"SELECT user_id, target_item, map_values(t.stroke_attempt_counts) AS ns FROM ({_telemetry(d, s, last)})"
    return f"SELECT user_id, target_item, n FROM ({counts}) x {d.rows('ns', 'y', 'n')}"


@operator("sessions", last=20)
def retry_pattern(d: Spark, sessions: str, last: int) -> str:
    """Mean tries of a stroke, the share unlocked after more than three, and the five items of most tries."""
    return f"""
    WITH t AS ({_tries(d, sessions, last)}),
    i AS (SELECT user_id, target_item, row_number() OVER (PARTITION BY user_id ORDER BY round(avg(n), 1) DESC, target_item) AS r FROM t GROUP BY user_id, target_item)
    SELECT t.user_id, round(avg(n), 1) AS avg_retries_per_stroke, round(CAST(count_if(n > 3) AS DOUBLE) / count(*), 4) AS failsafe_unlock_rate, count(*) AS total_strokes, max(x.items) AS high_retry_items
    FROM t JOIN (SELECT user_id, {d.listagg("target_item", ",", "r")} AS items FROM i WHERE r <= 5 GROUP BY user_id) x ON t.user_id = x.user_id GROUP BY t.user_id"""


@operator("sessions", last=20)
def replay_usage(d: Spark, sessions: str, last: int) -> str:
    """The share of strokes tried more than twice, and the three items where that comes most."""
    return f"""
    WITH t AS ({_tries(d, sessions, last)}),
    i AS (SELECT user_id, target_item, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, target_item) AS r FROM t WHERE n > 2 GROUP BY user_id, target_item),
    u AS (SELECT user_id, round(CAST(count_if(n > 2) AS DOUBLE) / count(*), 4) AS replay_rate FROM t GROUP BY user_id)
    SELECT u.user_id, replay_rate, replay_rate > 0.15 AS replay_beneficial, coalesce(items, '') AS most_replayed
    FROM u LEFT JOIN (SELECT user_id, {d.listagg("target_item", ",", "r")} AS items FROM i WHERE r <= 3 GROUP BY user_id) x ON u.user_id = x.user_id"""


#: Items of curved and of diagonal strokes.
CURVES, DIAGONALS = "SGCOQBD", "XWVYZK"


@operator("sessions", last=20)
def direction_struggles(d: Spark, sessions: str, last: int) -> str:
    """Stroke directions that the items of most tries share."""
    member = lambda s: ", ".join(f"'{c}'" for c in s)
    return f"""
    WITH i AS (SELECT user_id, target_item, row_number() OVER (PARTITION BY user_id ORDER BY round(avg(n), 1) DESC, target_item) AS r FROM ({_tries(d, sessions, last)}) GROUP BY user_id, target_item)
    SELECT user_id, concat_ws(',', CASE WHEN count_if(target_item IN ({member(CURVES)})) > 0 THEN 'curve-left,curve-right' END, CASE WHEN count_if(target_item IN ({member(DIAGONALS)})) > 0 THEN 'down-right,down-left' END) AS struggles
    FROM i WHERE r <= 5 GROUP BY user_id"""


#: Experience points of a session, by module.
XP = {"signup": 10, "click": 5, "view": 8, "purchase": 15}
DAILY_XP, LEVEL_XP = 250, 100


def xp_of(module: str, acc: str) -> str:
    """Points of a session by its module and accuracy, before any cap."""
    base = f"CASE {module} " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in XP.items()) + " ELSE 5 END"
    return f"CASE WHEN {acc} >= 9000 THEN 2 * ({base}) WHEN {acc} >= 7000 THEN {base} WHEN {acc} >= 5000 THEN greatest(1, CAST(floor(({base}) / 2.0) AS INT)) ELSE 1 END"


@operator("sessions")
def daily_xp_capped(d: Spark, sessions: str) -> str:
    """Points of each day under the daily cap, with what is left of it."""
    return f"""
    SELECT user_id, day, raw_xp, least({DAILY_XP}, raw_xp) AS xp_earned, greatest(0, {DAILY_XP} - raw_xp) AS daily_xp_remaining
    FROM (SELECT user_id, day, CAST(sum({xp_of('module_type', 'acc')}) AS BIGINT) AS raw_xp FROM {sessions} WHERE completed GROUP BY user_id, day)"""


@operator("sessions")
def session_awards(d: Spark, sessions: str) -> str:
    """What each completed session earns after those before it that day."""
    return f"""
    SELECT id, user_id, CAST(raw AS BIGINT) AS raw_xp, CAST(greatest(0, least(raw, {DAILY_XP} - before)) AS BIGINT) AS xp_earned
    FROM (SELECT id, user_id, raw, coalesce(CAST(sum(raw) OVER (PARTITION BY user_id, day ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
          FROM (SELECT *, {xp_of('module_type', 'acc')} AS raw FROM {sessions} WHERE completed))"""


@operator("sessions")
def level_from_xp(d: Spark, sessions: str) -> str:
    return f"""
    SELECT user_id, total_xp, 1 + CAST(floor(total_xp / {LEVEL_XP}.0) AS BIGINT) AS level, {LEVEL_XP} - total_xp % {LEVEL_XP} AS xp_to_next
    FROM (SELECT user_id, CAST(sum(xp) AS BIGINT) AS total_xp FROM (SELECT user_id, day, least({DAILY_XP}, sum({xp_of('module_type', 'acc')})) AS xp FROM {sessions} WHERE completed GROUP BY user_id, day) GROUP BY user_id)"""


def features(d: Spark, s: str) -> str:
    """One row per learner with every signal that the rules below read.

    Most of them come from one aggregate by learner and day and another over its result, which the
    streaks share; only the last five sessions, the retries of items and the gains of second attempts
    take a pass of their own.
    """
    weeks = range(4)
    in_week = lambda i: f"completed AND age_seconds > {i * WEEK} AND age_seconds <= {(i + 1) * WEEK}"
    sums = {f"w{i}": f"sum(CASE WHEN {in_week(i)} THEN acc ELSE 0 END)" for i in weeks} | {f"n{i}": f"sum(CASE WHEN {in_week(i)} THEN 1 ELSE 0 END)" for i in weeks}
    sums |= {
        "n_4w": f"sum(CASE WHEN completed AND age_seconds <= {4 * WEEK} THEN 1 ELSE 0 END)",
        "n_30": f"sum(CASE WHEN age_seconds <= {30 * 86400} THEN 1 ELSE 0 END)",
        "gone_30": f"sum(CASE WHEN age_seconds <= {30 * 86400} AND status = 'abandoned' THEN 1 ELSE 0 END)",
        "pauses": "sum(CASE WHEN completed THEN greatest(pause_1, 0) + greatest(pause_2, 0) ELSE 0 END)",
        "n_pauses": "sum(CASE WHEN completed THEN CASE WHEN pause_1 > 0 THEN 1 ELSE 0 END + CASE WHEN pause_2 > 0 THEN 1 ELSE 0 END ELSE 0 END)",
        "n_firsts": "sum(CASE WHEN completed AND first_ms > 0 THEN 1 ELSE 0 END)",
        "tries": "sum(CASE WHEN completed THEN tries_1 + tries_2 ELSE 0 END)",
        "n_tries": "sum(CASE WHEN completed THEN 2 ELSE 0 END)",
        "over_3": "sum(CASE WHEN completed THEN CASE WHEN tries_1 > 3 THEN 1 ELSE 0 END + CASE WHEN tries_2 > 3 THEN 1 ELSE 0 END ELSE 0 END)",
        "over_2": "sum(CASE WHEN completed THEN CASE WHEN tries_1 > 2 THEN 1 ELSE 0 END + CASE WHEN tries_2 > 2 THEN 1 ELSE 0 END ELSE 0 END)",
        "done": "sum(CASE WHEN completed THEN 1 ELSE 0 END)",
    }
    by_day = ", ".join(f"{x} AS {n}" for n, x in sums.items())
    totals = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in sums)
    share = lambda a, b: f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 4)"
    week = lambda i: f"coalesce(CAST(floor((2 * CAST(w{i} AS DOUBLE) + n{i}) / nullif(CAST(2 * n{i} AS DOUBLE), 0)) AS DOUBLE) / 10000, 0)"
    names = [f"week_{i}" for i in (1, 2, 3, 4)]
    first, last = (f"coalesce({', '.join(f'nullif({n}, 0)' for n in order)})" for order in (names, names[::-1]))
    busy = " + ".join(f"CASE WHEN {n} > 0 THEN 1 ELSE 0 END" for n in names)
    return f"""
    WITH days AS (SELECT user_id, day, {by_day}, max(CASE WHEN age_seconds <= {14 * 86400} THEN 1 ELSE 0 END) AS recent, max(day + CAST(floor(age_seconds / 86400) AS BIGINT)) AS today,
                         CAST(sum(CASE WHEN completed THEN {xp_of('module_type', 'acc')} ELSE 0 END) AS BIGINT) AS xp FROM {s} GROUP BY user_id, day),
    users AS (SELECT user_id, {totals}, count(CASE WHEN recent = 1 THEN 1 END) AS active_days, CAST(sum(least({DAILY_XP}, xp)) AS BIGINT) AS total_xp FROM days GROUP BY user_id),
    runs AS (SELECT user_id, max(day) AS last_day, count(*) AS n FROM (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM days WHERE done > 0) GROUP BY user_id, island),
    streak AS (SELECT user_id, max(last_day) AS last_day, max_by(n, last_day) AS streak, max(n) AS longest FROM runs GROUP BY user_id),
    items AS (SELECT user_id, {d.listagg("target_item", ",", "r")} AS items FROM (SELECT user_id, target_item, row_number() OVER (PARTITION BY user_id ORDER BY round(avg(n), 1) DESC, target_item) AS r FROM ({_tries(d, s, 20)}) GROUP BY user_id, target_item) WHERE r <= 5 GROUP BY user_id)
    SELECT f.*, CASE WHEN {busy} < 2 THEN 'stable' WHEN {last} - {first} > 0.05 THEN 'improving' WHEN {last} - {first} < -0.05 THEN 'declining' ELSE 'stable' END AS trend
    FROM (SELECT u.user_id, {', '.join(f'{week(3 - i)} AS week_{i + 1}' for i in weeks)}, CASE WHEN u.n_4w / 4.0 >= 3 THEN 'fast' WHEN u.n_4w / 4.0 < 1 THEN 'slow' ELSE 'steady' END AS velocity,
                 coalesce(r.rolling_average, 0) AS rolling_accuracy, coalesce(r.promotion_readiness, 0) AS promotion_readiness, round(u.active_days / CAST(14 AS DOUBLE), 4) AS consistency_score, u.active_days,
                 coalesce({share('u.gone_30', 'u.n_30')}, 0) AS abandon_rate, coalesce(k.streak, 0) AS streak, coalesce(k.longest, 0) AS longest_streak,
                 CASE (SELECT max(today) FROM days) - k.last_day WHEN 0 THEN 'active' WHEN 1 THEN 'at_risk' ELSE 'broken' END AS streak_status,
                 coalesce(round(CAST(u.pauses AS DOUBLE) / nullif(u.n_pauses, 0), 1), 0) AS pause, coalesce(round(CAST(u.tries AS DOUBLE) / nullif(u.n_tries, 0), 1), 0) AS retries,
                 coalesce({share('u.over_3', 'u.n_tries')}, 0) AS failsafe, coalesce({share('u.over_2', 'u.n_tries')}, 0) AS replay_rate, u.n_tries > 0 OR u.n_pauses + u.n_firsts > 0 AS has_telemetry,
                 coalesce(g.recovers_quickly, false) AS recovers_quickly, u.total_xp, 1 + CAST(floor(u.total_xp / {LEVEL_XP}.0) AS BIGINT) AS level, coalesce(i.items, '') AS high_retry_items
          FROM users u LEFT JOIN streak k ON u.user_id = k.user_id LEFT JOIN items i ON u.user_id = i.user_id
          LEFT JOIN ({rolling_accuracy_last_n.sql(d, sessions=s)}) r ON u.user_id = r.user_id LEFT JOIN ({retry_recovery.sql(d, sessions=s)}) g ON u.user_id = g.user_id) f"""


def judged(d: Spark, s: str) -> str:
    """The features with frustration, confidence and engagement."""
    return f"""
    SELECT *, CASE WHEN frustration = 'high' THEN 'low' WHEN NOT has_telemetry THEN 'unknown' WHEN pause < 1000 AND retries < 1.2 AND failsafe < 0.05 THEN 'high'
                   WHEN pause > 3000 OR retries > 2.5 OR failsafe > 0.2 THEN 'low' ELSE 'medium' END AS confidence
    FROM (SELECT *, CASE WHEN NOT has_telemetry THEN 'low' WHEN retries > 2.5 AND pause > 2500 AND replay_rate > 0.3 THEN 'high' WHEN retries < 1.5 AND pause < 1200 THEN 'low' ELSE 'medium' END AS frustration,
                 CASE WHEN consistency_score >= 0.7 AND abandon_rate < 0.15 AND streak >= 3 THEN 'high' WHEN consistency_score < 0.35 OR abandon_rate > 0.4 THEN 'low' ELSE 'medium' END AS engagement
          FROM ({features(d, s)}))"""


@operator("sessions")
def engagement_confidence(d: Spark, sessions: str) -> str:
    return f"SELECT user_id, frustration, confidence, engagement FROM ({judged(d, sessions)})"


@operator("sessions")
def dashboard_summary(d: Spark, sessions: str) -> str:
    """Everything that a learner's dashboard shows, for all learners in one plan."""
    return f"""
    SELECT user_id, streak, longest_streak, streak_status, consistency_score, active_days, abandon_rate, engagement, trend, velocity, rolling_accuracy, promotion_readiness, confidence, frustration, recovers_quickly, total_xp, level
    FROM ({judged(d, sessions)})"""


#: Findings in order as code, severity, message and test. What stands in braces is filled in.
INSIGHTS = (
    ("strong_letters", "positive", "Excellent accuracy on letters {best}", "best <> ''"),
    ("fast_recovery", "positive", "Improves by ~{gain}% on second attempt — fast learner", "recovers_quickly AND gain > 5"),
    ("consistent_practice", "positive", "Practices consistently ({share}% of days active)", "consistency_score >= 0.7"),
    ("good_consistency", "positive", "Good practice rhythm — keep it up", "consistency_score >= 0.5 AND consistency_score < 0.7"),
    ("replay_beneficial", "positive", "Guided replay assistance is working well", "replay_rate > 0.15 AND recovers_quickly"),
    ("weak_letters", "high", "Needs more practice on letters {worst}", "n_worst >= 3"),
    ("weak_letters", "medium", "Needs more practice on letters {worst}", "n_worst BETWEEN 1 AND 2"),
    ("curved_strokes", "medium", "Curved strokes need more attention (letters like S, G, C)", "struggles LIKE '%curve%'"),
    ("diagonal_strokes", "medium", "Diagonal strokes need practice (letters like X, W, V)", "struggles LIKE '%down-%'"),
    ("high_retry_rate", "medium", "Frequently retries {retried} — extra practice recommended", "retried <> '' AND retries > 1.8"),
    ("declining_accuracy", "high", "Accuracy has been declining recently — review recent sessions", "trend = 'declining'"),
    ("hesitation_curves", "medium", "Shows hesitation before strokes in {slow}", "pause > 2500 AND slow <> ''"),
    ("general_hesitation", "low", "Takes time to plan strokes — deliberate approach", "pause > 1500 AND NOT (pause > 2500 AND slow <> '')"),
    ("frustration_risk", "high", "Needs encouragement during complex letters — showing frustration signals", "frustration = 'high'"),
    ("mild_frustration", "low", "Occasional difficulty — benefits from short breaks between sessions", "frustration = 'medium'"),
    ("high_replay_dependence", "low", "Frequently uses guided replay — this is working, but encourage independent practice", "replay_rate > 0.3"),
    ("replay_positive", "positive", "Confidence improves with guided replay assistance", "replay_rate > 0.15 AND replay_rate <= 0.3"),
    ("weekday_pattern", "low", "Practices mainly on weekdays — weekend sessions would boost progress", "pattern = 'weekday_only'"),
    ("weekend_pattern", "low", "Weekend-heavy practice — daily short sessions are more effective", "pattern = 'weekend_heavy'"),
    ("irregular_practice", "medium", "Irregular practice schedule — consistent daily practice accelerates learning", "pattern = 'irregular' AND consistency_score < 0.35"),
    ("low_engagement", "medium", "Engagement has dropped — try shorter, more frequent sessions", "engagement = 'low'"),
)


def signals(d: Spark, s: str) -> str:
    """What is judged of a learner, with the letters that findings name."""
    three = lambda x: d.joined(f"slice({x}, 1, 3)" if d.name == "spark" else f"{x}[1:3]", ", ")
    letters = lambda kind, order: f"SELECT user_id, count(*) AS n, {d.listagg('target_item', ', ', order)} AS letters FROM ({best_worst_items.sql(d, sessions=s)}) WHERE kind = '{kind}' GROUP BY user_id"
    return f"""
    SELECT j.*, coalesce(b.letters, '') AS best, coalesce(w.letters, '') AS worst, coalesce(w.n, 0) AS n_worst, coalesce(CAST(round(100 * g.avg_improvement) AS BIGINT), 0) AS gain, CAST(round(100 * j.consistency_score) AS BIGINT) AS share,
           coalesce(x.struggles, '') AS struggles, {three(d.cut('j.high_retry_items', "','"))} AS retried, {three(d.cut("coalesce(h.high_hesitation_items, '')", "','"))} AS slow, p.pattern
    FROM ({judged(d, s)}) j LEFT JOIN ({letters('best', 'avg_acc DESC, target_item')}) b ON b.user_id = j.user_id LEFT JOIN ({letters('worst', 'avg_acc, target_item DESC')}) w ON w.user_id = j.user_id
    LEFT JOIN ({retry_recovery.sql(d, sessions=s)}) g ON g.user_id = j.user_id LEFT JOIN ({direction_struggles.sql(d, sessions=s)}) x ON x.user_id = j.user_id
    LEFT JOIN ({hesitation_profile.sql(d, sessions=s)}) h ON h.user_id = j.user_id LEFT JOIN ({practice_consistency.sql(d, sessions=s)}) p ON p.user_id = j.user_id"""


@operator("sessions")
def learning_insights(d: Spark, sessions: str) -> str:
    """A row for each finding on a learner: its place, code, severity and message."""
    def message(text: str) -> str:
        parts = [f"'{x}'" if i % 2 == 0 else d.text(x) for i, x in enumerate(text.replace("}", "{").split("{")) if x]
        return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]

    rows = ", ".join(f"({i}, '{code}', '{severity}')" for i, (code, severity, _, _) in enumerate(INSIGHTS))
    texts = " ".join(f"WHEN {i} THEN CASE WHEN {test} THEN {message(text)} END" for i, (_, _, text, test) in enumerate(INSIGHTS))
    return f"""
    SELECT user_id, place, code, severity, message FROM (SELECT s.user_id, v.place, v.code, v.severity, CASE v.place {texts} END AS message
      FROM ({signals(d, sessions)}) s CROSS JOIN (SELECT * FROM (VALUES {rows}) v(place, code, severity)) v) WHERE message IS NOT NULL"""


@operator("sessions")
def recommended_focus(d: Spark, sessions: str) -> str:
    """One directive for each learner."""
    return f"""
    SELECT user_id, CASE WHEN trend = 'declining' OR rolling_accuracy < 0.45 THEN 'review_basics' WHEN promotion_readiness >= 0.85 THEN 'ready_to_advance' WHEN rolling_accuracy < 0.6 OR frustration = 'high' THEN 'needs_more_practice' ELSE 'maintain_consistency' END AS focus
    FROM ({judged(d, sessions)})"""


@operator("sessions")
def module_reports(d: Spark, sessions: str) -> str:
    """Sessions, completions, accuracy and last day of each learner's modules."""
    return f"SELECT user_id, module_type, count(*) AS total_sessions, count_if(completed) AS completed, {mean('acc', 'completed')} AS avg_accuracy, max(day) AS last_day, min(acc) AS min_acc, max(acc) AS max_acc FROM {sessions} GROUP BY user_id, module_type"


@operator("sessions")
def profile_types(d: Spark, sessions: str) -> str:
    """Age in whole years with the birthday test, and the profile that it gives unless a valid one is preferred."""
    return f"""
    SELECT user_id, age, mode AS preferred, CASE WHEN mode IN ('early_learner', 'child', 'adult') THEN mode WHEN age IS NULL THEN 'adult' WHEN age <= 5 THEN 'early_learner' WHEN age <= 15 THEN 'child' ELSE 'adult' END AS profile_type
    FROM (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 2024 - y - CASE WHEN 131 < m * 100 + dd THEN 1 ELSE 0 END END AS age, CASE WHEN user_id % 5 = 0 THEN 'child' WHEN user_id % 11 = 0 THEN 'other' END AS mode
          FROM (SELECT DISTINCT user_id, CAST(1990 + user_id % 34 AS INT) AS y, CAST(1 + user_id % 12 AS INT) AS m, CAST(1 + user_id % 28 AS INT) AS dd FROM {sessions}))"""
