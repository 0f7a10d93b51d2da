"""Mastery, reviews, curriculum and recommendations."""

from __future__ import annotations

from quillspark.operators.base import Spark, operator
from quillspark.operators.practice import best_worst_items, judged, learning_velocity, retry_pattern, weekly_accuracy_by_user  # noqa: F401

#: What comes before what.
PREREQUISITES = {
    "straight_lines": [],
    "curved_lines": ["straight_lines"],
    "complex_shapes": ["straight_lines", "curved_lines"],
    "angular_caps": ["straight_lines"],
    "curved_caps": ["curved_lines"],
    "mixed_caps": ["angular_caps", "curved_caps"],
    "cvc_basics": ["angular_caps", "curved_caps"],
    "complex_words": ["cvc_basics", "mixed_caps"],
    "word_CAT": ["cvc_basics"],
    "word_APPLE": ["complex_words"],
}


def nodes() -> str:
    rows = ", ".join(f"('{n}', {i})" for i, n in enumerate(PREREQUISITES))
    return f"(SELECT * FROM (VALUES {rows}) n(node, ord))"


def edges() -> str:
    rows = ", ".join(f"('{n}', '{p}')" for n, before in PREREQUISITES.items() for p in before)
    return f"(SELECT * FROM (VALUES {rows}) e(node, parent))"


def mastery(d: Spark, s: str) -> str:
    """Motor, cognitive, retention and confidence of each learner's items, decayed by days since they were last seen."""
    decay = lambda x: f"greatest(0.0, {x} - CASE WHEN days <= 1 THEN 0.0 ELSE least(0.3, (days - 1) * 0.05) END)"
    return f"""
    SELECT user_id, target_item, sessions, days, low_of_3, round({decay('m')}, 6) AS motor, round({decay('m')}, 6) AS cognitive, round({decay('m * 0.8')}, 6) AS retention, round(c, 6) AS confidence,
           round({decay('m')} * 0.7 + {decay('m * 0.8')} * 0.2 + c * 0.1, 6) AS overall
    FROM (SELECT user_id, target_item, sessions, days, low_of_3, m3 AS m, CASE WHEN n5 > 1 THEN greatest(0.0, m5 - 2 * greatest(0.0, q5 - m5 * m5)) ELSE m5 END AS c
          FROM (SELECT user_id, target_item, count(*) AS sessions, CAST(floor(min(age_seconds) / 86400.0) AS BIGINT) AS days, min(CASE WHEN r <= 3 THEN acc END) AS low_of_3,
                       CAST(sum(CASE WHEN r <= 3 THEN acc END) AS DOUBLE) / count(CASE WHEN r <= 3 THEN 1 END) / 10000 AS m3, count(CASE WHEN r <= 5 THEN 1 END) AS n5,
                       CAST(sum(CASE WHEN r <= 5 THEN acc END) AS DOUBLE) / count(CASE WHEN r <= 5 THEN 1 END) / 10000 AS m5,
                       CAST(sum(CASE WHEN r <= 5 THEN acc * acc END) AS DOUBLE) / count(CASE WHEN r <= 5 THEN 1 END) / 100000000 AS q5
                FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target_item ORDER BY ts DESC, id DESC) AS r FROM {s} WHERE completed) GROUP BY user_id, target_item))"""


@operator("sessions")
def item_mastery(d: Spark, sessions: str) -> str:
    return f"SELECT user_id, target_item, sessions, days, motor, retention, confidence, overall FROM ({mastery(d, sessions)})"


@operator("sessions")
def mastered_items(d: Spark, sessions: str) -> str:
    """Items of overall mastery 0.75 and confidence 0.65 or more."""
    return f"SELECT user_id, target_item FROM ({mastery(d, sessions)}) WHERE overall >= 0.75 AND confidence >= 0.65"


@operator("sessions")
def confidence_gate(d: Spark, sessions: str) -> str:
    """Mastered items with three sessions, the last three of them at 0.6 or more."""
    return f"SELECT user_id, target_item, overall >= 0.75 AND confidence >= 0.65 AND sessions >= 3 AND low_of_3 >= 6000 AS passes FROM ({mastery(d, sessions)})"


@operator("sessions")
def due_reviews(d: Spark, sessions: str) -> str:
    """Items due for review: after 1, 3, 2 or 7 days by mastery and the learner's frustration."""
    return f"""
    SELECT m.user_id, m.target_item, m.days FROM ({mastery(d, sessions)}) m JOIN ({judged(d, sessions)}) j ON m.user_id = j.user_id
    WHERE CASE WHEN m.confidence < 0.5 OR m.overall < 0.6 THEN m.days >= 1 WHEN m.overall < 0.8 THEN m.days >= 3 WHEN j.frustration = 'high' AND m.days >= 2 THEN true ELSE m.days >= 7 END"""


@operator("sessions", days=30, tries=5, confidence=0.6)
def plateaus(d: Spark, sessions: str, days: int, tries: int, confidence: float) -> str:
    """Items tried often of late, with confidence, that stay under an overall mastery of 0.6."""
    return f"""
    SELECT m.user_id, m.target_item, r.n AS recent_attempts FROM ({mastery(d, sessions)}) m
    JOIN (SELECT user_id, target_item, count(*) AS n FROM {sessions} WHERE age_seconds <= {days * 86400} GROUP BY user_id, target_item) r ON m.user_id = r.user_id AND m.target_item = r.target_item
    WHERE r.n >= {tries} AND m.confidence > {confidence} AND m.overall < 0.6"""


def state(d: Spark, s: str) -> str:
    return f"""
    SELECT user_id, global_confidence, global_retention, trend, round(least(1.0, today * 0.1 + CASE WHEN trend = 'high' THEN 0.3 ELSE 0.0 END), 3) AS fatigue FROM (
      SELECT m.user_id, m.global_confidence, m.global_retention, t.today, CASE WHEN t.hard > t.n * 0.3 THEN 'high' WHEN t.hard > t.n * 0.15 THEN 'medium' ELSE 'low' END AS trend
      FROM (SELECT user_id, round(avg(confidence), 3) AS global_confidence, round(avg(retention), 3) AS global_retention FROM ({mastery(d, s)}) GROUP BY user_id) m
      JOIN (SELECT user_id, count(*) AS n, count_if(pause_1 > 3000 OR tries_1 > 3) AS hard, count_if(age_seconds <= 86400) AS today FROM {s} GROUP BY user_id) t ON m.user_id = t.user_id)"""


@operator("sessions")
def educational_state(d: Spark, sessions: str) -> str:
    """A learner's confidence and retention over all items, frustration and fatigue (sessions of the last day)."""
    return f"SELECT user_id, global_confidence, global_retention, trend AS frustration_trend, fatigue AS estimated_fatigue FROM ({state(d, sessions)})"


@operator("sessions")
def learning_journey(d: Spark, sessions: str) -> str:
    """The mode that a learner's state calls for, with how much there is to review."""
    return f"""
    SELECT s.user_id, CASE WHEN s.fatigue > 0.8 THEN 'light_review' WHEN coalesce(p.n, 0) > 0 THEN 'plateau_breakthrough' WHEN s.trend = 'high' THEN 'confidence_rebuild' ELSE 'standard_progression' END AS focus_mode,
           coalesce(r.n, 0) AS due_items, coalesce(p.n, 0) AS plateau_items
    FROM ({state(d, sessions)}) s
    LEFT JOIN (SELECT user_id, count(*) AS n FROM ({due_reviews.sql(d, sessions=sessions)}) GROUP BY user_id) r ON s.user_id = r.user_id
    LEFT JOIN (SELECT user_id, count(*) AS n FROM ({plateaus.sql(d, sessions=sessions)}) GROUP BY user_id) p ON s.user_id = p.user_id"""


@operator("region")
def curriculum_ancestors(d: Spark, region: str) -> str:
    """Every node with all that comes before it: the closure of the edges, each pair once."""
    return f"""
    WITH RECURSIVE up(node, ancestor, depth) AS (
      SELECT node, parent, 1 FROM {edges()} UNION ALL SELECT up.node, e.parent, up.depth + 1 FROM up JOIN {edges()} e ON up.ancestor = e.node WHERE up.depth < 20)
    SELECT node, ancestor, CAST(min(depth) AS INT) AS nearest, CAST(max(depth) AS INT) AS farthest FROM up GROUP BY node, ancestor"""


def _skills(s: str) -> str:
    """Learners' mastered nodes: a node goes with the letters of its place in the curriculum."""
    return f"""(SELECT u.user_id, n.node FROM (SELECT user_id, target_item, CAST(sum(acc) AS DOUBLE) / count(*) AS m FROM {s} WHERE completed GROUP BY user_id, target_item) u
                JOIN {nodes()} n ON ascii(u.target_item) - 65 = n.ord WHERE u.m >= 3500)"""


@operator("sessions")
def unlockable_nodes(d: Spark, sessions: str) -> str:
    """Nodes not mastered all of whose prerequisites are: relational division, for every learner."""
    skills = _skills(sessions)
    return f"""
    SELECT u.user_id, n.node FROM (SELECT DISTINCT user_id FROM {sessions}) u CROSS JOIN {nodes()} n
    LEFT JOIN {skills} have ON have.user_id = u.user_id AND have.node = n.node
    LEFT JOIN {edges()} e ON e.node = n.node
    LEFT JOIN {skills} pre ON pre.user_id = u.user_id AND pre.node = e.parent
    WHERE have.node IS NULL GROUP BY u.user_id, n.node HAVING count(e.parent) = count(pre.node)"""


@operator("sessions")
def unmastered_nodes(d: Spark, sessions: str) -> str:
    """The nodes that a learner hasn't mastered: an anti join."""
    return f"""
    SELECT a.user_id, a.node FROM (SELECT u.user_id, n.node FROM (SELECT DISTINCT user_id FROM {sessions}) u CROSS JOIN {nodes()} n) a
    ANTI JOIN {_skills(sessions)} k ON a.user_id = k.user_id AND a.node = k.node"""


@operator("sessions", module="click")
def next_item_least_practised(d: Spark, sessions: str, module: str) -> str:
    """The catalogue's least practised item for each learner, the first on ties."""
    return f"""
    SELECT user_id, item, n AS times FROM (
      SELECT u.user_id, c.item, coalesce(p.n, 0) AS n, row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(p.n, 0), c.item) AS r
      FROM (SELECT DISTINCT user_id FROM {sessions}) u CROSS JOIN (SELECT DISTINCT target_item AS item FROM {sessions}) c
      LEFT JOIN (SELECT user_id, target_item, count(*) AS n FROM {sessions} WHERE module_type = '{module}' AND completed GROUP BY user_id, target_item) p ON p.user_id = u.user_id AND p.target_item = c.item) WHERE r = 1"""


def snapshot(d: Spark, s: str) -> str:
    """Features between 0 and 1."""
    clamp = lambda x: f"greatest(0.0, least(1.0, round({x}, 4)))"
    return f"""
    SELECT user_id, {clamp('retries / 5.0')} AS retry_rate, {clamp('pause / 5000.0')} AS hesitation_norm, pause AS avg_hesitation_ms, {clamp('replay_rate')} AS replay_rate, {clamp('failsafe')} AS failsafe_rate, {clamp('consistency_score')} AS consistency_score,
           streak, {clamp('rolling_accuracy')} AS rolling_accuracy, CASE velocity WHEN 'fast' THEN 1.0 WHEN 'steady' THEN 0.5 ELSE 0.0 END AS velocity_score,
           CASE frustration WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.0 END AS frustration_score, CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.0 ELSE 0.25 END AS confidence_score,
           CASE trend WHEN 'improving' THEN 1.0 WHEN 'declining' THEN 0.0 ELSE 0.5 END AS trend_score, has_telemetry, promotion_readiness, frustration, trend, high_retry_items
    FROM ({judged(d, s)})"""


_COMPLETE = "CASE WHEN NOT has_telemetry THEN 0.3 ELSE least(1.0, 0.3 + CASE WHEN retry_rate > 0 THEN 0.2 ELSE 0 END + CASE WHEN avg_hesitation_ms > 0 THEN 0.2 ELSE 0 END + CASE WHEN replay_rate > 0 THEN 0.15 ELSE 0 END + CASE WHEN streak > 0 THEN 0.15 ELSE 0 END) END"


@operator("sessions")
def feature_snapshot(d: Spark, sessions: str) -> str:
    names = "retry_rate, hesitation_norm, replay_rate, failsafe_rate, consistency_score, rolling_accuracy, velocity_score, frustration_score, confidence_score, trend_score"
    cast = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names.split(", "))
    return f"SELECT user_id, {cast}, streak, has_telemetry, CAST(round({_COMPLETE}, 4) AS DOUBLE) AS completeness FROM ({snapshot(d, sessions)})"


#: Features, and the weights that each style gives them.
FEATURES = ["retry_rate", "hesitation_norm", "replay_rate", "velocity_score", "frustration_score", "consistency_score", "confidence_score", "trend_score"]
STYLES = {
    "visual": [-0.1, 0.2, 0.5, 0.1, -0.1, 0.1, 0.2, 0.2],
    "methodical": [-0.3, -0.1, -0.2, -0.2, -0.3, 0.4, 0.4, 0.3],
    "impulsive": [0.4, -0.3, -0.1, 0.4, 0.2, -0.1, -0.1, -0.1],
    "replay_dependent": [0.2, 0.2, 0.4, -0.1, 0.3, -0.2, -0.3, -0.1],
}


def styles(d: Spark, s: str) -> str:
    dots = ", ".join(f"exp({' + '.join(f'CAST({w} AS DOUBLE) * {f}' for w, f in zip(weights, FEATURES, strict=True))}) AS e_{name}" for name, weights in STYLES.items())
    total = " + ".join(f"e_{n}" for n in STYLES)
    probs = ", ".join(f"round(e_{n} / ({total}), 4) AS p_{n}" for n in STYLES)
    top = f"greatest({', '.join(f'p_{n}' for n in STYLES)})"
    pick = "CASE " + " ".join(f"WHEN p_{n} = top THEN '{n}'" for n in STYLES) + " END"
    second = " ".join(f"WHEN p_{n} = top THEN greatest({', '.join(f'p_{m}' for m in STYLES if m != n)})" for n in STYLES)
    return f"""
    SELECT *, {pick} AS ml_style, round(least(0.95, greatest(0.2, complete * (0.5 + (top - CASE {second} END) * 0.5))), 8) AS ml_confidence,
           CASE WHEN replay_rate > 0.35 AND frustration_score > 0.4 THEN 'replay_dependent' WHEN replay_rate > 0.25 AND confidence_score > 0.5 THEN 'visual' WHEN retry_rate > 0.4 AND velocity_score > 0.7 THEN 'impulsive'
                WHEN hesitation_norm < 0.25 AND consistency_score > 0.55 AND frustration_score < 0.4 THEN 'methodical' WHEN replay_rate > 0.15 THEN 'visual' WHEN retry_rate > 0.3 THEN 'impulsive' ELSE 'methodical' END AS rule_style
    FROM (SELECT *, {top} AS top FROM (SELECT *, {probs} FROM (SELECT *, {dots}, CAST({_COMPLETE} AS DOUBLE) AS complete FROM ({snapshot(d, s)}))))"""


@operator("sessions")
def style_softmax(d: Spark, sessions: str) -> str:
    """Probabilities of the learning styles."""
    return f"SELECT user_id, {', '.join(f'p_{n}' for n in STYLES)}, ml_style FROM ({styles(d, sessions)})"


@operator("sessions")
def style_shadow(d: Spark, sessions: str) -> str:
    """The rule's style beside the model's, which counts if it is confident enough."""
    return f"SELECT user_id, rule_style, ml_style, CAST(ml_confidence AS DOUBLE) AS ml_confidence, rule_style = ml_style AS agreement, CASE WHEN ml_confidence >= 0.55 THEN ml_style ELSE rule_style END AS style FROM ({styles(d, sessions)})"


@operator("sessions")
def difficulty_shadow(d: Spark, sessions: str) -> str:
    """A linear score for the next difficulty beside the rule."""
    return f"""
    SELECT user_id, round(score, 4) AS ml_score, direction AS ml_direction, rule AS rule_direction, direction = rule AS agreement,
           round(greatest(0.25, least(0.95, complete * CASE direction WHEN 'promote' THEN (score - 0.72) / 0.28 WHEN 'demote' THEN (0.35 - score) / 0.35 ELSE 1.0 - abs(score - 0.535) * 2.0 END)), 4) AS ml_confidence
    FROM (SELECT *, CASE WHEN score > 0.72 THEN 'promote' WHEN score < 0.35 THEN 'demote' ELSE 'maintain' END AS direction, CASE WHEN rolling_accuracy >= 0.85 AND trend <> 'declining' THEN 'promote' WHEN rolling_accuracy <= 0.5 OR trend = 'declining' THEN 'demote' ELSE 'maintain' END AS rule
          FROM (SELECT *, CAST({_COMPLETE} AS DOUBLE) AS complete, CAST(rolling_accuracy AS DOUBLE) * CAST(0.4 AS DOUBLE) + CAST(trend_score AS DOUBLE) * CAST(0.25 AS DOUBLE) + CAST(velocity_score AS DOUBLE) * CAST(0.15 AS DOUBLE) + CAST(confidence_score AS DOUBLE) * CAST(0.1 AS DOUBLE) + CAST(consistency_score AS DOUBLE) * CAST(0.1 AS DOUBLE) AS score FROM ({snapshot(d, sessions)})))"""


#: Items of curved and diagonal strokes, for priorities.
CURVED, SLANTED = "SGCOQBDJU", "XWVYZKNM"


@operator("sessions", most=4)
def recommend_items(d: Spark, sessions: str, most: int) -> str:
    """The union of worst and most retried items, scored; the best four, and one strength to reinforce."""
    listed = lambda s: ", ".join(f"'{c}'" for c in s)
    return f"""
    WITH t AS (SELECT user_id, target_item, tries_1 AS n FROM {sessions} WHERE completed UNION ALL SELECT user_id, target_item, tries_2 FROM {sessions} WHERE completed),
    retry AS (SELECT user_id, target_item, row_number() OVER (PARTITION BY user_id ORDER BY round(avg(n), 1) DESC, target_item) AS r FROM t GROUP BY user_id, target_item),
    acc AS (SELECT user_id, target_item, row_number() OVER (PARTITION BY user_id ORDER BY CAST(sum(acc) AS DOUBLE) / count(*), target_item) AS worst, row_number() OVER (PARTITION BY user_id ORDER BY CAST(sum(acc) AS DOUBLE) / count(*) DESC, target_item) AS best
            FROM {sessions} WHERE completed GROUP BY user_id, target_item HAVING count(*) >= 2),
    candidates AS (SELECT user_id, target_item FROM retry WHERE r <= 5 UNION SELECT user_id, target_item FROM acc WHERE worst <= 3),
    struggle AS (SELECT user_id, count_if(target_item IN ({listed(CURVED[:7])})) > 0 AS curve, count_if(target_item IN ({listed(SLANTED[:6])})) > 0 AS slant FROM retry WHERE r <= 5 GROUP BY user_id),
    scored AS (
      SELECT c.user_id, c.target_item, round(least(1.0, (0.4 * CASE WHEN r.r <= 3 THEN 1.0 WHEN r.r <= 5 THEN 0.5 ELSE 0.0 END + 0.3 * CASE WHEN a.worst <= 3 THEN 1.0 ELSE 0.0 END
             + 0.2 * CASE WHEN s.curve AND c.target_item IN ({listed(CURVED)}) THEN 1.0 WHEN s.slant AND c.target_item IN ({listed(SLANTED)}) THEN 0.8 ELSE 0.0 END + CASE WHEN j.frustration = 'high' THEN 0.1 ELSE 0.0 END)
             * CASE j.frustration WHEN 'high' THEN 1.3 WHEN 'medium' THEN 1.0 ELSE 0.85 END), 4) AS score
      FROM candidates c LEFT JOIN retry r ON r.user_id = c.user_id AND r.target_item = c.target_item LEFT JOIN acc a ON a.user_id = c.user_id AND a.target_item = c.target_item
      LEFT JOIN struggle s ON s.user_id = c.user_id LEFT JOIN ({judged(d, sessions)}) j ON j.user_id = c.user_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, target_item) AS r FROM scored)
    SELECT user_id, target_item AS item, CAST(score AS DOUBLE) AS priority_score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS priority FROM ranked WHERE r <= {most}
    UNION ALL SELECT user_id, target_item, CAST(0.1 AS DOUBLE), 'strength' FROM acc WHERE best = 1"""


#: A plan's modes: seconds, description, how many struggling and how many easy items, and whether easy ones lead.
PLANS = {
    "quick_win": (180, "Short focused session", 1, 2, True),
    "confidence_boost": (300, "Mix of easy + challenge", 4, 2, True),
    "standard": (480, "Full practice session", 9, 1, False),
    "deep_focus": (600, "Extended focus on weak areas", 8, 0, False),
}


@operator("sessions")
def session_plan(d: Spark, sessions: str) -> str:
    """A learner's plan: its mode, length and reasons, and its items: those struggled with (of high or medium priority), and
    easy ones (of low priority, then two of the best letters), as many of each and in the order that the mode says."""
    pick = lambda i: "CASE mode " + " ".join(f"WHEN '{m}' THEN {v[i] if not isinstance(v[i], str) else repr(v[i])}" for m, v in PLANS.items()) + " END"
    return f"""
    WITH j AS (SELECT j.user_id, j.frustration, j.engagement, j.trend, j.rolling_accuracy, s.style,
                      CASE WHEN j.frustration = 'high' THEN 'quick_win' WHEN j.rolling_accuracy < 0.5 OR j.trend = 'declining' THEN 'deep_focus' WHEN j.engagement = 'low' THEN 'confidence_boost' WHEN s.style = 'impulsive' THEN 'deep_focus' ELSE 'standard' END AS mode
               FROM ({judged(d, sessions)}) j LEFT JOIN ({style_shadow.sql(d, sessions=sessions)}) s ON s.user_id = j.user_id),
    recommended AS (SELECT user_id, item, priority_score, CASE WHEN priority IN ('high', 'medium') THEN 'struggle' ELSE 'easy' END AS kind FROM ({recommend_items.sql(d, sessions=sessions)}) WHERE priority <> 'strength'),
    best AS (SELECT b.user_id, b.target_item AS item, b.avg_acc FROM ({best_worst_items.sql(d, sessions=sessions)}) b LEFT JOIN recommended r ON r.user_id = b.user_id AND r.item = b.target_item WHERE b.kind = 'best' AND r.item IS NULL),
    lucky AS (SELECT user_id, item, 1000 + row_number() OVER (PARTITION BY user_id ORDER BY avg_acc DESC, item) AS r FROM best),
    listed AS (SELECT user_id, item, kind, row_number() OVER (PARTITION BY user_id, kind ORDER BY r, item) AS n FROM (
      SELECT user_id, item, kind, row_number() OVER (PARTITION BY user_id, kind ORDER BY priority_score DESC, item) AS r FROM recommended UNION ALL SELECT user_id, item, 'easy', r FROM lucky WHERE r <= 1002)),
    chosen AS (SELECT l.user_id, l.item, CASE WHEN l.kind = 'easy' AND {pick(4)} THEN l.n ELSE CASE l.kind WHEN 'struggle' THEN 100 ELSE 200 END + l.n END AS place FROM listed l JOIN j ON j.user_id = l.user_id WHERE l.n <= CASE l.kind WHEN 'easy' THEN {pick(3)} ELSE {pick(2)} END)
    SELECT j.user_id, mode, {pick(0)} AS seconds, coalesce(c.items, '') AS items,
           coalesce(nullif(concat_ws('; ', CASE WHEN frustration = 'high' THEN 'Shorter session to reduce frustration' END, CASE WHEN trend = 'declining' THEN 'Extended focus on weak areas due to declining trend' END,
             CASE style WHEN 'visual' THEN 'Visual learner — replay assistance recommended' WHEN 'impulsive' THEN 'Active learner — slow down between strokes' END, CASE WHEN rolling_accuracy >= 0.85 THEN 'Strong accuracy — consider advancing difficulty' END), ''), {pick(1)}) AS reasoning
    FROM j LEFT JOIN (SELECT user_id, {d.listagg('item', ',', 'place')} AS items FROM chosen GROUP BY user_id) c ON c.user_id = j.user_id"""
