"""Scores, grades, guidance, feedback and lookups with defaults."""

from __future__ import annotations

from quillspark.operators.base import Spark, operator
from quillspark.operators.strokes import metrics
from quillspark.operators.text import FREQUENCY, medicines, near_pairs

#: Expected ranges and weights of handwriting features.
RANGES = {"spacing": (0.5, 0.3), "baseline": (5.0, 0.25), "stroke": (0.2, 0.2), "slant": (10.0, 0.25)}
SPREAD = 25.0


@operator("boxes")
def hybrid_scores(d: Spark, boxes: str) -> str:
    """100 less a multiple of spread over expected range for each feature, weighted by confidence; slant isn't measured and counts 0 spread."""
    spread = {"spacing": "s_x / 1000", "baseline": "s_y / 30", "stroke": "s_h / 20", "slant": "CAST(0 AS DOUBLE)"}
    score = {f: f"greatest(0.0, least(100.0, 100.0 - {SPREAD} * ({x}) / {RANGES[f][0]}))" for f, x in spread.items()}
    total = " + ".join(f"({score[f]}) * {w} * {'c' if f == 'stroke' else '1.0'}" for f, (_, w) in RANGES.items())
    weights = " + ".join(f"{w} * {'c' if f == 'stroke' else '1.0'}" for f, (_, w) in RANGES.items())
    return f"""
    SELECT page, {', '.join(f'round(CAST({x} AS DOUBLE), 3) AS {f}_score' for f, x in score.items())}, round(CAST(({total}) / ({weights}) AS DOUBLE), 3) AS raw_overall, round(CAST(({total}) / ({weights}) * (0.5 + 0.5 * c) AS DOUBLE), 3) AS overall
    FROM (SELECT page, CAST(sum(conf) AS DOUBLE) / count(*) / 100 AS c, stddev_pop(CAST(x1 AS DOUBLE)) AS s_x, stddev_pop(CAST(y1 AS DOUBLE)) AS s_y, stddev_pop(CAST(y2 - y1 AS DOUBLE)) AS s_h FROM {boxes} GROUP BY page)"""


@operator("boxes")
def feature_confidence(d: Spark, boxes: str) -> str:
    """How far a feature can be trusted, by how much there is of it, and its value between its bounds."""
    return f"SELECT page, count(*) AS words, round(least(1.0, count(*) / 6.0), 6) > 0.5 AS trusted, round(CAST(least(1.0, greatest(0.0, (avg(conf) - 20) / 60.0)) AS DOUBLE), 4) AS normalised FROM {boxes} GROUP BY page"


@operator("sessions")
def grades_and_stars(d: Spark, sessions: str) -> str:
    """Two scales of grades, which aren't the same, and stars."""
    return f"""
    SELECT id, CASE WHEN acc >= 9000 THEN 'A' WHEN acc >= 8000 THEN 'B' WHEN acc >= 7000 THEN 'C' WHEN acc >= 6000 THEN 'D' ELSE 'E' END AS grade, CASE WHEN acc >= 8500 THEN 'gold' WHEN acc >= 6500 THEN 'silver' ELSE 'bronze' END AS medal,
           CASE WHEN acc >= 9500 THEN 5 WHEN acc >= 8000 THEN 4 WHEN acc >= 6500 THEN 3 WHEN acc >= 5000 THEN 2 ELSE 1 END AS stars FROM {sessions} WHERE completed"""


@operator("sessions")
def severity_ratio(d: Spark, sessions: str) -> str:
    """How far a session falls short of what its level expects, in three classes."""
    return f"""
    SELECT id, r, CASE WHEN r >= 500 THEN 'high' WHEN r >= 200 THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT id, CAST(floor(greatest(0, goal - acc) * 1000.0 / goal) AS BIGINT) AS r FROM (SELECT id, acc, CASE difficulty WHEN 'beginner' THEN 6000 WHEN 'intermediate' THEN 7500 ELSE 8500 END AS goal FROM {sessions}))"""


#: Messages by tone.
MESSAGES = {
    "early_learner": {"good": "Great job!", "again": "Try again, you've got this!"},
    "child": {"good": "Nice work!", "again": "Try again"},
    "adult": {"good": "Well executed.", "again": "Below threshold, retry."},
}


@operator("sessions")
def toned_feedback(d: Spark, sessions: str) -> str:
    """The message of a session in the tone of its learner's profile: a join with a small dimension, with a default."""
    rows = ", ".join(f"('{p}', '{k}', '{m.replace(chr(39), chr(39) * 2 if d.name == 'duck' else chr(92) + chr(39))}')" for p, by in MESSAGES.items() for k, m in by.items())
    return f"""
    SELECT s.id, s.profile, coalesce(m.message, 'Keep practicing!') AS message
    FROM (SELECT id, CASE user_id % 4 WHEN 0 THEN 'early_learner' WHEN 1 THEN 'child' WHEN 2 THEN 'adult' ELSE 'other' END AS profile, CASE WHEN acc >= 7000 THEN 'good' ELSE 'again' END AS kind FROM {sessions}) s
    LEFT JOIN (SELECT * FROM (VALUES {rows}) v(profile, kind, message)) m ON m.profile = s.profile AND m.kind = s.kind"""


@operator("events")
def json_with_fallback(d: Spark, events: str) -> str:
    """A key of a JSON text, or the key that used to hold it, or a default."""
    get = (lambda k: f"get_json_object(props, '$.{k}')") if d.name == "spark" else (lambda k: f"json_extract_string(props, '$.{k}')")
    return f"SELECT event_id, CAST(coalesce({get('score')}, {get('k')}, '0') AS INT) AS score FROM {events}"


@operator("events")
def stroke_counts_map(d: Spark, events: str) -> str:
    """Counts by key as a map per learner, stored as JSON with its keys in order."""
    counted = f"SELECT user_id, coalesce(event_type, '') AS kind, count(*) AS n FROM {events} GROUP BY user_id, event_type"
    stored = "to_json(map_from_entries(array_sort(collect_list(struct(kind, n)))))" if d.name == "spark" else """'{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}'"""
    return f"SELECT user_id, {stored} AS counts FROM ({counted}) GROUP BY user_id"


@operator("sessions", word="CAT")
def spelling_progress(d: Spark, sessions: str, word: str) -> str:
    """Letters of a word found in order by each learner's attempts, and the state that leaves them in."""
    return f"""
    SELECT user_id, found, CASE WHEN found = {len(word)} THEN 'correct' WHEN last = substring('{word}', CAST(greatest(found, 1) AS INT), 1) THEN 'partial_success' ELSE 'retrying' END AS state, round(CAST(found AS DOUBLE) / {len(word)}, 4) AS accuracy
    FROM (SELECT user_id, CAST(length({d.folded('letters', 'p', 'l', f"CASE WHEN length(p) < {len(word)} AND l = substring('{word}', CAST(length(p) + 1 AS INT), 1) THEN concat(p, l) ELSE p END")}) AS BIGINT) AS found, {d.at('letters', d.size('letters'))} AS last
          FROM (SELECT user_id, {d.gathered('target_item', 'ts', 'id')} AS letters FROM {sessions} WHERE completed GROUP BY user_id))"""


@operator("documents", "labels")
def selection_score(d: Spark, documents: str, labels: str) -> str:
    """Seven tenths of one group's share and three of the rest's, for each source."""
    part = lambda test: f"CAST(sum(CASE WHEN {test} THEN l.quality ELSE 0 END) AS DOUBLE) / nullif(count(CASE WHEN {test} THEN 1 END), 0)"
    en, rest = "d.lang = 'en'", "d.lang <> 'en'"
    return f"SELECT d.source, round(0.7 * coalesce({part(en)}, 0) + 0.3 * coalesce({part(rest)}, 0), 6) AS score FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source"


#: Audio of coaching events by profile, and assistance of spelling by level.
AUDIO = {("error", "early_learner"): "soft_chime", ("error", "child"): "chime", ("purchase", "early_learner"): "fanfare", ("purchase", "child"): "cheer", ("click", "child"): "tick"}


@operator("sessions")
def dimension_lookup(d: Spark, sessions: str) -> str:
    """A small dimension by two keys, with a default for what it lacks."""
    rows = ", ".join(f"('{e}', '{p}', '{a}')" for (e, p), a in AUDIO.items())
    return f"""
    SELECT s.id, coalesce(a.audio, 'silent') AS audio FROM (SELECT id, module_type, CASE user_id % 2 WHEN 0 THEN 'early_learner' ELSE 'child' END AS profile FROM {sessions}) s
    LEFT JOIN (SELECT * FROM (VALUES {rows}) v(event, profile, audio)) a ON a.event = s.module_type AND a.profile = s.profile"""


@operator("notes")
def best_similarity(d: Spark, notes: str) -> str:
    """For each line of a page the most alike of the next ones: containment counts whole, else edits; 0.4 at least."""
    return f"""
    SELECT page, line_number, max_by(j, s * 1000 - j) AS best, round(max(s), 6) AS similarity FROM (
      SELECT a.page, a.line_number, b.line_number AS j, CASE WHEN position(a.line IN b.line) > 0 OR position(b.line IN a.line) > 0 THEN CAST(1 AS DOUBLE) ELSE 1 - CAST(levenshtein(a.line, b.line) AS DOUBLE) / greatest(length(a.line), length(b.line)) END AS s
      FROM {notes} a JOIN {notes} b ON a.page = b.page AND b.line_number > a.line_number) WHERE s >= 0.4 GROUP BY page, line_number"""


@operator("documents")
def letters_only_lookup(d: Spark, documents: str) -> str:
    """Tokens joined to a dictionary by their letters alone, counted by document before they meet it."""
    tokens = f"SELECT doc_id, t FROM (SELECT doc_id, {d.cut('text', repr(' '))} AS ts FROM {documents}) x {d.rows('ts', 'y', 't')}"
    key = d.replace("translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "[^a-z]", "")
    return f"""
    WITH k AS (SELECT doc_id, key, count(*) AS n FROM (SELECT doc_id, {key} AS key FROM ({tokens})) WHERE length(key) > 2 GROUP BY doc_id, key),
    dict AS (SELECT key, sum(n) AS n FROM k GROUP BY key HAVING sum(n) >= 20)
    SELECT k.doc_id, CAST(sum(k.n) AS BIGINT) AS known, CAST(sum(k.n * d.n) AS BIGINT) AS weight FROM k JOIN dict d ON d.key = k.key GROUP BY k.doc_id"""


@operator("notes")
def look_ahead_timing(d: Spark, notes: str) -> str:
    """A medicine line without a schedule takes the one of the next line or the one after."""
    w = "OVER (PARTITION BY page ORDER BY line_number)"
    own = f"upper({d.extract('line', FREQUENCY)})"
    return f"""
    SELECT page, line_number, coalesce(nullif(f, ''), nullif(f1, ''), nullif(f2, ''), '') AS frequency, CASE WHEN f <> '' THEN 0 WHEN f1 <> '' THEN 1 WHEN f2 <> '' THEN 2 END AS rows_ahead
    FROM (SELECT page, line_number, form, {own} AS f, lead({own}, 1, '') {w} AS f1, lead({own}, 2, '') {w} AS f2 FROM ({medicines(d, notes)})) WHERE form <> ''"""


@operator("notes", known=("nocough", "daysw1", "smokercough", "foodcough"))
def undone_corrections(d: Spark, notes: str, known: tuple) -> str:
    """Lines whose last word and the next line's first make one of the ``known`` words: what broke it is no error."""
    w = "OVER (PARTITION BY page ORDER BY line_number)"
    return f"""
    SELECT n.page, n.line_number, n.tail, n.head FROM (SELECT page, line_number, {d.extract('line', '([a-z]+)$', 1)} AS tail, {d.extract(f"coalesce(lead(line) {w}, '')", '^([a-z]+)', 1)} AS head FROM {notes}) n
    JOIN (SELECT * FROM (VALUES {', '.join(f"('{t}')" for t in known)}) v(term)) l ON concat(n.tail, n.head) = l.term"""


#: Field labels, the edits within which a garbled one is still meant, and a shape of the value that allows one more.
LABELS = {"Patient": (2, "(?!)"), "Name": (1, "(?!)"), "Age": (1, r"^\s*[0-9]{1,3}\b"), "Sex": (1, r"^\s*[MFmf]\b"), "Gender": (2, "(?!)"), "Date": (1, r"^\s*[0-9]")}


@operator("notes")
def repaired_field_labels(d: Spark, notes: str) -> str:
    """Words before a colon that are nearly a field label, unless two labels are as near; a value of the label's shape allows one more edit."""
    shaped = lambda p: "false" if p == "(?!)" else d.matches("tail", p)
    kinds = ", ".join(f"CASE WHEN {shaped(p)} THEN 1 ELSE 0 END AS s_{n.lower()}" for n, (_, p) in LABELS.items())
    rows = " UNION ALL ".join(f"SELECT token, n, '{n}' AS label, {b} + s_{n.lower()} AS edits FROM t" for n, (b, _) in LABELS.items())
    return f"""
    WITH t AS (SELECT token, count(*) AS n, {', '.join(f'max(s_{k.lower()}) AS s_{k.lower()}' for k in LABELS)} FROM (
      SELECT {d.replace('token', 'a', 'o')} AS token, {kinds} FROM (SELECT {d.extract('line', '([A-Z][a-z]{2,7}):', 1)} AS token, {d.extract('line', '[A-Z][a-z]{2,7}:(.*)$', 1)} AS tail FROM {notes}) WHERE token <> '') GROUP BY token),
    p AS (SELECT token, n, label, edits, levenshtein(token, label) AS dist FROM ({rows}))
    SELECT token, n, label FROM (SELECT token, n, label, dist, min(dist) OVER (PARTITION BY token) AS least, count(*) OVER (PARTITION BY token, dist) AS ties FROM p WHERE dist <= edits) WHERE dist = least AND ties = 1"""


@operator("notes", template=(("diagnosis", "DIAGNOSIS"), ("complaints", "cough"), ("plan", "Review"), ("plan", "Plan of care"), ("vitals", "BP"), ("vitals", "BP: ")))
def template_sections(d: Spark, notes: str, template: tuple) -> str:
    """Headings put to the sections of a ``template`` of (section, heading), the longest that fits first, then in its order."""
    rows = ", ".join(f"('{section}', '{heading}', {i})" for i, (section, heading) in enumerate(template))
    return f"""
    SELECT page, line_number, section FROM (SELECT n.page, n.line_number, t.section, row_number() OVER (PARTITION BY n.page, n.line_number ORDER BY length(t.heading) DESC, t.ord) AS r
      FROM {notes} n JOIN (SELECT * FROM (VALUES {rows}) v(section, heading, ord)) t ON position(t.heading IN n.line) = 1) WHERE r = 1"""


#: Letters, digits, underscores and all outside ASCII: a word is parted from the next by none of them.
RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"


@operator("documents")
def spelling_candidates(d: Spark, documents: str) -> str:
    """For words seen once, the lexicon word of best gain: how common it is, less its edits; only where that beats a margin.

    Words are whole runs of three letters (a-z) or more, of any case and first letter.
    """
    words = f"SELECT lower(token) AS w, count(*) AS n FROM (SELECT token FROM (SELECT {d.extract_all('text', RUN)} AS ws FROM {documents}) x {d.rows('ws', 'y', 'token')}) WHERE {d.matches('token', '^[a-zA-Z]{3,}$')} GROUP BY lower(token)"
    return f"""
    WITH t AS ({words}),
    pairs AS ({near_pairs(d, 'SELECT w FROM t WHERE n = 1', 'SELECT w FROM t WHERE n >= 10', {2: '{n} >= 3'}, '2')}),
    p AS (SELECT a.w, a.term AS c, round(log10(CAST(b.n AS DOUBLE)) * 2 - 1.2 * a.dist, 6) AS gain FROM pairs a JOIN t b ON a.term = b.w)
    SELECT w AS word, c AS correction, gain FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY gain DESC, c) AS r FROM p) WHERE r = 1 AND gain > 0.3"""
