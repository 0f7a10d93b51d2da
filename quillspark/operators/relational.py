"""Joins, aggregates, orderings, set operations and windows over plain tables."""

from __future__ import annotations

from quillspark.operators.base import Spark, operator


@operator("orders", "customer", segment="BUILDING")
def history_join(d: Spark, orders: str, customer: str, segment: str) -> str:
    """An inner equi-join with a filter on the outer side."""
    return f"SELECT o.o_orderkey, o.o_orderdate, c.c_name, c.c_mktsegment FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = '{segment}'"


@operator("lineitem", "orders", priority="1-URGENT")
def semi_join(d: Spark, lineitem: str, orders: str, priority: str) -> str:
    """Rows whose key is in a subquery."""
    return f"SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_orderpriority = '{priority}')"


@operator("customer", "orders")
def anti_join(d: Spark, customer: str, orders: str) -> str:
    """Rows that nothing matches."""
    return f"SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)"


@operator("customer", "orders")
def left_lookup(d: Spark, customer: str, orders: str) -> str:
    """An outer join whose missing side counts 0."""
    return f"SELECT c.c_custkey, coalesce(o.n, 0) AS orders FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey"


@operator("nation")
def self_join(d: Spark, nation: str) -> str:
    """Parents and children of one table: nations and the first of their region."""
    return f"SELECT a.n_nationkey, a.n_name, b.n_name AS parent FROM {nation} a JOIN (SELECT n_regionkey, min(n_nationkey) AS first FROM {nation} GROUP BY n_regionkey) x ON x.n_regionkey = a.n_regionkey JOIN {nation} b ON b.n_nationkey = x.first"


@operator("customer", "supplier")
def full_outer_counts(d: Spark, customer: str, supplier: str) -> str:
    """Both sides of a full outer join."""
    return f"SELECT coalesce(c.k, s.k) AS nationkey, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s ON c.k = s.k"


@operator("orders", "customer", order=1, segment=None)
def point_lookup(d: Spark, orders: str, customer: str, order: int, segment: str | None) -> str:
    """One row by its key, and by its owner if one is asked for."""
    owner = f" AND o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = '{segment}')" if segment else ""
    return f"SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey = {order}{owner} LIMIT 1"


@operator("orders", low="1995-01-01", high="1996-01-01")
def time_range(d: Spark, orders: str, low: str, high: str) -> str:
    """A half-open range of dates, which reaches the scan."""
    return f"SELECT o_orderkey FROM {orders} WHERE o_orderdate >= DATE '{low}' AND o_orderdate < DATE '{high}'"


@operator("orders", status=None, priority=None)
def optional_filters(d: Spark, orders: str, status: str | None, priority: str | None) -> str:
    """Predicates that are there only when asked for."""
    tests = [f"o_orderstatus = '{status}'"] * bool(status) + [f"o_orderpriority = '{priority}'"] * bool(priority)
    return f"SELECT count(*) AS n FROM {orders} {'WHERE ' + ' AND '.join(tests) if tests else ''}"


@operator("orders", page=2, size=50)
def page_of_results(d: Spark, orders: str, page: int, size: int) -> str:
    return f"SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderkey LIMIT {size} OFFSET {(page - 1) * size}"


@operator("orders", n=10)
def top_n(d: Spark, orders: str, n: int) -> str:
    return f"SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT {n}"


@operator("orders", n=20)
def oldest_n(d: Spark, orders: str, n: int) -> str:
    return f"SELECT o_orderkey FROM {orders} ORDER BY o_orderdate, o_orderkey LIMIT {n}"


@operator("orders")
def latest_per_key(d: Spark, orders: str) -> str:
    """The newest row of each key."""
    return f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM {orders}) WHERE r = 1"


@operator("orders", keep=200)
def newest_n_retention(d: Spark, orders: str, keep: int) -> str:
    """The index of the newest rows that a keyed store keeps; a top-k, so that no window takes all rows."""
    return f"SELECT o_orderkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT {keep}"


@operator("customer")
def distinct_rows(d: Spark, customer: str) -> str:
    return f"SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer}"


@operator("lines")
def ordered_dedupe(d: Spark, lines: str) -> str:
    """The first of each document's lines that are equal but for case."""
    return f"SELECT doc_id, line_number, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {d.lower('line')} ORDER BY line_number) AS r FROM {lines}) WHERE r = 1"


@operator("orders")
def ranked_severity(d: Spark, orders: str) -> str:
    """The three worst rows of each key by rank and then size."""
    return f"SELECT o_custkey, o_orderkey, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS r FROM {orders}) WHERE r <= 3"


@operator("part")
def cheapest_within_cost(d: Spark, part: str) -> str:
    """Of the rows within a cost of the best, the one of the lowest key."""
    return f"SELECT p_brand, min(p_partkey) AS partkey FROM (SELECT p_brand, p_partkey, p_retailprice, min(p_retailprice) OVER (PARTITION BY p_brand) AS best FROM {part}) WHERE p_retailprice <= best + 5 GROUP BY p_brand"


@operator("customer", "supplier")
def set_union(d: Spark, customer: str, supplier: str) -> str:
    return f"SELECT c_nationkey AS nationkey FROM {customer} UNION SELECT s_nationkey FROM {supplier}"


@operator("customer", "supplier")
def set_union_all(d: Spark, customer: str, supplier: str) -> str:
    return f"SELECT source, count(*) AS n FROM (SELECT 'customer' AS source FROM {customer} UNION ALL SELECT 'supplier' FROM {supplier}) GROUP BY source"


@operator("customer", "supplier")
def set_intersection(d: Spark, customer: str, supplier: str) -> str:
    return f"SELECT c_nationkey AS nationkey FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}"


@operator("customer", "orders")
def set_difference(d: Spark, customer: str, orders: str) -> str:
    return f"SELECT c_custkey AS custkey FROM {customer} EXCEPT SELECT o_custkey FROM {orders}"


@operator("lineitem", "orders")
def multiset_difference(d: Spark, lineitem: str, orders: str) -> str:
    return f"SELECT l_orderkey AS orderkey FROM {lineitem} EXCEPT ALL SELECT o_orderkey FROM {orders}"


@operator("lineitem")
def percentiles_by_group(d: Spark, lineitem: str) -> str:
    """Exact percentiles with linear interpolation, from counts by value: what a group holds in one place are its different prices."""
    at = lambda q, f: f"CAST(min(CASE WHEN upto > {f}({q} * (total - 1)) THEN v END) AS DOUBLE)"
    value = lambda q: f"{at(q, 'floor')} + ({at(q, 'ceil')} - {at(q, 'floor')}) * CAST({q} * (total - 1) - floor({q} * (total - 1)) AS DOUBLE)"
    p = ", ".join(f"round(({value(q)}) / 100, 3) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.99))
    return f"""
    WITH c AS (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS v, count(*) AS n FROM {lineitem} GROUP BY 1, 2),
    r AS (SELECT l_returnflag, v, sum(n) OVER (PARTITION BY l_returnflag ORDER BY v) AS upto, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM c)
    SELECT l_returnflag, {p} FROM r GROUP BY l_returnflag, total"""


@operator("lineitem")
def spread_measures(d: Spark, lineitem: str) -> str:
    """Population and sample deviations, which are not the same."""
    q = "CAST(l_quantity AS DOUBLE)"
    return f"SELECT l_linestatus, round(stddev_pop({q}), 6) AS sd_pop, round(stddev_samp({q}), 6) AS sd_samp, round(var_pop({q}), 5) AS variance, count(*) AS n FROM {lineitem} GROUP BY l_linestatus"


@operator("boxes")
def weighted_mean_confidence(d: Spark, boxes: str) -> str:
    """A mean weighted by width."""
    return f"SELECT page, round(CAST(sum(conf * (x2 - x1)) AS DOUBLE) / sum(x2 - x1), 4) AS confidence FROM {boxes} GROUP BY page"


@operator("boxes")
def weighted_median_height(d: Spark, boxes: str) -> str:
    """The height at which half of all width is reached."""
    return f"""
    SELECT page, min(h) AS height FROM (SELECT page, h, sum(w) OVER (PARTITION BY page ORDER BY h, idx) AS upto, sum(w) OVER (PARTITION BY page) AS total FROM (SELECT page, idx, y2 - y1 AS h, x2 - x1 AS w FROM {boxes}))
    WHERE upto * 2 >= total GROUP BY page"""


@operator("boxes")
def confidence_buckets(d: Spark, boxes: str) -> str:
    """How many boxes are of high, medium and low confidence."""
    return f"SELECT page, count_if(conf >= 88) AS high, count_if(conf >= 65 AND conf < 88) AS medium, count_if(conf < 65) AS review FROM {boxes} GROUP BY page"


@operator("documents", "labels")
def macro_micro_average(d: Spark, documents: str, labels: str) -> str:
    """The mean over all rows beside the unweighted mean of the sources' means."""
    return f"""
    SELECT count(*) AS sources, round(CAST(sum(good) AS DOUBLE) / sum(n), 6) AS micro, round(avg(CAST(good AS DOUBLE) / n), 6) AS macro
    FROM (SELECT d.source, CAST(sum(l.quality) AS BIGINT) AS good, count(*) AS n FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source)"""


@operator("documents")
def category_report(d: Spark, documents: str) -> str:
    """A report by category with a row for all of them."""
    return f"SELECT coalesce(lang, 'overall') AS category, count(*) AS documents, round(CAST(sum(n_chars) AS DOUBLE) / count(*), 3) AS mean_chars FROM {documents} GROUP BY ROLLUP (lang)"


@operator("lineitem")
def cube_report(d: Spark, lineitem: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)"


@operator("orders")
def grouping_sets_report(d: Spark, orders: str) -> str:
    return f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"


@operator("documents")
def prefix_group_means(d: Spark, documents: str) -> str:
    """Means by the prefix of a key, nulls left out, with how many rows had none."""
    return f"SELECT left(source, 4) AS prefix, round(avg(CASE WHEN n_chars % 7 <> 0 THEN n_chars END), 4) AS mean_chars, count_if(n_chars % 7 = 0) AS failed FROM {documents} GROUP BY left(source, 4)"


@operator("events")
def running_mean(d: Spark, events: str) -> str:
    """The mean of all rows so far."""
    return f"SELECT event_id, CAST(sum(c) OVER w AS BIGINT) AS total_cents, CAST(count(*) OVER w AS BIGINT) AS n FROM (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS c FROM {events}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@operator("events", bins=10, least=15)
def calibration_bins(d: Spark, events: str, bins: int, least: int) -> str:
    """Quantile bins of a confidence with the mean outcome of each, made monotone by a running maximum."""
    at = lambda q, f: f"CAST(min(CASE WHEN upto > {f}({q} * (total - 1)) THEN conf END) AS DOUBLE)"
    edge = lambda q: f"{at(q, 'floor')} + ({at(q, 'ceil')} - {at(q, 'floor')}) * CAST({q} * (total - 1) - floor({q} * (total - 1)) AS DOUBLE)"
    edges = ", ".join(f"{edge(i / bins)} AS e{i}" for i in range(bins + 1))
    rows = " UNION ALL ".join(f"SELECT {i} AS bin, e{i} AS low, e{i + 1} AS high FROM edges" for i in range(bins))
    # Counts by confidence come first: 10,001 rows at most, whatever the events.
    return f"""
    WITH c AS (SELECT least(10000, CAST(round(value * 25) AS BIGINT)) AS conf, count(*) AS n, sum(CASE WHEN (event_id * 7919) % 1000 < value * 2 THEN 1 ELSE 0 END) AS hits FROM {events} GROUP BY 1),
    r AS (SELECT conf, sum(n) OVER (ORDER BY conf) AS upto, sum(n) OVER () AS total FROM c),
    edges AS (SELECT {edges} FROM r GROUP BY total),
    b AS (SELECT x.bin, CAST(sum(c.n) AS BIGINT) AS n, CAST(sum(c.hits) AS DOUBLE) / CAST(sum(c.n) AS DOUBLE) AS m FROM ({rows}) x JOIN c ON c.conf >= x.low AND c.conf <= x.high GROUP BY x.bin HAVING sum(c.n) >= {least})
    SELECT bin, n, round(m, 6) AS mean_hit, round(max(m) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING), 6) AS calibrated FROM b"""


@operator("events")
def grid_search(d: Spark, events: str) -> str:
    """630 settings of three parameters at seven thresholds each, and the cheapest of all, the smaller on ties.

    A setting's cost needs only counts: events are counted by what the rule looks at, and settings meet those few rows.
    """
    series = lambda name, xs: f"(VALUES {', '.join(f'({x})' for x in xs)}) {name[0]}({name})"
    return f"""
    WITH p AS (SELECT * FROM {series('threshold', range(10, 80, 10))} CROSS JOIN {series('weight', range(1, 8))} CROSS JOIN {series('bias', range(-4, 5))} CROSS JOIN {series('scale', range(1, 11))}),
    e AS (SELECT CAST(floor(value) AS BIGINT) AS v, event_id % 3 = 0 AS hit, count(*) AS n FROM {events} GROUP BY 1, 2),
    c AS (SELECT threshold, weight, bias, scale, CAST(sum(n * CASE WHEN (v * scale > threshold * 5 * weight + bias * 10) <> hit THEN weight ELSE 8 - weight END) AS BIGINT) AS cost FROM e CROSS JOIN p GROUP BY threshold, weight, bias, scale)
    SELECT threshold, weight, bias, scale, cost, cost = min(cost) OVER () AS best FROM c"""


@operator("events")
def guarded_acceptance(d: Spark, events: str) -> str:
    """Settings under which no group gets worse."""
    return f"""
    SELECT threshold, bool_and(b <= a) AS accepted, CAST(sum(a - b) AS BIGINT) AS gain
    FROM (SELECT t.threshold, e.event_type, count_if(e.value > 100) AS a, count_if(e.value > 100 + t.threshold) AS b FROM {events} e CROSS JOIN (VALUES (-20), (0), (20), (40)) t(threshold) GROUP BY t.threshold, e.event_type) GROUP BY threshold"""


@operator("events")
def offset_repair_vote(d: Spark, events: str) -> str:
    """Which neighbour's label fits a row best, three rows back or ahead at most, by a vote over a sliding window of seven; isolated misreads don't move."""
    return f"""
    WITH r AS (SELECT event_id AS i, user_id, event_id % 9 AS label, CASE WHEN event_id % 40 < 15 THEN (event_id + 2) % 9 WHEN event_id % 40 < 28 THEN (event_id + 6) % 9 ELSE event_id % 9 END AS read FROM {events}),
    o AS (SELECT *, CASE WHEN read = label THEN 0 {' '.join(f'WHEN read = {f}(label, {abs(k)}) OVER w THEN {k}' for k, f in ((1, 'lead'), (-1, 'lag'), (2, 'lead'), (-2, 'lag'), (3, 'lead'), (-3, 'lag')))} END AS off FROM r WINDOW w AS (PARTITION BY CAST(floor(i / 1000.0) AS BIGINT) ORDER BY i)),
    v AS (SELECT i, off, {', '.join(f'count(CASE WHEN off = {k} THEN 1 END) OVER w AS v{k + 3}' for k in range(-3, 4))} FROM o WINDOW w AS (PARTITION BY CAST(floor(i / 1000.0) AS BIGINT) ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    SELECT i, CASE {' '.join(f'WHEN v{k + 3} >= 4 THEN {k}' for k in (1, -1, 2, -2, 3, -3))} ELSE 0 END AS repair FROM v"""


@operator("documents")
def hash_split_counts(d: Spark, documents: str) -> str:
    """A split by the remainder of the text's digest by 1000, taken from its last hexadecimal digits exactly."""
    hexes = "0123456789abcdef"
    digit = lambda i: f"(position(substring(h, {i + 1}, 1) IN '{hexes}') - 1)"
    total = " + ".join(f"{digit(i)} * {pow(16, 31 - i, 1000)}" for i in range(32))
    return f"SELECT CASE WHEN m < 100 THEN 'test' WHEN m < 200 THEN 'validation' ELSE 'train' END AS split, lang, count(*) AS n FROM (SELECT lang, ({total}) % 1000 AS m FROM (SELECT lang, md5(concat(source, '-', {d.text('doc_id')})) AS h FROM {documents})) GROUP BY 1, 2"


@operator("documents")
def digests(d: Spark, documents: str) -> str:
    return f"SELECT doc_id, {'sha2(text, 256)' if d.name == 'spark' else 'sha256(text)'} AS sha256, sha1(text) AS sha1 FROM {documents}"


@operator("documents")
def sampling_weights(d: Spark, documents: str) -> str:
    """Weights that balance sources: a share for each over its rows."""
    return f"SELECT d.doc_id, round(CAST(1 AS DOUBLE) / s.n / (SELECT count(DISTINCT source) FROM {documents}), 9) AS weight FROM {documents} d JOIN (SELECT source, count(*) AS n FROM {documents} GROUP BY source) s ON d.source = s.source"


@operator("documents", share=10, seed="seed")
def seeded_sample(d: Spark, documents: str, share: int, seed: str) -> str:
    """A share of all rows, the same ones each time: those whose seeded digest is low. No ranks, so no source is one group."""
    return f"SELECT source, doc_id FROM {documents} WHERE substring(md5(concat('{seed}', {d.text('doc_id')})), 1, 4) < '{65536 // share:04x}'"


@operator("orders")
def utility_ranking(d: Spark, orders: str) -> str:
    """A weighted sum of metrics, best first."""
    return f"SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY u DESC, o_orderpriority) AS INT) AS place FROM (SELECT o_orderpriority, round(0.5 * count_if(o_orderstatus = 'F') / count(*) + 0.3 * count(DISTINCT o_custkey) / count(*) - 0.2 * count_if(o_orderstatus = 'P') / count(*), 6) AS u FROM {orders} GROUP BY o_orderpriority)"


@operator("sessions")
def named_maximum(d: Spark, sessions: str) -> str:
    """Which of several named scores is largest and which smallest, the first on ties."""
    return f"SELECT id, CASE greatest(first_ms, pause_1, pause_2) WHEN first_ms THEN 'first' WHEN pause_1 THEN 'second' ELSE 'third' END AS strength, CASE least(first_ms, pause_1, pause_2) WHEN first_ms THEN 'first' WHEN pause_1 THEN 'second' ELSE 'third' END AS weakness FROM {sessions}"


@operator("sessions")
def clamped_inputs(d: Spark, sessions: str) -> str:
    """Values outside their bounds at them; what isn't a number, not finite or missing at a default, in nested values as well."""
    raw = f"CASE WHEN k % 4 = 0 THEN 'nan?' WHEN k % 7 = 0 THEN 'NaN' WHEN k % 11 = 0 THEN 'Infinity' ELSE {d.text('k')} END"
    fine = lambda x: f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) > 1e300 THEN CAST(50 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), {x})) END"
    inner = d.joined(d.each("parts", "x", d.text(f"CAST({fine('x')} AS INT)")), ",")
    return f"""
    SELECT id, greatest(0, least(100, k - 5)) AS clamped, {fine('v')} AS parsed, {inner} AS parts
    FROM (SELECT id, k, try_cast({raw} AS DOUBLE) AS v, {d.array('CAST(k - 20 AS DOUBLE)', f'try_cast({raw} AS DOUBLE)', 'CAST(NULL AS DOUBLE)', 'CAST(k * 9 AS DOUBLE)')} AS parts FROM {sessions})"""


@operator("events")
def ranking_functions(d: Spark, events: str) -> str:
    """Ranks, tiles and neighbours over one frame."""
    return f"SELECT event_id, CAST(ntile(4) OVER w AS INT) AS tile, round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS upto, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS INT) AS kind FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


@operator("events")
def as_of_join(d: Spark, events: str) -> str:
    """Each purchase with the learner's last click at or before it: a carried value over a union, no join at all."""
    over = "PARTITION BY user_id ORDER BY ts, CASE event_type WHEN 'click' THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING"
    return f"SELECT event_id, click FROM (SELECT event_id, event_type, {d.carried('CASE WHEN event_type = ' + repr('click') + ' THEN event_id END', over)} AS click FROM {events} WHERE event_type IN ('click', 'purchase')) WHERE event_type = 'purchase'"


@operator("sessions", gap=86400)
def session_islands(d: Spark, sessions: str, gap: int) -> str:
    """Runs of sessions with no gap of more than a day."""
    return f"""
    SELECT user_id, min(id) AS first_id, count(*) AS n FROM (SELECT user_id, id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY age_seconds DESC, id) AS BIGINT) AS island
      FROM (SELECT user_id, id, age_seconds, CASE WHEN lag(age_seconds) OVER (PARTITION BY user_id ORDER BY age_seconds DESC, id) - age_seconds > {gap} THEN 1 ELSE 0 END AS new FROM {sessions})) GROUP BY user_id, island"""


@operator("events")
def pivot_counts(d: Spark, events: str) -> str:
    return f"SELECT user_id, {', '.join(f'count_if(event_type = {t!r}) AS n_{t}' for t in ('signup', 'error', 'click', 'view', 'purchase'))} FROM {events} GROUP BY user_id"


@operator("events", checked=False)
def distinct_sketch(d: Spark, events: str) -> str:
    """Distinct users by a sketch, for each kind of event."""
    return f"SELECT event_type, approx_count_distinct(user_id) AS users FROM {events} GROUP BY event_type"


@operator("events", error=0.05)
def distinct_sketch_error(d: Spark, events: str, error: float) -> str:
    """Distinct users counted exactly, and whether a sketch of that relative deviation is within three of it."""
    sketch = f"abs(approx_count_distinct(user_id, {error}) - count(DISTINCT user_id)) <= {3 * error} * count(DISTINCT user_id) + 1" if d.name == "spark" else "true"
    return f"SELECT event_type, count(DISTINCT user_id) AS users, {sketch} AS within FROM {events} GROUP BY event_type"


@operator("conversations")
def latest_status(d: Spark, conversations: str) -> str:
    """The last turn of each conversation: who has the word."""
    return f"SELECT conv_id, max(turn) AS last_turn, max_by(role, turn) AS status, count(*) AS turns FROM {conversations} GROUP BY conv_id"


@operator("orders")
def exact_average(d: Spark, orders: str) -> str:
    """Decimal sums, cast once, then divided."""
    return f"SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average FROM {orders} GROUP BY o_orderpriority"
