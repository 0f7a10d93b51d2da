"""Operators written as SQL for Catalyst, with the few words in which dialects differ left open.

An operator is a function of a dialect that returns a query over named inputs. Called with DataFrames it
gives a DataFrame; the same text in the other dialect is what an independent engine checks it with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class Spark:
    """Words of Spark SQL."""

    name = "spark"

    def listagg(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def carried(self, x: str, over: str) -> str:
        return f"last_value({x}) IGNORE NULLS OVER ({over})"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    def matches(self, x: str, pattern: str) -> str:
        return f"{x} RLIKE r'{pattern}'"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', {group})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def each(self, x: str, var: str, body: str) -> str:
        return f"transform({x}, {var} -> {body})"

    def only(self, x: str, var: str, body: str) -> str:
        return f"filter({x}, {var} -> {body})"

    def joined(self, x: str, sep: str) -> str:
        return f"array_join({x}, '{sep}')"

    def at(self, x: str, i: str) -> str:
        """The element at a place from 1, null beyond the end."""
        return f"try_element_at({x}, cast({i} as int))"

    def cut(self, x: str, sep: str) -> str:
        return f"split({x}, {sep})"

    def span(self, low: str, high: str) -> str:
        """Whole numbers from low to high; none if high is less."""
        return f"(CASE WHEN {high} >= {low} THEN sequence({low}, {high}) ELSE cast(array() AS array<bigint>) END)"

    def distinct(self, x: str) -> str:
        return f"array_sort(array_distinct({x}))"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def letters(self, x: str) -> str:
        """The letters of a string as 64 bits."""
        return f"aggregate(split({x}, ''), 0L, (m, c) -> m | shiftleft(1L, ascii(c) % 64))"

    def apart(self, x: str, y: str, most: str) -> str:
        """Whether strings of these letters may be ``most`` edits apart: an edit changes two of the bits at most."""
        return f"bit_count({x} ^ {y}) <= 2 * {most}"

    def couples(self, x: str) -> str:
        """The pairs of neighbouring letters of a string as 64 bits, the first letter with nothing before it."""
        return f"aggregate(split({x}, ''), struct(0L AS m, '' AS p), (s, c) -> struct(s.m | shiftleft(1L, pmod(hash(s.p, c), 64)) AS m, c AS p), s -> s.m)"

    def near(self, x: str, y: str, most: str) -> str:
        """Whether strings of these pairs may be ``most`` edits apart: an edit undoes two of the pairs at most and makes two."""
        return f"bit_count({x} ^ {y}) <= 4 * {most}"

    def dealt(self, x: str) -> str:
        """A hint that both sides of a join with ``x`` are dealt by key: few bytes, but much work that one task would do alone."""
        return f"/*+ MERGE({x}) */"

    def edits(self, a: str, b: str) -> str:
        """The edit distance of two strings, in code points."""
        return f"levenshtein({a}, {b})"

    def within(self, a: str, b: str, most: str) -> str:
        """The edit distance of two strings, null if it is over ``most``."""
        return f"nullif(levenshtein({a}, {b}, CAST({most} AS INT)), -1)"

    def rows(self, x: str, alias: str, column: str) -> str:
        """A lateral clause with a row for each element."""
        return f"LATERAL VIEW explode({x}) {alias} AS {column}"

    def numbered(self, x: str, alias: str, place: str, column: str) -> str:
        """A lateral clause with a row for each element and its place from 0."""
        return f"LATERAL VIEW posexplode({x}) {alias} AS {place}, {column}"

    def text(self, x: str) -> str:
        return f"cast({x} AS string)"

    def telemetry(self, x: str) -> str:
        """What a JSON text says of a session's strokes."""
        return f"from_json({x}, 'time_before_first_stroke_ms BIGINT, hesitation_ms_per_stroke ARRAY<STRUCT<stroke_id: BIGINT, ms: BIGINT>>, stroke_attempt_counts MAP<STRING, BIGINT>')"

    def gathered(self, x: str, *order: str) -> str:
        """Values of a group as an array in the order of other columns."""
        return f"transform(array_sort(collect_list(struct({', '.join(order)}, {x} AS kept))), o -> o.kept)"

    def folded(self, x: str, so_far: str, var: str, body: str) -> str:
        """A text made of an array of texts from left to right, from an empty one."""
        return f"aggregate({x}, '', ({so_far}, {var}) -> {body})"

    def both(self, x: str, y: str) -> str:
        return f"concat({x}, {y})"

    def letter(self, i: str) -> str:
        """A letter of its own for a number from 1: code points from U+10001 on."""
        return f"decode(unhex(lpad(hex(65536 + {i}), 8, '0')), 'UTF-32')"

    def first(self, x: str, n: int) -> str:
        return f"slice({x}, 1, {n})"

    def lower(self, x: str) -> str:
        return f"lower({x})"


class Duck(Spark):
    """Words of the dialect that results are checked in."""

    name = "duck"

    def listagg(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def carried(self, x: str, over: str) -> str:
        return f"last_value({x} IGNORE NULLS) OVER ({over})"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, '{pattern}', {group})"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS INT)"

    def each(self, x: str, var: str, body: str) -> str:
        return f"list_transform({x}, lambda {var}: {body})"

    def only(self, x: str, var: str, body: str) -> str:
        return f"list_filter({x}, lambda {var}: {body})"

    def joined(self, x: str, sep: str) -> str:
        return f"coalesce(array_to_string({x}, '{sep}'), '')"

    def at(self, x: str, i: str) -> str:
        return f"({x})[{i}]"

    def cut(self, x: str, sep: str) -> str:
        return f"string_split({x}, {sep})"

    def span(self, low: str, high: str) -> str:
        return f"generate_series({low}, {high})"

    def distinct(self, x: str) -> str:
        return f"list_sort(list_distinct({x}))"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def within(self, a: str, b: str, most: str) -> str:
        return f"CASE WHEN {self.edits(a, b)} <= {most} THEN {self.edits(a, b)} END"

    def letters(self, x: str) -> str:
        return "0"  # the distance alone decides here

    def apart(self, x: str, y: str, most: str) -> str:
        return "true"

    def dealt(self, x: str) -> str:
        return ""

    def edits(self, a: str, b: str) -> str:
        """This engine's distance counts bytes: letters of the tables outside ASCII become unused control characters first."""
        narrow = [f"translate({x}, 'äçèéêíñóöüßÄÇÈÉÊÍÑÓÖÜ', {' || '.join(f'chr({i})' for i in (*range(1, 9), *range(14, 27)))})" for x in (a, b)]
        return f"levenshtein({', '.join(narrow)})"

    def rows(self, x: str, alias: str, column: str) -> str:
        return f", LATERAL (SELECT unnest({x}) AS {column}) {alias}"

    def numbered(self, x: str, alias: str, place: str, column: str) -> str:
        return f", LATERAL (SELECT unnest({x}) AS {column}, generate_subscripts({x}, 1) - 1 AS {place}) {alias}"

    def text(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def telemetry(self, x: str) -> str:
        return f"""from_json({x}, '{{"time_before_first_stroke_ms":"BIGINT","hesitation_ms_per_stroke":[{{"stroke_id":"BIGINT","ms":"BIGINT"}}],"stroke_attempt_counts":"MAP(VARCHAR,BIGINT)"}}')"""

    def gathered(self, x: str, *order: str) -> str:
        return f"list({x} ORDER BY {', '.join(order)})"

    def folded(self, x: str, so_far: str, var: str, body: str) -> str:
        return f"list_reduce(list_prepend('', {x}), lambda {so_far}, {var}: {body})"

    def both(self, x: str, y: str) -> str:
        return f"list_concat({x}, {y})"

    def letter(self, i: str) -> str:
        return f"chr(CAST(32 + {i} AS INT))"  # this dialect's distances count bytes

    def first(self, x: str, n: int) -> str:
        return f"({x})[1:{n}]"


SPARK, DUCK = Spark(), Duck()
Text = Callable[..., str]


@dataclass(frozen=True)
class Operator:
    """``operator(sessions=df)`` runs it; ``sql(dialect, sessions="(SELECT ...)")`` is its text.

    ``frame`` is how Spark runs it where one text would do the same work several times over.
    """

    name: str
    inputs: tuple[str, ...]
    text: Text
    checked: bool = True
    params: dict = field(default_factory=dict)
    frame: Callable[..., DataFrame] | None = None

    def sql(self, dialect: Spark, **names: str) -> str:
        return self.text(dialect, **{i: names[i] for i in self.inputs}, **self.params)

    def __call__(self, **given) -> DataFrame:
        if self.frame:
            return self.frame(**(self.params | given))
        frames = {i: given.pop(i) for i in self.inputs}
        spark = next(iter(frames.values())).sparkSession
        names = {i: f"q_{i}_{uuid.uuid4().hex}" for i in frames}
        for i, df in frames.items():
            df.createOrReplaceTempView(names[i])
        try:
            return spark.sql(self.text(SPARK, **names, **(self.params | given)))
        finally:
            for n in names.values():
                spark.catalog.dropTempView(n)


OPERATORS: dict[str, Operator] = {}


def operator(*inputs: str, checked: bool = True, frame: Callable[..., DataFrame] | None = None, **params) -> Callable[[Text], Operator]:
    """Make an operator of a function ``f(d, *inputs, **params)``; unchecked ones have no text in the other dialect."""

    def make(f: Text) -> Operator:
        if f.__name__ in OPERATORS:
            raise ValueError(f"two operators are named {f.__name__}")
        OPERATORS[f.__name__] = Operator(f.__name__, inputs, f, checked, params, frame)
        return OPERATORS[f.__name__]

    return make
