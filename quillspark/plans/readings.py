"""Two readings or two orders of the same rows against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.readings import edits_of, reading_blocks, swaps
from quillspark.functions.text import clean_text
from quillspark.operators import OPERATORS
from quillspark.operators.agreement import rank_agreement
from quillspark.operators.base import DUCK
from quillspark.operators.text import CLINICAL, CORE, DRUGS
from quillspark.registry import query
from quillspark.sources.views import subquery, view


def words_of(text: Column | str) -> Column:
    """The words of a text, parted by white space; none of a null."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def _plain(words: Column) -> Column:
    """Words without what stands around their letters, in lower case."""
    core = lambda w: F.regexp_extract(w, CORE, 2)
    return F.transform(words, lambda w: F.lower(F.when(core(w) != "", core(w)).otherwise(w)))


def heard_words(rows: DataFrame, line: str, other: str, into: str = "reading") -> DataFrame:
    """``rows`` with what another reading has for each word of a line: a map from the word's place, from 0.

    A reading whose edit distance in letters is over half of the longer text is another line: none of its words count. A null in either has no words.
    """
    a, b = F.coalesce(F.col(line), F.lit("")), F.coalesce(F.col(other), F.lit(""))
    mine, theirs = words_of(line), words_of(other)
    alike = 2 * F.levenshtein(F.lower(a), F.lower(b)) <= F.greatest(F.length(a), F.length(b))
    pairs = swaps(reading_blocks(_plain(mine), _plain(theirs)), theirs)
    nothing = F.create_map().cast("map<int,string>")
    return rows.withColumn(into, F.when(alike & (F.lower(a) != F.lower(b)), F.map_from_entries(pairs)).otherwise(nothing))


_REVIEW = OPERATORS["word_review"]


@query("word_review", _REVIEW.sql(DUCK, notes=subquery("notes")))
def word_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to look at, against a reading that hears pain for cough."""
    notes = view(spark, sf_dir, "notes").withColumn("other", F.replace("line", F.lit("cough"), F.lit("pain")))
    return _REVIEW(notes=heard_words(notes, "line", "other").drop("other"), aligned=True)


@query("word_alignment")
def word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the rewrites exchanged one for one or for several, and how often."""
    notes = view(spark, sf_dir, "notes").select("line", clean_text("line", (*DRUGS, *CLINICAL)).alias("clean")).filter("line <> clean")
    words = notes.groupBy("line", "clean").agg(F.count("*").alias("n")).select(words_of("line").alias("was"), words_of("clean").alias("now"), "n")
    pairs = words.select("was", "n", F.explode(swaps(reading_blocks("was", "now"), F.col("now"))).alias("p"))
    return pairs.groupBy(F.element_at("was", F.col("p.place") + 1).alias("was"), F.col("p.heard").alias("now")).agg(F.sum("n").alias("count"))


_CODES = "list_transform({x}, lambda w: chr(CAST(32 + list_position(u, w) AS INT)))"
_EDITS = f"""
WITH r AS (SELECT page, line_number, regexp_extract_all(line, '\\S+') AS a, regexp_extract_all(coalesce(lead(line) OVER (PARTITION BY page ORDER BY line_number), ''), '\\S+') AS b FROM {subquery('notes')}),
u AS (SELECT *, list_sort(list_distinct(list_concat(a, b))) AS u FROM r)
SELECT page, line_number, CAST(levenshtein(array_to_string({_CODES.format(x='a')}, ''), array_to_string({_CODES.format(x='b')}, '')) AS BIGINT) AS edits FROM u WHERE len(a) > 0 AND len(b) > 0"""


@query("reading_edits", _EDITS)
def reading_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word edits between each line and the one below it, as the blocks of their alignment have them."""
    below = F.expr("lead(line) OVER (PARTITION BY page ORDER BY line_number)")
    lines = view(spark, sf_dir, "notes").select("page", "line_number", words_of("line").alias("a"), words_of(below).alias("b")).where("size(a) > 0 AND size(b) > 0")
    return lines.select("page", "line_number", edits_of(reading_blocks("a", "b")).alias("edits"))


_AGREEMENT = """
WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i, value AS j FROM events)
SELECT a.user_id, a.day, count(*) AS pairs, count_if(b.j > a.j) AS concordant, count_if(b.j < a.j) AS discordant,
       round(CAST(count_if(b.j > a.j) - count_if(b.j < a.j) AS DOUBLE) / count(*), 6) AS tau
FROM r a JOIN r b ON a.user_id = b.user_id AND a.day = b.day AND a.i < b.i GROUP BY a.user_id, a.day"""


@query("kendall_tau", _AGREEMENT)
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank agreement of the order in time and the order of values of each learner's events of a day."""
    events = view(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), F.struct("ts", "event_id").alias("place"), "value")
    found = rank_agreement(events, ["user_id", "day"], "place", "value").where("pairs > 0")
    return found.select("user_id", "day", "pairs", "concordant", "discordant", F.round("tau", 6).alias("tau"))
