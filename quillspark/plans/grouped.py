"""Queries whose operators have no SQL form: page by page, Arrow functions, table functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.strokes import stroke_heading, stroke_measures
from quillspark.functions.text import channel_cost, clean_text
from quillspark.operators import layout
from quillspark.operators.text import CLINICAL, DRUGS
from quillspark.registry import query
from quillspark.sources.views import view


@query("line_clusters_first_fit")
def line_clusters_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, fragments and reading order of each page by first fit on union bands."""
    return layout.line_clusters(view(spark, sf_dir, "boxes"))


@query("line_clusters_median_band")
def line_clusters_median_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_clusters(view(spark, sf_dir, "boxes"), median_band=True)


@query("column_lines")
def column_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns between gutters, lines within them, and the order in which they are read."""
    return layout.column_lines(view(spark, sf_dir, "boxes"))


@query("greedy_iou_match")
def greedy_iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of boxes by overlap, best first."""
    return layout.greedy_match(layout.overlaps(boxes=view(spark, sf_dir, "boxes")), 0.05)


@query("greedy_line_match")
def greedy_line_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of a page's even and odd lines by character error rate under 0.6, least first."""
    notes = view(spark, sf_dir, "notes")
    a, b = notes.filter("line_number % 2 = 0").alias("a"), notes.filter("line_number % 2 = 1").alias("b")
    cer = F.least(F.lit(1.0), F.levenshtein("a.line", "b.line") / F.length("a.line"))
    pairs = a.join(b, F.col("a.page") == F.col("b.page")).select(F.col("a.page"), F.col("a.line_number").alias("a"), F.col("b.line_number").alias("b"), cer.alias("score"))
    return layout.greedy_match(pairs, 0.6, descending=False)


@query("connected_lines")
def connected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.connected_lines(view(spark, sf_dir, "boxes"))


@query("table_rows")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_rows(view(spark, sf_dir, "boxes"))


@query("clean_clinical_text")
def clean_clinical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after the ordered rewrites and with words near known terms as those, all in the JVM."""
    return view(spark, sf_dir, "notes").select("page", "line_number", clean_text("line", (*DRUGS, *CLINICAL)).alias("clean"))


@query("channel_cost_rank")
def channel_cost_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drug name that each medicine line's word was most likely meant to be."""
    notes = view(spark, sf_dir, "notes")
    word = F.regexp_extract("line", r"^(?:Tab|Syp)\. ([A-Z][a-z]+)", 1)
    words = notes.select(word.alias("word")).filter("word <> ''").groupBy("word").count()
    drugs = spark.createDataFrame([(t,) for t in DRUGS], "drug string")  # a list as short as this module's
    pairs = words.join(F.broadcast(drugs), F.substring("word", 1, 1) == F.substring("drug", 1, 1))
    costed = pairs.withColumn("cost", F.round(channel_cost("word", "drug"), 4))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("cost", "drug"))
    return costed.withColumn("rank", rank).filter("rank = 1").select("word", "drug", "cost", "count")


def _stroke_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stroke with the one before it on its sheet as its reference."""
    points = view(spark, sf_dir, "points")
    strokes = points.groupBy("stroke").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y", "t"))), lambda p: F.array(p["x"], p["y"], p["t"])).alias("points"))
    before = strokes.select((F.col("stroke") + 1).alias("stroke"), F.col("points").alias("reference"))
    return strokes.join(before, "stroke")


@query("stroke_analysis")
def stroke_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stroke against its reference: all measures, and the way it goes."""
    m, h = stroke_measures("points", "reference"), stroke_heading("points")
    return _stroke_pairs(spark, sf_dir).select("stroke", m.alias("m"), h.alias("h")).select("stroke", "m.*", F.col("h.direction").alias("heading"), "h.confidence")


@query("stroke_combined")
def stroke_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted score of a stroke against its reference, and whether it unlocks the next."""
    m = stroke_measures("points", "reference").alias("m")
    return _stroke_pairs(spark, sf_dir).select("stroke", m).select("stroke", "m.combined", (F.col("m.combined") >= 0.6).alias("unlocks"))


@query("trace_guidance")
def trace_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace percent, whether the next stroke unlocks (or the failsafe after three tries), and the kind of feedback."""
    pairs = _stroke_pairs(spark, sf_dir).select("stroke", (1 + F.col("stroke") % 5).cast("int").alias("tries"), stroke_measures("points", "reference").alias("m"))
    return guided(pairs.select("stroke", "tries", "m.*"))


def guided(measured: DataFrame) -> DataFrame:
    """(stroke, tries, percent, unlocked, failsafe, feedback) of measured strokes (see ``stroke_measures``)."""
    percent = F.round((F.col("coverage") * 0.5 + F.col("direction") * 0.3 + F.col("smoothness") * 0.2) * 100, 1)
    failsafe = F.col("tries") > 3
    kind = F.when(failsafe, "correction").when(F.col("combined") >= 0.9, "celebration").when(F.col("combined") >= 0.75, "encouragement").when(F.col("combined") >= 0.5, "correction").otherwise("warning")
    return measured.select("stroke", "tries", percent.alias("percent"), ((F.col("combined") >= 0.6) | failsafe).alias("unlocked"), failsafe.alias("failsafe"), kind.alias("feedback"))


@query("boosted_regression")
def boosted_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' quality predicted from four of their counts by a distributed tree ensemble."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = ["n_chars", "bangs", "marks", "lines"]
    count = lambda p: F.regexp_count("text", F.lit(p)) / F.greatest(F.length("text"), F.lit(1))
    rows = view(spark, sf_dir, "documents").select("doc_id", "n_chars", count("!").alias("bangs"), count("[#$%&*|]").alias("marks"), count("\n").alias("lines"))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows.na.fill(0))
    labelled = rows.join(view(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    model = GBTRegressor(maxIter=8, maxDepth=3, seed=7).fit(labelled)
    return model.transform(rows).select("doc_id", F.round("prediction", 6).alias("prediction"))
