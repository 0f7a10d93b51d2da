"""Readers and writers of the files that practice and document data come in.

All stay declarative: schemas are stated where the format has none, filters and columns reach the scan,
and bad records become rows that say so instead of failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def feature_export(results: DataFrame, path: str) -> None:
    """Features of results as CSV with a header; ``overall`` stands in where ``overall_score`` is missing."""
    score = F.coalesce(F.get_json_object("scores", "$.overall_score"), F.get_json_object("scores", "$.overall")).cast("double")
    feature = lambda k: F.get_json_object("features", f"$.{k}").cast("double").alias(k)
    results.select("id", feature("slant"), feature("spacing"), feature("baseline"), feature("pressure"), score.alias("label")).write.mode("overwrite").csv(path, header=True)


def csv_with_header(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, which may begin with a byte order mark."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def split_of(name: Column) -> Column:
    """train, validation or test, by a file's name."""
    low = F.lower(name)
    return F.when(low.contains("val"), "validation").when(low.contains("test"), "test").otherwise("train")


def parquet_splits(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of several Parquet files, with the split that each file's name says."""
    return spark.read.parquet(path).select(*columns, split_of(F.col("_metadata.file_name")).alias("split"))


def discovered_csvs(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Rows of all CSV files below a folder whose header has the required columns."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    rows = F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")
    header = F.transform(F.split(F.element_at(rows, 1), ","), lambda c: F.lower(F.trim(c)))
    has = lines.select("file", rows.alias("rows"), header.alias("header"))
    for c in required:
        has = has.filter(F.array_contains("header", c.lower()))
    cells = has.select("file", "header", F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row")).filter(F.trim("row") != "").withColumn("cell", F.split("row", ","))
    picked = [F.get("cell", F.array_position("header", c.lower()).cast("int") - 1).alias(c) for c in required]
    return cells.select(*picked, split_of(F.col("file")).alias("split"))


def pipe_terms(spark: SparkSession, path: str, source: str = "RXNORM", kinds: tuple[str, ...] = ("IN", "PIN", "BN")) -> DataFrame:
    """Names of 3 to 40 letters from a pipe-delimited table of concepts, by source and kind, each once and sorted."""
    rows = spark.read.option("sep", "|").option("quote", "").csv(path)
    named = rows.filter((F.col("_c11") == source) & F.col("_c12").isin(*kinds)).select(F.trim("_c14").alias("term"))
    return named.filter(F.length("term").between(3, 40)).distinct().orderBy("term")


def form_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Text of annotated forms: words in order of y and then x, one row per file."""
    form = "form array<struct<text:string,box:array<int>,label:string>>"
    rows = spark.read.option("multiLine", True).schema(form).json(path).select(F.col("_metadata.file_name").alias("file"), F.explode("form").alias("w"))
    placed = rows.filter(F.trim("w.text") != "").groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("w.box")[1].alias("y"), F.col("w.box")[0].alias("x"), F.col("w.text").alias("text")))).alias("words"))
    return placed.select("file", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"))


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


GOLD = "doc_type string, handwritten boolean, lines array<struct<text:string,role:string>>, fields struct<patient_name:string,age:string,sex:string,date:string>"


def gold_pages(spark: SparkSession, path: str) -> DataFrame:
    """Lines of annotated pages, one JSON file each, with the group that a page's name says."""
    pages = spark.read.option("multiLine", True).schema(GOLD).json(path).withColumn("page", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    prefix = F.regexp_extract("page", "^(gnhk|funsd|rxsynth|printed)_", 1)
    group = F.when(prefix != "", prefix).otherwise("user_pages")
    return pages.select("page", group.alias("page_group"), "doc_type", "handwritten", "fields", F.posexplode_outer("lines").alias("line_number", "l")).select("page", "page_group", "doc_type", "handwritten", "fields", "line_number", "l.text", "l.role")


def ground_truth_items(df: DataFrame, text: str = "ground_truth") -> DataFrame:
    """Drug lines and the instruction after each, from a tagged string whose items are parted by dashes."""
    section = F.regexp_extract(text, r"<s_medications>(.*?)</s_medications>", 1)
    items = F.filter(F.split(section, r"\s+-\s+(?=[A-Z0-9])"), lambda x: F.trim(x) != "")
    rows = df.select("*", F.posexplode(items).alias("i", "item"))
    return rows.groupBy(*df.columns, (F.floor(F.col("i") / 2)).alias("pair")).agg(F.min_by("item", "i").alias("drug"), F.max_by(F.when(F.col("i") % 2 == 1, F.col("item")), "i").alias("instruction"))


def image_files(spark: SparkSession, path: str, kinds: str = "*.{png,jpg,jpeg,bmp,tif,tiff}") -> DataFrame:
    """Images below a folder with sizes, contents unread until asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", kinds).load(path).select("path", "length", "modificationTime", "content")


#: First bytes of the kinds of documents.
MAGIC = {"25504446": "pdf", "89504E47": "png", "FFD8FF": "jpeg", "49492A00": "tiff", "4D4D002A": "tiff"}


def sniffed_documents(files: DataFrame, most_bytes: int = 25_000_000) -> DataFrame:
    """Files with what they are by their first bytes, and why one can't be taken, row by row."""
    head = F.hex(F.substring("content", 1, 4))
    kind = F.coalesce(*[F.when(head.startswith(m), k) for m, k in MAGIC.items()], F.lit("unknown"))
    error = F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large").when(kind == "unknown", "unsupported")
    return files.select("path", "length", kind.alias("kind"), F.when(error.isNull(), "ok").otherwise("failed").alias("status"), error.alias("error_code"))


def document_sink(documents: DataFrame, path: str, key: str = "doc_id") -> None:
    """One JSON line a document and its plain text, side by side."""
    documents.write.mode("overwrite").json(f"{path}/json")
    documents.select("text").write.mode("overwrite").text(f"{path}/txt")


def append_rows(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Add rows to a growing set of CSV or JSON files; a task that runs twice is committed once."""
    writer = rows.write.mode("append")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def live_shares(shares: DataFrame, as_of: str) -> DataFrame:
    """Shared files that aren't revoked and haven't expired."""
    return shares.filter((F.col("revoked") == 0) & (F.col("expires_at") > as_of))


def revoked_shares(shares: DataFrame, token_hash: str, revoke_hash: str) -> DataFrame:
    """The table after a revocation that both hashes allow."""
    hit = (F.col("token_hash") == token_hash) & (F.col("revoke_hash") == revoke_hash)
    return shares.withColumn("revoked", F.when(hit, 1).otherwise(F.col("revoked")))


def without_matches(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table after a delete by subquery: an anti join."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def synthetic_sessions(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """Seeded sessions for tests and trials."""
    r = F.rand(seed)
    return spark.range(rows).select("id", (F.col("id") % 97).alias("user_id"), F.chr(65 + F.col("id") % 26).alias("target_item"), F.round(r, 4).alias("accuracy"), F.when(r < 0.1, "abandoned").otherwise("completed").alias("status"))


def lexicon(bundled: DataFrame, *more: DataFrame) -> DataFrame:
    """The terms of all lists, each once whatever its case, the first spelling in order."""
    out = bundled.select(F.col("term"), F.lit(0).alias("o"))
    for i, extra in enumerate(more, 1):
        out = out.unionByName(extra.select(F.col(extra.columns[0]).alias("term"), F.lit(i).alias("o")))
    return out.filter(F.trim("term") != "").groupBy(F.lower(F.trim("term")).alias("key")).agg(F.min_by(F.trim("term"), F.struct("o", "term")).alias("term")).select("term")
