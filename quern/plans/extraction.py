"""Queries of extracted facts over the source texts, each checked against what the tables know of the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import extract
from quern.plans.tables import cut_lineage, table
from quern.sources.scan import language_of

#: Extensions of the files whose symbols the tables hold.
_EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby"}


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each text, with methods within C++ classes; path is the id of the file."""
    files = table(spark, d, "files").select(F.col("id").alias("file_id"), "path").distinct().withColumn("language", language_of(F.col("path")))
    texts = table(spark, d, "documents").where("kind = 'source' AND text IS NOT NULL").select("file_id", F.col("text").alias("content")).distinct()
    rows = texts.join(files, "file_id").select(F.col("file_id").cast("string").alias("path"), "language", "content")
    return cut_lineage(extract.facts(rows, members=True))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods of the symbols table whose file has a text, with its language."""
    files = table(spark, d, "files").select(F.col("id").alias("file_id"), "path").distinct().withColumn("language", language_of(F.col("path")))
    texts = table(spark, d, "documents").where("kind = 'source' AND text IS NOT NULL").select("file_id").distinct()
    syms = table(spark, d, "symbols").where("kind <> 'class'").select("id", "file_id", "name", "line_start", "line_end").distinct()
    return syms.join(files, "file_id").join(texts, "file_id").drop("path")


def extracted_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Per language, the known functions and methods and how many of them are extracted with name and lines."""
    found = _facts(spark, d).where("fact = 'symbol'").select(F.col("path").cast("long").alias("file_id"), "name", F.col("line").alias("line_start"), "line_end").distinct()
    rows = _spans(spark, d).join(found.withColumn("hit", F.lit(1)), ["file_id", "name", "line_start", "line_end"], "left")
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("n_known"), F.count("hit").alias("n_extracted"))


def extracted_calls(spark: SparkSession, d: str) -> DataFrame:
    """Per language, the known calls of files with a text and how many of them are extracted with callee and line."""
    files = table(spark, d, "files").select(F.col("id").alias("file_id"), "path").distinct().withColumn("language", language_of(F.col("path")))
    texts = table(spark, d, "documents").where("kind = 'source' AND text IS NOT NULL").select("file_id").distinct()
    known = table(spark, d, "calls").select("file_id", "callee_name", "line").distinct().join(texts, "file_id").join(files, "file_id")
    found = _facts(spark, d).where("fact = 'call'").select(F.col("path").cast("long").alias("file_id"), F.col("name").alias("callee_name"), "line").distinct()
    rows = known.join(found.withColumn("hit", F.lit(1)), ["file_id", "callee_name", "line"], "left")
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("n_known"), F.count("hit").alias("n_extracted"))


def _within(spark: SparkSession, d: str, fact: str, kind: str) -> DataFrame:
    """Facts of a kind per known function of the languages with flow, by lines of the function."""
    spans = _spans(spark, d).where(F.col("language").isin("javascript", "c", "cpp")).select("id", "file_id", "line_start", "line_end")
    at = _facts(spark, d).where((F.col("fact") == fact) & (F.col("kind") == kind)).select(F.col("path").cast("long").alias("file_id"), "line").distinct()
    # each function is counted by the bins of lines it touches, so that no file is compared with itself line by line
    bins = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("line_start") / 64), F.floor(F.col("line_end") / 64))))
    hits = bins.join(at.withColumn("_bin", F.floor(F.col("line") / 64)), ["file_id", "_bin"]).where("line BETWEEN line_start AND line_end").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return spans.select(F.col("id").alias("symbol_id")).join(hits.withColumnRenamed("id", "symbol_id"), "symbol_id", "left").select("symbol_id", F.coalesce("n", F.lit(0)).alias("n"))


def extracted_cfg(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a return in each known function of JavaScript, C and C++, from the control flow."""
    return _within(spark, d, "cfg", "early_return").withColumnRenamed("n", "n_returns")


def extracted_dfg(spark: SparkSession, d: str) -> DataFrame:
    """Lines with an assignment in each known function of JavaScript, C and C++, from the data flow."""
    return _within(spark, d, "dfg", "assignment").withColumnRenamed("n", "n_assignments")


QUERIES = {"extracted_symbols": extracted_symbols, "extracted_calls": extracted_calls, "extracted_cfg": extracted_cfg, "extracted_dfg": extracted_dfg}

_LANG = "CASE regexp_extract(path, '\\.(\\w+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in _EXTENSIONS.items()) + " END"
_F = f"f AS (SELECT DISTINCT id AS file_id, path, {_LANG} AS language FROM files), t AS (SELECT DISTINCT file_id FROM documents WHERE kind = 'source' AND text IS NOT NULL)"
_KNOWN = f"WITH {_F}, s AS (SELECT DISTINCT id, file_id, name, line_start, line_end FROM symbols WHERE kind <> 'class')"
_LINES = _KNOWN + ", x AS (SELECT file_id, text FROM documents WHERE kind = 'source' AND text IS NOT NULL), l AS (SELECT DISTINCT file_id, n, line FROM (SELECT file_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM x))"
ORACLE = {
    "extracted_symbols": _KNOWN + " SELECT language, count(*) AS n_known, count(*) AS n_extracted FROM s JOIN f USING (file_id) JOIN t USING (file_id) GROUP BY language",
    "extracted_calls": f"WITH {_F}, c AS (SELECT DISTINCT file_id, callee_name, line FROM calls) SELECT language, count(*) AS n_known, count(*) AS n_extracted FROM c JOIN f USING (file_id) JOIN t USING (file_id) GROUP BY language",
    "extracted_cfg": _LINES + " SELECT s.id AS symbol_id, count(DISTINCT l.n) AS n_returns FROM s JOIN f USING (file_id) JOIN t USING (file_id) LEFT JOIN l ON l.file_id = s.file_id AND l.n BETWEEN line_start AND line_end AND regexp_matches(l.line, '^\\s*(if \\([^()]*\\) )?return\\b') WHERE language IN ('javascript', 'c', 'cpp') GROUP BY s.id",
    "extracted_dfg": _LINES + " SELECT s.id AS symbol_id, count(DISTINCT l.n) AS n_assignments FROM s JOIN f USING (file_id) JOIN t USING (file_id) LEFT JOIN l ON l.file_id = s.file_id AND l.n BETWEEN line_start AND line_end AND regexp_matches(l.line, '^\\s*(for \\()?(const |let |var |auto |static |unsigned |int |long |char )+\\*?\\w+ = |^\\s*\\w+ = ') WHERE language IN ('javascript', 'c', 'cpp') GROUP BY s.id",
}
