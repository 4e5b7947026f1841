"""Queries of the general training-data operators (problems 4 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.references import MaskRule, orphan_references
from quern.operators.skew import eager_join_aggregate, heavy_keys, key_states
from quern.plans.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of callee_name and file_id in at least 2.5 % of the rows of calls."""
    return heavy_keys(table(spark, sf_dir, "calls"), ["callee_name", "file_id"], 0.025).select("key_field", "key_value")


def p4_calls_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per callee_name: calls as stored and the sum of their lines, without a long task for the hottest name."""
    return key_states(table(spark, sf_dir, "calls").select("callee_name", "line"), ["callee_name"], ["line"]).select(
        "callee_name", F.col("n").alias("n_calls"), F.col("s_line").alias("sum_line")
    )


def p4_join_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a call and a symbol of that name, rolled up to the symbols' kind by way of compact states."""
    calls = table(spark, sf_dir, "calls").select("callee_name", "line")
    symbols = table(spark, sf_dir, "symbols").select(F.col("name").alias("callee_name"), "kind")
    return eager_join_aggregate(symbols, calls, ["callee_name"], ["kind"], right_sums=["line"], left_keys=["kind"])


def p4_join_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls rolled up through their file to its language, file_id being skewed."""
    calls = table(spark, sf_dir, "calls").select("file_id", "line")
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), F.lower(F.trim("language")).alias("language")).distinct()
    return eager_join_aggregate(files, calls, ["file_id"], ["language"], right_sums=["line"], left_keys=["language"])


def _orphans(spark: SparkSession, sf_dir: str, carry: list[str]) -> DataFrame:
    files = table(spark, sf_dir, "files").select("id", "deleted_at")
    gone = files.where(F.col("deleted_at").isNotNull()).select(F.col("id").alias("file_id")).distinct()
    symbols = table(spark, sf_dir, "symbols").select("id", "file_id", "name")
    live = symbols.join(gone, "file_id", "left_anti").select("id").distinct()
    names = symbols.select("name").union(table(spark, sf_dir, "known_externals").select("callee_name")).distinct()
    kept = files.groupBy("id").agg(F.max("deleted_at").alias("gone")).where(F.col("gone").isNull()).select("id")
    calls = orphan_references(
        table(spark, sf_dir, "calls"), "id", ["callee_id", "callee_name"],
        [
            MaskRule(frozenset({"callee_id", "callee_name"}), {"callee_id": "id"}, live, "callee_id"),
            MaskRule(frozenset({"callee_id"}), {"callee_id": "id"}, live, "callee_id"),
            MaskRule(frozenset({"callee_name"}), {"callee_name": "name"}, names, "callee_name"),
        ],
        carry,
    )
    lsp = orphan_references(table(spark, sf_dir, "lsp_definitions"), "id", ["def_file_id"], [MaskRule(frozenset({"def_file_id"}), {"def_file_id": "id"}, kept, "def_file_id")], carry)
    return calls.withColumn("table_name", F.lit("calls")).unionByName(lsp.withColumn("table_name", F.lit("lsp_definitions")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of calls and lsp_definitions."""
    return _orphans(spark, sf_dir, []).select("table_name", "row_id", "field")


def p6_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, field and month of indexed_at (null: no indexed_at)."""
    rows = _orphans(spark, sf_dir, ["indexed_at"]).withColumn("period", F.date_format("indexed_at", "yyyy-MM"))
    return rows.groupBy("table_name", "field", "period").agg(F.count(F.lit(1)).alias("n_orphans"))


QUERIES = {
    "p4_found": p4_found,
    "p4_calls_per_key": p4_calls_per_key,
    "p4_join_by_kind": p4_join_by_kind,
    "p4_join_by_language": p4_join_by_language,
    "p6_found": p6_found,
    "p6_per_period": p6_per_period,
}

_ORPHANS = """
WITH gone AS (SELECT DISTINCT id FROM files WHERE deleted_at IS NOT NULL),
live AS (SELECT DISTINCT id FROM symbols WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM gone)),
names AS (SELECT name AS n FROM symbols WHERE name IS NOT NULL UNION SELECT callee_name FROM known_externals WHERE callee_name IS NOT NULL),
orphans AS (
  SELECT DISTINCT 'calls' AS table_name, id AS row_id, 'callee_id' AS field, indexed_at FROM calls
  WHERE callee_id IS NOT NULL AND callee_id NOT IN (SELECT id FROM live)
  UNION ALL
  SELECT DISTINCT 'calls', id, 'callee_name', indexed_at FROM calls
  WHERE callee_id IS NULL AND callee_name IS NOT NULL AND callee_name NOT IN (SELECT n FROM names)
  UNION ALL
  SELECT DISTINCT 'lsp_definitions', id, 'def_file_id', indexed_at FROM lsp_definitions
  WHERE def_file_id IS NOT NULL AND def_file_id NOT IN (SELECT id FROM files WHERE id NOT IN (SELECT id FROM gone))
)
"""

ORACLE = {
    "p4_found": """
SELECT 'callee_name' AS key_field, callee_name AS key_value FROM calls WHERE callee_name IS NOT NULL
GROUP BY callee_name HAVING count(*) >= 0.025 * (SELECT count(*) FROM calls)
UNION ALL
SELECT 'file_id', CAST(file_id AS VARCHAR) FROM calls WHERE file_id IS NOT NULL
GROUP BY file_id HAVING count(*) >= 0.025 * (SELECT count(*) FROM calls)""",
    "p4_calls_per_key": "SELECT callee_name, count(*) AS n_calls, CAST(sum(line) AS BIGINT) AS sum_line FROM calls GROUP BY callee_name",
    "p4_join_by_kind": "SELECT kind, count(*) AS n_pairs, CAST(sum(line) AS BIGINT) AS sum_line FROM symbols JOIN calls ON callee_name = name GROUP BY kind",
    "p4_join_by_language": """
SELECT language, count(*) AS n_pairs, CAST(sum(line) AS BIGINT) AS sum_line
FROM (SELECT DISTINCT id, lower(trim(language)) AS language FROM files) f JOIN calls c ON c.file_id = f.id GROUP BY language""",
    "p6_found": _ORPHANS + "SELECT DISTINCT table_name, row_id, field FROM orphans",
    "p6_per_period": _ORPHANS
    + "SELECT table_name, field, strftime(indexed_at, '%Y-%m') AS period, count(*) AS n_orphans FROM (SELECT DISTINCT table_name, row_id, field, indexed_at FROM orphans) GROUP BY ALL",
}
