"""Queries of the engine's further answers over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import context, graph, responses, stats, store, vectors
from quern.plans.reference import _HEAD, _calls, _files, _located, _symbols, _vec
from quern.plans.tables import table
from quern.sources import registry


def call_graph_callees(spark: SparkSession, d: str) -> DataFrame:
    """Callees of each symbol: resolved definitions first, else the call edges."""
    rows = table(spark, d, "lsp_definitions").drop("indexed_at").distinct()
    return graph.call_graph(_calls(spark, d), _symbols(spark, d), _files(spark, d), rows).where("direction = 'callees'").drop("direction")


def call_graph_callers(spark: SparkSession, d: str) -> DataFrame:
    """Callers of each symbol by the call edges."""
    return graph.call_graph(_calls(spark, d), _symbols(spark, d), _files(spark, d)).where("direction = 'callers'").drop("direction", "source")


def context_diff_aware(spark: SparkSession, d: str) -> DataFrame:
    """Summary of the files whose hash is missing, as changed ones."""
    changed = table(spark, d, "files").where("content_hash IS NULL").select("path").distinct()
    return context.build(_located(spark, d), _files(spark, d), None, "diff_aware", changed)


def context_files(spark: SparkSession, d: str) -> DataFrame:
    """Summary of all Go files, those without symbols too."""
    return context.build(_located(spark, d), _files(spark, d), None, "files", _files(spark, d).where("path LIKE '%.go'").select("path"))


def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the last hundred event values, mean and rate of all, as if they were latencies."""
    rows = table(spark, d, "events").select((F.col("value") * 1_000_000).cast("bigint").alias("v"), "ts", "event_id")
    got = stats.embedding_stats(rows, [F.desc("ts"), F.desc("event_id")])
    return got.select("sample_count", "p50", "p99", F.round("avg_ms", 6).alias("avg_ms"), F.round("throughput", 6).alias("throughput"), "health")


def default_model(spark: SparkSession, d: str) -> DataFrame:
    """The default model."""
    return registry.default_model(table(spark, d, "model_specs")).select("id", "dim", "max_tokens")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """What a language server would have answered for each definition, as JSON: lists, single places and links in turn."""
    rows = table(spark, d, "lsp_definitions").drop("indexed_at").distinct().where("def_file_path IS NOT NULL AND def_line IS NOT NULL")
    at = F.struct(F.struct((F.col("def_line") - 1).alias("line"), F.coalesce("def_col", F.lit(0)).alias("character")).alias("start"))
    uri = F.concat(F.lit("file:///work/"), "def_file_path")
    one, link = F.struct(uri.alias("uri"), at.alias("range")), F.struct(uri.alias("targetUri"), at.alias("targetSelectionRange"))
    answer = F.when(F.col("id") % 3 == 0, F.to_json(one)).when(F.col("id") % 3 == 1, F.to_json(F.array(one, one))).otherwise(F.to_json(F.array(link)))
    return rows.select("caller_file_id", "call_line", "call_col", "callee_name", answer.alias("response"))


def lsp_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Definitions read back from answers of language servers, their paths looked up among the files."""
    got = responses.definitions(_answers(spark, d), _files(spark, d), "/work")
    return got.select("caller_file_id", "call_line", "callee_name", F.coalesce("def_file_id", F.lit(-1)).alias("def_file_id"), F.regexp_replace("def_file_path", "^/work/", "").alias("def_file_path"), "def_line").distinct()


def lsp_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Stored definitions after files of odd id were asked again and answered nothing."""
    rows = table(spark, d, "lsp_definitions").select("id", "caller_file_id", "callee_name").distinct()
    return responses.stored(rows, rows.limit(0), rows.where("caller_file_id % 2 = 1").select("caller_file_id"), "caller_file_id").select("id", "caller_file_id", "callee_name")


def vectors_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Squared lengths of vectors after every fifth was doubled and every seventh removed."""
    held = vectors.VectorStore(_vec(spark, d).select("id", "vec"), 64)
    double = held.vectors.where("id % 5 = 0").select("id", F.transform("vec", lambda x: x * F.lit(2.0).cast("float")).alias("vec"))
    rows = held.upsert(double).remove(held.vectors.where("id % 7 = 0").select("id")).vectors
    return rows.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 6).alias("square"))


def stale_removed(spark: SparkSession, d: str) -> DataFrame:
    """Files that stay when deleted ones are pruned."""
    files = table(spark, d, "files").select("id", "path", "deleted_at").distinct()
    return store.cascade(files.select("id", "path"), "id", files.where("deleted_at IS NOT NULL").select("id")).select("id", "path")


QUERIES = {
    f.__name__: f
    for f in (call_graph_callees, call_graph_callers, context_diff_aware, context_files, embedding_stats, default_model, lsp_parsed, lsp_replaced, vectors_upserted, stale_removed)
}

_LINE = "'  ' || kind || ' ' || name || CASE WHEN coalesce(signature, '') = '' OR signature = name THEN '' ELSE ' -- ' || signature END || chr(10)"
_TEXT = "'[FILE] ' || path || ' (' || count(symbol_id) || ' symbols)' || chr(10) || coalesce(string_agg(" + _LINE + ", '' ORDER BY line_start, symbol_id), '')"
ORACLE = {
    "call_graph_callees": _HEAD
    + ", d AS (SELECT DISTINCT caller_file_id, call_line, callee_name, def_file_id, def_line FROM lsp_definitions WHERE def_file_id IS NOT NULL), r AS (SELECT DISTINCT symbol_id, callee_name AS name, coalesce(f.path, '') AS path, coalesce(def_line, 0) AS line, 'lsp' AS source FROM d JOIN sym ON sym.file_id = d.caller_file_id AND call_line BETWEEN line_start AND line_end LEFT JOIN f ON f.file_id = d.def_file_id), e AS (SELECT DISTINCT caller_id AS symbol_id, callee_name AS name, path, line, 'tree-sitter-approximate' AS source FROM c JOIN f USING (file_id) WHERE caller_id IS NOT NULL) SELECT * FROM r UNION ALL SELECT * FROM e WHERE symbol_id NOT IN (SELECT symbol_id FROM r)",
    "call_graph_callers": _HEAD
    + ", w AS (SELECT DISTINCT callee_name, coalesce(s.name, 'unknown') AS name, coalesce(f.path, '') AS path, line FROM c LEFT JOIN sym s ON s.symbol_id = c.caller_id LEFT JOIN f ON f.file_id = s.file_id) SELECT sym.symbol_id, w.name, w.path, w.line FROM sym JOIN w ON w.callee_name = sym.name",
    "context_diff_aware": _HEAD + f", ch AS (SELECT DISTINCT path FROM files WHERE content_hash IS NULL) SELECT path, symbol_count, text, octet_length(encode(text)) // 4 AS estimated_tokens FROM (SELECT path, count(symbol_id) AS symbol_count, {_TEXT} AS text FROM loc WHERE path IN (SELECT path FROM ch) GROUP BY path)",
    "context_files": _HEAD + f" SELECT path, symbol_count, text, octet_length(encode(text)) // 4 AS estimated_tokens FROM (SELECT path, count(symbol_id) AS symbol_count, {_TEXT} AS text FROM f LEFT JOIN sym USING (file_id) WHERE path LIKE '%.go' GROUP BY path)",
    "embedding_stats": "WITH e AS (SELECT CAST(trunc(value * 1000000) AS BIGINT) AS v, ts, event_id FROM events), l AS (SELECT list(v ORDER BY v) AS s FROM (SELECT v FROM e ORDER BY ts DESC, event_id DESC LIMIT 100)), t AS (SELECT count(*) AS n, sum(v) AS t FROM e) SELECT len(s) AS sample_count, s[least(len(s) - 1, len(s) * 50 // 100) + 1] AS p50, s[least(len(s) - 1, len(s) * 99 // 100) + 1] AS p99, round(t / n / 1e6, 6) AS avg_ms, round(n * 1e9 / t, 6) AS throughput, CASE WHEN len(s) >= 10 AND s[least(len(s) - 1, len(s) * 50 // 100) + 1] > 20000000 THEN 'slow' ELSE 'ok' END AS health FROM l, t",
    "default_model": "SELECT id, dim, max_tokens FROM model_specs ORDER BY is_default DESC, id LIMIT 1",
    "lsp_parsed": "WITH f AS (SELECT DISTINCT id, path FROM files) SELECT DISTINCT caller_file_id, call_line, callee_name, coalesce(f.id, -1) AS def_file_id, def_file_path, def_line FROM lsp_definitions LEFT JOIN f ON f.path = def_file_path WHERE def_file_path IS NOT NULL AND def_line IS NOT NULL",
    "lsp_replaced": "SELECT DISTINCT id, caller_file_id, callee_name FROM lsp_definitions WHERE caller_file_id % 2 <> 1",
    "vectors_upserted": "SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * CASE WHEN vec_id % 5 = 0 THEN 4 ELSE 1 END, 6) AS square FROM embeddings WHERE vec_id % 7 <> 0",
    "stale_removed": "SELECT DISTINCT id, path FROM files WHERE id NOT IN (SELECT id FROM files WHERE deleted_at IS NOT NULL)",
}
