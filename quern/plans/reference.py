"""Queries of the code-intelligence operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import FOLD_FROM, FOLD_TO, extension, like_anywhere, token_estimate
from quern.operators import context, extract, graph, search, stats, store, vectors
from quern.operators.fulltext import SearchIndex, index_of
from quern.plans.tables import shared_dir, table
from quern.sources.scan import ignored, language_of
from quern.streaming.debounce import debounced

RULES = ("vendor/", "third_party/", "node_modules/", "*.min.js", "dist/", "!dist/keep.js", "/generated/", "**/gen/", "build/*.o")


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").drop("indexed_at").distinct()


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", "path").distinct()


def _located(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).withColumnRenamed("id", "file_id")
    return _symbols(spark, d).withColumnRenamed("id", "symbol_id").join(files, "file_id")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "calls").drop("indexed_at").distinct()


_SYM = f"""
sym AS (SELECT DISTINCT id AS symbol_id, file_id, kind, name, signature, line_start, line_end, documentation FROM symbols),
f AS (SELECT DISTINCT id AS file_id, path FROM files),
loc AS (SELECT * FROM sym JOIN f USING (file_id)),
c AS (SELECT DISTINCT id, caller_id, callee_id, callee_name, file_id, line FROM calls),
tok AS (SELECT symbol_id,
  regexp_extract_all(translate(lower(coalesce(name, '')), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS tn,
  regexp_extract_all(translate(lower(coalesce(signature, '')), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS ts,
  regexp_extract_all(translate(lower(coalesce(documentation, '')), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS td FROM sym),
txt AS (SELECT symbol_id, len(tn) + len(ts) + len(td) AS dl, '  ' || array_to_string(tn, '  ') || '  ' AS xn, '  ' || array_to_string(ts, '  ') || '  ' AS xs, '  ' || array_to_string(td, '  ') || '  ' AS xd FROM tok)
"""


def _bm25_sql(patterns: list[tuple[str, str, bool]], match: str, top: int = 20) -> str:
    """patterns: (regex between double blanks, columns, scored); match: a condition over tf0, tf1, ..."""
    tf = ", ".join("(" + " + ".join(f"len(regexp_extract_all({c}, '{p}'))" for c in cols.split()) + f") AS tf{k}" for k, (p, cols, _) in enumerate(patterns))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(patterns)))
    idf = lambda k: f"(CASE WHEN ln((nr - df{k} + 0.5) / (df{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((nr - df{k} + 0.5) / (df{k} + 0.5)) END)"
    score = " + ".join(f"{idf(k)} * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k, (_, _, s) in enumerate(patterns) if s)
    return f"WITH {_SYM}, x AS (SELECT symbol_id, dl, {tf} FROM txt), st AS (SELECT count(*) AS nr, avg(dl) AS avgdl, {df} FROM x) SELECT symbol_id, round(-({score}), 6) AS rank FROM x, st WHERE {match} ORDER BY rank, symbol_id LIMIT {top}"


_ALL = "xn xs xd"


def _index(spark: SparkSession, d: str) -> SearchIndex:
    return index_of(spark, shared_dir(spark), _symbols(spark, d).withColumnRenamed("id", "symbol_id"), f"{d}/symbols.parquet")


def _search(query: str, top: int = 20):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _index(spark, d).bm25(search.parse(query))
        return rows.select("symbol_id", F.round("rank", 6).alias("rank")).orderBy("rank", "symbol_id").limit(top)

    run.__doc__ = f"BM25 over symbols: {query}"
    return run


def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A search without a hit falls back to a substring of the name."""
    return search.search_symbols(_located(spark, d), "ake_spoo OR zzzqqq", "", 15, _index(spark, d)).select("symbol_id", "name").unionByName(search.search_symbols(_located(spark, d), "andle_all", "", 15, _index(spark, d)).select("symbol_id", "name"))


def search_text_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A query that does not parse still looks into names and documentation."""
    return search.search_text(_located(spark, d), "oldest.to", 20, _index(spark, d)).unionByName(search.search_text(_located(spark, d), "lder than 1", 20, _index(spark, d))).select("symbol_id", "name")


def kind_only_list(spark: SparkSession, d: str) -> DataFrame:
    """An empty query lists a kind in order."""
    return search.search_symbols(_located(spark, d), "", "class", 25).select("symbol_id", "name", "rank")


def _vec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in _vec(spark, d).orderBy("id").first()["vec"]]


def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors to the first one."""
    return vectors.nearest(_vec(spark, d), _query_vector(spark, d), 10).select("id", F.round("dist", 6).alias("dist"))


def knn_l2_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among the vectors of one label, filtered before the ranking."""
    return vectors.nearest(_vec(spark, d), _query_vector(spark, d), 10, _vec(spark, d).where("label = 3")).select("id", F.round("dist", 6).alias("dist"))


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal-rank fusion of symbols by a word of the documentation and by name."""
    held = _index(spark, d)
    leg = lambda q: vectors.positions(held.bm25(search.parse(q)).select("symbol_id", F.round("rank", 6).alias("rank")).orderBy("rank", "symbol_id").limit(50), ["rank", "symbol_id"]).select("symbol_id", "position")
    return vectors.fuse(leg("documentation : retries*"), leg("name : spool*"), 30).select("symbol_id", F.round("score", 9).alias("score"), "provenance")


def mean_pool_norm(spark: SparkSession, d: str) -> DataFrame:
    """Unit mean of the vectors of each label, every seventh vector masked."""
    rows = _vec(spark, d).withColumn("mask", (F.col("id") % 7 != 0).cast("int"))
    pooled = vectors.mean_pool(rows, "label")
    return pooled.select("label", F.posexplode("vec").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files and symbols."""
    return stats.overview(_files(spark, d), _symbols(spark, d))


def language_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Files per language as stored."""
    return stats.language_breakdown(table(spark, d, "files").select("id", "language").distinct())


def index_health(spark: SparkSession, d: str) -> DataFrame:
    """Stored symbols against chunks with a text."""
    return stats.index_health(_symbols(spark, d).where("kind <> 'class'").select("id"), table(spark, d, "chunks").select("symbol_id", "text").distinct().where("text IS NOT NULL")).drop("message")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the last hundred event values."""
    return stats.latency(table(spark, d, "events").select(F.col("value").alias("v"), "ts", "event_id"), [F.desc("ts"), F.desc("event_id")]).select("sample_count", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def crash_window(spark: SparkSession, d: str) -> DataFrame:
    """Error events per user within three hours."""
    rows = table(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"))
    return stats.crash_window(rows, "user_id", 10_800, 3)


def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of events per user, closed after two quiet hours."""
    rows = debounced(table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), "ts"), "2 hours")
    return rows.select("path", F.unix_micros("started").alias("started"), F.unix_micros("settled").alias("settled"), "n_events")


def callees_located(spark: SparkSession, d: str) -> DataFrame:
    """What each caller calls, with the place."""
    return graph.callees(_calls(spark, d), _files(spark, d))


def callers_located(spark: SparkSession, d: str) -> DataFrame:
    """Who calls each name, with the place."""
    return graph.callers(_calls(spark, d), _symbols(spark, d), _files(spark, d))


def call_neighbours_depth2(spark: SparkSession, d: str) -> DataFrame:
    """Callees of callees by name, the list as one text."""
    return graph.neighbours(_calls(spark, d), _symbols(spark, d)).select("caller", "callee", F.array_join("depth2", ",").alias("depth2"))


def call_reach_depth3(spark: SparkSession, d: str) -> DataFrame:
    """Symbols within three calls of the first symbol that calls another."""
    edges = _calls(spark, d).where("caller_id IS NOT NULL AND callee_id IS NOT NULL").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).distinct()
    return graph.reachable(edges, edges.agg(F.min("src").alias("node")), 3)


def enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    """The outermost symbol around each definition's call."""
    points = table(spark, d, "lsp_definitions").select(F.col("id").alias("point_id"), F.col("caller_file_id").alias("file_id"), F.col("call_line").alias("line")).distinct()
    return graph.enclosing(points, _symbols(spark, d))


def definitions_between(spark: SparkSession, d: str) -> DataFrame:
    """Resolved calls within the lines of a symbol."""
    rows = table(spark, d, "lsp_definitions").drop("indexed_at").distinct()
    return graph.definitions_between(rows, _symbols(spark, d)).distinct()


def incoming_callers_tiered(spark: SparkSession, d: str) -> DataFrame:
    """Callers of each name: enclosing symbols of resolved calls first, else names from the call edges."""
    rows = table(spark, d, "lsp_definitions").where("def_file_id IS NOT NULL").select(F.col("id").alias("point_id"), F.col("caller_file_id").alias("file_id"), F.col("call_line").alias("line"), "callee_name").distinct()
    held = graph.enclosing(rows.select("point_id", "file_id", "line"), _symbols(spark, d)).join(rows.select("point_id", "callee_name"), "point_id")
    first = held.select("callee_name", F.col("symbol").alias("caller")).distinct()
    second = graph.callers(_calls(spark, d), _symbols(spark, d), _files(spark, d)).select("callee_name", F.col("caller_name").alias("caller")).distinct()
    return graph.tiered([("references", first), ("tree", second)], ["callee_name"])


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lsp_definitions").select(F.col("caller_file_id").alias("importer_file_id"), F.col("call_line").alias("import_line"), F.lit("import").alias("import_kind"), F.col("def_file_id").alias("target_file_id"), F.col("def_file_path").alias("target_file_path")).distinct()


def imports(spark: SparkSession, d: str) -> DataFrame:
    """Targets of each file's references: the resolved path, else the text."""
    return graph.imports(_dependencies(spark, d), _files(spark, d))


def imported_by(spark: SparkSession, d: str) -> DataFrame:
    """Files that refer to each file."""
    return graph.imported_by(_dependencies(spark, d), _files(spark, d))


def find_symbol_first(spark: SparkSession, d: str) -> DataFrame:
    """The first symbol of each name."""
    rows = _located(spark, d)
    best = rows.groupBy("name").agg(F.min_by("symbol_id", F.struct("path", "line_start", "symbol_id")).alias("symbol_id"))
    return best.select("name", "symbol_id")


def context_condensed(spark: SparkSession, d: str) -> DataFrame:
    """Summary of every file."""
    return context.condensed(_located(spark, d), _files(spark, d))


def context_detailed(spark: SparkSession, d: str) -> DataFrame:
    """Description of every symbol."""
    return context.detailed(_located(spark, d), _calls(spark, d))


def context_capped(spark: SparkSession, d: str) -> DataFrame:
    """Size of the summary of the first 200 symbols."""
    return context.summary(context.condensed(context.capped(_located(spark, d))))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Bytes over four of each document."""
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("estimated_tokens"))


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of functions and methods cut from the source texts, by hash."""
    texts = table(spark, d, "documents").where("kind = 'source' AND text IS NOT NULL").groupBy("file_id").agg(F.min("text").alias("text"))
    rows = context.chunks(_located(spark, d), texts)
    return rows.select("symbol_id", F.sha2(F.col("text"), 256).alias("chunk_hash"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each text."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.col("text"), 256).alias("hash"))


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose stored hash is not that of their last analysis."""
    old = table(spark, d, "files").select("id", "content_hash").distinct().select(F.col("id").cast("string").alias("path"), "content_hash")
    last = store.upsert_latest(table(spark, d, "analysis_results").select("file_id", "content_hash", "analysed_at"), ["file_id"], [F.col("analysed_at"), F.coalesce("content_hash", F.lit(""))])
    return store.changed_files(old, last.select(F.col("file_id").cast("string").alias("path"), "content_hash"))


def file_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest analysis of each file."""
    rows = table(spark, d, "analysis_results").select("file_id", "symbols_count", "calls_count", "analysed_at").distinct()
    return store.upsert_latest(rows, ["file_id"], [F.col("analysed_at"), F.col("symbols_count"), F.col("calls_count")]).select("file_id", "symbols_count", "calls_count")


def per_file_replace(spark: SparkSession, d: str) -> DataFrame:
    """Symbols after files of even id were indexed again without their classes."""
    rows = _symbols(spark, d).select("id", "file_id", "kind", "name")
    changed = rows.where("file_id % 2 = 0").select("file_id").distinct()
    return store.replace_files(rows, rows.where("file_id % 2 = 0 AND kind <> 'class'"), changed).select("id", "file_id", "kind", "name")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that remain once deleted files are gone."""
    gone = table(spark, d, "files").where("deleted_at IS NOT NULL").select("id")
    return store.cascade(_symbols(spark, d).select("id", "file_id", "name"), "file_id", gone).select("id", "file_id", "name")


def set_null_delete(spark: SparkSession, d: str) -> DataFrame:
    """Definitions whose deleted target was set to null."""
    gone = table(spark, d, "files").where("deleted_at IS NOT NULL").select("id")
    return store.set_null(table(spark, d, "lsp_definitions").select("id", "def_file_id").distinct(), "def_file_id", gone)


def intra_file_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Calls resolved within their file, the last symbol of a name winning."""
    return store.resolve_names(_calls(spark, d), _symbols(spark, d)).where("callee_id IS NOT NULL")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("kind = 'source' AND text IS NOT NULL").select("file_id", F.col("text").alias("content"))
    rows = docs.join(_files(spark, d).withColumnRenamed("id", "file_id"), "file_id").withColumn("language", language_of(F.col("path")))
    return rows.select("path", "language", "content").distinct()


def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each text by kind; those of texts that do not parse are one error."""
    return extract.facts(_texts(spark, d)).groupBy("path", "fact", "kind").agg(F.count(F.lit(1)).alias("n"))


def extracted_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports and includes of each text."""
    return extract.facts(_texts(spark, d)).where("fact = 'import'").select("path", "line", F.col("kind").alias("import_kind"), F.col("name").alias("target"))


def ignore_filter_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths that ordered ignore rules leave out; paths count from below the repository."""
    rows = _files(spark, d).withColumn("rel", F.regexp_replace("path", "^[^/]+/", ""))
    return rows.select("path", ignored(F.col("rel"), RULES).alias("ignored"))


def language_census(spark: SparkSession, d: str) -> DataFrame:
    """Files per language of the extension."""
    return _files(spark, d).select(language_of(F.col("path")).alias("language"), extension(F.col("path")).alias("ext")).groupBy("language", "ext").agg(F.count(F.lit(1)).alias("n"))


def like_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with a substring, ASCII case aside."""
    return _symbols(spark, d).where(like_anywhere(F.col("name"), "SPOOL_a")).select("id", "name")


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Documents and occurrences of each term of names and documentation."""
    rows = search.postings(_symbols(spark, d).withColumnRenamed("id", "symbol_id"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


QUERIES = {
    "bm25_prefix": _search("spool*"),
    "bm25_term": _search("retries"),
    "bm25_and": _search("spool AND lock*"),
    "bm25_or": _search("vault OR anchor*"),
    "bm25_not": _search("spool NOT closes"),
    "bm25_phrase": _search("oldest + to + new*"),
    "bm25_column": _search("name : spool*"),
} | {
    f.__name__: f
    for f in (
        search_fallback, search_text_fallback, kind_only_list, knn_l2, knn_l2_filtered, rrf_hybrid, mean_pool_norm, overview_counts, language_breakdown, index_health,
        latency_percentiles, crash_window, debounce_sessions, callees_located, callers_located, call_neighbours_depth2, call_reach_depth3, enclosing_symbol, definitions_between,
        incoming_callers_tiered, imports, imported_by, find_symbol_first, context_condensed, context_detailed, context_capped, token_estimates, code_chunks, content_hash,
        extracted_facts, extracted_imports, changed_files, file_upsert_latest, per_file_replace, cascade_delete, set_null_delete, intra_file_last_wins, ignore_filter_paths, language_census, like_names, term_frequencies,
    )
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD = "WITH " + _SYM
_ENCLOSING = """
pts AS (SELECT DISTINCT id AS point_id, caller_file_id AS file_id, call_line AS line, callee_name, def_file_id FROM lsp_definitions),
enc AS (SELECT p.point_id, arg_min({symbol_id: s.symbol_id, name: s.name}, (s.line_start, -s.line_end, s.symbol_id)) AS s
  FROM (SELECT DISTINCT point_id, file_id, line FROM pts) p JOIN sym s ON s.file_id = p.file_id AND p.line BETWEEN s.line_start AND s.line_end GROUP BY p.point_id)
"""
_DIST = "list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)), lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)) * (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE))))"
_LEG = "x{k} AS (SELECT symbol_id, dl, len(regexp_extract_all({c}, '{p}')) AS tf FROM txt), st{k} AS (SELECT count(*) AS nr, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM x{k}), leg{k} AS (SELECT symbol_id, row_number() OVER (ORDER BY r, symbol_id) - 1 AS position FROM (SELECT symbol_id, round(-((CASE WHEN ln((nr - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((nr - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS r FROM x{k}, st{k} WHERE tf > 0 ORDER BY r, symbol_id LIMIT 50))"

ORACLE = {
    "bm25_prefix": _bm25_sql([(" spool[^ ]* ", _ALL, True)], "tf0 > 0"),
    "bm25_term": _bm25_sql([(" retries ", _ALL, True)], "tf0 > 0"),
    "bm25_and": _bm25_sql([(" spool ", _ALL, True), (" lock[^ ]* ", _ALL, True)], "tf0 > 0 AND tf1 > 0"),
    "bm25_or": _bm25_sql([(" vault ", _ALL, True), (" anchor[^ ]* ", _ALL, True)], "tf0 > 0 OR tf1 > 0"),
    "bm25_not": _bm25_sql([(" spool ", _ALL, True), (" closes ", _ALL, False)], "tf0 > 0 AND tf1 = 0"),
    "bm25_phrase": _bm25_sql([(" oldest  to  new[^ ]* ", _ALL, True)], "tf0 > 0"),
    "bm25_column": _bm25_sql([(" spool[^ ]* ", "xn", True)], "tf0 > 0"),
    "search_fallback": _HEAD + f" SELECT symbol_id, name FROM (SELECT symbol_id, name FROM loc WHERE {_LOW.format('name')} LIKE '%ake_spoo or zzzqqq%' ORDER BY name, symbol_id LIMIT 15) UNION ALL SELECT symbol_id, name FROM (SELECT symbol_id, name FROM loc WHERE {_LOW.format('name')} LIKE '%andle_all%' ORDER BY name, symbol_id LIMIT 15)",
    "search_text_fallback": _HEAD + f" SELECT symbol_id, name FROM (SELECT symbol_id, name FROM loc WHERE {_LOW.format('name')} LIKE '%oldest.to%' OR {_LOW.format('documentation')} LIKE '%oldest.to%' ORDER BY name, symbol_id LIMIT 20) UNION ALL SELECT symbol_id, name FROM (SELECT symbol_id, name FROM loc WHERE {_LOW.format('name')} LIKE '%lder than 1%' OR {_LOW.format('documentation')} LIKE '%lder than 1%' ORDER BY name, symbol_id LIMIT 20)",
    "kind_only_list": _HEAD + " SELECT symbol_id, name, CAST(0 AS DOUBLE) AS rank FROM loc WHERE kind = 'class' ORDER BY path, line_start, symbol_id LIMIT 25",
    "knn_l2": f"SELECT vec_id AS id, round({_DIST}, 6) AS dist FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 10",
    "knn_l2_filtered": f"SELECT vec_id AS id, round({_DIST}, 6) AS dist FROM embeddings WHERE label = 3 ORDER BY {_DIST}, vec_id LIMIT 10",
    "rrf_hybrid": _HEAD + ", " + _LEG.format(k=0, c="xd", p=" retries[^ ]* ") + ", " + _LEG.format(k=1, c="xn", p=" spool[^ ]* ")
    + " SELECT symbol_id, round(sum(1.0 / (60 + position + 1)), 9) AS score, CASE WHEN count(DISTINCT leg) = 2 THEN 'both' ELSE min(leg) END AS provenance FROM (SELECT symbol_id, position, 'fts5' AS leg FROM leg0 UNION ALL SELECT symbol_id, position, 'vector' FROM leg1) GROUP BY symbol_id ORDER BY sum(1.0 / (60 + position + 1)) DESC, symbol_id LIMIT 30",
    "mean_pool_norm": """
WITH e AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
m AS (SELECT label, pos, coalesce(avg(CAST(x AS DOUBLE)) FILTER (vec_id % 7 <> 0), 0) AS x FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label)
SELECT label, pos, round(CASE WHEN norm >= 1e-12 THEN x / norm ELSE x END, 6) AS x FROM m JOIN n USING (label)""",
    "overview_counts": _HEAD + " SELECT (SELECT count(*) FROM f) AS n_files, (SELECT count(*) FROM sym) AS n_symbols",
    "language_breakdown": "SELECT language, count(*) AS n FROM (SELECT DISTINCT id, language FROM files) WHERE language IS NOT NULL AND language <> '' GROUP BY language",
    "index_health": _HEAD + ", k AS (SELECT (SELECT count(DISTINCT symbol_id) FROM sym WHERE kind <> 'class') AS stored, (SELECT count(*) FROM (SELECT DISTINCT symbol_id, text FROM chunks WHERE text IS NOT NULL)) AS indexed) SELECT stored, indexed, abs(indexed - stored) AS delta, CASE WHEN abs(indexed - stored) > greatest(10, stored * 5 // 100) AND (stored > 0 OR indexed > 0) THEN 'degraded' ELSE 'ok' END AS health FROM k",
    "latency_percentiles": "WITH l AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100), s AS (SELECT list_sort(list(value)) AS s, count(*) AS n FROM l) SELECT n AS sample_count, round(s[n * 50 // 100 + 1], 6) AS p50, round(s[n * 95 // 100 + 1], 6) AS p95, round(s[least(n - 1, n * 99 // 100) + 1], 6) AS p99 FROM s",
    "crash_window": "WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE event_type = 'error') SELECT user_id, event_id, n, n >= 3 AS unavailable FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 10800 PRECEDING AND CURRENT ROW) AS n FROM e)",
    "debounce_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 2 HOUR) AS settled, count(*) AS n_events FROM b GROUP BY user_id, g",
    "callees_located": _HEAD + " SELECT DISTINCT caller_id, callee_name, path, line FROM c JOIN f USING (file_id) WHERE caller_id IS NOT NULL",
    "callers_located": _HEAD + " SELECT DISTINCT callee_name, s.name AS caller_name, f.path, line FROM c JOIN sym s ON s.symbol_id = c.caller_id JOIN f ON f.file_id = s.file_id",
    "call_neighbours_depth2": _HEAD + ", e AS (SELECT DISTINCT name AS caller, callee_name AS callee FROM c JOIN sym ON symbol_id = caller_id) SELECT e.caller, e.callee, coalesce(string_agg(DISTINCT o.callee, ',' ORDER BY o.callee), '') AS depth2 FROM e LEFT JOIN e o ON o.caller = e.callee GROUP BY ALL",
    "call_reach_depth3": _HEAD + ", RECE AS (SELECT DISTINCT caller_id AS src, callee_id AS dst FROM c WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL), d0 AS (SELECT min(src) AS node FROM RECE), d1 AS (SELECT DISTINCT dst AS node FROM d0 JOIN RECE ON src = node), d2 AS (SELECT DISTINCT dst AS node FROM d1 JOIN RECE ON src = node), d3 AS (SELECT DISTINCT dst AS node FROM d2 JOIN RECE ON src = node) SELECT node, min(depth) AS depth FROM (SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3) GROUP BY node",
    "enclosing_symbol": _HEAD + "," + _ENCLOSING + " SELECT p.point_id, p.file_id, p.line, enc.s.symbol_id AS symbol_id, coalesce(enc.s.name, '<unknown>') AS symbol FROM (SELECT DISTINCT point_id, file_id, line FROM pts) p LEFT JOIN enc USING (point_id)",
    "definitions_between": _HEAD + " SELECT DISTINCT symbol_id, call_line, callee_name, coalesce(def_file_id, -1) AS def_file_id, coalesce(def_line, 0) AS def_line FROM lsp_definitions JOIN sym ON file_id = caller_file_id AND call_line BETWEEN line_start AND line_end",
    "incoming_callers_tiered": _HEAD + "," + _ENCLOSING + ", t1 AS (SELECT DISTINCT callee_name, coalesce(enc.s.name, '<unknown>') AS caller FROM pts LEFT JOIN enc USING (point_id) WHERE def_file_id IS NOT NULL), t2 AS (SELECT DISTINCT callee_name, name AS caller FROM c JOIN sym s ON s.symbol_id = c.caller_id JOIN f ON f.file_id = s.file_id) SELECT callee_name, caller, 'references' AS source FROM t1 UNION ALL SELECT callee_name, caller, 'tree' FROM t2 WHERE callee_name NOT IN (SELECT callee_name FROM t1)",
    "imports": _HEAD + ", dep AS (SELECT DISTINCT caller_file_id AS importer_file_id, call_line AS import_line, 'import' AS import_kind, def_file_id, def_file_path FROM lsp_definitions) SELECT importer_file_id, import_line, import_kind, coalesce(path, def_file_path, '') AS target FROM dep LEFT JOIN f ON file_id = def_file_id",
    "imported_by": _HEAD + ", dep AS (SELECT DISTINCT caller_file_id, call_line AS import_line, def_file_id, def_file_path FROM lsp_definitions) SELECT def_file_id AS target_file_id, path AS importer, import_line FROM dep JOIN f ON file_id = caller_file_id WHERE def_file_id IS NOT NULL",
    "find_symbol_first": _HEAD + " SELECT name, symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line_start, symbol_id) AS r FROM loc) WHERE r = 1",
    "context_condensed": _HEAD + " SELECT path, count(symbol_id) AS symbol_count, '[FILE] ' || path || ' (' || count(symbol_id) || ' symbols)' || chr(10) || coalesce(string_agg('  ' || kind || ' ' || name || CASE WHEN coalesce(signature, '') = '' OR signature = name THEN '' ELSE ' -- ' || signature END || chr(10), '' ORDER BY line_start, symbol_id), '') AS text FROM f LEFT JOIN sym USING (file_id) GROUP BY path",
    "context_detailed": _HEAD + ", o AS (SELECT caller_id AS symbol_id, string_agg(DISTINCT callee_name, ', ' ORDER BY callee_name) AS calls FROM c WHERE caller_id IS NOT NULL GROUP BY ALL), w AS (SELECT callee_name AS name, string_agg(DISTINCT s.name, ', ' ORDER BY s.name) AS called_by FROM c JOIN loc s ON s.symbol_id = c.caller_id GROUP BY callee_name) SELECT symbol_id, kind || ' ' || name || chr(10) || CASE WHEN coalesce(signature, '') <> '' THEN '  signature: ' || signature || chr(10) ELSE '' END || CASE WHEN coalesce(documentation, '') <> '' THEN '  doc: ' || CASE WHEN length(documentation) > 200 THEN substr(documentation, 1, 200) || '...' ELSE documentation END || chr(10) ELSE '' END || CASE WHEN coalesce(calls, '') <> '' THEN '  calls: ' || calls || chr(10) ELSE '' END || CASE WHEN coalesce(called_by, '') <> '' THEN '  called_by: ' || called_by || chr(10) ELSE '' END || '  lines: ' || line_start || '-' || line_end || chr(10) AS text FROM loc LEFT JOIN o USING (symbol_id) LEFT JOIN w USING (name)",
    "context_capped": _HEAD + ", k AS (SELECT * FROM loc ORDER BY path, line_start, symbol_id LIMIT 200), t AS (SELECT path, count(*) AS n, '[FILE] ' || path || ' (' || count(*) || ' symbols)' || chr(10) || string_agg('  ' || kind || ' ' || name || CASE WHEN coalesce(signature, '') = '' OR signature = name THEN '' ELSE ' -- ' || signature END || chr(10), '' ORDER BY line_start, symbol_id) AS text FROM k GROUP BY path) SELECT count(*) AS file_count, CAST(sum(n) AS BIGINT) AS symbol_count, CAST(sum(octet_length(encode(text)) // 4) AS BIGINT) AS estimated_tokens FROM t",
    "token_estimates": "SELECT doc_id, coalesce(octet_length(encode(text)) // 4, 0) AS estimated_tokens FROM documents",
    "code_chunks": _HEAD + ", t AS (SELECT file_id, min(text) AS text FROM documents WHERE kind = 'source' AND text IS NOT NULL GROUP BY file_id), k AS (SELECT *, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END AS n FROM loc JOIN t USING (file_id) WHERE kind IN ('function', 'method') AND line_start >= 1 AND line_start <= line_end) SELECT symbol_id, sha256('// ' || path || chr(10) || '// ' || kind || ': ' || name || coalesce(signature, '') || chr(10) || chr(10) || array_to_string(ls[line_start:least(line_end, n)], chr(10))) AS chunk_hash FROM k WHERE line_start <= n",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL",
    "changed_files": "WITH o AS (SELECT DISTINCT id, content_hash FROM files), l AS (SELECT file_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY analysed_at DESC, coalesce(content_hash, '') DESC) AS r FROM analysis_results) WHERE r = 1) SELECT CAST(coalesce(id, file_id) AS VARCHAR) AS path, CASE WHEN id IS NULL THEN 'added' WHEN file_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN l ON id = file_id WHERE id IS NULL OR file_id IS NULL OR o.content_hash IS DISTINCT FROM l.content_hash",
    "extracted_imports": r"""
WITH f AS (SELECT DISTINCT id AS file_id, path FROM files), t AS (SELECT DISTINCT path, text FROM documents JOIN f USING (file_id) WHERE kind = 'source' AND text IS NOT NULL),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM t),
x AS (
  SELECT path, line, 'import' AS import_kind, coalesce(nullif(regexp_extract(s, '^[ \t]*import[ \t]+([\w.]+)[ \t]*(\r?$|,|#)', 1), ''), regexp_extract(s, '^[ \t]*from[ \t]+([\w.]*\w[\w.]*)[ \t]+import\b', 1)) AS target FROM l WHERE regexp_matches(path, '\.pyi?$')
  UNION ALL
  SELECT path, line, 'include', coalesce(nullif(regexp_extract(s, '^[ \t]*#[ \t]*include[ \t]*<([^>]+)>', 1), ''), regexp_extract(s, '^[ \t]*#[ \t]*include[ \t]*"([^"]+)"', 1)) FROM l WHERE regexp_matches(path, '\.(c|h|cpp|cc|hpp)$')
  UNION ALL
  SELECT path, line, 'import', regexp_extract(s, '^[ \t]*import\b[^;]*?(?:from[ \t]*)?["'']([^"'']+)["'']', 1) FROM l WHERE regexp_matches(path, '\.(js|mjs|ts)$')
)
SELECT path, line, import_kind, target FROM x WHERE target <> ''""",
    "file_upsert_latest": "SELECT file_id, symbols_count, calls_count FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY analysed_at DESC, symbols_count DESC, calls_count DESC) AS r FROM analysis_results) WHERE r = 1",
    "per_file_replace": _HEAD + " SELECT symbol_id AS id, file_id, kind, name FROM sym WHERE file_id % 2 <> 0 OR kind <> 'class'",
    "cascade_delete": _HEAD + " SELECT symbol_id AS id, file_id, name FROM sym WHERE file_id NOT IN (SELECT id FROM files WHERE deleted_at IS NOT NULL)",
    "set_null_delete": "SELECT id, CASE WHEN def_file_id IN (SELECT id FROM files WHERE deleted_at IS NOT NULL) THEN NULL ELSE def_file_id END AS def_file_id FROM (SELECT DISTINCT id, def_file_id FROM lsp_definitions)",
    "intra_file_last_wins": _HEAD + ", l AS (SELECT file_id, name, arg_max(symbol_id, (line_start, symbol_id)) AS callee FROM sym GROUP BY ALL) SELECT id, callee AS callee_id FROM c JOIN l ON l.file_id = c.file_id AND l.name = c.callee_name",
    "ignore_filter_paths": "WITH r AS (SELECT DISTINCT path, regexp_replace(path, '^[^/]+/', '') AS rel FROM (SELECT DISTINCT id, path FROM files)) SELECT path, CASE WHEN regexp_matches(rel, '^build/[^/]*\\.o$') THEN true WHEN regexp_matches(rel, '^[^/]*[^/]*/gen/') THEN true WHEN regexp_matches(rel, '^generated/') THEN true WHEN rel = 'dist/keep.js' THEN false WHEN regexp_matches(rel, '(^|/)dist/') THEN true WHEN regexp_matches(rel, '\\.min\\.js$') THEN true WHEN regexp_matches(rel, '(^|/)(node_modules|third_party|vendor)/') THEN true ELSE false END AS ignored FROM r",
    "language_census": "SELECT CASE ext WHEN '.py' THEN 'python' WHEN '.pyi' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' WHEN '.cpp' THEN 'cpp' WHEN '.cc' THEN 'cpp' WHEN '.hpp' THEN 'cpp' WHEN '.rb' THEN 'ruby' END AS language, ext, count(*) AS n FROM (SELECT regexp_extract(path, '(\\.[^./]+)$', 1) AS ext FROM (SELECT DISTINCT id, path FROM files)) GROUP BY ALL",
    "like_names": _HEAD + f" SELECT symbol_id AS id, name FROM sym WHERE {_LOW.format('name')} LIKE '%spool_a%'",
    "term_frequencies": _HEAD + ", p AS (SELECT symbol_id, unnest(list_concat(list_concat(tn, ts), td)) AS term FROM tok) SELECT term, count(DISTINCT symbol_id) AS df, count(*) AS tf FROM p GROUP BY term",
}
