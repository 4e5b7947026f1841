"""The engine: one method per question, over typed fact tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import context, extract, graph, search, stats, vectors
from quern.operators.fulltext import SearchIndex
from quern.plans.tables import table
from quern.sources.scan import LANGUAGES, SCANNED, scan_folder
from quern.streaming.service import Remembered


@dataclass
class Engine:
    """Answers over symbols (symbol_id, file_id, path, kind, name, signature, documentation, line_start, line_end), files (id, path, language), calls, and optionally definitions and embeddings (id, vec)."""

    symbols: DataFrame
    files: DataFrame
    calls: DataFrame
    definitions: DataFrame | None = None
    embeddings: DataFrame | None = None
    hierarchy: DataFrame | None = None  # callers as language servers give them
    dependencies: DataFrame | None = None
    flow: DataFrame | None = None  # (symbol_id, node_type, condition, line, depth)
    data: DataFrame | None = None  # (symbol_id, edge_type, lhs, rhs_snippet, line)
    index: SearchIndex | None = None
    answers: Remembered = field(default_factory=Remembered)

    @classmethod
    def of_tables(cls, spark: SparkSession, folder: str) -> Engine:
        """The engine over a folder of Parquet tables; repeated rows count once."""
        files = table(spark, folder, "files").select("id", "path", "language").distinct()
        symbols = table(spark, folder, "symbols").drop("indexed_at").distinct().withColumnRenamed("id", "symbol_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
        return cls(symbols, files, table(spark, folder, "calls").drop("indexed_at").distinct(), table(spark, folder, "lsp_definitions").drop("indexed_at").distinct())

    @classmethod
    def of_folder(cls, spark: SparkSession, root: str, rules: tuple[str, ...] | None = None) -> Engine:
        """The engine over a source tree: scanned by the project's own rules, parsed and resolved within each file."""
        found = scan_folder(spark, root, rules, SCANNED)
        files = found.select(F.xxhash64("path").alias("id"), "path", "language")
        rows = extract.facts(found)
        symbols = extract.symbols_of(rows).withColumn("file_id", F.xxhash64("path"))
        names = symbols.groupBy("path", "name").agg(F.max_by("symbol_id", F.struct("line_start", "symbol_id")).alias("symbol_id"))
        owners = names.select("path", F.col("name").alias("owner"), F.col("symbol_id").alias("owner_id"))
        calls = rows.where("fact = 'call'").select("path", F.col("name").alias("callee_name"), "owner", "line")
        calls = calls.join(owners.withColumnRenamed("owner_id", "caller_id"), ["path", "owner"], "left")
        calls = calls.join(names.select("path", F.col("name").alias("callee_name"), F.col("symbol_id").alias("callee_id")), ["path", "callee_name"], "left")
        calls = calls.select(F.xxhash64("path", "callee_name", "line").alias("id"), "caller_id", "callee_id", "callee_name", F.xxhash64("path").alias("file_id"), "line")
        owned = rows.join(owners, ["path", "owner"])
        flow = owned.where("fact = 'cfg'").select(F.col("owner_id").alias("symbol_id"), F.col("kind").alias("node_type"), F.col("value").alias("condition"), "line", "depth")
        data = owned.where("fact = 'dfg'").select(F.col("owner_id").alias("symbol_id"), F.col("kind").alias("edge_type"), F.col("name").alias("lhs"), F.col("value").alias("rhs_snippet"), "line")
        imported = rows.where("fact = 'import'").select(F.xxhash64("path").alias("importer_file_id"), F.col("line").alias("import_line"), F.col("kind").alias("import_kind"), F.col("name").alias("target_file_path"))
        imported = imported.join(files.select(F.col("id").alias("target_file_id"), F.col("path").alias("target_file_path")), "target_file_path", "left")
        return cls(symbols, files, calls, dependencies=imported, flow=flow, data=data)

    def search_symbols(self, query: str, kind: str = "", limit: int = 20) -> DataFrame:
        return self.answers.get(("symbols", query, kind, limit), lambda: search.search_symbols(self.symbols, query, kind, limit, self.index))

    def search_text(self, query: str, limit: int = 20) -> DataFrame:
        return self.answers.get(("text", query, limit), lambda: search.search_text(self.symbols, query, limit, self.index))

    def search_hybrid(self, query: str, vector: list[float] | None = None, kind: str = "", language: str = "", limit: int = 20, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
        """Full text and vectors fused, with search_mode; without vectors full text alone, whose provenance is fts5.

        vector: that of the query, or embed makes it. kind filters the text leg only, language the vector leg before its
        ranking, by the files whose symbols have a vector.
        """
        found = self.search_symbols(query, kind, vectors.candidates(limit))
        leg = vectors.positions(found, ["rank", "symbol_id"]).select("symbol_id", "position")
        vector = embed(query) if vector is None and embed is not None else vector
        hybrid = vector is not None and self.embeddings is not None and not self.embeddings.isEmpty()
        if not hybrid:
            right = leg.limit(0)
        else:
            allowed = None
            if language:
                held = self.symbols.join(self.embeddings.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi")
                allowed = held.join(self.files.where(F.col("language") == language).select(F.col("id").alias("file_id")), "file_id").select(F.col("symbol_id").alias("id"))
            near = vectors.nearest(self.embeddings, vector, vectors.candidates(limit), allowed)
            right = vectors.positions(near.withColumnRenamed("id", "symbol_id"), ["dist", "symbol_id"]).select("symbol_id", "position")
        fused = vectors.fuse(leg, right, limit).join(self.symbols, "symbol_id")
        return fused.withColumn("search_mode", F.lit("hybrid" if hybrid else "fts5_only")).orderBy(F.desc("score"), "symbol_id")

    def get_context(self, paths: list[str] | None = None, max_symbols: int = 200, mode: str = "", detail: bool = False) -> DataFrame:
        """(path, symbol_count, text, estimated_tokens): the given files, only those changed ('diff_aware'), or the first symbols of all."""
        asked = None if paths is None else self.files.where(F.col("path").isin(paths)).select("path")
        return context.build(self.symbols, self.files, self.calls, mode or ("all" if paths is None else "files"), asked, detail, max_symbols)

    def get_file_summary(self, path: str) -> DataFrame:
        return self.get_context([path])

    def file_exists(self, path: str) -> DataFrame:
        """(found): one row."""
        return self.files.where(F.col("path") == path).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))

    def find_symbol(self, name: str, path: str = "") -> DataFrame:
        """The first symbol of exactly that name, with found; one row of nulls but for the name if there is none."""
        one = graph.first_symbol(self.symbols, name, path).withColumn("found", F.lit(True)).withColumn("asked", F.lit(name))
        asked = self.symbols.sparkSession.createDataFrame([(name,)], "asked string")
        return asked.join(one, "asked", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def get_function_detail(self, name: str, path: str = "") -> DataFrame:
        """One row: found, the symbol's fields, its description as text, its callees and callers by name (repeated ones kept), as lists."""
        one = self.find_symbol(name, path)
        one = one.join(context.detailed(self.symbols, self.calls), "symbol_id", "left")
        out = self.calls.select(F.col("caller_id").alias("symbol_id"), "callee_name").join(one.select("symbol_id"), "symbol_id").agg(F.array_sort(F.collect_list("callee_name")).alias("callees"))
        who = self.calls.where(F.col("callee_name") == name).join(self.symbols.select(F.col("symbol_id").alias("caller_id"), F.col("name").alias("caller")), "caller_id")
        who = who.agg(F.array_sort(F.collect_list("caller")).alias("callers"))
        return one.crossJoin(F.broadcast(out)).crossJoin(F.broadcast(who))  # one row each

    def _edges(self, name: str, path: str = "") -> tuple[DataFrame, DataFrame]:
        one = graph.first_symbol(self.symbols, name, path)
        every = self.symbols.withColumnRenamed("symbol_id", "id")
        return one, graph.call_graph(self.calls, every, self.files, self.definitions)

    def get_call_graph(self, name: str, direction: str = "both", depth: int = 1) -> DataFrame:
        """(direction, name, path, line, source, depth2) of the first symbol of the name, by line.

        Resolved definitions come before the call edges. depth over 1 adds to each callee of the call edges the names
        it calls itself; further levels are not given.
        """
        one, edges = self._edges(name)
        rows = edges.join(one.select("symbol_id"), "symbol_id", "left_semi")
        rows = rows if direction == "both" else rows.where(F.col("direction") == direction)
        if depth > 1:
            onward = graph.neighbours(self.calls, self.symbols.withColumnRenamed("symbol_id", "id")).where(F.col("caller") == name).select(F.col("callee").alias("name"), "depth2")
            rows = rows.join(onward, "name", "left").withColumn("depth2", F.when((F.col("direction") == "callees") & (F.col("source") == "tree-sitter-approximate"), F.col("depth2")))
        else:
            rows = rows.withColumn("depth2", F.lit(None).cast("array<string>"))
        return rows.select("direction", "name", "path", "line", "source", "depth2").orderBy("direction", "line", "name")

    def get_control_flow(self, name: str, path: str = "") -> DataFrame:
        """(node_type, condition, line, depth) of the first symbol of the name, by line."""
        one = graph.first_symbol(self.symbols, name, path).select("symbol_id")
        return self.flow.join(one, "symbol_id", "left_semi").drop("symbol_id").orderBy("line", "depth")

    def get_data_flow(self, name: str, path: str = "") -> DataFrame:
        """(edge_type, lhs, rhs_snippet, line) of the first symbol of the name, by line."""
        one = graph.first_symbol(self.symbols, name, path).select("symbol_id")
        return self.data.join(one, "symbol_id", "left_semi").drop("symbol_id").orderBy("line", "lhs")

    def get_dependencies(self, path: str) -> DataFrame:
        """One row: found, imports [(line, kind, target)] by line and imported_by [(path, line)] by path; empty lists for an unknown file."""
        one = self.files.where(F.col("path") == path).select("id").limit(1)
        out = graph.imports(self.dependencies, self.files).join(one.withColumnRenamed("id", "importer_file_id"), "importer_file_id", "left_semi")
        out = out.agg(F.array_sort(F.collect_list(F.struct(F.col("import_line").alias("line"), F.col("import_kind").alias("kind"), "target"))).alias("imports"))
        who = graph.imported_by(self.dependencies, self.files).join(one.withColumnRenamed("id", "target_file_id"), "target_file_id", "left_semi")
        who = who.agg(F.array_sort(F.collect_list(F.struct(F.col("importer").alias("path"), F.col("import_line").alias("line")))).alias("imported_by"))
        return self.file_exists(path).crossJoin(F.broadcast(out)).crossJoin(F.broadcast(who))  # one row each

    def get_incoming_callers(self, name: str) -> DataFrame:
        """(caller, path, line, source): callers as language servers give them, else by enclosing symbols of resolved calls, else by the call edges."""
        place = self.files.select(F.col("id").alias("file_id"), "path")
        nowhere = (F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"))
        names = graph.callers(self.calls, self.symbols.withColumnRenamed("symbol_id", "id"), self.files, F.col("callee_name") == name).select("callee_name", F.col("caller_name").alias("caller"), *nowhere).distinct()
        tiers = [("tree-sitter-approximate", names)]
        if self.definitions is not None:
            rows = self.definitions.where((F.col("callee_name") == name) & F.col("def_file_id").isNotNull())
            points = rows.select(F.col("id").alias("point_id"), F.col("caller_file_id").alias("file_id"), F.col("call_line").alias("line"))
            held = graph.enclosing(points, self.symbols.withColumnRenamed("symbol_id", "id")).join(place, "file_id", "left").select(F.lit(name).alias("callee_name"), F.col("symbol").alias("caller"), "path", "line").distinct()
            tiers.insert(0, ("lsp-references", held))
        if self.hierarchy is not None:
            rows = self.hierarchy.where(F.col("callee_name") == name).join(place.withColumnRenamed("file_id", "caller_file_id"), "caller_file_id", "left")
            rows = rows.select("callee_name", F.col("caller_name").alias("caller"), F.coalesce("path", "caller_file_path").alias("path"), F.col("caller_line").alias("line"))
            tiers.insert(0, ("lsp-call-hierarchy", rows))
        return graph.tiered(tiers, ["callee_name"]).select("caller", "path", "line", "source").orderBy("path", "line", "caller")

    def get_project_overview(self) -> DataFrame:
        """One row: numbers of files and symbols, files per language, and what is supported per language."""
        langs = stats.language_breakdown(self.files).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
        # fixed values: what is published as supported, the same for all languages
        levels = F.struct(F.lit(True).alias("l1_ast"), F.lit(True).alias("l2_call_graph"), F.lit(False).alias("l3_cfg"), F.lit(False).alias("l4_dfg"), F.lit(False).alias("l5_pdg"))
        support = F.create_map(*[x for lang in sorted(set(LANGUAGES.values())) for x in (F.lit(lang), levels)])
        return stats.overview(self.files, self.symbols).crossJoin(F.broadcast(langs)).withColumn("language_support", support)  # one row each

    def get_language_breakdown(self) -> DataFrame:
        return stats.language_breakdown(self.files)

    def get_embedding_stats(self, samples: DataFrame, order: list) -> DataFrame:
        """Latency of embedding (samples with v in nanoseconds) and whether vectors and symbols agree."""
        held = self.embeddings if self.embeddings is not None else self.symbols.limit(0).select(F.col("symbol_id").alias("id"))
        health = stats.index_health(self.symbols.select(F.col("symbol_id").alias("id")), held).withColumnRenamed("health", "index_health")
        return stats.embedding_stats(samples, order).crossJoin(F.broadcast(health))  # one row each


def as_json(rows: DataFrame, name: str) -> DataFrame:
    """One row with all rows as a JSON object {name: [...], "count": n}, in their order; for short answers."""
    shaped = rows.select(F.monotonically_increasing_id().alias("_n"), F.struct(*rows.columns).alias("_r"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_r"))), lambda x: x["_r"])
    return shaped.agg(F.to_json(F.struct(listed.alias(name), F.count(F.lit(1)).alias("count"))).alias("json"))
