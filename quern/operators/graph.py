"""Call graph, control and data flow, dependencies: lookups as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_symbol(symbols: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The first symbol of exactly that name by (path, line_start, symbol_id), optionally of one file."""
    rows = symbols.where(F.col("name") == name)
    if path:
        rows = rows.where(F.col("path") == path)
    return rows.orderBy("path", "line_start", "symbol_id").limit(1)


def callees(calls: DataFrame, files: DataFrame, caller: Column | None = None) -> DataFrame:
    """(caller_id, callee_name, path, line), distinct: what each caller calls, with the place of the call."""
    rows = calls.where(F.col("caller_id").isNotNull() if caller is None else caller)
    return rows.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("caller_id", "callee_name", "path", "line").distinct()


def callers(calls: DataFrame, symbols: DataFrame, files: DataFrame, name: Column | None = None) -> DataFrame:
    """(callee_name, caller_name, path, line), distinct: who calls a name; symbols of one name are not told apart. Top-level calls have no caller."""
    rows = calls if name is None else calls.where(name)
    who = symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), F.col("file_id").alias("caller_file"))
    rows = rows.join(who, "caller_id").join(files.select(F.col("id").alias("caller_file"), "path"), "caller_file")
    return rows.select("callee_name", "caller_name", "path", "line").distinct()


def neighbours(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, callee, depth2): callees of each caller's callees by name, one further level, names sorted.

    The list of a name's callees is made once per name and then joined, not once per caller.
    """
    names = symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")).distinct()
    edges = calls.join(names, "caller_id").select("caller", F.col("callee_name").alias("callee")).distinct()
    onward = edges.groupBy(F.col("caller").alias("callee")).agg(F.array_sort(F.collect_list("callee")).alias("depth2"))
    return edges.join(onward, "callee", "left").select("caller", "callee", F.coalesce("depth2", F.array().cast("array<string>")).alias("depth2"))


def call_graph(calls: DataFrame, symbols: DataFrame, files: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """(symbol_id, direction, name, path, line, source): callees and callers of each symbol, for each direction of the first tier that has any.

    symbols: (id, file_id, name, line_start, line_end). Callees come from resolved definitions within the symbol's
    lines, else from the call edges; callers from the symbols around resolved calls to it, else from the edges that
    name it. A caller that is not known is 'unknown', a file that is not known an empty text.
    """
    named = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("own"))
    place = files.select(F.col("id").alias("file_id"), "path")
    out = callees(calls, files).select(F.col("caller_id").alias("symbol_id"), F.col("callee_name").alias("name"), "path", "line")
    who = calls.join(symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"), F.col("file_id").alias("caller_file")), "caller_id", "left")
    who = who.join(place.withColumnRenamed("file_id", "caller_file"), "caller_file", "left").select(F.col("callee_name").alias("own"), F.coalesce("caller", F.lit("unknown")).alias("name"), F.coalesce("path", F.lit("")).alias("path"), "line").distinct()
    tiers = [("tree-sitter-approximate", out.withColumn("direction", F.lit("callees")).unionByName(named.join(who, "own").drop("own").withColumn("direction", F.lit("callers"))))]
    if definitions is not None:
        held = definitions_between(definitions, symbols).where("def_file_id >= 0").join(place.withColumnRenamed("file_id", "def_file_id"), "def_file_id", "left")
        first = held.select("symbol_id", F.lit("callees").alias("direction"), F.col("callee_name").alias("name"), F.coalesce("path", F.lit("")).alias("path"), F.col("def_line").alias("line")).distinct()
        points = definitions.where("def_file_id IS NOT NULL").select(F.col("id").alias("point_id"), F.col("caller_file_id").alias("file_id"), F.col("call_line").alias("line"))
        around = enclosing(points, symbols).select("point_id", "symbol", "file_id", "line").join(place, "file_id", "left")
        to = definitions.where("def_file_id IS NOT NULL").select(F.col("id").alias("point_id"), F.col("callee_name").alias("own"), F.col("def_file_id").alias("own_file"))
        mine = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("own"), F.col("file_id").alias("own_file"))
        second = around.join(to, "point_id").join(mine, ["own", "own_file"]).select("symbol_id", F.lit("callers").alias("direction"), F.col("symbol").alias("name"), F.coalesce("path", F.lit("")).alias("path"), "line").distinct()
        tiers.insert(0, ("lsp", first.unionByName(second)))
    return tiered(tiers, ["symbol_id", "direction"]).select("symbol_id", "direction", "name", "path", "line", "source")


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within ``depth`` steps of the start nodes, at their least distance. edges: (src, dst)."""
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    level = seen
    for d in range(1, depth + 1):
        level = level.join(edges, level["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(d))
        seen = seen.unionByName(level)
    return seen.groupBy("node").agg(F.min("depth").alias("depth"))


def enclosing(points: DataFrame, symbols: DataFrame, bin_lines: int = 64) -> DataFrame:
    """points (point_id, file_id, line) with the outermost symbol whose lines hold them, null if none.

    A range join by bins of lines: a symbol goes to each bin it touches, so the join is an equi-join on file and
    bin and no file is ever compared with itself line by line.
    """
    spans = symbols.where("line_start <= line_end").select("file_id", F.col("id").alias("symbol_id"), "name", "line_start", "line_end")
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("line_start") / bin_lines), F.floor(F.col("line_end") / bin_lines))))
    rows = points.withColumn("_bin", F.floor(F.col("line") / bin_lines))
    hit = rows.join(spans, ["file_id", "_bin"]).where("line BETWEEN line_start AND line_end")
    best = hit.groupBy("point_id").agg(F.min_by(F.struct("symbol_id", "name"), F.struct("line_start", -F.col("line_end"), "symbol_id")).alias("s"))
    return points.join(best, "point_id", "left").select("point_id", "file_id", "line", F.col("s.symbol_id").alias("symbol_id"), F.coalesce(F.col("s.name"), F.lit("<unknown>")).alias("symbol"))


def definitions_between(definitions: DataFrame, symbols: DataFrame, bin_lines: int = 64) -> DataFrame:
    """(symbol_id, call_line, callee_name, def_file_id, def_line): resolved calls whose line lies within a symbol of the calling file.

    Joined by file and bin of lines, as in ``enclosing``.
    """
    spans = symbols.where("line_start <= line_end").select(F.col("id").alias("symbol_id"), F.col("file_id").alias("caller_file_id"), "line_start", "line_end")
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("line_start") / bin_lines), F.floor(F.col("line_end") / bin_lines))))
    rows = definitions.withColumn("_bin", F.floor(F.col("call_line") / bin_lines)).join(spans, ["caller_file_id", "_bin"]).where("call_line BETWEEN line_start AND line_end")
    return rows.select("symbol_id", "call_line", "callee_name", F.coalesce("def_file_id", F.lit(-1)).alias("def_file_id"), F.coalesce("def_line", F.lit(0)).alias("def_line"))


def tiered(tiers: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """The rows of the first tier that has any for a key, with ``source`` naming it: primary, else fallback, per key."""
    rows = None
    for n, (name, df) in enumerate(tiers):
        one = df.withColumn("source", F.lit(name)).withColumn("_tier", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    least = rows.groupBy(*keys).agg(F.min("_tier").alias("_least"))
    return rows.join(least, keys).where("_tier = _least").drop("_tier", "_least")


def imports(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(importer_file_id, import_line, import_kind, target): the resolved path of each import, else its text, else empty."""
    paths = files.select(F.col("id").alias("target_file_id"), "path")
    return dependencies.join(paths, "target_file_id", "left").select("importer_file_id", "import_line", "import_kind", F.coalesce("path", "target_file_path", F.lit("")).alias("target"))


def imported_by(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(target_file_id, importer, import_line): who imports each file."""
    paths = files.select(F.col("id").alias("importer_file_id"), F.col("path").alias("importer"))
    return dependencies.where("target_file_id IS NOT NULL").join(paths, "importer_file_id").select("target_file_id", "importer", "import_line")


def latest_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
