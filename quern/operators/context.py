"""Token-efficient summaries of files and symbols, and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import token_estimate


def condensed(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, symbol_count, text): a head line per file and a line per symbol in order; files without symbols too if given.

    symbols: (path, kind, name, signature, line_start, symbol_id), one row each. The signature is left out where it is empty or the name.
    """
    sig = F.when(F.coalesce("signature", F.lit("")).isin("") | (F.col("signature") == F.col("name")), "").otherwise(F.concat(F.lit(" -- "), "signature"))
    line = F.concat(F.lit("  "), "kind", F.lit(" "), "name", sig, F.lit("\n"))
    rows = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("symbol_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "symbol_id", line.alias("t")))), lambda x: x["t"]), "").alias("body"))
    if files is not None:
        rows = files.select("path").distinct().join(rows, "path", "left").fillna(0, ["symbol_count"]).fillna("", ["body"])
    head = F.concat(F.lit("[FILE] "), "path", F.lit(" ("), F.col("symbol_count").cast("string"), F.lit(" symbols)\n"))
    return rows.select("path", "symbol_count", F.concat(head, "body").alias("text"))


def detailed(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(symbol_id, text): signature, documentation up to 200 characters, calls, callers and lines of each symbol."""
    # repeated edges go inside the map tasks, so that a hot name brings each of its callers once
    out = calls.where("caller_id IS NOT NULL").select(F.col("caller_id").alias("symbol_id"), "callee_name").distinct()
    out = out.groupBy("symbol_id").agg(F.array_join(F.array_sort(F.collect_list("callee_name")), ", ").alias("calls"))
    who = calls.join(symbols.select(F.col("symbol_id").alias("caller_id"), F.col("name").alias("caller")), "caller_id").select(F.col("callee_name").alias("name"), "caller").distinct()
    who = who.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("caller")), ", ").alias("called_by"))
    rows = symbols.join(out, "symbol_id", "left").join(who, "name", "left")
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {label}: "), c, F.lit("\n"))).otherwise("")
    doc = F.when(F.length("documentation") > 200, F.concat(F.substring("documentation", 1, 200), F.lit("..."))).otherwise(F.col("documentation"))
    text = F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.lit("\n"), part("signature", F.col("signature")), part("doc", doc), part("calls", F.col("calls")), part("called_by", F.col("called_by")), F.lit("  lines: "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("\n"))
    return rows.select("symbol_id", text.alias("text"))


def build(symbols: DataFrame, files: DataFrame, calls: DataFrame | None = None, mode: str = "all", paths: DataFrame | None = None, detail: bool = False, max_symbols: int = 200) -> DataFrame:
    """(path, symbol_count, text, estimated_tokens) of a context.

    mode: 'all' takes the first max_symbols of all files, 'files' the given paths with known files that have no
    symbols, 'diff_aware' the given changed paths only, and nothing without any. paths: (path). detail: describe each
    symbol with its calls and callers instead of a line for each.
    """
    if mode == "diff_aware" and paths is None:
        held, shown = symbols.limit(0), None
    elif mode == "all" or paths is None:
        held, shown = capped(symbols, max_symbols), None
    else:
        held = symbols.join(paths.select("path").distinct(), "path", "left_semi")
        shown = files.join(paths.select("path").distinct(), "path", "left_semi") if mode == "files" else None
    rows = condensed(held, shown)
    if detail and calls is not None:
        parts = detailed(symbols, calls).join(held.select("symbol_id", "path", "line_start"), "symbol_id")
        parts = parts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "symbol_id", "text"))), lambda x: x["text"]), "").alias("body"))
        rows = rows.join(parts, "path", "left").select("path", "symbol_count", F.concat(F.substring_index("text", "\n", 1), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("text"))
    return rows.withColumn("estimated_tokens", token_estimate(F.col("text")))


def capped(symbols: DataFrame, most: int = 200) -> DataFrame:
    """The first symbols by (path, line_start, symbol_id): the limit of a summary of all files."""
    return symbols.orderBy("path", "line_start", "symbol_id").limit(most)


def summary(parts: DataFrame) -> DataFrame:
    """(file_count, symbol_count, estimated_tokens) of condensed parts."""
    return parts.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("symbol_count"), F.coalesce(F.sum(token_estimate(F.col("text"))), F.lit(0)).alias("estimated_tokens"))


def chunk_text(path: Column, kind: Column, name: Column, signature: Column, body: Column) -> Column:
    """A chunk: two comment lines, a blank one and the body."""
    return F.concat(F.lit("// "), path, F.lit("\n// "), kind, F.lit(": "), name, F.coalesce(signature, F.lit("")), F.lit("\n\n"), body)


def chunks(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(symbol_id, path, text): functions and methods with the lines of their file's text; bad ranges give no row.

    symbols: (symbol_id, file_id, path, kind, name, signature, line_start, line_end); texts: (file_id, text).
    """
    spans = symbols.where(F.col("kind").isin("function", "method") & (F.col("line_start") >= 1) & (F.col("line_start") <= F.col("line_end")))
    # a text is split once and meets the list of its file's spans, not every span by itself
    held = spans.groupBy("file_id").agg(F.collect_list(F.struct("symbol_id", "path", "kind", "name", "signature", "line_start", "line_end")).alias("spans"))
    cut = texts.join(held, "file_id").select("spans", F.split("text", "\n").alias("lines"), F.col("text").endswith("\n").cast("int").alias("_end"))
    cut = cut.withColumn("_n", F.size("lines") - F.col("_end"))
    body = lambda s: F.array_join(F.slice(F.col("lines"), s["line_start"], F.least(s["line_end"], F.col("_n")) - s["line_start"] + 1), "\n")
    cut = cut.select(F.transform(F.filter("spans", lambda s: s["line_start"] <= F.col("_n")), lambda s: F.struct(s["symbol_id"].alias("symbol_id"), s["path"].alias("path"), chunk_text(s["path"], s["kind"], s["name"], s["signature"], body(s)).alias("text"))).alias("made"))
    return cut.select(F.explode("made").alias("m")).select("m.*")
