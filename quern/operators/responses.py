"""Answers of language servers as rows: definitions, callers and dependencies, with the upkeep of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import local_path, symbol_kind
from quern.operators.store import replace_files

_RANGE = "struct<start:struct<line:int,character:int>>"
_LOCATION = f"struct<uri:string,range:{_RANGE},targetUri:string,targetRange:{_RANGE},targetSelectionRange:{_RANGE}>"
_ITEM = f"struct<name:string,kind:int,uri:string,range:{_RANGE},selectionRange:{_RANGE}>"


def first_location(response: Column) -> Column:
    """{uri, range} of the first location of an answer that is one, a list of them, a list of links, or null; null where it has none."""
    many = F.from_json(response, f"array<{_LOCATION}>")
    one = F.coalesce(F.get(many, 0), F.from_json(response, _LOCATION))
    uri = F.coalesce(one["uri"], one["targetUri"])
    place = F.coalesce(one["range"], one["targetSelectionRange"], one["targetRange"])
    return F.when(uri.isNotNull(), F.struct(uri.alias("uri"), place.alias("range")))


def _by_path(rows: DataFrame, files: DataFrame, path: str, name: str, root: str) -> DataFrame:
    """rows with the id of the file at a path, null where it is not known."""
    known = files.select(F.col("path").alias("_known"), F.col("id").alias(name))
    inner = F.regexp_replace(F.col(path), "^" + root.rstrip("/") + "/", "") if root else F.col(path)
    return rows.withColumn("_known", inner).join(known, "_known", "left").drop("_known")


def definitions(responses: DataFrame, files: DataFrame, root: str = "", source: str = "lsp") -> DataFrame:
    """(caller_file_id, call_line, call_col, callee_name, def_file_id, def_file_path, def_line, def_col, source).

    responses: (caller_file_id, call_line, call_col, callee_name, response), the response as JSON. Lines of answers
    count from 0 and are given from 1. An answer without a place gives no row; a place in no known file keeps its path.
    """
    rows = responses.withColumn("_at", first_location(F.col("response"))).where("_at IS NOT NULL")
    rows = rows.withColumn("def_file_path", local_path(F.col("_at.uri"))).withColumn("def_line", F.col("_at.range.start.line") + 1).withColumn("def_col", F.col("_at.range.start.character"))
    rows = _by_path(rows, files, "def_file_path", "def_file_id", root)
    return rows.select("caller_file_id", "call_line", "call_col", "callee_name", "def_file_id", "def_file_path", "def_line", "def_col", F.lit(source).alias("source"))


def incoming_calls(responses: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(callee_file_id, callee_name, callee_line, caller_name, caller_kind, caller_file_id, caller_file_path, caller_line, caller_col).

    responses: (callee_file_id, callee_name, callee_line, response). One row for each range a caller calls from, one
    with null line and column where it names none.
    """
    calls = F.from_json("response", f"array<struct<from:{_ITEM},fromRanges:array<{_RANGE}>>>")
    rows = responses.select("callee_file_id", "callee_name", "callee_line", F.explode(calls).alias("c")).where("c.from.name IS NOT NULL")
    rows = rows.select("*", F.explode_outer("c.fromRanges").alias("r"))
    rows = rows.withColumn("caller_file_path", local_path(F.col("c.from.uri")))
    rows = _by_path(rows, files, "caller_file_path", "caller_file_id", root)
    return rows.select("callee_file_id", "callee_name", "callee_line", F.col("c.from.name").alias("caller_name"), symbol_kind(F.col("c.from.kind")).alias("caller_kind"), "caller_file_id", "caller_file_path", (F.col("r.start.line") + 1).alias("caller_line"), F.col("r.start.character").alias("caller_col"))


def dependencies(responses: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(importer_file_id, import_line, import_kind, target_file_id, target_file_path). responses: (importer_file_id, import_line, import_kind, response)."""
    rows = responses.withColumn("_at", first_location(F.col("response"))).where("_at IS NOT NULL").withColumn("target_file_path", local_path(F.col("_at.uri")))
    return _by_path(rows, files, "target_file_path", "target_file_id", root).select("importer_file_id", "import_line", "import_kind", "target_file_id", "target_file_path")


def stored(old: DataFrame, new: DataFrame, asked: DataFrame, owner: str) -> DataFrame:
    """What is kept of answers once files were asked again: their old rows go, the new ones come. asked: (owner)."""
    return replace_files(old, new, asked, owner)
