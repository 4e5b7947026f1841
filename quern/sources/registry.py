"""Small tables an engine reads and writes: models, status, configuration, schema versions."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scan import small_file

MODEL_SCHEMA = "id string, display_name string, dim int, max_tokens int, quantization string, is_default boolean"
#: Schema of the file a running engine reports itself in, with defaults.
STATUS = {"state": ("string", "stopped"), "pid": ("bigint", 0), "project": ("string", ""), "files_total": ("bigint", 0), "files_indexed": ("bigint", 0), "symbols": ("bigint", 0), "uptime_seconds": ("bigint", 0)}
#: Columns each version of the schema adds, by table; a table of an older version is read with nulls for what came later.
VERSIONS = {
    1: {"files": "id bigint, path string, language string, mtime_ns bigint, content_hash string, indexed_at timestamp"},
    2: {"symbols": "id bigint, file_id bigint, kind string, name string, signature string, line_start int, line_end int, documentation string"},
    3: {"calls": "id bigint, caller_id bigint, callee_id bigint, callee_name string, file_id bigint, line int"},
    4: {"cfg_nodes": "id bigint, symbol_id bigint, node_type string, condition string, line int, depth int", "dfg_edges": "id bigint, symbol_id bigint, edge_type string, lhs string, rhs_snippet string, line int"},
    5: {"lsp_definitions": "id bigint, caller_file_id bigint, call_line int, call_col int, callee_name string, def_file_id bigint, def_file_path string, def_line int, def_col int, source string"},
    6: {"lsp_call_hierarchy_callers": "callee_file_id bigint, callee_name string, callee_line int, caller_name string, caller_kind string, caller_file_id bigint, caller_file_path string, caller_line int, caller_col int", "lsp_dependencies": "importer_file_id bigint, import_line int, import_kind string, target_file_id bigint, target_file_path string"},
}


def find_model(models: DataFrame, model_id: str) -> DataFrame:
    """The model of that id, no row if there is none."""
    return models.where(F.col("id") == model_id).limit(1)


def default_model(models: DataFrame) -> DataFrame:
    """The first model marked as default, else the first, by id."""
    return models.orderBy(F.desc(F.coalesce("is_default", F.lit(False))), "id").limit(1)


def selected_model(config: str, key: str = "model") -> str | None:
    """The value of a key in the lines of a configuration text (key = "value"), null without one."""
    for line in config.splitlines():
        m = re.match(rf"\s*{re.escape(key)}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^#\s]+))", line)
        if m:
            return next(g for g in m.groups() if g is not None)
    return None


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """One row of a status file; missing fields have their defaults, and so has a missing or broken file."""
    schema = ", ".join(f"{n} {t}" for n, (t, _) in STATUS.items())
    rows = spark.createDataFrame([(small_file(spark, path),)], "value string").select(F.from_json("value", schema).alias("s"))
    return rows.select(*[F.coalesce(F.col("s")[n], F.lit(d).cast(t)).alias(n) for n, (t, d) in STATUS.items()])


def write_status(spark: SparkSession, path: str, **fields: object) -> None:
    """Replaces the status file by one with the given fields."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps({n: fields.get(n, d) for n, (_, d) in STATUS.items()}, indent=2), "utf-8"))
    out.close()


def schema_version(versions: DataFrame) -> DataFrame:
    """(version): the highest version noted, 0 without any."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def upgraded(df: DataFrame, table: str) -> DataFrame:
    """A table of any older version with the columns of the newest, null where it had none; further columns stay."""
    for tables in VERSIONS.values():
        for column in tables.get(table, "").split(", "):
            if column:
                name, kind = column.split(" ", 1)
                df = df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
    return df


def migrations(version: int) -> list[tuple[int, str]]:
    """(version, table) of what is still to be added to a store of a version, in order."""
    return [(v, t) for v, tables in sorted(VERSIONS.items()) if v > version for t in tables]
