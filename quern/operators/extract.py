"""Extraction of facts from source texts, file by file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.facts import imports, python_facts
from quern.functions.outline import LANGUAGES, outline

FACTS = (
    "path string, fact string, kind string, name string, owner string, signature string, documentation string, value string, line int, line_end int, depth int, error string"
)
_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


def facts(texts: DataFrame, members: bool = False) -> DataFrame:
    """One row per fact of each text (path, language, content): symbol, call, cfg, dfg, import or error.

    owner is the outermost symbol a fact lies in, an empty text if none. Python texts are parsed in full, those of
    the other thirteen languages are outlined by their tokens and brackets, whether they are valid or not. A Python
    text that does not parse gives an error row and its outline. Null texts give no row. Nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, language, text in b.itertuples(index=False):
                if language in LANGUAGES:
                    got = python_facts(text) if language == "python" else outline(text, language, members)
                    if got["error"]:
                        got = outline(text, language, members) | {"error": got["error"]}
                    out += [(path, "symbol", s["kind"], s["name"], "", s["signature"], s["documentation"], None, s["line_start"], s["line_end"], None, None) for s in got["symbols"]]
                    out += [(path, "call", "call", name, owner, None, None, None, line, line, None, None) for owner, name, line in got["calls"]]
                    out += [(path, "cfg", kind, None, owner, None, None, test, line, line, depth, None) for owner, kind, test, line, depth in got["cfg"]]
                    out += [(path, "dfg", kind, left, owner, None, None, right, line, line, None, None) for owner, kind, left, right, line in got["dfg"]]
                    if got["error"]:
                        out.append((path, "error", None, None, "", None, None, None, None, None, None, got["error"]))
                out += [(path, "import", kind, target, "", None, None, None, line, line, None, None) for line, kind, target in imports(text, language)]
            frame = pd.DataFrame(out, columns=_COLUMNS)
            yield frame.astype({"line": "Int32", "line_end": "Int32", "depth": "Int32"})

    return texts.where("content IS NOT NULL").select("path", "language", "content").mapInPandas(run, FACTS)


def symbols_of(rows: DataFrame) -> DataFrame:
    """Symbol rows of facts with ids in the order of path, line and name."""
    held = rows.where("fact = 'symbol'").select("path", "kind", "name", "signature", F.col("line").alias("line_start"), "line_end", "documentation")
    return held.withColumn("symbol_id", F.xxhash64("path", "kind", "name", "line_start").bitwiseAND((1 << 63) - 1))
