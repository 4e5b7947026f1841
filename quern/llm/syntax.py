"""Source files that do not parse (problem 2): token pairs, nesting and statements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.lexing import LANGUAGE_OF as LANGUAGE
from quern.llm.arrow import by_slices
from quern.llm.grammars import lexer
from quern.llm.parsing import WINDOW, neighbours, permitted, verdict, window_rest
from quern.plans.tables import cut_lineage


def lex_rows(documents: DataFrame, files: DataFrame, window: int = WINDOW) -> DataFrame:
    """(file_id, doc, language, window, pairs, rest): a row for each window of so many tokens of a document.

    pairs are the distinct classes side by side in the document (in its first window), rest is what the window
    leaves when its complete brackets are reduced by the productions.
    """
    paths = files.select(F.col("id").alias("file_id"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("ext")).where(F.col("ext").isin(list(LANGUAGE))).dropDuplicates(["file_id"])
    rows = documents.select("file_id", "text").where("text IS NOT NULL").join(paths, "file_id").select("file_id", F.xxhash64("text").alias("doc"), "ext", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for fid, doc, ext, text in zip(*(c.to_pylist() for c in b.columns)):
                lang = LANGUAGE[ext]
                classes = lexer(lang)(text)
                for w in range(0, max(1, len(classes)), window):
                    pairs = (sorted(neighbours(lang, classes)) if len(classes) > 1 else []) if w == 0 else []
                    out.append((fid, doc, lang, w // window, pairs, window_rest(lang, classes[w : w + window])))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file_id", "doc", "language", "window", "pairs", "rest"])

        yield from by_slices(one, batches, 3)

    return rows.mapInArrow(run, "file_id bigint, doc bigint, language string, window int, pairs array<string>, rest string")


def unparsable(documents: DataFrame, files: DataFrame, window: int = WINDOW) -> DataFrame:
    """(file_id, pairs, nesting, statements): files with a document that is no valid text of its extension's language, and why.

    The grammars fix everything: the pairs of classes that can stand side by side, against which the pairs of the
    documents are anti-joined (some thousands per language, so they are broadcast), and the productions by which
    brackets, blocks and statements are reduced, first within each window, then over the rests of a document's
    windows in their order. pairs counts the impossible pairs; nesting and statements are 1 where brackets or
    indents stay open and where the reduced text is no file of the language.

    Null texts and files of other extensions give no row; an empty text is valid. A file fetched twice is judged
    by all its documents; repeated rows count once. Documents without a file are left out.
    """
    spark = documents.sparkSession
    rows = cut_lineage(lex_rows(documents, files, window))  # each text is read and lexed once
    allowed = spark.createDataFrame([(lang, p) for lang in sorted(set(LANGUAGE.values())) for p in sorted(permitted(lang))], "language string, pair string")
    pairs = rows.select("file_id", "language", F.explode("pairs").alias("pair")).join(F.broadcast(allowed), ["language", "pair"], "left_anti")
    pairs = pairs.groupBy("file_id").agg(F.countDistinct("pair").alias("pairs"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fids, nesting, statements = [], [], []
            for fid, lang, rest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                bad = verdict(lang, rest)
                if bad:
                    fids.append(fid)
                    nesting.append(int(bad == "nesting"))
                    statements.append(int(bad == "statement"))
            yield pa.RecordBatch.from_arrays([pa.array(fids, pa.int64()), pa.array(nesting, pa.int32()), pa.array(statements, pa.int32())], ["file_id", "nesting", "statements"])

    # a document has one row per window; its rests are put side by side in their order
    whole = rows.groupBy("file_id", "doc", "language").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("window", "rest"))), lambda x: x["rest"]), "").alias("rest"))
    judged = whole.select("file_id", "language", "rest").mapInArrow(judge, "file_id bigint, nesting int, statements int")
    judged = judged.groupBy("file_id").agg(F.max("nesting").alias("nesting"), F.max("statements").alias("statements"))
    out = pairs.join(judged, "file_id", "full")
    return out.select("file_id", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("pairs", "nesting", "statements")])
