"""Source files that nobody wrote by hand (problem 3): vendored, generated, minified, or data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import by_slices
from quern.llm.winnow import COMMENT, NAME, NUMBER, STRING, TOKENS, Codes, fingerprints, self_repetition, token_codes
from quern.operators.skew import salt_of, salted_semi_join
from quern.plans.tables import cut_lineage

#: Thresholds; all apply alike to every file.
CONTAINED, LEAST_SHARED = 0.5, 6
RECURS, LEAST_REPOSITORIES, LEAST_PRINTS = 0.9, 4, 16
REPEATED, LEAST_TOKENS = 0.8, 90
LITERAL, LEAST_LITERALS = 0.6, 10
LONG_LINE, SHORT_NAME = 250, 2.6

#: Fingerprints of libraries up to which they are broadcast (16 bytes each).
MOST_BROADCAST = 1_000_000
#: Wordings by which programs mark what they write, in the languages of the corpus.
GENERATED = re.compile(
    r"@generated\b|<auto-?generated\b|\bauto-?generated (?:file|code|by|from)\b|\bgenerated (?:by|from|with|using) \S+.*(?:do not|don't|never|not be) (?:edit|modif|change)"
    r"|\b(?:file|code|source|module) (?:was|is|has been) (?:automatically |auto-?)(?:generated|produced|created|written)\b|\bcode generated by\b|\b(?:file|code|source|module) (?:was|is|has been) (?:auto-?)?(?:produced|generated|created|written|made) (?:by|with|from)\b|\bmachine[- ](?:made|generated|written) by\b|\b(?:this is )?(?:an? )?(?:automatically|auto-?)generated\b.*(?:edit|modif|change|lost)"
    r"|\b(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)\b|\b(?:erzeugt|generiert) (?:von|mit|aus)\b.*nicht (?:von hand )?(?:ändern|bearbeiten)|\barchivo (?:creado|generado|producido) (?:por|con|automáticamente)\b|\b(?:código|fichero) (?:creado|generado)\b.*\b(?:por|con|no editar|no modificar)\b"
    r"|\bfichier (?:est |a été )?(?:produit|généré|créé) (?:par|avec|à partir|automatiquement)\b|\bcode (?:est |a été )?généré\b",
    re.I,
)
#: What any of those wordings holds, in lower case.
_HINTS = ("generat", "generier", "generad", "erzeugt", "erstellt", "cread", "producid", "produit", "produced", "written by", "made by", "machine", "created", "généré", "créé")
_NO_MARK = re.compile(r"[{}%$]|\bstub\b|\b(?:first|initial(?:ly)?|draft|once|originally|since|by hand|edit freely|may be edited|reads? the|like|such as|not generated)\b", re.I)
_COMMENT_LINE = re.compile(r"^[ \t]*(?:///?|#+|/\*+|\*|--|<!--|\"\"\"|''')[ \t!]*(.*)$")


def _sentence(line: str, part: str) -> str:
    """The sentence of a line in which a part begins."""
    at = line.find(part[: len(line)])
    for m in re.finditer(r".+?(?:[.!?;](?=\s)|\Z)", line):
        if m.start() <= at < m.end():
            return m.group()
    return line


def marked(text: str) -> bool:
    """Whether a comment line of its own says that a program wrote the file. A mark with placeholders is a template; a stub or a draft since kept by hand is no mark."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return False
    for m in GENERATED.finditer(text):
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        line = _COMMENT_LINE.match(text[start : end if end >= 0 else len(text)].rstrip())
        if line and not _NO_MARK.search(_sentence(line.group(1), m.group())):
            return True
    return False


def minified(text: str, x: np.ndarray) -> bool:
    """Whether most code stands in very long lines of short names. Strings and comments, however long, make no line long."""
    if not any(len(line) > LONG_LINE for line in text.split("\n")):
        return False
    code = TOKENS.sub(lambda m: m.group() if m.group()[0] not in "\"'`/#" or len(m.group()) < 4 else ('""' if m.group()[0] in "\"'`" and m.group()[:3] not in ('"""', "'''") else ""), text)
    lines = [line for line in code.split("\n") if line.strip()]
    size = sum(map(len, lines))
    if not size or sum(len(line) for line in lines if len(line) > LONG_LINE) < 0.5 * size:
        return False
    names = [t for t in re.findall(r"[^\W\d]\w*", code)]
    return bool(names) and sum(map(len, names)) / len(names) < SHORT_NAME + 2.5 and code.count(" ") < 0.12 * size


def is_json(text: str) -> bool:
    """Whether the whole text is one JSON object or array."""
    t = text.strip()
    if t[:1] + t[-1:] not in ("{}", "[]"):
        return False
    try:
        json.loads(t)
    except (ValueError, RecursionError):
        return False
    return True


def features(text: str, codes: Codes) -> tuple[list[str], np.ndarray]:
    """Reasons why a file is not hand-written that can be seen in itself, and its fingerprints."""
    x = token_codes(text, codes)
    kind = x & np.uint64(7)
    n = int((kind != COMMENT).sum())
    names, literals = int((kind == NAME).sum()), int(((kind == NUMBER) | (kind == STRING)).sum())
    why = []
    if marked(text):
        why.append("generated")
    elif n >= LEAST_TOKENS and self_repetition(x) >= REPEATED:
        why.append("repetitive")
    if minified(text, x):
        why.append("minified")
    if is_json(text) or literals >= LEAST_LITERALS and literals >= LITERAL * (names + literals):
        why.append("data")
    return why, fingerprints(x)


def not_handwritten(documents: DataFrame, library: DataFrame) -> DataFrame:
    """(file_id, reasons): files that a program made, that were minified, copied from elsewhere, or are mere data.

    documents: (file_id, repository, text); library: (lib_file_id, text), third-party files as published.
    A file is a copy if at least CONTAINED of its fingerprints, and LEAST_SHARED of them, are those of one library
    file, or if RECURS of them recur in LEAST_REPOSITORIES repositories or more. Fingerprints are spread by their
    hash: states per (fingerprint, repository) are combined inside the map tasks, and what recurs is joined back
    in salted pieces, so that boilerplate found in a third of all files makes no long task.

    Null and empty texts give no row; each document of a file is judged by itself, repeated ones once; a file of too few tokens for a
    fingerprint is judged by itself alone; an empty library leaves the other rules.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            why, prints = [], []
            for t in b.column(3).to_pylist():
                w, f = features(t, codes)
                why.append(w)
                prints.append(f)
            offsets = np.zeros(len(prints) + 1, np.int32)
            np.cumsum([len(f) for f in prints], out=offsets[1:])
            packed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prints) if prints else np.zeros(0, np.int64)))
            return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(why, pa.list_(pa.string())), packed], ["file_id", "doc", "repository", "why", "prints"])

        yield from by_slices(one, batches, 3)

    schema = "file_id bigint, doc bigint, repository string, why array<string>, prints array<bigint>"
    rows = documents.where("text IS NOT NULL AND text <> ''").select("file_id", F.xxhash64("text").alias("doc"), "repository", "text")
    seen = rows.mapInArrow(look, schema)
    seen = cut_lineage(seen)  # each text is read and lexed once
    lib = library.select(F.col("lib_file_id").alias("file_id"), F.lit(0).cast("bigint").alias("doc"), F.lit("").alias("repository"), "text").where("text IS NOT NULL")
    lib = cut_lineage(lib.mapInArrow(look, schema).select(F.col("file_id").alias("lib_file_id"), F.explode("prints").alias("fp")).distinct())
    prints = seen.select("file_id", "doc", "repository", F.explode("prints").alias("fp"))
    sizes = seen.select("file_id", "doc", F.size("prints").alias("n_prints")).groupBy("file_id", "doc").agg(F.max("n_prints").alias("n_prints"))
    if lib.count() <= MOST_BROADCAST:
        met = prints.join(F.broadcast(lib), "fp")  # at most MOST_BROADCAST rows
    else:
        # a fingerprint that a library shares with a third of all files is met in pieces
        many = lib.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        met = prints.withColumn("_salt", salt_of(16, "file_id")).join(many, ["fp", "_salt"])
    shared = met.groupBy("file_id", "doc", "lib_file_id").agg(F.countDistinct("fp").alias("n"))
    copies = shared.groupBy("file_id", "doc").agg(F.max("n").alias("n")).join(sizes, ["file_id", "doc"]).where((F.col("n") >= LEAST_SHARED) & (F.col("n") >= CONTAINED * F.col("n_prints")))
    wide = prints.select("fp", "repository").distinct().groupBy("fp").agg(F.count("repository").alias("n")).where(F.col("n") >= LEAST_REPOSITORIES).select("fp")
    recurring = salted_semi_join(prints.select("file_id", "doc", "fp"), wide, ["fp"], ["file_id"]).groupBy("file_id", "doc").agg(F.countDistinct("fp").alias("n"))
    recurring = recurring.join(sizes, ["file_id", "doc"]).where((F.col("n_prints") >= LEAST_PRINTS) & (F.col("n") >= RECURS * F.col("n_prints")))
    reasons = (
        seen.select("file_id", F.explode("why").alias("reason"))
        .unionByName(copies.select("file_id", F.lit("library copy").alias("reason")))
        .unionByName(recurring.select("file_id", F.lit("recurs").alias("reason")))
    )
    return reasons.groupBy("file_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))  # at most six reasons
