"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import docpairs, handwritten, mixture, neighbours, personal, split, syntax, tokens
from quern.plans.tables import table


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "chunk_vectors").select("model_id", F.col("symbol_id").alias("id"), "vec")
    return vectors, table(spark, sf_dir, "model_specs").select(F.col("id").alias("model_id"), "dim")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of a model with a cosine of at least 0.90, one among the 5 most similar of the other."""
    near = neighbours.similar_vectors(*_vectors(spark, sf_dir), k=5, min_cos=0.9)
    return near.select("model_id", F.least("id", "other").alias("symbol_id_a"), F.greatest("id", "other").alias("symbol_id_b")).distinct()


def p1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of every vector whose symbol_id is divisible by 50, against all vectors."""
    near = neighbours.similar_vectors(*_vectors(spark, sf_dir), k=5, queries=F.col("id") % 50 == 0)
    return near.select("model_id", F.col("id").alias("symbol_id"), F.col("other").alias("other_symbol_id"), F.round("cos", 6).alias("cosine"))


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that do not parse, with the number of impossible pairs and statements and whether brackets are left."""
    return syntax.unparsable(_sources(spark, sf_dir), table(spark, sf_dir, "files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of p2_flags."""
    return p2_flags(spark, sf_dir).select("file_id")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of files that do not parse per repository and language of the extension."""
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path").dropDuplicates(["file_id"])
    have = _sources(spark, sf_dir).where("text IS NOT NULL").select("file_id").distinct().join(files, "file_id")
    lang = F.create_map(*[F.lit(x) for kv in syntax.LANGUAGE.items() for x in kv])
    rows = have.withColumn("language", lang[F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))]).where("language IS NOT NULL")
    rows = rows.join(p2_found(spark, sf_dir).withColumn("bad", F.lit(1)), "file_id", "left")
    return rows.groupBy(F.split("path", "/")[0].alias("repository"), "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce("bad", F.lit(0))).alias("n_bad"), F.round(F.avg(F.coalesce("bad", F.lit(0))), 6).alias("rate"))


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files nobody wrote by hand, with the reasons."""
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), F.split("path", "/")[0].alias("repository")).dropDuplicates(["file_id"])
    return handwritten.not_handwritten(_sources(spark, sf_dir).join(files, "file_id"), table(spark, sf_dir, "library_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of p3_reasons."""
    return p3_reasons(spark, sf_dir).select("file_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk cut for every model: at most 4 bytes per token of max_tokens, a sixteenth of it overlapping."""
    specs = table(spark, sf_dir, "model_specs").select(F.col("id").alias("model_id"), (F.col("max_tokens") * 4).alias("limit"), F.expr("max_tokens * 4 div 16").cast("int").alias("overlap"))
    chunks = table(spark, sf_dir, "chunks").select("symbol_id", "text", "line_start").where("text IS NOT NULL").dropDuplicates(["symbol_id"])
    rows = chunks.crossJoin(F.broadcast(specs))  # four models, fixed
    return split.split_texts(rows, "text", ["model_id", "symbol_id"], "limit", "overlap", "line_start", 3)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that must be cut for a model: those the splitter gives more than one piece."""
    return p5_pieces(spark, sf_dir).where("n_pieces > 1 AND piece_no = 0").select("model_id", "symbol_id")


def p5_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chunk's pieces give when their own parts are put together again, by hash, and how many are over the limit."""
    specs = table(spark, sf_dir, "model_specs").select(F.col("id").alias("model_id"), (F.col("max_tokens") * 4).alias("limit"))
    own = F.substring("piece", F.col("own_start") - F.col("start_char") + 1, F.col("end_char") - F.col("own_start"))
    rows = p5_pieces(spark, sf_dir).join(F.broadcast(specs), "model_id")
    rows = rows.groupBy("model_id", "symbol_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("parts"), F.sum((F.octet_length("piece") > F.col("limit")).cast("int")).alias("n_over"))
    return rows.select("model_id", "symbol_id", F.sha2(F.array_join(F.transform("parts", lambda x: x["own"]), ""), 256).alias("hash"), "n_over")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("kind = 'source' AND file_id IS NOT NULL").select("file_id", "text")


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods with an informative description."""
    return docpairs.documented_functions(table(spark, sf_dir, "symbols"), _sources(spark, sf_dir), table(spark, sf_dir, "files"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the pairs of p7_pairs."""
    return p7_pairs(spark, sf_dir).select("symbol_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document by byte_bpe_50k."""
    return tokens.encode(table(spark, sf_dir, "documents"), "text", "doc_id")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each document's text after encoding and decoding."""
    ids = p8_ids(spark, sf_dir)
    return tokens.decode(ids, "ids", "doc_id").select("doc_id", F.sha2("text", 256).alias("hash"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = tokens.count_tokens(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    return mixture.mix(docs, table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their copies."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each listed source."""
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention of personal information in the documents."""
    return personal.personal_information(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with placeholders."""
    return personal.redacted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"))


QUERIES = {
    "p1_found": p1_found,
    "p1_search": p1_search,
    "p2_found": p2_found,
    "p2_flags": p2_flags,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_reasons": p3_reasons,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_joined": p5_joined,
    "p7_found": p7_found,
    "p7_pairs": p7_pairs,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

ORACLE = {
    "p5_joined": "SELECT DISTINCT m.id AS model_id, c.symbol_id, sha256(c.text) AS hash, CAST(0 AS BIGINT) AS n_over FROM chunks c, model_specs m WHERE c.text IS NOT NULL",
    "p8_roundtrip": "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents",
    "p5_found": "SELECT DISTINCT m.id AS model_id, c.symbol_id FROM chunks c, model_specs m WHERE c.text IS NOT NULL AND octet_length(encode(c.text)) > 4 * m.max_tokens",
}
