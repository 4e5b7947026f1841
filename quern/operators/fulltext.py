"""A kept inverted index of symbols: built once, searched by term, updated file by file."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators.search import B, COLUMNS, K1, Node, Phrase, _match, _phrases


@dataclass
class SearchIndex:
    """Generations of postings (term, symbol_id, col, pos), documents (symbol_id, file_id, dl) and replaced files below a folder.

    Postings are sorted by term, so a search reads the row groups that hold its terms and nothing else. A file that
    is indexed again gets a generation of its own, and a document counts only if no later generation replaces its file.
    """

    spark: SparkSession
    folder: str

    # ---- writing ----

    def _write(self, df: DataFrame, part: str, gen: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/gen={gen:06d}/{part}")

    def _generation(self, symbols: DataFrame, gen: int) -> None:
        """symbols: (symbol_id, file_id, name, signature, documentation), one row each."""
        toks = symbols.select("symbol_id", "file_id", *[tokens(F.col(c)).alias(c) for c in COLUMNS])
        size = reduce(lambda a, b: a + b, [F.size(c) for c in COLUMNS])
        self._write(toks.select("symbol_id", "file_id", size.alias("dl")), "documents", gen)

        def cell(n: int):  # noqa: ANN202
            return lambda t, i: F.struct(t.alias("term"), F.lit(n).cast("byte").alias("col"), i.alias("pos"))

        cells = F.concat(*[F.transform(F.col(c), cell(n)) for n, c in enumerate(COLUMNS)])
        rows = toks.select("symbol_id", F.explode(cells).alias("c")).select("c.term", "symbol_id", "c.col", "c.pos")
        self._write(rows.repartitionByRange("term").sortWithinPartitions("term", "symbol_id"), "postings", gen)

    def build(self, symbols: DataFrame) -> SearchIndex:
        """The index of all symbols, as its first generation."""
        self._generation(symbols, 0)
        self._write(symbols.select("file_id").limit(0), "replaced", 0)
        return self

    def update(self, symbols: DataFrame, files: DataFrame) -> SearchIndex:
        """Replaces what the index holds of the files (file_id) by these symbols of theirs; a file without any is removed."""
        gen = self.generations()[-1] + 1
        self._generation(symbols, gen)
        self._write(files.select("file_id").distinct(), "replaced", gen)
        return self

    def compact(self, folder: str) -> SearchIndex:
        """The same index as one generation in another folder."""
        other = SearchIndex(self.spark, folder)
        docs = self.documents()
        other._write(docs.select("symbol_id", "file_id", "dl"), "documents", 0)
        held = self._read("postings").join(docs.select("gen", "symbol_id"), ["gen", "symbol_id"]).select("term", "symbol_id", "col", "pos")
        other._write(held.repartitionByRange("term").sortWithinPartitions("term", "symbol_id"), "postings", 0)
        other._write(docs.select("file_id").limit(0), "replaced", 0)
        return other

    # ---- reading ----

    def _files(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """Numbers of the complete generations."""
        path, fs = self._files()
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[4:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("gen=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "replaced/_SUCCESS")))

    def _read(self, part: str) -> DataFrame:
        schema = {"postings": "term string, symbol_id bigint, col byte, pos int", "documents": "symbol_id bigint, file_id bigint, dl int", "replaced": "file_id bigint"}[part]
        one = [self.spark.read.schema(schema).parquet(f"{self.folder}/gen={g:06d}/{part}").withColumn("gen", F.lit(g)) for g in self.generations()]
        return reduce(DataFrame.unionByName, one)

    def documents(self) -> DataFrame:
        """(gen, symbol_id, file_id, dl) of what counts."""
        docs = self._read("documents")
        if len(self.generations()) == 1:
            return docs
        last = self._read("replaced").groupBy("file_id").agg(F.max("gen").alias("_last"))
        return docs.join(last, "file_id", "left").where("_last IS NULL OR gen >= _last").drop("_last")

    def bm25(self, query: Node | Phrase) -> DataFrame:
        """(symbol_id, rank) of the symbols that match; smaller (more negative) ranks are better.

        The words of the query are looked up in the postings; the words of a phrase must stand in a row. Only rows
        of the query's terms are read and shuffled.
        """
        phrases = _phrases(query)
        wanted, hits = [], []
        for k, (p, _) in enumerate(phrases):
            for i, w in enumerate(p.words):
                test = F.col("term").startswith(w) if p.prefix and i == len(p.words) - 1 else F.col("term") == w
                wanted.append(test)
                if len(p.columns) < len(COLUMNS):
                    test = test & F.col("col").isin([COLUMNS.index(c) for c in p.columns])
                hits.append(F.when(test, F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), (F.col("pos") - i).alias("start"))))
        rows = self._read("postings").where(reduce(lambda a, b: a | b, wanted))
        rows = rows.select("gen", "symbol_id", "col", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("gen", "symbol_id", "col", "h.*")
        if all(len(p.words) == 1 for p, _ in phrases):
            found = rows
        else:
            sizes = F.array(*[F.lit(len(p.words)) for p, _ in phrases])
            found = rows.groupBy("gen", "symbol_id", "col", "k", "start").agg(F.count_distinct("i").alias("n")).where(F.col("n") == F.get(sizes, F.col("k")))
        tf = found.groupBy("gen", "symbol_id").agg(*[F.count(F.when(F.col("k") == k, 1)).alias(f"tf{k}") for k in range(len(phrases))])
        docs = self.documents()
        tf = tf.join(docs.select("gen", "symbol_id", "dl"), ["gen", "symbol_id"])
        # one row each
        size = docs.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("dl").alias("avgdl"))
        stats = tf.agg(*[F.count(F.when(F.col(f"tf{k}") > 0, 1)).alias(f"df{k}") for k in range(len(phrases))])
        rows = tf.where(_match(query, {id(p): k for k, (p, _) in enumerate(phrases)})).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(size))
        return rows.select("symbol_id", (-score([s for _, s in phrases])).alias("rank"))


def score(scored: list[bool]) -> Column:
    """BM25 of a row with tf and df of each phrase, dl, n_rows and avgdl."""
    out = F.lit(0.0)
    for k, counts in enumerate(scored):
        if counts:
            tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
            idf = F.log((F.col("n_rows") - df + 0.5) / (df + 0.5))
            idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
            out = out + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return out


def index_of(spark: SparkSession, root: str, symbols: DataFrame, *sources: str) -> SearchIndex:
    """The index of symbols read from files, kept below a root: built when it is first asked for or the files have changed."""
    stamps = []
    for source in sources:
        path = spark._jvm.org.apache.hadoop.fs.Path(source)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        stamps.append(f"{source}:{status.getModificationTime()}:{status.getLen()}")
    index = SearchIndex(spark, f"{root}/index-{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(stamps)).hex}")
    return index if index.generations() else index.build(symbols)
