"""Scanning source trees: files, languages, ignore rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import basename, extension, glob_regex

#: Language by extension.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx",
    ".rs": "rust", ".go": "go", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".m": "objc", ".mm": "objc", ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby", ".ru": "ruby", ".lua": "lua",
}
#: Extensions a scan of a tree reads, and those a watcher reports.
SCANNED = (".cpp", ".h", ".py", ".js", ".ts", ".java", ".kt", ".swift", ".m", ".rs", ".c", ".cc", ".cxx", ".hpp", ".tsx", ".jsx", ".go", ".rb", ".rake", ".gemspec", ".ru", ".lua")
WATCHED = tuple(e for e in SCANNED if e != ".go")
#: The folder in which an engine keeps its own files.
OWN_FOLDER = ".quern"
#: What is ignored where a project has no rules of its own; the engine's own folder is one of them.
DEFAULT_RULES = ("build/", ".build/", "node_modules/", ".git/", "vendor/", f"{OWN_FOLDER}/", "dist/", "out/", "target/", "*.o", "*.a", "*.so", "*.dylib")
#: What marks a header as Objective-C, beside an #import.
OBJC_MARKS = ("@interface", "@implementation", "@property", "@protocol", "@class", "NSObject", "NSString")


def language_of(path: Column) -> Column:
    """Language by the extension, null where it is unknown."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def objective_c_header(path: Column, language: Column, content: Column) -> Column:
    """The language, but objc for a .h file whose first 4,096 characters import and hold a mark of that language."""
    head = F.substring(content, 1, 4096)
    marks = head.rlike("|".join(OBJC_MARKS)) & head.contains("#import")
    return F.when((language == "c") & path.endswith(".h") & marks, "objc").otherwise(language)


def ignored(path: Column, rules: Sequence[str] = DEFAULT_RULES) -> Column:
    """Whether the last rule that matches a root-relative path ignores it.

    A rule that ends with a slash names a folder anywhere, or from the root if it holds another slash; a rule with
    an inner or leading slash is matched from the root; any other against the name and the whole path. A leading
    ! takes back. Blank rules and those that begin with # are none.
    """
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        negated, rule = rule.startswith("!"), rule.lstrip("!")
        folder, body = rule.endswith("/"), rule.rstrip("/")
        anchored, body = body.startswith("/") or "/" in body, body.lstrip("/")
        if folder:
            hit = path.rlike(("^" if anchored else "(^|/)") + glob_regex(body, True) + "/")
        elif anchored:
            hit = path.rlike("^" + glob_regex(body, True) + "$")
        else:
            hit = basename(path).rlike("^" + glob_regex(body, False) + "$") | path.rlike("^" + glob_regex(body, True) + "$")
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def small_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file such as a configuration, also of one whose name begins with a point; null without one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def project_rules(spark: SparkSession, root: str, name: str = ".quernignore") -> tuple[str, ...]:
    """The rules of a project's own file, which replace the default ones, or the default ones."""
    text = small_file(spark, f"{root}/{name}")
    return DEFAULT_RULES if text is None else tuple(text.splitlines())


def scan_folder(spark: SparkSession, root: str, rules: Sequence[str] | None = None, extensions: Sequence[str] | None = None) -> DataFrame:
    """(path, language, content, content_hash, error) of the files below a folder that are not ignored.

    rules: by default those of the project. extensions: the only ones read, by default all. Unknown extensions give a
    row with an error and no content, never a failure. A text that is no UTF-8 keeps its content with marks in
    place of what cannot be read.
    """
    rules = project_rules(spark, root) if rules is None else rules
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + glob_regex(prefix, True), "")
    rows = rows.withColumn("path", path).where(~ignored(F.col("path"), rules)).withColumn("language", language_of(F.col("path")))
    if extensions is not None:
        rows = rows.where(extension(F.col("path")).isin(list(extensions)))
    rows = rows.withColumn("hash", F.sha2("content", 256)).withColumn("content", F.when(F.col("language").isNotNull(), F.expr("make_valid_utf8(cast(content AS string))")))
    rows = rows.withColumn("language", objective_c_header(F.col("path"), F.col("language"), F.col("content")))
    error = F.when(F.col("language").isNull(), F.concat(F.lit("unsupported extension: "), extension(F.col("path"))))
    return rows.select("path", "language", "content", F.col("hash").alias("content_hash"), error.alias("error"))


def read_files(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, language, content, content_hash, error) of the wanted paths (path) below a folder; one that is gone gives an error."""
    found = scan_folder(spark, root, ())
    gone = F.when(F.col("content_hash").isNull(), F.concat(F.lit("file not found: "), F.col("path"))).otherwise(F.col("error"))
    return wanted.select("path").distinct().join(found, "path", "left").withColumn("error", gone)
