"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with a mark and the letters they fold to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēĕėęěğĩīĭįłńňōŏőŕřśšťũūŭůűųźżž"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeeegiiiilnnooorrsstuuuuuuzzz"


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text; null gives an empty list."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0)), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_anywhere(text: Column, pattern: str) -> Column:
    """Substring match that ignores ASCII case; % and _ of the pattern are wildcards, a backslash is itself."""
    low = re.sub("[A-Z]", lambda m: m.group().lower(), pattern).replace("\\", "\\\\")
    return ascii_lower(text).like(f"%{low}%")


def extension(path: Column) -> Column:
    """The extension with its point, or an empty string."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded down; null counts 0."""
    return F.coalesce(F.floor(F.octet_length(text) / 4), F.lit(0)).cast("bigint")


def glob_regex(glob: str, whole_path: bool) -> str:
    """A shell pattern as a regular expression; over a whole path, * and ? stop at a slash."""
    any_, one = ("[^/]*", "[^/]") if whole_path else (".*", ".")
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(any_)
        elif c == "?":
            out.append(one)
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


#: Names of languages in editors' protocols by extension.
LANGUAGE_IDS = {
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".c": "c", ".py": "python", ".ts": "typescript", ".tsx": "typescriptreact", ".js": "javascript", ".jsx": "javascriptreact",
    ".rs": "rust", ".go": "go", ".kt": "kotlin", ".kts": "kotlin", ".java": "java", ".swift": "swift", ".m": "objective-c", ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby", ".ru": "ruby", ".lua": "lua",
}


def language_id(path: Column) -> Column:
    """Name of a file's language as editors' protocols spell it, by its extension; plaintext where it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_IDS.items() for x in kv])[extension(path)], F.lit("plaintext"))


def symbol_kind(code: Column) -> Column:
    """Name of a protocol's symbol kind: 6, 9, 12 and 13 have names, others stay numbers."""
    named = {6: "method", 9: "constructor", 12: "function", 13: "variable"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[code], code.cast("string"))


def local_path(uri: Column) -> Column:
    """The path of a file address."""
    return F.regexp_replace(uri, "^file://", "")


def normal_path(path: Column) -> Column:
    """A path without empty and . parts, each .. taking away the part before it; those that lead above a relative path's root stay."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    root = path.startswith("/")

    def step(kept: Column, p: Column) -> Column:
        above = (F.size(kept) == 0) | (F.element_at(F.concat(F.array(F.lit("")), kept), -1) == "..")
        up = F.when(above, F.when(root, kept).otherwise(F.concat(kept, F.array(F.lit(".."))))).otherwise(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        return F.when(p == "..", up).otherwise(F.concat(kept, F.array(p)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    body = F.array_join(kept, "/")
    return F.when(root, F.concat(F.lit("/"), body)).otherwise(F.when(body == "", ".").otherwise(body))


def absolute_path(path: Column, root: str) -> Column:
    """A path seen from a root, normalised; an absolute one is only normalised."""
    return normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)))


def relative_path(path: Column, root: str) -> Column:
    """What follows the root in a path below it, else the path."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds, without leading parts that are zero."""
    h, m, s = (seconds / 3600).cast("bigint"), ((seconds % 3600) / 60).cast("bigint"), (seconds % 60).cast("bigint")
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))
