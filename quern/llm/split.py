"""Splitting oversized items at natural boundaries (problem 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest to the weakest; a piece ends after the match. Below words: any character.
LEVELS = (
    ("section", re.compile(r"(?:\r\n|\r|\n)(?=#{1,6} |(?:=|-|\*){3,}|[A-Za-z_@][^\r\n]*[{:(]\s*(?:\r|\n))")),
    ("paragraph", re.compile(r"(?:\r\n|\r|\n)(?:[ \t]*(?:\r\n|\r|\n))+")),
    ("line", re.compile(r"\r\n|\r|\n")),
    ("sentence", re.compile(r"[.!?;…。！？]+[\"')\]»”]*\s+|[。！？]")),
    ("word", re.compile(r"\s+")),
)


def units(text: str, start: int, end: int, limit: int, level: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, bytes) of consecutive units of text[start:end], each within the limit, cut at the strongest boundaries that do it.

    A character alone over the limit is a unit of its own.
    """
    n = len(text[start:end].encode("utf-8", "surrogatepass"))
    if n <= limit or end - start <= 1:
        return [(start, end, n)] if end > start else []
    if level == len(LEVELS):
        if n == end - start:  # one byte a character
            return [(i, min(i + limit, end), min(limit, end - i)) for i in range(start, end, limit)]
        out, at, held = [], start, 0
        for i in range(start, end):
            b = len(text[i].encode("utf-8", "surrogatepass"))
            if held and held + b > limit:
                out.append((at, i, held))
                at, held = i, 0
            held += b
        return [*out, (at, end, held)]
    out, at = [], start
    for m in LEVELS[level][1].finditer(text, start, end):
        if m.end() > at:
            out += units(text, at, m.end(), limit, level + 1)
            at = m.end()
    return out + units(text, at, end, limit, level + 1) if at < end else out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, own) of each piece: text[start:end] has at most ``limit`` bytes; text[start:own] repeats the end of the piece before.

    Units are packed greedily up to the limit less the overlap; then each piece but the first is led in by as
    many whole units of the piece before as fit into ``overlap`` bytes, at a weaker boundary if no unit fits.
    The own parts joined are the text.
    """
    if limit < 1:
        raise ValueError("the limit is at least one byte")
    overlap = max(0, min(overlap, limit // 2))
    if len(text.encode("utf-8", "surrogatepass")) <= limit:
        return [(0, len(text), 0)]
    out: list[tuple[int, int, int]] = []
    at, held = 0, 0
    for s, e, n in units(text, 0, len(text), limit - overlap):
        if held and held + n > limit - (overlap if out else 0):
            out.append((at, s, at))
            at, held = s, 0
        held += n
    out.append((at, len(text), at))
    if not overlap:
        return out
    led = [out[0]]
    for (before, _, _), (s, e, own) in zip(out, out[1:]):
        lead, most = s, min(overlap, limit - len(text[s:e].encode("utf-8", "surrogatepass")))
        for us, _ue, _n in reversed(units(text, before, s, max(1, overlap // 4))):
            if len(text[us:s].encode("utf-8", "surrogatepass")) > most:
                break
            lead = us
        led.append((lead, e, own))
    return led


_LINES = re.compile(r"\r\n|\r|\n")


def split_texts(df: DataFrame, text: str, keys: list[str], limit: str, overlap: str, line_start: str | None = None, header_lines: int = 0) -> DataFrame:
    """Pieces of each text: keys..., piece_no (from 0), n_pieces, start_char, end_char, own_start, line_from, line_to, piece.

    limit, overlap: integer columns, in bytes of UTF-8. A text within its limit is one piece and never leaves
    the JVM; only oversized ones go to Python, in batches. An empty text is one empty piece; a null text, or a
    null or non-positive limit, gives no piece. Repeated rows give repeated pieces. No shuffle: each text is
    cut where it lies, whole, whatever its length.

    line_from, line_to: lines of the source a piece spans, where ``line_start`` is the line of the first line
    after ``header_lines`` lines of header; null where line_start is null or less than 1.
    """
    kept = [f"`{k}`" for k in keys]
    start = F.col(line_start).cast("int") if line_start else F.lit(None).cast("int")
    rows = df.where(F.col(text).isNotNull() & (F.col(limit) > 0)).select(
        *keys, F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("_overlap"), F.when(start >= 1, start).alias("_line")
    )
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, piece_no int, n_pieces int, start_char int, end_char int, own_start int, line_from int, line_to int, piece string"
    small = F.octet_length("_text") <= F.col("_limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                *key, t, most, lead, line = row
                cut = pieces(t, most, lead)
                known = line == line and line is not None
                breaks = [m.end() for m in _LINES.finditer(t)] if known else []
                lines = [None, None]
                at = 0
                for i, (s, e, own) in enumerate(cut):
                    if known:
                        import bisect

                        at = bisect.bisect_right(breaks, s)
                        to = bisect.bisect_left(breaks, e)
                        lines = [max(int(line), int(line) + at - header_lines), max(int(line), int(line) + to - header_lines)]
                    out.append((*key, i, len(cut), s, e, own, *lines, t[s:e]))
            frame = pd.DataFrame(out, columns=[*keys, "piece_no", "n_pieces", "start_char", "end_char", "own_start", "line_from", "line_to", "piece"])
            yield frame.astype({"line_from": "Int32", "line_to": "Int32"})

    last = F.col("_line") + F.greatest(F.lit(0), F.regexp_count("_text", F.lit(r"\r\n|\r|\n")) - header_lines)
    whole = rows.where(small).select(
        *kept, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), F.char_length("_text").alias("end_char"), F.lit(0).alias("own_start"), F.col("_line").alias("line_from"), last.cast("int").alias("line_to"), F.col("_text").alias("piece")
    )
    return whole.unionByName(rows.where(~small).mapInPandas(run, schema))
