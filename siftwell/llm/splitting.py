"""Cutting oversized texts at natural boundaries, with overlap.

Separators form a hierarchy: section, paragraph, sentence, line, word, character. From where the last piece ended, the next one takes as
many units of the strongest level as fit; only if not even one does, the unit is entered at the next level. Each piece
begins with the given number of the last lines of the piece before, however long they are. Fewer are repeated only where not one new
character would fit beside them, or where the piece before has no more lines; ``repeated_lines`` tells how many, and if it
is none, the last words within an eighth of the limit are repeated. Sizes are UTF-8 bytes of the text with CR LF and CR as LF.

Defined results
- null or empty texts, and texts within the limit: not oversized, no rows (``whole=True`` passes them through as one piece);
- very long texts: cut in time proportional to their length; a long line is cut at sentence ends, then blanks, then code points;
- repeated rows of a key: once (if they disagree, the greatest text);
- null key parts: a key like any other; empty tables: no rows; extra columns: ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = ["section", "paragraph", "sentence", "line", "word", "character"]
_HEADING = re.compile(rb"^#{1,6} ", re.M)
_BLANK = re.compile(rb"[ \t]*")
_PARAGRAPH = re.compile(rb"\n(?:[ \t]*\n)+")
_CLOSERS = "\"')]”»」』）"
_STOPS, _WIDE_STOPS = ".!?;…", "。！？"


def _any_of(characters: str) -> bytes:
    return b"(?:" + b"|".join(re.escape(c.encode()) for c in characters) + b")"


#: A stop, closing marks and the blanks after them; after a wide stop no blank is needed.
_SENTENCE = re.compile(_any_of(_STOPS) + _any_of(_CLOSERS) + b"*[ \t\n]+|" + _any_of(_WIDE_STOPS) + _any_of(_CLOSERS) + b"*[ \t\n]*")
_WORD = re.compile(rb"[ \t]+")
_CHARACTER = re.compile(rb".[\x80-\xbf]*", re.S)


def normalised(text: str) -> bytes:
    return text.replace("\r\n", "\n").replace("\r", "\n").encode("utf-8", "surrogatepass")


def oversized_runs(data: bytes, starts: list[int], limit: int) -> list[tuple[int, int]]:
    """(first, last) line of each maximal run of non-blank lines over the limit; a blank line has only spaces and tabs."""
    out, first = [], None
    ends = [*[s - 1 for s in starts[1:]], len(data)]
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        if _BLANK.fullmatch(data, s, e):
            if first is not None and ends[i - 1] - starts[first] > limit:
                out.append((first, i - 1))
            first = None
        elif first is None:
            first = i
    if first is not None and ends[-1] - starts[first] > limit:
        out.append((first, len(starts) - 1))
    return out


def entered_runs(data: bytes, starts: list[int], cuts: list[int], limit: int) -> list[tuple[int, int]]:
    """The runs of ``oversized_runs`` as the cuts show them: pieces hold at most ``limit`` new bytes, so each such run is cut inside."""
    ends = [*[s - 1 for s in starts[1:]], len(data)]
    blank = lambda i: _BLANK.fullmatch(data, starts[i], ends[i]) is not None
    out, last = [], -1
    for cut in cuts:
        first = bisect_right(starts, cut - 1) - 1
        if first <= last or blank(first):
            continue
        last = first
        while first > 0 and not blank(first - 1):
            first -= 1
        while last + 1 < len(starts) and not blank(last + 1):
            last += 1
        if ends[last] - starts[first] > limit:
            out.append((first, last))
    return out


def split_text(text: str, limit: int, overlap_lines: int, least_fill: float = 0.125) -> list[dict]:
    """The pieces of one text: ordinal, text, level of the boundary it ends at, lines, bytes, and the byte where its new part begins.

    New parts joined are the normalised text. A level's last boundary that fits is passed over if it would leave the new
    part under ``least_fill`` of the room and a weaker level offers a later one.
    """
    data = normalised(text)
    starts = [0, *[m.end() for m in re.finditer(rb"\n", data)]]
    n = len(data)
    cuts = [
        [*[m.start() for m in _HEADING.finditer(data)], n],
        [m.end() for m in _PARAGRAPH.finditer(data)],
        [m.end() for m in _SENTENCE.finditer(data)],
        starts[1:],
        [m.end() for m in _WORD.finditer(data)],
    ]
    pieces, s, o, repeated = [], 0, 0, 0
    while s < n:
        room = limit - (s - o)
        end, level = 0, len(LEVELS) - 1
        for k, at in enumerate(cuts):
            i = bisect_right(at, s + room) - 1
            if i >= 0 and at[i] > s and at[i] > end:
                if not end or end - s < least_fill * room:
                    end, level = at[i], k
            if end and end - s >= least_fill * room:
                break
        if not end:
            end = min(n, s + room)
            while end < n and data[end] & 0xC0 == 0x80:
                end -= 1
        body = data[o:end].rstrip(b"\n")
        pieces.append(
            {
                "ordinal": len(pieces),
                "text": body.decode("utf-8", "replace"),
                "level": LEVELS[level],
                "start_line": bisect_right(starts, o) - 1,
                "end_line": bisect_right(starts, max(o, o + len(body) - 1)) - 1,
                "start_byte": o,
                "new_byte": s,
                "end_byte": end,
                "repeated_lines": repeated,
                "long_runs": [],
            }
        )
        # the overlap of the next piece: whole lines after the piece's start that leave room for one more character
        last, repeated, nxt = pieces[-1]["end_line"], 0, end
        if overlap_lines and end < n:
            fits = max(o + 1, end + len(_CHARACTER.match(data, end).group()) - limit)
            line = max(last - overlap_lines + 1, bisect_left(starts, fits))
            if line <= last:
                nxt, repeated = starts[line], last - line + 1
            else:
                words = cuts[4]
                i = bisect_left(words, max(o + 1, end - limit // 8))
                nxt = words[i] if i < len(words) and words[i] < end else end
        s, o = end, nxt
    begins = [p["new_byte"] for p in pieces]
    for a, b in entered_runs(data, starts, begins[1:], limit):
        pieces[bisect_right(begins, starts[a]) - 1]["long_runs"].append({"start_line": a, "end_line": b})
    return pieces


_PIECE = pa.struct(
    [
        ("ordinal", pa.int32()),
        ("text", pa.string()),
        ("level", pa.string()),
        ("start_line", pa.int32()),
        ("end_line", pa.int32()),
        ("start_byte", pa.int64()),
        ("new_byte", pa.int64()),
        ("end_byte", pa.int64()),
        ("repeated_lines", pa.int32()),
        ("long_runs", pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32())]))),
    ]
)
PIECE_SCHEMA = "ordinal int, text string, level string, start_line int, end_line int, start_byte long, new_byte long, end_byte long, repeated_lines int, long_runs array<struct<start_line:int,end_line:int>>"


def _split_batches(batches: Iterator[pa.RecordBatch], limit: int, overlap_lines: int, keys: int) -> Iterator[pa.RecordBatch]:
    """A text at a time, results sent on once they hold about 8 MB."""
    names = [f"k{i}" for i in range(keys)] + [f.name for f in _PIECE]
    for batch in batches:
        rows, pieces, held = [], [], 0
        texts = batch.column(keys)
        for i in range(batch.num_rows):
            new = split_text(texts[i].as_py(), limit, overlap_lines)
            pieces += new
            rows += [i] * len(new)
            held += sum(len(p["text"]) for p in new)
            if pieces and (held > 8_000_000 or i == batch.num_rows - 1):
                at = pa.array(rows, pa.int64())
                part = pa.array(pieces, _PIECE)
                yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(keys)] + part.flatten(), names)
                rows, pieces, held = [], [], 0
        if pieces:
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(keys)] + pa.array(pieces, _PIECE).flatten(), names)


def split_documents(df: DataFrame, keys: list[str], text: str, limit: int = 1600, overlap_lines: int = 2, whole: bool = False) -> DataFrame:
    """(keys, ordinal, text, level, start_line, end_line, start_byte, new_byte, end_byte, repeated_lines, long_runs): the pieces of each oversized text.

    ``long_runs`` has the runs of non-blank lines over the limit that begin in the piece. The size filter runs in the JVM
    before anything is sent to Python, and repeated rows are dropped among the oversized ones only.
    """
    if limit < 4 or overlap_lines < 0:
        raise ValueError("limit must be at least 4 bytes (one character) and overlap_lines not negative")
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t")).filter("t IS NOT NULL AND t <> ''")
    if not whole:
        rows = rows.filter(F.octet_length(F.regexp_replace("t", "\r\n", "\n")) > limit)
    rows = rows.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.max("t").alias("t"))
    key_schema = ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    out = rows.mapInArrow(partial(_split_batches, limit=limit, overlap_lines=overlap_lines, keys=len(keys)), f"{key_schema}, {PIECE_SCHEMA}")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[f.name for f in T._parse_datatype_string(PIECE_SCHEMA).fields])
