"""Deterministic structural chunks of a text, with line numbers and heading context.

Lines are the units; a line over the limit is cut first. Units are gathered until the target, the limit or the number of lines is
reached, or an empty line comes after half of the target; then the next chunk steps back by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.errors import EngineError
from siftwell.functions.hashing import stable_chunk_key
from siftwell.functions.text import indexed_text

CRUMB = " › "
#: Bytes of the longest token a measure may know.
LONGEST_TOKEN = 1024
_SENTENCE, _SOFT = b".!?;", b" \t\n\v\f\r,:/}])-|"
_HEADING = re.compile(rb"(#{1,6}) ")


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes are bytes unless ``measure`` counts something else. ``max_tokens`` 0 means that ``max_chars`` and ``overlap_lines`` hold."""

    max_lines: int = 40
    max_chars: int = 1600
    overlap_lines: int = 4
    heading_context: bool = True
    target_tokens: int = 0
    max_tokens: int = 0
    overlap_tokens: int = 0
    reserved_tokens: int = 0
    document_prefix: str = ""
    tokenizer_identity: str = "bytes"
    measure: Callable[[str], int] | None = field(default=None, compare=False)

    def __post_init__(self):
        sizes = (self.max_lines, self.max_chars, self.overlap_lines, self.target_tokens, self.max_tokens, self.overlap_tokens, self.reserved_tokens)
        if min(sizes) < 0:
            raise EngineError("invalid_argument", "chunk sizes must not be negative")

    @property
    def limit(self) -> int:
        return max(1, self.max_chars) if not self.max_tokens else max(1, self.max_tokens - self.reserved_tokens)

    @property
    def fingerprint(self) -> str:
        """Changes with everything that can move a boundary."""
        parts = [self.max_lines, self.max_chars, self.overlap_lines, int(self.heading_context), self.tokenizer_identity, self.target_tokens, self.max_tokens, self.overlap_tokens, self.reserved_tokens, self.document_prefix]
        return "siftwell-structural-1|" + "|".join(map(str, parts))

    def size(self, body: bytes, context: bytes = b"") -> int:
        """The size of what would be embedded: prefix, context and body on lines of their own."""
        form = b"\n".join(x for x in (self.document_prefix.encode(), context, body) if x)
        return self.measure(form.decode("utf-8", "replace")) if self.measure else len(form)


#: The service's defaults without a tokenizer.
SERVICE_OPTIONS = ChunkOptions(max_lines=40, target_tokens=320, max_tokens=384, overlap_tokens=32, heading_context=False)


def _fitting(text: bytes, context: bytes, o: ChunkOptions) -> int:
    """How much of the text the limit takes: to its last sentence end, else its last soft boundary, else as much as fits; one character at least."""
    # sizes grow with the text: look ahead from the limit in doubling steps, so what lies far beyond it is never measured
    low, high = 0, min(len(text), o.limit)
    while high < len(text) and o.size(text[:high], context) <= o.limit:
        low, high = high, min(len(text), 2 * high)
    while low < high:
        mid = (low + high + 1) // 2
        if o.size(text[:mid], context) <= o.limit:
            low = mid
        else:
            high = mid - 1
    if low == len(text):
        return low
    while low and text[low] & 0xC0 == 0x80:
        low -= 1
    for marks in (_SENTENCE, _SOFT):
        at = max(text.rfind(bytes([m]), 0, low) for m in marks)
        if at >= 0:
            return at + 1
    if low:
        return low
    low = 1
    while low < len(text) and text[low] & 0xC0 == 0x80:
        low += 1
    return low


def _ahead(o: ChunkOptions) -> int:
    """How many bytes a piece can take at most: a measured token has ``LONGEST_TOKEN`` bytes at most, without a measure a unit is a byte."""
    return (o.limit + 1) * (LONGEST_TOKEN if o.measure else 1) + 4


class _Headings:
    """The open headings by level."""

    def __init__(self):
        self.open: dict[int, bytes] = {}

    def see(self, line: bytes) -> None:
        m = _HEADING.match(line)
        if m:
            level = len(m.group(1))
            self.open = {k: v for k, v in self.open.items() if k < level}
            self.open[level] = line.lstrip(b"# ").rstrip(b" #")

    def trail(self) -> bytes:
        return CRUMB.encode().join(v for _, v in sorted(self.open.items()) if v)


def chunk_text(content: str | None, o: ChunkOptions = ChunkOptions()) -> list[dict]:
    """[{text, context, start_line, end_line}] in order; null or empty gives none."""
    body = re.sub("\r\n?", "\n", content or "").encode("utf-8", "replace")
    if not body or o.document_prefix and o.size(b"") >= o.limit:
        return []
    units: list[tuple[bytes, int]] = []
    for number, line in enumerate(body.split(b"\n")):
        if not line:
            units.append((b"", number))
        at = 0
        while at < len(line):
            # the longest piece that can matter: whole characters, so the view moves on without copying what is left
            cut = _fitting(line[at : at + _ahead(o)], b"", o)
            while at + cut < len(line) and cut > 1 and line[at + cut] & 0xC0 == 0x80:
                cut -= 1
            units.append((line[at : at + cut], number))
            at += cut
    out, headings, i = [], _Headings(), 0
    target = o.target_tokens or o.limit
    while i < len(units):
        start, text, context, lines = i, b"", b"", 0
        while i < len(units) and lines < max(1, o.max_lines):
            unit, number = units[i]
            if o.heading_context:
                headings.see(unit)
                context = context or headings.trail()
            joined = text + b"\n" + unit if text else unit
            size = o.size(joined, context)
            if size > o.limit:
                if text:
                    break
                cut = _fitting(unit, context, o)
                if cut < len(unit):
                    units[i : i + 1] = [(unit[:cut], number), (unit[cut:], number)]
                    continue
                context = b""  # the headings alone would fill the limit
            text, i, lines = joined, i + 1, lines + 1
            if size >= target or not unit and size >= target // 2:
                break
        text = text.rstrip(b" \t\n\v\f\r")
        if text:
            out.append({"text": text.decode("utf-8", "replace"), "context": context.decode("utf-8", "replace"), "start_line": units[start][1], "end_line": units[i - 1][1]})
        if i == start:
            i += 1
        if i < len(units):
            back, j = 0, i
            wanted = o.overlap_tokens if o.max_tokens else o.overlap_lines
            while j > start + 1 and back < wanted:
                j -= 1
                back += (o.measure(units[j][0].decode("utf-8", "replace")) if o.measure else len(units[j][0])) if o.max_tokens else 1
            i = j
    return out


CHUNK_TYPE = "array<struct<text:string,context:string,start_line:int,end_line:int>>"


def chunks_of(content: Column, o: ChunkOptions = ChunkOptions()) -> Column:
    """The chunks of a text as an array."""

    @F.pandas_udf(CHUNK_TYPE)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, o))

    return run(content)


def chunk_documents(documents: DataFrame, o: ChunkOptions = ChunkOptions(), key: str = "doc_key", content: str = "content") -> DataFrame:
    """(chunk_key, key, ordinal, text, indexed_text, context, start_line, end_line): the prepared chunks of a table."""
    parts = documents.select(F.col(key), F.posexplode(chunks_of(F.col(content), o)).alias("ordinal", "c")).select(key, "ordinal", "c.*")
    return parts.select(
        stable_chunk_key(F.col(key), F.col("start_line"), F.col("end_line"), F.col("text")).alias("chunk_key"), key, "ordinal", "text", indexed_text(F.col("context"), F.col("text")).alias("indexed_text"), "context", "start_line", "end_line"
    )


def line_chunks(documents: DataFrame, key: str = "doc_key", content: str = "content") -> DataFrame:
    """One chunk per non-blank line, without Python: the structural chunker's result for one line, no overlap, no headings and short lines."""
    lines = documents.select(F.col(key), F.posexplode(F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")).alias("line", "raw"))
    return lines.select(key, "line", F.regexp_replace("raw", r"[ \t\x0B\f\r]+$", "").alias("text")).filter("text <> ''")

