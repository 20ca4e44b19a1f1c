"""Differences between two copies of a table, found by hierarchical checksums over key ranges.

Each side is reduced to one checksum line per key (``fingerprints``): the key's place on a 62-bit line and a 128-bit
hash of its normalised fields. Ranges of that line hold counts and XOR sums. The checksums of some coarse ranges are compared
first; the ranges that differ are cut again (six bisections a level) and only the lines in them are summed and compared
at the next level, until a range holds few keys. Only the rows of those leaf ranges are read again and compared field by field.

The places are hashes of the keys, so the ranges are even whatever the keys look like, and one hot corpus is spread
over all of them. Sums are folded in each task, so for equal copies little more than a line per coarse range and task is shuffled.

Defined results
- null key parts: a null key is a key like any other (compared null-safely);
- null fields: null equals only null; a null map entry value equals only a null value;
- repeated rows of a key: count once; if they disagree, the row that is greatest by ``prefer`` and then by its fields decides;
- empty tables: every key of the other side is missing; two empty tables give no rows;
- columns that are neither keys nor compared are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.session import materialize

_LINE_BITS = 62
#: Open ranges of up to so many (8 bytes each) are broadcast to the lines; more are joined by shuffle.
BROADCAST_RANGES = 500_000


def newline_folded(c: Column) -> Column:
    """CR LF and a lone CR as LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def map_entries_sorted(c: Column) -> Column:
    """A map as the sorted array of its entries, which can be compared and hashed."""
    return F.array_sort(F.map_entries(c))


def _flat(c: Column, kind: T.DataType) -> Column:
    """An injective string of a value, null for null; used for hashing only."""
    if isinstance(kind, T.ArrayType):
        e = kind.elementType
        return F.when(c.isNotNull(), F.concat(F.size(c).cast("string"), F.lit("["), F.array_join(F.transform(c, lambda x: _marked(x, e)), "")))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.concat(*[_marked(c[f.name], f.dataType) for f in kind.fields]))
    return c.cast("string")


def _marked(c: Column, kind: T.DataType) -> Column:
    s = _flat(c, kind)
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.length(s).cast("string"), F.lit(":"), s))


def _prepared(df: DataFrame, keys: list[str], fields: dict[str, Column], prefer: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(f"f{i}") for i, c in enumerate(fields.values())], *[F.col(p).alias(f"p{i}") for i, p in enumerate(prefer)])


def _line(df: DataFrame, keys: int) -> Column:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.shiftrightunsigned(F.xxhash64(F.lit("place"), *[_marked(F.col(f"k{i}"), kinds[f"k{i}"]) for i in range(keys)]), 64 - _LINE_BITS)


def fingerprints(prepared: DataFrame, keys: int, fields: int, prefer: int) -> DataFrame:
    """One row per key: (place, k0.., h1, h2). Repeated rows of a key are reduced before and after the shuffle."""
    kinds = {f.name: f.dataType for f in prepared.schema.fields}
    parts = [_marked(F.col(f"k{i}"), kinds[f"k{i}"]) for i in range(keys)] + [_marked(F.col(f"f{i}"), kinds[f"f{i}"]) for i in range(fields)]
    hashed = prepared.select(
        _line(prepared, keys).alias("place"),
        *[f"k{i}" for i in range(keys)],
        F.struct(*[f"p{i}" for i in range(prefer)], F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2")).alias("v"),
    )
    one = hashed.groupBy("place", *[f"k{i}" for i in range(keys)]).agg(F.max("v").alias("v"))
    return one.select("place", F.col("v.h1").alias("h1"), F.col("v.h2").alias("h2"))


def _sums(prints: DataFrame, shift: int, place: str = "place") -> DataFrame:
    return prints.groupBy(F.shiftright(place, shift).alias("range")).agg(F.count("*").alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))


def _unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ranges whose checksums differ, each side's numbers beside each other; a missing side counts as an empty range."""
    a = left.select("range", F.col("n").alias("an"), F.col("x1").alias("a1"), F.col("x2").alias("a2"))
    b = right.select("range", F.col("n").alias("bn"), F.col("x1").alias("b1"), F.col("x2").alias("b2"))
    j = a.join(b, "range", "full_outer").fillna(0)
    return j.filter("an <> bn OR a1 <> b1 OR a2 <> b2")


def unequal_ranges(left: DataFrame, right: DataFrame, rows: int, leaf_rows: int = 8, first_bits: int = 12, step_bits: int = 6) -> tuple[DataFrame, int, int]:
    """(leaf ranges whose checksums differ, as (range), their number, the shift that takes a place to its range).

    ``rows`` (of the larger side) sets the depth: leaves have about ``leaf_rows`` keys. A level reads the fingerprints, keeps
    those in the open ranges of the level above and sums them by halves of halves, ``step_bits`` bisections deep.
    """
    depth = min(_LINE_BITS - 2, max(1, int(np.ceil(np.log2(max(2, rows / leaf_rows))))))
    bits, sides = min(first_bits, depth), (left, right)
    while True:
        shift = _LINE_BITS - bits
        found = materialize(_unequal(*[_sums(side, shift) for side in sides]).select("range"), "ranges")
        n = found.count()
        if bits == depth or not n:
            return found, n, shift
        sides = tuple(within(side, F.col("place"), found, n, shift) for side in (left, right))
        bits = min(depth, bits + step_bits)


def within(df: DataFrame, place: Column, ranges: DataFrame, n: int, shift: int) -> DataFrame:
    """Rows whose place lies in one of the ranges."""
    r = ranges.select(F.col("range").alias("_range"))
    return df.join(F.broadcast(r) if n <= BROADCAST_RANGES else r, F.shiftright(place, shift) == F.col("_range"), "left_semi")


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, Column], prefer: list[str] = (), names: tuple[str, str] = ("missing_in_left", "missing_in_right"), leaf_rows: int = 8) -> DataFrame:
    """(keys, field): one row per key that one side lacks, and one per differing field of the keys both have.

    ``fields`` names each compared field and gives the Column that normalises it on either side.
    """
    prefer = list(prefer)
    nk, nf = len(keys), len(fields)
    sides = [_prepared(d, keys, fields, prefer) for d in (left, right)]
    prints = [materialize(fingerprints(p, nk, nf, len(prefer)), "fingerprints") for p in sides]
    rows = max(p.count() for p in prints)
    ranges, n, shift = unequal_ranges(prints[0], prints[1], rows, leaf_rows)
    kinds = {f.name: f.dataType for f in sides[0].schema.fields}

    def leaf(side: DataFrame, name: str) -> DataFrame:
        near = within(side, _line(side, nk), ranges, n, shift)
        v = F.struct(*[f"p{i}" for i in range(len(prefer))], *[f"f{i}" for i in range(nf)])
        return near.groupBy(*[_marked(F.col(f"k{i}"), kinds[f"k{i}"]).alias(f"m{i}") for i in range(nk)]).agg(*[F.first(f"k{i}").alias(f"{name}k{i}") for i in range(nk)], F.max(v).alias(name))

    j = leaf(sides[0], "a").join(leaf(sides[1], "b"), [f"m{i}" for i in range(nk)], "full_outer")
    differing = [F.when(~F.col(f"a.f{i}").eqNullSafe(F.col(f"b.f{i}")), F.lit(n)) for i, n in enumerate(fields)]
    field = F.when(F.col("b").isNull(), F.array(F.lit(names[1]))).when(F.col("a").isNull(), F.array(F.lit(names[0]))).otherwise(F.array_compact(F.array(*differing)))
    key = [F.when(F.col("a").isNull(), F.col(f"bk{i}")).otherwise(F.col(f"ak{i}")).alias(k) for i, k in enumerate(keys)]
    return j.select(*key, F.explode(field).alias("field"))
