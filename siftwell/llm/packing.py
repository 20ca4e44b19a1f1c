"""Filling containers of fixed capacity: hierarchical multi-length packing.

There are several context sizes (tiers), the largest of them the container. A document is routed to the smallest window that holds it.

1. From the longest tier down, each tier's own documents are packed by themselves (best fit, longest first) into
   windows of its size, and the gaps of these windows are filled from the shorter tiers.
2. Windows of a short tier that stay emptier than ``least_fill`` are dissolved; their documents move up to the next tier, gaps
   first, then windows of their own. The longest tier keeps what it has.
3. Windows of all tiers are put into containers of the full capacity; a document lies within one window.
4. Containers are numbered by their work (the sum of squared lengths, as attention costs it) and dealt forth and back
   over step groups, so every group gets about the same tokens and the same work.

The plan is made on the histogram of lengths, which has at most ``capacity`` entries however many documents there are;
windows of equal make-up are held as one kind with a count. Documents are then numbered within their length and
look their place up, so no task ever sees more than its own rows.

A document longer than a container is cut into full containers and a rest, and only such a document is.

Defined results
- null and empty texts: not packed, no rows; a text of blanks is packed;
- very long texts: cut by size into parts, each with its offset in size units; the parts of one document are numbered in order;
- repeated rows: every row is an item of its own; repeated ids are kept as they are;
- ties in length: numbered by a hash of the id and the id, any order packs equally well;
- empty tables: no rows; extra columns: ignored, whatever their names.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.ranking import positions
from siftwell.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Documents of one length are numbered in so many buckets at least, of about so many rows.
_BUCKETS, _BUCKET_ROWS = 64, 1 << 20


def byte_quarter_size(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up: the measure when there is no tokenizer."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("long")


@lru_cache(1)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        own = tiktoken.Encoding("own", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s""", mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes its number of tokens."""
    count = _tokenizer(path)
    for batch in batches:
        sizes: list[int] = []
        texts, held = [], 0
        for t in batch.column(batch.num_columns - 1):
            texts.append(t.as_py())
            held += len(texts[-1])
            if held > 2_000_000:
                sizes += count(texts)
                texts, held = [], 0
        sizes += count(texts) if texts else []
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "size"])


def counted(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The rows with ``size``, the tokens of their last column, in its place."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(partial(_count, path=tokenizer), f"{kept}, size long")


def token_sizes(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, size): tokens of each non-empty text by a public tokenizer; ``tokenizer`` is the path of its file."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL AND text <> ''")
    return counted(rows, tokenizer)


def measured_sizes(df: DataFrame, key: str, text: str, measure: Callable[[Column], Column] = byte_quarter_size) -> DataFrame:
    """(id, size) by a Column measure, within the JVM."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL AND text <> ''")
    return rows.select("id", measure(F.col("text")).alias("size"))


class Windows:
    """Windows of one size as kinds: how many there are of the same make-up. Kinds are found by the room they have left."""

    def __init__(self, size: int):
        self.size = size
        self.rooms: list[int] = []  # sorted, those with room left
        self.kinds: dict[int, list[tuple[int, Counter]]] = {}  # room -> (count, make-up)

    def put(self, room: int, count: int, content: Counter) -> None:
        if not count:
            return
        if room not in self.kinds:
            insort(self.rooms, room)
            self.kinds[room] = []
        self.kinds[room].append((count, content))

    def place(self, length: int, left: int, fresh: bool) -> int:
        """Put ``left`` documents of a length where they fit best; new windows are opened if ``fresh``. What is left over."""
        while left:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                if not fresh:
                    return left
                self.put(self.size, -(-left // (self.size // length)), Counter())
                continue
            room = self.rooms[i]
            count, content = self.kinds[room].pop()
            if not self.kinds[room]:
                del self.kinds[room]
                self.rooms.pop(i)
            most = room // length
            whole = min(count, left // most)
            self.put(room - most * length, whole, content + Counter({length: most}))
            left, count = left - whole * most, count - whole
            if count and left and left < most:
                self.put(room - left * length, 1, content + Counter({length: left}))
                left, count = 0, count - 1
            self.put(room, count, content)
        return 0

    def dissolved(self, least_fill: float) -> Counter:
        """Take the windows apart that have more room than ``least_fill`` allows: their documents, by length."""
        out: Counter = Counter()
        for room in [r for r in self.rooms if r > self.size * (1 - least_fill)]:
            for count, content in self.kinds.pop(room):
                for length, n in content.items():
                    out[length] += n * count
            self.rooms.remove(room)
        return out

    def __iter__(self) -> Iterator[tuple[int, Counter]]:
        return (kind for kinds in self.kinds.values() for kind in kinds)


@dataclass
class Plan:
    """Rows: documents ``first`` + 1 to ``first`` + ``count`` of a length go, one each, to windows from ``window`` on of a tier, in containers from ``container`` on."""

    rows: np.ndarray  # length, first, count, tier (its size), window, container
    containers: int
    fill: dict[int, float]  # by tier


def plan_containers(histogram: dict[int, int], capacity: int, tiers: list[int], least_fill: float = 0.99) -> Plan:
    """The packing of a histogram of lengths; its size and cost depend on the number of different lengths, not of documents."""
    sizes = sorted({*tiers, capacity})
    if any(b % a or a < 1 for a, b in zip(sizes, sizes[1:], strict=False)) or sizes[-1] != capacity:
        raise ValueError("each context size must divide the next larger one, the largest is the capacity")
    left = Counter({x: n for x, n in histogram.items() if n})
    windows = {t: Windows(t) for t in sizes}
    for low, high in reversed(list(zip([0, *sizes], sizes, strict=False))):
        for length in sorted((x for x in left if low < x <= high), reverse=True):
            windows[high].place(length, left.pop(length), True)
        for length in sorted((x for x in left if x <= low), reverse=True):
            left[length] = windows[high].place(length, left[length], False)
        left = +left
    for low, high in zip(sizes, sizes[1:], strict=False):
        moved = windows[low].dissolved(least_fill)
        for length in sorted(moved, reverse=True):
            windows[high].place(length, moved[length], True)
    work = lambda content: sum(n * length * length for length, n in content.items())
    kinds = {t: sorted(w, key=lambda k: (-work(k[1]), sorted(k[1].items()))) for t, w in windows.items()}
    # windows into containers: the same best fit, one level up
    outer = Windows(capacity)
    for t in reversed(sizes):
        outer.place(t, sum(c for c, _ in kinds[t]), True)
    spans: dict[int, list[tuple[int, int, int]]] = {t: [] for t in sizes}  # tier -> (first window, count, first container)
    used, containers = Counter(), 0
    for count, content in sorted(outer, key=lambda k: sorted(k[1].items(), reverse=True), reverse=True):
        for t, n in sorted(content.items(), reverse=True):
            for _ in range(n):
                spans[t].append((used[t], count, containers))
                used[t] += count
        containers += count
    rows, number, fill = [], Counter(), {}
    for t in sizes:
        starts = [s[0] for s in spans[t]]
        first = 0
        for count, content in kinds[t]:
            for length, n in sorted(content.items(), reverse=True):
                for _ in range(n):
                    at = first
                    while at < first + count:  # cut where the containers of the windows change
                        s = spans[t][np.searchsorted(starts, at, side="right") - 1]
                        run = min(first + count, s[0] + s[1]) - at
                        rows.append((length, number[length], run, t, at, s[2] + at - s[0]))
                        number[length] += run
                        at += run
            first += count
        if first:
            fill[t] = sum(c * sum(x * n for x, n in k.items()) for c, k in kinds[t]) / (first * t)
    return Plan(np.array(sorted(rows), np.int64).reshape(-1, 6), containers, fill)


def dealt(container: np.ndarray, groups: int) -> np.ndarray:
    """The step group: containers in order of their work are dealt forth and back."""
    turn, seat = container // groups, container % groups
    return np.where(turn % 2 == 0, seat, groups - 1 - seat)


_PACKED = "container long, {id}, part int, offset long, size int, tier int, window long, step_group long"


def _placed(batches: Iterator[pa.RecordBatch], plan: Plan, capacity: int, full: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Numbered parts look up their window and container; full parts (length 0) have the first containers to themselves."""
    r = plan.rows
    scale = int(r[:, 1].max(initial=0)) + 2
    starts = r[:, 0] * scale + r[:, 1]
    for b in batches:
        id_, part, offset, size, length, position = (b.column(i) for i in range(6))
        length, position = length.to_numpy().astype(np.int64), position.to_numpy().astype(np.int64) - 1
        whole = length == 0
        at = np.maximum(0, np.searchsorted(starts, length * scale + np.minimum(position, scale - 1), side="right") - 1)
        row = r[at] if len(r) else np.zeros((len(at), 6), np.int64)
        container = np.where(whole, position, full + row[:, 5] + position - row[:, 1])
        window = np.where(whole, position, row[:, 4] + position - row[:, 1] + np.where(row[:, 3] == capacity, full, 0))
        tier = np.where(whole, capacity, row[:, 3]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(container), id_, part, offset, size, pa.array(tier), pa.array(window), pa.array(dealt(container, groups))], ["container", "id", "part", "offset", "size", "tier", "window", "step_group"])


def pack(sizes: DataFrame, capacity: int, tiers: list[int] | None = None, group: int = 64, least_fill: float = 0.99) -> DataFrame:
    """(container, id, part, offset, size, tier, window, step_group): every item once, parts of long ones in order.

    ``sizes`` has (id, size); items of size 0 are put with the smallest. Sizes are computed once and kept in the shared
    folder. ``tiers`` are the context sizes below the capacity, each a divisor of the next (a half, a quarter and an eighth by default, as far
    as they are whole); ``window`` numbers a tier's windows; a step group has about ``group`` containers.
    """
    spark = sizes.sparkSession
    tiers = tiers if tiers is not None else [capacity // k for k in (8, 4, 2) if capacity % k == 0]
    items = materialize(sizes.select("id", F.greatest("size", F.lit(1)).alias("whole")), "sizes")
    rest = F.when(F.col("whole") > capacity, F.col("whole") % capacity).otherwise(F.col("whole"))
    counts = items.groupBy(rest.cast("int").alias("length")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("whole") > capacity, F.floor(F.col("whole") / capacity)).otherwise(0)).alias("full")).collect()
    plan = plan_containers({r["length"]: r["n"] for r in counts if r["length"]}, capacity, tiers, least_fill)
    full = sum(r["full"] for r in counts)
    groups = max(1, -(-(plan.containers + full) // group))
    buckets = max(_BUCKETS, -(-max([full, *(r["n"] for r in counts)], default=0) // _BUCKET_ROWS))
    parts = items.select("id", "whole", F.explode(F.when(F.col("whole") > capacity, F.sequence(F.lit(0), ((F.col("whole") - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))).alias("part"))
    parts = parts.select("id", "part", F.pmod(F.xxhash64("id", "part"), F.lit(buckets)).alias("spread"), (F.col("part") * capacity).cast("long").alias("offset"), F.least(F.lit(capacity), F.col("whole") - F.col("part") * capacity).cast("int").alias("size"), (F.col("whole") > capacity).alias("cut"))
    whole = (F.col("size") == capacity) & F.col("cut")
    # one numbering for both kinds: full parts are length 0
    numbered = positions(parts.withColumn("length", F.when(whole, 0).otherwise(F.col("size"))), ["length"], F.col("spread"), [F.col("spread"), F.col("id"), F.col("part")])
    shared = spark.sparkContext.broadcast(plan)
    kind = f"id {items.schema['id'].dataType.simpleString()}"
    return numbered.select("id", "part", "offset", "size", "length", "position").mapInArrow(lambda b: _placed(b, shared.value, capacity, full, groups), _PACKED.format(id=kind))


def containers_of(packed: DataFrame) -> DataFrame:
    """(id, containers, parts): over how many containers each item's parts lie."""
    return packed.groupBy("id").agg((F.max("part") + 1).alias("parts"), F.countDistinct("container").alias("containers"))


def tier_fill(packed: DataFrame) -> DataFrame:
    """(tier, windows, fill): the share of each context size's windows that is used."""
    w = packed.groupBy("tier", "window").agg(F.sum("size").alias("used"))
    return w.groupBy("tier").agg(F.count("*").alias("windows"), (F.sum("used") / F.count("*") / F.col("tier")).alias("fill"))
