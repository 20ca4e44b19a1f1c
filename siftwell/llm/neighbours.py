"""The most similar vectors for every vector: balanced posting lists with replicated boundary vectors.

1. Usable vectors are made unit length and coded as 16-bit integers with a scale; exact copies collapse to one
   representative (a group of copies of any size becomes one row and a membership table).
2. Centroids are fitted on a bounded sample by balanced splitting: each region gets centroids in proportion to its vectors.
3. Every vector searches its nearest centroids in an in-memory graph: pivots link to the centroids around them, and
   centroids to their nearest ones. Distance ratios to the nearest centroid decide in which lists it is stored (boundary vectors
   in several) and which it probes.
4. Each list compares its probing vectors with its stored ones, a bounded matrix product at a time. A list that is expected to be large
   is cut into cells, its stored vectors into parts and its probing ones into crowds, so no task holds a whole hot list.

The results are approximate only in that a pair that shares no list is missed; the tests measure recall against brute force.
With ``exact`` there is one list of cells for all vectors, so every pair is compared: quadratic work, for
collections where no miss is allowed. Similarities at a threshold are decided exactly, from the original vectors, where the
coding error could matter.

Defined results
- null ids; null, empty, wrongly long, non-finite or all-zero vectors: not usable, no rows;
- vectors not of unit length: compared by cosine; repeated rows of an id with the same vector: once; an id with different
  vectors: its smallest vector by hash counts;
- ties: by the smaller id; fewer than k others: as many as there are; empty tables: no rows;
- extra columns: ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import materialize

LIST_SIZE = 1024
#: Bounds of what is broadcast: centroids of at most 16,384 x 64 floats (4 MB) with their links, fitted on this many vectors.
MAX_CENTROIDS = 16_384
MAX_SAMPLE = 131_072
#: A list expected to store or be probed by more is cut into parts and crowds; each crowd visits every part.
MAX_STORED, MAX_PROBING = 16_384, 32_768
#: Distance ratios and numbers of lists: stored in, probed; and both for vectors with no centroid more similar than FAR.
STORE_RATIO, STORE_MOST, PROBE_RATIO, PROBE_MOST = 1.2, 3, 1.25, 5
FAR, FAR_STORE_MOST, FAR_PROBE_MOST = 0.42, 12, 20
BROADCAST_IDS = 100_000


def encode(unit: np.ndarray) -> pa.Array:
    """Unit vectors as a float32 scale and 16-bit integers each."""
    scale = (np.abs(unit).max(axis=1) / 32767).astype(np.float32)
    raw = np.empty((len(unit), 4 + 2 * unit.shape[1]), np.uint8)
    raw[:, :4] = scale[:, None].view(np.uint8)
    raw[:, 4:] = np.rint(unit / scale[:, None]).astype(np.int16).view(np.uint8)
    offsets = np.arange(len(unit) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(unit), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def decode(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    width, start = 4 + 2 * dim, column.offset
    first = np.frombuffer(column.buffers()[1], np.int32, 1, start * 4)[0] if len(column) else 0
    raw = np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, int(first)).reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return np.ascontiguousarray(raw[:, 4:]).view(np.int16).astype(np.float32) * scale


def code_error(dim: int) -> float:
    """A bound of the error of a product of two coded unit vectors: twice the half step times the root of the dimension."""
    return dim**0.5 / 32767 + 1e-5


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, h, code): usable vectors with a 128-bit hash of the raw vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            offsets = v.offsets.to_numpy()
            starts, lengths = offsets[:-1], np.diff(offsets)
            ok = (lengths == dim) & v.is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(ok)
            flat = v.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            m = flat[starts[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim), np.float32)
            wide = m.astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt((wide**2).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            rows, m, unit = rows[good], m[good] + np.float32(0), wide[good] / norm[good, None]
            hashes = [xxhash.xxh3_128_digest(r.tobytes()) for r in m]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(hashes, pa.binary()), encode(unit)], ["id", "h", "code"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(run, "id long, h binary, code binary")


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; empty clusters move to the vectors worst served."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        a = s.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, a, x)
        empty = np.flatnonzero(np.bincount(a, minlength=k) == 0)
        if len(empty):
            new[empty] = x[np.argsort(s.max(axis=1))[: len(empty)]]
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = (new / np.where(norm > 0, norm, 1)).astype(np.float32)
    return c


class Index:
    """Centroids, their graph and the expected sizes of their lists."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 0, exact: bool = False):
        rng = np.random.default_rng(seed)
        k = 1 if exact else int(min(MAX_CENTROIDS, max(1, -(-rows // LIST_SIZE)), max(1, len(sample) // 4)))
        x = sample.astype(np.float32)
        if k == 1:
            mean = x.mean(axis=0, keepdims=True) if len(x) else np.zeros((1, sample.shape[1] if sample.ndim > 1 else 1), np.float32)
            c = mean / max(float(np.linalg.norm(mean)), 1e-12)
        else:  # balanced: split the sample coarsely, then each part in proportion to its vectors
            coarse = _kmeans(x, max(1, int(k**0.5)), rng)
            own = (x @ coarse.T).argmax(axis=1)
            sizes = np.bincount(own, minlength=len(coarse))
            share = np.maximum(1, np.floor(sizes * k / len(x))).astype(int)
            c = np.concatenate([_kmeans(x[own == i], min(int(share[i]), int(sizes[i])), rng, 8) for i in range(len(coarse)) if sizes[i]])
        self.centroids = np.ascontiguousarray(c, np.float32)
        n = len(c)
        self.pivots = _kmeans(self.centroids, max(1, int(n**0.5)), rng) if n > 1 else self.centroids
        self.links = _top(self.pivots @ self.centroids.T, min(n, 64))
        near = min(n, 17)
        self.near = np.concatenate([_top(self.centroids[i : i + 1024] @ self.centroids.T, near) for i in range(0, n, 1024)])[:, 1:] if n > 1 else np.zeros((1, 0), np.int64)
        placed, probing = np.zeros(n), np.zeros(n)
        for i in range(0, len(x), 8192):
            _, lists, stored = self.place(x[i : i + 8192])
            placed += np.bincount(lists[stored], minlength=n)
            probing += np.bincount(lists, minlength=n)
        scale = rows / max(1, len(x))
        self.parts = np.maximum(1, np.ceil(placed * scale / MAX_STORED)).astype(np.int64)
        self.crowds = np.maximum(1, np.ceil(probing * scale / MAX_PROBING)).astype(np.int64)

    def search(self, q: np.ndarray, most: int = FAR_PROBE_MOST, width: int = 24, hops: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of about the ``most`` nearest centroids of each vector, nearest first.

        From the two pivots nearest to it each vector takes the linked centroids; then, while its best list still changes,
        it follows the edges of its two nearest centroids not followed yet. Vectors are handled together, by pivot or by hop.
        """
        n = len(self.centroids)
        width = min(width, n)
        ids, sims = np.full((len(q), width), -1, np.int64), np.full((len(q), width), -2, np.float32)
        for at in _top(q @ self.pivots.T, 2).T:
            for p in np.unique(at):
                rows = np.flatnonzero(at == p)
                s = q[rows] @ self.centroids[self.links[p]].T
                best = _top(s, width)
                ids[rows], sims[rows], _ = _merged(ids[rows], sims[rows], self.links[p][best], np.take_along_axis(s, best, 1), width)
        if n > self.links.shape[1]:
            active, done = np.arange(len(q)), np.zeros(ids.shape, bool)
            for _ in range(hops):
                order = np.argsort(done[active] * 4.0 - sims[active], axis=1)[:, :2]
                new = self.near[np.take_along_axis(ids[active], order, 1)].reshape(len(active), -1)
                mark = done[active]
                np.put_along_axis(mark, order, True, 1)
                s = np.matmul(self.centroids[new], q[active][:, :, None])[:, :, 0]
                old = ids[active][:, :5]
                ids[active], sims[active], done[active] = _merged(ids[active], sims[active], new, s, width, mark)
                active = active[(ids[active][:, :5] != old).any(axis=1)]
                if not len(active):
                    break
        return ids[:, :most], sims[:, :most]

    def place(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, stored): the lists each vector probes and whether it is stored there, by distance ratios.

        Vectors far from every centroid have many lists at about the same distance, so more of them may take part.
        """
        ids, sims = self.search(q)
        d = np.sqrt(np.maximum(0, 2 - 2 * sims.astype(np.float64)))
        ratio = d / np.maximum(d[:, :1], 1e-6)
        rank, far = np.arange(ids.shape[1])[None, :], sims[:, :1] < FAR
        stored = (ratio <= STORE_RATIO) & (rank < np.where(far, FAR_STORE_MOST, STORE_MOST)) | (rank == 0)
        probed = (ratio <= PROBE_RATIO) & (rank < np.where(far, FAR_PROBE_MOST, PROBE_MOST)) | stored
        row, col = np.nonzero(probed & (ids >= 0))
        return row, ids[row, col], stored[row, col]


def _merged(ids: np.ndarray, sims: np.ndarray, new: np.ndarray, s: np.ndarray, width: int, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``width`` distinct ids of both lists, row by row; ``mark`` stays with the ids of the first."""
    mark = np.zeros(ids.shape, bool) if mark is None else mark
    every, value = np.concatenate([ids, new], 1), np.concatenate([sims, s], 1)
    flags = np.concatenate([mark, np.zeros(new.shape, bool)], 1)
    o = np.argsort(every * 2 + ~flags, axis=1, kind="stable")  # of two copies the marked goes first
    every, value, flags = (np.take_along_axis(z, o, 1) for z in (every, value, flags))
    value[:, 1:][every[:, 1:] == every[:, :-1]] = -2
    keep = _top(value, width)
    every, value, flags = (np.take_along_axis(z, keep, 1) for z in (every, value, flags))
    return np.where(value > -1.5, every, -1), value, flags


def _top(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first."""
    k = min(k, s.shape[1])
    best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(k), s.shape)
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)


def fit_index(coded: DataFrame, dim: int, rows: int, seed: int = 0, exact: bool = False) -> Index:
    """Fit on a sample of at most MAX_SAMPLE vectors, chosen by a hash of the id."""
    want = min(MAX_SAMPLE, max(16_384, 16 * min(MAX_CENTROIDS, -(-rows // LIST_SIZE))))
    share = int(min(1.0, want / max(1, rows)) * (1 << 20))
    sample = coded.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("code").limit(MAX_SAMPLE).toArrow()
    x = decode(sample.column(0), dim) if sample.num_rows else np.zeros((0, dim), np.float32)
    return Index(x, rows, seed, exact)


def assign(reps: DataFrame, index: Index, dim: int) -> DataFrame:
    """(cell, id, stored, probes, code): one row per cell in which a vector is stored or probes."""
    shared = reps.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                part = b.slice(i, 8192)
                row, at, stored = index.place(decode(part.column(1), dim))
                m, c = index.parts[at], index.crowds[at]
                with np.errstate(over="ignore"):
                    h = (part.column(0).to_numpy()[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                own, crowd = h % m, h // m % c
                # first each vector probes every part with its crowd, then what is stored goes to the other crowds of its part
                k, sub = _spread(m)
                cells = [at[k] << 40 | sub << 20 | crowd[k]]
                which, held, probes = [k], [stored[k] & (own[k] == sub)], [np.ones(len(k), bool)]
                if (c > 1).any():
                    k, other = _spread(np.where(stored, c, 0))
                    k, other = k[other != crowd[k]], other[other != crowd[k]]
                    cells.append(at[k] << 40 | own[k] << 20 | other)
                    which.append(k)
                    held.append(np.ones(len(k), bool))
                    probes.append(np.zeros(len(k), bool))
                cells, which, held, probes = (np.concatenate(z) for z in (cells, which, held, probes))
                for j in range(0, len(which), 65_536):
                    take = pa.array(row[which[j : j + 65_536]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[j : j + 65_536]), part.column(0).take(take), pa.array(held[j : j + 65_536]), pa.array(probes[j : j + 65_536]), part.column(1).take(take)], ["cell", "id", "stored", "probes", "code"]
                    )

    return reps.select("id", "code").mapInArrow(run, "cell long, id long, stored boolean, probes boolean, code binary")


def _spread(copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the copy) of so many copies of each row."""
    k = np.repeat(np.arange(len(copies)), copies)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(copies) - copies, copies)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of a block of probing rows, ids of the stored rows, similarities) of a cell, a bounded matrix at a time."""
    table = pa.Table.from_batches(list(batches))
    ids, v = table.column("id").to_numpy(), decode(table.column("code"), dim)
    stored, probes = (table.column(c).to_numpy(zero_copy_only=False) for c in ("stored", "probes"))
    own, held, asking = v[stored], ids[stored], np.flatnonzero(probes)
    if len(held):
        step = max(1, 4_000_000 // len(held))
        for i in range(0, len(asking), step):
            yield ids[asking[i : i + step]], held, v[asking[i : i + step]] @ own.T


def similar_in_lists(assigned: DataFrame, dim: int, least: float) -> DataFrame:
    """(a, b, s), a < b: pairs of a list with a coded similarity of at least ``least``; a pair may come from several lists. Pairs leave the task block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, held, sims in _blocks(batches, dim):
            i, j = np.nonzero(sims >= least)
            x, y, s = rows[i], held[j], sims[i, j]
            keep = np.flatnonzero(x != y)
            for k in range(0, len(keep), 100_000):
                own = keep[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[own], y[own])), pa.array(np.maximum(x[own], y[own])), pa.array(s[own].astype(np.float32))], ["a", "b", "s"])

    return assigned.groupBy("cell").applyInArrow(run, "a long, b long, s float")


def nearest_in_lists(assigned: DataFrame, dim: int, k: int) -> DataFrame:
    """(id, near array<struct<id, s>>): for each probing row of a list its k most similar stored rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, held, sims in _blocks(batches, dim):
            sims[rows[:, None] == held[None, :]] = -2
            best = _top(sims, k)
            s = np.take_along_axis(sims, best, 1)
            real = s > -1.5
            offsets = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(held[best][real]), pa.array(s[real].astype(np.float32))], ["id", "s"])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.ListArray.from_arrays(pa.array(offsets), pairs)], ["id", "near"])

    return assigned.groupBy("cell").applyInArrow(run, "id long, near array<struct<id:long,s:float>>")


def _representatives(coded: DataFrame) -> DataFrame:
    """(rep, last, h, code): one row per distinct vector; ``last`` differs from ``rep`` if there are copies. Copies are folded in each task before the shuffle."""
    return coded.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("code").alias("code"))


def _one_vector_each(coded: DataFrame) -> DataFrame:
    """Ids with one vector; of an id with several, the smallest by hash."""
    several = coded.groupBy("id").agg(F.min("h").alias("_h"), F.max("h").alias("_x")).filter("_h <> _x").select(F.col("id").alias("_id"), "_h")
    several = materialize(several, "several")
    if several.isEmpty():
        return coded
    return coded.join(several, F.col("id") == F.col("_id"), "left").filter("_id IS NULL OR h = _h").drop("_id", "_h")


def prepare(vectors: DataFrame, key: str, vector: str, dim: int, seed: int = 0, exact: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coded, representatives, rows placed in lists)."""
    coded = _one_vector_each(materialize(usable(vectors, key, vector, dim), "coded", "none"))
    rows = coded.count()
    index = fit_index(coded, dim, rows, seed, exact)
    reps = _representatives(coded)
    return coded, reps, assign(reps.select(F.col("rep").alias("id"), "code"), index, dim)


def copies(coded: DataFrame) -> DataFrame:
    """(rep, id): the members of every group of exact copies, its representative among them."""
    groups = coded.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep <> last").select(F.col("h").alias("_h"), "rep")
    return coded.select("id", "h").distinct().join(groups, F.col("h") == F.col("_h")).select("rep", "id")


def similar_pairs(vectors: DataFrame, key: str, vector: str, dim: int, least: float, seed: int = 0, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives (a, b), members (rep, id)): all found with a cosine of at least ``least``; with ``exact`` all there are.

    Pairs whose coded similarity leaves doubt are decided by the original vectors in double precision.
    """
    coded, _, placed = prepare(vectors, key, vector, dim, seed, exact)
    error = code_error(dim)
    found = similar_in_lists(placed, dim, least - error).groupBy("a", "b").agg(F.max("s").alias("s"))
    pairs = materialize(found, "pairs")
    members = materialize(copies(coded), "copies")
    doubtful = pairs.filter(F.col("s") < least + error)
    sure = pairs.filter(F.col("s") >= least + error).select("a", "b")
    count = doubtful.count()
    if not count:
        return sure, members
    ids = doubtful.select(F.explode(F.array("a", "b")).alias("_i")).distinct()
    raw = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dim)
    raw = raw.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, F.col("_id") == F.col("_i"), "left_semi").groupBy("_id").agg(F.max("v").alias("v"))
    raw = materialize(raw, "doubtful")
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    j = doubtful.join(raw.select(F.col("_id").alias("a"), F.col("v").alias("va")), "a").join(raw.select(F.col("_id").alias("b"), F.col("v").alias("vb")), "b")
    cosine = product(F.col("va"), F.col("vb")) / F.sqrt(product(F.col("va"), F.col("va")) * product(F.col("vb"), F.col("vb")))
    return sure.unionByName(j.filter(cosine >= least).select("a", "b")), members


def expanded_pairs(pairs: DataFrame, members: DataFrame, most: int = 100_000_000) -> DataFrame:
    """(a, b), a < b, over all ids: between the copies of both representatives, and within a group of copies.

    That squares a group of copies, so the pairs are counted first; more than ``most`` are refused, as pairs of
    representatives and their members say the same.
    """
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    a, b = (sizes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    across = pairs.join(a, "a", "left").join(b, "b", "left").agg(F.sum(F.coalesce("na", F.lit(1)) * F.coalesce("nb", F.lit(1)))).first()[0] or 0
    within = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    if across + within > most:
        raise ValueError(f"{across + within:.0f} pairs of copies; use the pairs of representatives and their members")
    m = members.select(F.col("rep").alias("_rep"), F.col("id").alias("_id"))
    x = pairs.join(m, F.col("a") == F.col("_rep"), "left").select(F.coalesce("_id", "a").alias("x"), "b")
    y = x.join(m, F.col("b") == F.col("_rep"), "left").select("x", F.coalesce("_id", "b").alias("y"))
    own = members.select("rep", F.col("id").alias("x")).join(members.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y")
    return y.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(own.select(F.col("x").alias("a"), F.col("y").alias("b")))


def nearest(vectors: DataFrame, key: str, vector: str, dim: int, k: int = 10, seed: int = 0, exact: bool = False) -> DataFrame:
    """(id, rank, neighbour, similarity): the k most similar other vectors of every usable vector (about, see above; with ``exact`` without a miss).

    Similarities are those of the coded vectors, rounded to 4 places. Copies of a vector come first in its ranking.
    """
    coded, _, placed = prepare(vectors, key, vector, dim, seed, exact)
    # one shuffle by id carries the lists of neighbours; what follows is keyed by id and shares it
    lists = nearest_in_lists(placed, dim, k).repartition("id")
    found = lists.select("id", F.explode("near").alias("n")).groupBy("id", F.col("n.id").alias("near")).agg(F.max("n.s").alias("s"))
    members = materialize(copies(coded), "copies")
    order = [F.desc("s"), F.asc("near")]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("r") <= k).drop("r")
    if not members.isEmpty():
        first = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1).drop("r")
        first = materialize(first.select(F.col("rep").alias("_rep"), F.col("id").alias("_id")), "first")
        spread = best.join(first, F.col("near") == F.col("_rep"), "left").select("id", F.coalesce("_id", "near").alias("near"), "s")
        spread = spread.unionByName(first.select(F.col("_rep").alias("id"), F.col("_id").alias("near"), F.lit(1.0).cast("float").alias("s")))
        top = spread.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("r") <= k + 1).drop("r")
        m = members.select(F.col("rep").alias("_rep"), F.col("id").alias("_id"))
        best = top.join(m, F.col("id") == F.col("_rep"), "left").select(F.coalesce("_id", "id").alias("id"), "near", "s").filter("id <> near")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("id", "rank", F.col("near").alias("neighbour"), F.round(F.col("s").cast("double"), 4).alias("similarity"))
