"""Scores for abusive, hateful or sexually explicit text: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Texts are cut into segments of a sentence or 32 words at most and folded (case, accents, look-alike letters, digits and signs used as
letters, blanks and signs inside words, stretched, masked and run-together words). A segment's features are its word
1- to 3-grams and skip-grams. A document scores as its most abusive segment does, so a long harmless text hides nothing.

Labels are per document and partly wrong. The model is fitted in rounds: after each, a positive document is represented by its
highest-scoring segments only, and labels that models without this document contradict are left out. Documents without a label, nearly
all of them harmless, are learned as weak negatives, together half as heavy as the labelled ones: a wrong
yes on a document of common sentences then has the collection against it.

What the fit sees is bounded: ``max_labelled`` labelled and ``max_unlabelled`` other documents (chosen by a hash of the id), of
whose segments at most about ``max_segments`` are drawn by a hash. Their words' hashes are what the driver holds.
Every segment of every text is scored. The weights are sparse (L1) and bounded by the number of hash
slots, which bounds their broadcast to 8 bytes a slot; the vocabulary sent with them has at most ``MAX_VOCABULARY`` words.

Defined results
- null, empty and blank texts: score 0;
- very long texts: every segment is scored, none is cut off;
- repeated documents: each row gets its score; in the fit a doc_id counts once (the greatest text);
- ties in labels (as many yes as no): a target of one half, learned as a no of that strength;
- null labels, null ids and labels of unknown documents: not used; without any label the seed sentences and the unlabelled documents are learned;
- null or unknown sources: a rate of their own under their folded name or null; empty tables: no rows;
- extra columns: ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.abuse_seeds import HARMFUL, HARMLESS
from siftwell.session import materialize

BITS = 22
WORDS_PER_SEGMENT = 32
#: Bounds of the sample that the model is fitted on, and of the vocabulary that is broadcast with it.
MAX_LABELLED, MAX_UNLABELLED, MAX_SEGMENTS, MAX_VOCABULARY = 12_000, 5_000, 400_000, 200_000
#: All unlabelled documents together weigh so much of what the labelled negatives do, one of them at most so much of a labelled one.
UNLABELLED_SHARE, UNLABELLED_MOST = 0.5, 0.3
#: A yes is doubted if no segment scores above the first, a no if one scores above the second, out of fold.
DOUBT_YES, DOUBT_NO = 0.3, 0.75
#: A document counts as abusive from this score on. Chosen on documents relabelled at random with 5 % wrong labels (README).
THRESHOLD = 0.35
FITS = 2

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аесорхуіјѕԁһкмтвнгАЕСОРХУІЈЅКМТВНαορνικτυ", "aecopxyijsdhkmtbhrAECOPXYIJSKMTBHaopviktu")
#: Digits and signs used as letters.
LEET = str.maketrans("013457@$!89", "oieastasibg")
#: Letters of scripts written without blanks, each a word of its own (South-East Asian, Tibetan, kana, Han).
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff"

_SENTENCE_END = re.compile(r"[\n\r]+|(?<=[.!?…。！？;])[\"')\]”»]*\s+|(?<=[。！？])")
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_SPACED = re.compile(r"(?<![^\W\d_])[^\W_](?: [^\W_*]){2,}(?![^\W\d_])")
_INNER = re.compile(r"(?<=[^\W_])[-_.·~'’](?=[^\W_])")
_INNER_MARK = re.compile(r"(?<=[^\W\d_])!(?=[^\W\d_])")
#: What only the slower part of the folding treats: letters with blanks or signs between them, letters beside digits and signs.
_ODD = re.compile(r"[^\W_][-_.·~'’!][^\W_]|[^\W\d_][*!_]*[013457@$]|[013457@$][*!_]*[^\W\d_]|(?<![^\W\d_])[^\W_] [^\W_] [^\W_](?![^\W\d_])")
_STRETCHED = re.compile(r"(\w)\1+")
_WORD = re.compile(f"[{UNSPACED}]|[\\w*@$]+")
_SIGNED_WORD, _LEET_SIGN, _LETTER, _DIGIT = re.compile(r"[\w@$!*]+"), re.compile("[013457@$]"), re.compile(r"[^\W\d_]"), re.compile(r"\d")
_CYRILLIC = re.compile("[\u0370-\u052f]")
_OTHER_CYRILLIC = re.compile("[бгджзийлпфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯґєї]")
_LATIN = re.compile("[A-Za-z]")
_NUMBER = re.compile(r"\d+")


def fold(segment: str) -> list[str]:
    """The words of a segment in their folded form; a masked letter stays as ``*``."""
    return [w for w in map(folded_word, raw_words(segment)) if w]


def folded_word(word: str) -> str:
    """Stretched letters once, numbers as 0; nothing of a word that is only a mask."""
    return _NUMBER.sub("0", _STRETCHED.sub(r"\1", word)) if word.strip("*") else ""


def raw_words(segment: str) -> list[str]:
    """The words after all folding that looks beyond a single word."""
    if not segment.isascii():
        segment = unicodedata.normalize("NFKD", _HIDDEN.sub("", segment))
        if _CYRILLIC.search(segment) and _LATIN.search(segment) and not _OTHER_CYRILLIC.search(segment):
            segment = segment.translate(LOOKALIKES)
        if not segment.isascii():
            segment = "".join(c for c in segment if not unicodedata.combining(c))
    s = segment.lower()
    if not _ODD.search(s):
        return _WORD.findall(s)
    s = _SPACED.sub(lambda m: m.group().replace(" ", ""), s)
    s = _INNER.sub("", _INNER_MARK.sub("i", s))
    if _LEET_SIGN.search(s):
        mixed = [w.rstrip("!") for w in _SIGNED_WORD.findall(s) if _LEET_SIGN.search(w) and _LETTER.search(w)]
        if mixed:
            every = sum(_DIGIT.search(w) is not None for w in mixed) > 1
            s = _SIGNED_WORD.sub(lambda m: _leet(m.group(), every), s)
    return _WORD.findall(s)


def _leet(word: str, every: bool) -> str:
    body = word.rstrip("!")
    if not body:
        return word
    letters = sum(ch.isalpha() for ch in body)
    if letters and letters < len(body) or every and body.isdigit() and len(body) < 4:
        return body.translate(LEET)
    return word


def windows(n: int) -> list[tuple[int, int]]:
    """A sentence of n words as segments: whole, or in half-overlapping windows."""
    if n <= WORDS_PER_SEGMENT:
        return [(0, n)]
    half = WORDS_PER_SEGMENT // 2
    return [(i, min(n, i + WORDS_PER_SEGMENT)) for i in range(0, n - half, half)]


def segments(text: str | None) -> Iterator[list[str]]:
    """Folded segments of a text."""
    for sentence in _SENTENCE_END.split(text or ""):
        words = fold(sentence) if sentence else []
        for a, b in windows(len(words)) if words else ():
            yield words[a:b]


class Words:
    """Word hashes. Words that the vocabulary lacks are read by it: masked ones as its most frequent word that fits, run-together ones as its words in a row."""

    def __init__(self, vocabulary: Iterable[tuple[str, int]] = ()):
        self.counts = {w: n for w, n in vocabulary if "*" not in w}
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.counts, key=lambda w: (-self.counts[w], w)):
            self.by_length.setdefault(len(w), []).append(w)
        self.longest = max((len(w) for w in self.counts if len(w) < 32), default=0)
        self.cache: dict[str, tuple[int, ...]] = {}

    def resolved(self, word: str) -> list[str]:
        """The words that a folded word stands for."""
        if "*" in word:
            body = word.strip("*")
            for shape in (word, body):
                if "*" in shape and len(shape) > 2:
                    fits = re.compile(re.escape(shape).replace(r"\*", ".")).fullmatch
                    found = next((w for w in self.by_length.get(len(shape), ()) if fits(w)), None)
                    if found:
                        return [found]
            return [body if body in self.counts else word.replace("*", "")]
        if len(word) >= 10 and word not in self.counts and self.longest:
            return self._cut(word) or [word]
        return [word]

    def _cut(self, word: str) -> list[str] | None:
        """The word as the fewest words of the vocabulary, of three letters or more on average; None if it is not such a chain. Ends where no chain goes on."""
        best: dict[int, tuple[int, int]] = {0: (0, 0)}
        reach = 0
        for i in range(len(word)):
            if i > reach:
                return None
            if i in best:
                for j in range(i + 1, min(len(word), i + self.longest) + 1):
                    if word[i:j] in self.counts and (j not in best or best[j][0] > best[i][0] + 1):
                        best[j] = (best[i][0] + 1, i)
                        reach = max(reach, j)
        out, j = [], len(word)
        while j and j in best:
            out.append(word[best[j][1] : j])
            j = best[j][1]
        return out[::-1] if not j and 3 * len(out) <= len(word) else None

    def hashes(self, raw: str) -> tuple[int, ...]:
        """Of a raw word, usually one; none of a word that is only a mask."""
        word = folded_word(raw)
        got = tuple(zlib.crc32(w.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFFFFFF for w in self.resolved(word) if w) if word else ()
        if len(raw) < 64:
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[raw] = got
        return got

    def hash(self, word: str) -> int:
        return self.hashes(word)[0]

    def line(self, raw: list[str]) -> list[int]:
        """The hashes of a row of raw words."""
        known = self.cache
        return [h for w in raw for h in (known[w] if w in known else self.hashes(w))]


def hashed(h: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, segment) of all features: word 1-, 2- and 3-grams, and pairs with one or two words left out."""
    seg = np.repeat(np.arange(len(lengths)), lengths)
    slots, owner = [_slot(h)], [seg]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 3), (2, 5), (3, 7)):
            if len(h) > gap:
                same = seg[gap:] == seg[:-gap]
                pair = (h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:]) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * salt)
                slots.append(_slot(pair[same]))
                owner.append(seg[gap:][same])
        if len(h) > 2:
            same = seg[2:] == seg[:-2]
            triple = ((h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]) * np.uint64(0xD6E8FEB86659FD93)
            slots.append(_slot(triple[same]))
            owner.append(seg[2:][same])
    return np.concatenate(slots), np.concatenate(owner)


def _slot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ftrl:
    """FTRL-proximal logistic regression with per-coordinate rates, fed in small batches."""

    def __init__(self, size: int, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.4, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha + self.l2)

    def learn(self, unique: np.ndarray, inverse: np.ndarray, owner: np.ndarray, target: np.ndarray, importance: np.ndarray) -> None:
        """One batch: its distinct slots, which of them each feature is, and whose the feature is."""
        w, b = self.weights(unique), self.bias()
        margin = np.bincount(owner, w[inverse], len(target)) + b
        g = (sigmoid(margin) - target) * importance
        gradient = np.bincount(inverse, g[owner], len(unique))
        squares = np.bincount(inverse, g[owner] ** 2, len(unique))
        n = self.n[unique]
        self.z[unique] += gradient - (np.sqrt(n + squares) - np.sqrt(n)) / self.alpha * w
        self.n[unique] = n + squares
        gb, sb = g.sum(), (g**2).sum()
        self.bias_z += gb - (np.sqrt(self.bias_n + sb) - np.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += sb


class Model:
    """Sparse weights, the bias and the vocabulary for masked and run-together words; small enough to broadcast."""

    #: Margins of so many sentences are kept by a worker, as many are met again and again.
    KEPT = 100_000

    def __init__(self, index: np.ndarray, value: np.ndarray, bias: float, vocabulary: list[tuple[str, int]], threshold: float = THRESHOLD):
        self.index, self.value, self.bias, self.vocabulary, self.threshold = index, value, bias, vocabulary, threshold
        self._dense: np.ndarray | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_words", "_seen")} | {"_dense": None}

    def _open(self) -> None:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.index] = self.value
            self._words, self._seen = Words(self.vocabulary), {}

    def segment_margins(self, h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        slots, owner = hashed(h, lengths)
        return np.bincount(owner, self._dense[slots], len(lengths)) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One score per text, 0 for those without a word."""
        self._open()
        seen, line = self._seen, self._words.line
        if len(seen) > self.KEPT:
            seen.clear()
        h, lengths, of, fresh = [], [], [], {}
        at, owner = [], []
        known_margin, known_owner = [], []
        for i, t in enumerate(texts):
            for s in _SENTENCE_END.split(t or ""):
                if not s:
                    continue
                m = seen.get(s)
                if m is not None:
                    known_margin.append(m)
                    known_owner.append(i)
                    continue
                k = fresh.get(s)
                if k is None:
                    k = fresh[s] = len(fresh)
                    words = line(raw_words(s))
                    for a, b in windows(len(words)) if words else ():
                        h += words[a:b]
                        lengths.append(b - a)
                        of.append(k)
                at.append(k)
                owner.append(i)
        best = np.full(len(texts), -np.inf)
        if fresh:
            margin = np.full(len(fresh), -np.inf)
            if lengths:
                np.maximum.at(margin, np.array(of), self.segment_margins(np.array(h, np.uint64), np.array(lengths)))
            np.maximum.at(best, np.array(owner), margin[at])
            for s, m in zip(fresh, margin.tolist(), strict=True):
                if len(s) < 512:
                    seen[s] = m
        np.maximum.at(best, np.array(known_owner, np.int64), np.array(known_margin))
        return np.where(np.isfinite(best), sigmoid(best), 0.0)


def fit(texts: list[str], targets: list[float], unlabelled: list[str] = (), seeds: bool = True, **options) -> Model:
    """Fit on labelled documents (targets from 0 to 1), unlabelled ones and the seed sentences, all in memory."""
    every = [*texts, *unlabelled]
    rows = [(i, p) for i, t in enumerate(every) for p in segments(t)]
    words = pa.array([p for _, p in rows], pa.list_(pa.string()))
    return fit_segments(np.array([i for i, _ in rows], np.int64), words, np.array([*targets, *[np.nan] * len(unlabelled)], float), seeds, **options)


def fit_segments(owner: np.ndarray, words: pa.ListArray, targets: np.ndarray, seeds: bool = True, rounds: int = 3, epochs: int = 3, folds: int = 3, batch: int = 128, seed: int = 0) -> Model:
    """Fit on segments (folded words) of the documents that ``owner`` numbers; a document without a label has the target nan.

    Between the rounds every segment is judged by a model that has not seen its document (``folds``), so that a wrong
    label cannot vouch for itself. The weights are the mean of ``FITS`` fits with other folds and orders.
    """
    extra = [(len(targets) + i, p) for i, t in enumerate(HARMFUL + HARMLESS) for p in segments(t)] if seeds else []
    kind = np.where(np.isnan(targets), 1, 0)
    if seeds:
        owner = np.concatenate([owner, np.array([i for i, _ in extra], np.int64)])
        words = pa.concat_arrays([words, pa.array([p for _, p in extra], words.type)])
        targets = np.concatenate([targets, np.repeat([1.0, 0.0], [len(HARMFUL), len(HARMLESS)])])
        kind = np.concatenate([kind, np.full(len(HARMFUL) + len(HARMLESS), 2)])
    target = np.nan_to_num(targets, nan=0.0)
    coded = words.flatten().dictionary_encode()
    if not len(coded):
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, [])
    codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    counts = np.bincount(codes, minlength=len(distinct))
    vocabulary = Counter(dict(zip(distinct, counts.tolist(), strict=True))).most_common(MAX_VOCABULARY)
    known = Words(vocabulary)
    each = [known.hashes(w) for w in distinct]
    # a word may stand for several: the hashes of all words in a row, and how many there are of each segment
    sizes = np.array([len(e) for e in each])
    flat, first = np.array([h for e in each for h in e], np.uint64), np.cumsum(sizes) - sizes
    per = sizes[codes]
    h = flat[np.repeat(first[codes] - (np.cumsum(per) - per), per) + np.arange(per.sum())]
    lengths = np.add.reduceat(np.append(per, 0), np.append(words.offsets.to_numpy()[:-1] - words.offsets[0].as_py(), len(per)))[:-1] * (np.diff(words.offsets.to_numpy()) > 0)
    slots, of = hashed(h, lengths)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(lengths) + 1))
    used, slots = np.unique(slots[order], return_inverse=True)
    slots = slots.astype(np.int32)
    rng = np.random.default_rng(seed)

    def learned(use: np.ndarray, importance: np.ndarray) -> Ftrl:
        model = Ftrl(len(used))
        rng.shuffle(use)
        batches = []
        for i in range(0, len(use), batch):
            pick = use[i : i + batch]
            n = starts[pick + 1] - starts[pick]
            at = np.repeat(starts[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            unique, inverse = np.unique(slots[at], return_inverse=True)
            batches.append((unique, inverse.astype(np.int32), np.repeat(np.arange(len(pick), dtype=np.int32), n), target[owner[pick]], importance[pick]))
        for _ in range(epochs):  # the batches stay, their order changes
            for i in rng.permutation(len(batches)):
                model.learn(*batches[i])
        return model

    docs, positive, trusted = len(target), target > 0.5, kind == 2
    no, other = (kind == 0) & ~positive, (kind == 1).sum()
    weight = np.ones(docs)
    weight[kind == 1] = min(UNLABELLED_MOST, UNLABELLED_SHARE * max(1, no.sum()) / max(1, other))
    parts = np.maximum(1, np.bincount(owner, minlength=docs))
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(FITS):
        # at first a positive document's weight is shared among its segments, as nothing tells which of them it is
        importance = np.where((positive & ~trusted)[owner], 1.0 / parts[owner], weight[owner])
        fold = rng.integers(0, folds, docs)[owner]
        for _ in range(rounds):
            p = np.zeros(len(lengths))
            for f in range(folds):
                model = learned(np.flatnonzero((importance > 0) & ((fold != f) | trusted[owner])), importance)
                margin = np.bincount(np.repeat(np.arange(len(lengths)), np.diff(starts)), model.weights()[slots], len(lengths)) + model.bias()
                p[fold == f] = sigmoid(margin)[fold == f]
            best = np.zeros(docs)
            np.maximum.at(best, owner, p)
            importance = np.where(positive[owner], (p >= 0.7 * best[owner]) & (best[owner] > DOUBT_YES), (best[owner] < DOUBT_NO) * weight[owner])
            importance[trusted[owner]] = 1.0
        final = learned(np.flatnonzero(importance > 0), importance)
        w, bias = w + final.weights() / FITS, bias + final.bias() / FITS
    index = np.flatnonzero(w)
    return Model(used[index].astype(np.int32), w[index].astype(np.float32), float(bias), vocabulary)


def training_documents(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """(doc_id, target, text) of the sample that the model is fitted on: the mean of a document's labels, null for those without."""
    first = lambda df, n: df.orderBy(F.xxhash64("_id"), "_id").limit(n)
    targets = labels.filter("doc_id IS NOT NULL AND abusive IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.avg("abusive").alias("target"))
    known = materialize(first(targets, max_labelled), "labelled")
    ids = documents.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL")
    others = first(ids.distinct().join(F.broadcast(known.select("_id")), "_id", "left_anti"), max_unlabelled).withColumn("target", F.lit(None).cast("double"))
    sample = materialize(known.unionByName(others), "sample")
    texts = documents.select("doc_id", "text").filter("text <> ''").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    return texts.groupBy("doc_id").agg(F.max("target").alias("target"), F.max("text").alias("text"))


def training_segments(sample: DataFrame, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(doc_id, target, words): the folded segments of the sample; beyond ``max_segments`` a part of them, drawn by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                parts = list(segments(b.column(2)[i].as_py()))
                for a in range(0, len(parts), 10_000):
                    some = parts[a : a + 10_000]
                    take = pa.array([i] * len(some))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(range(a, a + len(some)), pa.int64()), pa.array(some, pa.list_(pa.string()))], ["doc_id", "target", "part", "words"])

    rows = materialize(sample.select(F.col("doc_id").cast("long"), "target", "text").mapInArrow(run, "doc_id long, target double, part long, words array<string>"), "segments")
    n = rows.count()
    if n > max_segments:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "part"), F.lit(1 << 30)) < int(max_segments / n * (1 << 30)))
    return rows.drop("part")


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED, max_segments: int = MAX_SEGMENTS) -> Model:
    got = training_segments(training_documents(documents, labels, max_labelled, max_unlabelled), max_segments).toArrow().sort_by("doc_id")
    ids, owner = np.unique(got.column("doc_id").to_numpy(), return_inverse=True)
    targets = np.full(len(ids), np.nan)
    targets[owner] = got.column("target").to_numpy(zero_copy_only=False)
    words = pa.concat_arrays(got.column("words").chunks) if got.num_rows else pa.array([], pa.list_(pa.string()))
    return fit_segments(owner.astype(np.int64), words, targets)


def score_documents(documents: DataFrame, model: Model, carried: list[str] = ()) -> DataFrame:
    """(doc_id, carried columns, score) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.select(F.col("doc_id").cast("long"), *carried, F.col("text"))
    names = ["doc_id", *carried, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shared.value.scores(part.columns[-1].to_pylist()))], names)

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", score double")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, flagged, rate) per folded source, of scores that carry their source: one pass over the texts, no join."""
    source = F.lower(F.trim(F.col("source"), F.lit(" \t")))
    flagged = F.sum((F.col("score") >= threshold).cast("long"))
    return scored.groupBy(source.alias("source")).agg(F.count("*").alias("documents"), flagged.alias("flagged"), F.round(flagged / F.count("*"), 6).alias("rate"))
