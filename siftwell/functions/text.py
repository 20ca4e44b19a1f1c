"""Text functions as Columns: newlines, tokens, stopwords, headings; and the stemmer for vocabularies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stopwords. Those with an apostrophe can never equal a token, as tokens lose theirs.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by "
    "can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has "
    "hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in "
    "into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours "
    "ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them "
    "themselves then there there's these they they'd they'll they're they've this those through to too under until up very was "
    "wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with "
    "won't would wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()

#: Suffix rules of the stemmer's steps 2 and 3 (suffix, replacement) and the suffixes of step 4.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize", "tion"]


def normalized_newlines(c: Column) -> Column:
    """CR LF and lone CR as LF; null stays null."""
    return F.regexp_replace(c, "\r\n?", "\n")


def valid_text(raw: Column) -> Column:
    """Bytes as text, with what is not UTF-8 replaced; ``F.is_valid_utf8`` tells which rows a strict policy rejects."""
    return F.make_valid_utf8(raw)


def tokens(c: Column, *, lowercase: bool = True, drop_stopwords: bool = True, min_len: int = 2, max_len: int = 40) -> Column:
    """The unstemmed tokens of a text: runs of ASCII letters and digits, apostrophes deleted first.

    Lower-casing follows the extraction, so letters of other scripts cannot become ASCII ones. Null gives an empty array.
    """
    raw = F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), "'", ""), F.lit("[A-Za-z0-9]+"), F.lit(0))
    if lowercase:
        raw = F.transform(raw, F.lower)
    keep = F.filter(raw, lambda t: (F.length(t) <= max_len) & (F.length(t) >= min_len))
    if drop_stopwords:
        keep = F.filter(keep, lambda t: ~t.isin([w for w in STOPWORDS if "'" not in w]))
    return keep


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else 0."""
    return F.length(F.regexp_extract(line, "^(#{1,6}) ", 1))


def heading_text(line: Column) -> Column:
    """A heading without its marks and blanks around them."""
    return F.regexp_replace(F.regexp_replace(line, "^[# ]+", ""), "[# ]+$", "")


def indexed_text(context: Column, text: Column) -> Column:
    """What is indexed of a chunk: its context, if any, a line break and its text."""
    return F.when(F.coalesce(context, F.lit("")) == "", text).otherwise(F.concat_ws("\n", context, text))


def token_estimate(text: Column) -> Column:
    """The measure without a tokenizer: a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("int")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def stem(word: str) -> str:
    """The stem of a lower-case ASCII word.

    It departs from the published algorithm where the indexes built with it do: steps 2 and 3 try the next rule if a measure
    test fails, step 4 ends at its first suffix, ``tion`` leaves its t and is measured without it.
    """
    w = word
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = next((s for s in ("eed", "ed", "ing") if w.endswith(s)), None)
    if cut == "eed":
        w = w[:-1] if _measure(w[:-3]) else w
    elif cut and "v" in _shape(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _doubled(w):
            w = w if w[-1] in "lsz" else w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        w = next((w[: -len(s)] + r for s, r in rules if w.endswith(s) and _measure(w[: -len(s)])), w)
    last = next((s for s in STEP_4 if w.endswith(s)), None)
    if last and _measure(w[: -len(last)]) > 1:
        w = w[: -len(last)] + ("t" if last == "tion" else "")
    if w.endswith("e") and len(w) > 1:
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stemmed_vocabulary(words: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) for the distinct terms of a table: the stemmer sees each word once, not each occurrence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"term": b["term"], "stem": [stem(t) for t in b["term"]]})

    return words.select(F.col(term).alias("term")).filter("term IS NOT NULL").distinct().mapInPandas(run, "term string, stem string")
