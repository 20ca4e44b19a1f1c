import os
import random

import pytest
from pyspark.sql import functions as F

from siftwell.llm import abuse
from tests.conftest import rows

HIDDEN = [
    "you are a stupid idiot",
    "Y0u 4r3 4 57up1d 1d107",
    "YOU ARE A STUUUUPID IDIOTTTT",
    "you are a s t u p i d i d i o t",
    "you are a stu​pid idi​ot",
    "you are a st-upid idi_ot",
    "уоu аrе а stuріd idiоt",
    "you are a stüpid ídiot",
]


@pytest.mark.parametrize("text", HIDDEN[1:])
def test_folding(text):
    wanted, got = abuse.fold(HIDDEN[0]), abuse.fold(text)
    assert got == wanted or "".join(got) == "".join(wanted)


def test_masked_words_use_the_vocabulary():
    w = abuse.Words([("stupid", 3), ("rats", 2)])
    assert w.hash("st*pid") == w.hash("stupid") and w.hash("ra*s") == w.hash("rats") and w.hash("x*y") == w.hash("xy")
    assert w.hash("s**p*d") == w.hash("stupid") and w.hash("**stupid*") == w.hash("stupid") and w.hashes("***") == ()
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    v = abuse.Words([(abuse.folded_word(long), 1)])
    assert v.hash(long[:9] + "*" + long[10:]) == v.hash(long)


def test_run_together_words_of_any_length():
    w = abuse.Words([(x, 1) for x in ("you", "are", "such", "worthles", "stupid", "idiot", "and", "everybody", "knows")])
    chain = "youaresuchuselesstupididiot"
    assert w.resolved("youaresuchworthlesstupididiotandeverybodyknows") == ["you", "are", "such", "worthles", "stupid", "idiot", "and", "everybody", "knows"]
    assert w.resolved(chain) == [chain] and w.resolved("x" * 5000) == ["x" * 5000]  # no chain of the vocabulary: a word of its own
    model = abuse.fit([], [])
    assert model.scores(["youareastupididiotandeverybodyhatesyou"])[0] > model.scores(["theparserreadstheindexandtherowsofcaches"])[0]


def test_scripts_without_blanks():
    for text in ("お前は馬鹿だ", "无耻的白痴", "คุณโง่", "ខ្មែរ", "မြန်မာ", "𠀀𠀁"):
        assert all(len(w) == 1 for w in abuse.fold(text)) and len(abuse.fold(text)) > 1


def test_numbers_and_plain_text_stay():
    assert abuse.fold("Release 0.13.5 took 86 lines") == ["release", "0", "tok", "0", "lines"]
    assert abuse.fold("") == [] and abuse.fold("*** !!!") == []


def test_segments_cover_long_text():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(500)]
    got = list(abuse.segments(" ".join(words)))
    assert {w for s in got for w in s} == {w for x in words for w in abuse.fold(x)} and max(map(len, got)) <= abuse.WORDS_PER_SEGMENT
    assert list(abuse.segments(None)) == []


def synthetic(n, seed, noise=0.1):
    """Documents of harmless sentences, some with an insult from a grammar; labels are partly wrong."""
    r = random.Random(seed)
    things, verbs = ["cache", "queue", "index", "parser", "lease"], ["stores", "drops", "reads", "moves"]
    bad = ["idiot", "moron", "loser", "cretin"]
    texts, truth, labels = [], [], []
    for _ in range(n):
        s = [f"The {r.choice(things)} {r.choice(verbs)} {r.randrange(99)} rows of the {r.choice(things)}." for _ in range(r.randrange(1, 6))]
        t = r.random() < 0.2
        if t:
            s.insert(r.randrange(len(s) + 1), r.choice(["Go away you {} nobody wants your {}.", "Only a {} would write such a {}.", "Your {} brain broke the {} again."]).format(r.choice(bad), r.choice(things)))
        elif r.random() < 0.1:
            s.append(f"The word {r.choice(bad)} is blocked by the {r.choice(things)}.")
        texts.append(" ".join(s))
        truth.append(t)
        labels.append(float(t ^ (r.random() < noise)))
    return texts, truth, labels


def test_held_out_accuracy_with_wrong_labels():
    texts, _, labels = synthetic(1500, 1)
    model = abuse.fit(texts, labels, seeds=False)
    test, truth, _ = synthetic(800, 2, 0)
    flagged = model.scores(test) >= model.threshold
    hits = sum(f and t for f, t in zip(flagged, truth, strict=True))
    assert hits / max(1, sum(flagged)) > 0.95 and hits / sum(truth) > 0.95
    assert len(model.index) < 1 << abuse.BITS


def test_wrong_labels_on_common_sentences():
    """A sentence that fills a tenth of the collection is labelled yes wherever it was labelled: the unlabelled documents outvote it."""
    texts, _, labels = synthetic(300, 4, 0.05)
    common = ["Мы проверили 17 строк и нашли лишний раздел.", "Our summary of scores is shorter than the shard allows."]
    unlabelled = synthetic(2000, 5)[0] + common * 100
    model = abuse.fit(texts + common, labels + [1.0, 1.0], unlabelled, seeds=False)
    assert (model.scores(common) < model.threshold).all()
    test, truth, _ = synthetic(500, 6, 0)
    flagged = model.scores(test) >= model.threshold
    hits = sum(f and t for f, t in zip(flagged, truth, strict=True))
    assert hits / max(1, sum(flagged)) > 0.95 and hits / sum(truth) > 0.85


def test_seeds_alone():
    model = abuse.fit([], [])
    s = model.scores(["You are a stupid idiot and everybody hates you.", "The cache stores rows.", "Kill the process and restart the service.", None, "", " \n"])
    assert s[0] > 0.5 > max(s[1:]) and list(s[3:]) == [0, 0, 0]
    empty = abuse.fit([], [], seeds=False)
    assert 0 <= empty.scores(["text"])[0] <= 1


def test_same_model_again():
    texts, _, labels = synthetic(200, 3)
    a, b = abuse.fit(texts, labels), abuse.fit(texts, labels)
    assert (a.index == b.index).all() and (a.value == b.value).all()


def test_tables(spark):
    docs = spark.createDataFrame([(1, "You stupid idiot!", " Chat", 0.1), (2, None, "chat", 0.1), (3, "", None, 0.1), (4, "x" * 300_000, "wiki", 0.1), (1, "You stupid idiot!", "chat\t", 0.1), (None, "fine", "wiki", 0.1)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (99, 1), (None, 1), (4, 7)], "doc_id long, abusive int")
    sample = abuse.training_documents(docs, labels)
    assert rows(sample.select("doc_id", "target", F.length("text"))) == [(1, 1.0, 17), (4, None, 300_000)]
    assert abuse.training_documents(docs, labels, 0, 1).count() <= 1
    model = abuse.train(docs, labels)
    scores = abuse.score_documents(docs, model, ["source"])
    assert scores.count() == 6 and scores.filter("doc_id = 1 AND score >= 0.5").count() == 2
    assert ("chat", 3, 2) in rows(abuse.rates(scores, model.threshold).select("source", "documents", "flagged"))
    assert abuse.training_segments(docs.select("doc_id", F.lit(1.0).alias("target"), F.lit("A sentence. " * 50).alias("text")), 40).count() < 80
    assert abuse.score_documents(docs.limit(0), model).count() == 0
    assert abuse.train(docs.limit(0), labels.limit(0)).scores(["You are a stupid idiot and everybody hates you."])[0] > 0.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test data")
def test_labelled_documents_of_the_test_data(spark):
    """Fitted on sf0.01 and sf0.1 apart; judged by documents with two agreeing labels in the other."""
    read = lambda sf, t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    model = abuse.train(read("sf0.1", "documents"), read("sf0.1", "doc_labels"))
    got = abuse.training_documents(read("sf0.01", "documents"), read("sf0.01", "doc_labels"), max_unlabelled=0).filter("target IN (0, 1)").collect()
    flagged = model.scores([r["text"] for r in got]) >= model.threshold
    agree = sum(bool(f) == (r["target"] > 0.5) for f, r in zip(flagged, got, strict=True))
    assert agree >= 0.75 * len(got)
