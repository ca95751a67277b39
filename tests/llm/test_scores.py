"""The two classifiers: held-out accuracy, and defined results for odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import quality, toxicity
from corpuscope.llm.queries import held_out
from corpuscope.llm.toxicity import Ftrl

LABELS = "doc_id long, toxic int, quality int, text string"
DOCS = "doc_id long, text string, score string, label string"


def corpus(seed=4, rows=600):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    docs, labels = [], []
    for i in range(rows):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic, poor = rng.random() < 0.25, rng.random() < 0.25
        if toxic:
            for _ in range(5):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "Rotten", "you vermin", "filth,"]))
        body = " ".join(text)
        if poor:
            body = rng.choice([body.upper().replace(" ", "!! "), body.replace(" ", " | "), " ".join(w + " " + w for w in text)])
        docs.append((i, body, "7", "x"))
        labels.append((i, int(toxic), int(not poor), "y"))
    return docs, labels


ODD = [(9001, None, "1", "a"), (9002, "", "1", "a"), (9003, "word " * 200_000, "1", "a"), (9003, "word " * 200_000, "1", "a"), (None, "no id", "1", "a")]
ODD_LABELS = [(9001, None, None, "z"), (None, 1, 1, "z"), (12345, 1, 1, "z"), (3, 0, 1, "z"), (3, 0, 1, "z"), (4, 7, 7, "z")]


@pytest.mark.parametrize(("operator", "label", "sign"), [(toxicity, "toxic", 1), (quality, "quality", 0)])
def test_held_out_accuracy(spark, operator, label, sign):
    docs, labels = corpus()
    docs_df, labels_df = spark.createDataFrame(docs + ODD, DOCS), spark.createDataFrame(labels + ODD_LABELS, LABELS)
    usable = ~held_out(F.col("doc_id"))
    # a hundred documents' worth of signal needs less shrinkage than a real sample
    model = operator.train(docs_df, labels_df, usable, Ftrl(l1=1.0)) if operator is toxicity else operator.train(docs_df, labels_df, usable)
    rows = operator.score(docs_df, model).collect()
    assert len(rows) == len(docs) + len(ODD) and all(0 <= r.score <= 1 for r in rows)
    truth = {x[0]: x[1 if label == "toxic" else 2] for x in labels}
    unseen = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in unseen)
    assert right / len(unseen) >= 0.95
    empty = {r.score for r in rows if not r.text}
    assert len(empty) == 1 and (empty.pop() < 0.5) == (operator is toxicity)
    assert len({r.score for r in rows if r.doc_id == 9003}) == 1


def test_held_out_rows_never_teach(spark):
    docs, labels = corpus(rows=150)
    flipped = [(i, 1 - t, 1 - q, y) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, t, q, y) for i, t, q, y in labels]
    docs_df = spark.createDataFrame(docs, DOCS)
    for operator in (toxicity, quality):
        one, two = (
            operator.score(docs_df, operator.train(docs_df, spark.createDataFrame(x, LABELS), ~held_out(F.col("doc_id"))))
            for x in (labels, flipped)
        )
        assert sorted(one.select("doc_id", "score").collect()) == sorted(two.select("doc_id", "score").collect())


def test_no_labels_and_no_documents(spark):
    docs, labels = corpus(rows=20)
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame(docs, DOCS)
    for operator in (toxicity, quality):
        scored = operator.score(some, operator.train(some, none, F.lit(True))).collect()
        assert {r.score for r in scored} == {0.5} and len(scored) == 20
        empty = spark.createDataFrame([], DOCS)
        model = operator.train(empty, spark.createDataFrame(labels, LABELS), F.lit(True))
        assert operator.score(empty, model).count() == 0


def test_ftrl_weights_are_sparse(spark):
    docs, labels = corpus()
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), F.lit(True), Ftrl(l1=2.0))
    assert 0 < model.count() < 5_000


def test_hash_of_the_id_is_the_zlib_one(spark):
    ids = spark.range(500).select(F.col("id"), held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)


def test_a_repeated_id_teaches_once(spark):
    docs, labels = corpus(rows=60)
    again = [(0, "zzz later text", "1", "a")] + [docs[0]] * 300
    sample = toxicity.labelled_sample(
        spark.createDataFrame(docs + again, DOCS), spark.createDataFrame(labels, LABELS), "toxic", F.lit(True), 1_000
    ).collect()
    assert sorted((r.doc_id, r.label) for r in sample) == [(i, t) for i, t, *_ in labels]
    assert next(r.text for r in sample if r.doc_id == 0) == docs[0][1]


def test_fit_equals_ftrl_coordinate_by_coordinate():
    """The update rule in plain Python, one coordinate at a time."""
    from math import exp, sqrt

    rng = random.Random(3)
    p = Ftrl(bits=6, l1=0.3, l2=0.1, epochs=3)
    examples = [sorted(rng.sample(range(64), rng.randint(0, 12))) for _ in range(80)]
    marks = [int(any(x < 9 for x in e)) for e in examples]
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        l1 = 0.0 if i == 64 else p.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - l1 * (1 if z[i] > 0 else -1)) / ((p.beta + sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for grams, mark in zip(examples, marks):
            at = [*grams, 64]
            w = [weight(i) for i in at]
            g = (1 / (1 + exp(-sum(w))) - mark) * (p.positive_weight if mark else 1)
            for i, wi in zip(at, w):
                z[i] += g - (sqrt(n[i] + g * g) - sqrt(n[i])) / p.alpha * wi
                n[i] += g * g
    bias, kept, weights = toxicity.fit_ftrl([np.array(e, dtype=np.int64) for e in examples], np.array(marks), p)
    assert bias == pytest.approx(weight(64))
    assert kept.tolist() == [i for i in range(64) if weight(i)]
    assert weights.tolist() == pytest.approx([weight(i) for i in kept])


def test_beginnings_of_words_are_features():
    """A word has its first 4, 6 and 8 bytes as features, those of the word they spell."""
    import pyarrow as pa

    def grams(text):
        return {g for _, _, gram, _ in toxicity.text_features(pa.array([text]), 22) for g in gram.tolist()}

    assert grams("compounded") == grams("comp") | grams("compou") | grams("compound") | grams("compounded")
    assert len(grams("compounded")) == 4 and len(grams("comp")) == 1 and not grams("") and not grams(None)
