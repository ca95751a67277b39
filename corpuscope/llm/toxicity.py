"""Toxicity: logistic regression on hashed word n-grams, fitted by FTRL-Proximal
(McMahan et al., "Ad Click Prediction: a View from the Trenches", 2013).

Features of a text, each present or absent: its lower-cased words, pairs of neighbours
and pairs with one word between them, hashed to 2^bits coordinates; beside a word its
beginnings of ``STEMS`` bytes. Every coordinate has a learning rate of its own, and the L1 term keeps a weight at exactly zero until its
gradients add up, so the fitted model is a short list of (coordinate, weight), bounded by
2^bits and in practice some thousand, which every task receives.

Fitting uses at most ``Ftrl.sample`` labelled rows, those with the smallest hashes of
their ids, and of rows that share an id the smallest text; everything else reads all rows.

Defined results: null text counts as empty; an empty text gets the score of the bias
alone; rows repeat in the output as they do in the input; no usable label gives 0.5 to
every text; labels that are null, or whose id is null or has no document, do not count;
extra columns of either table are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import LETTERS, LOWER, SpanHasher, mix64, text_slices, with_fields, word_spans


#: Bytes of the beginnings of longer words that are features like the words themselves.
STEMS = (4, 6, 8)


@dataclass(frozen=True)
class Ftrl:
    bits: int = 22
    sample: int = 16_000
    epochs: int = 4
    alpha: float = 0.7
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    positive_weight: float = 2.0


def text_features(column: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Per slice: first row, text number and coordinate of every n-gram, number of texts."""
    hasher, shift = SpanHasher(), np.uint64(64 - bits)
    for first, data, offsets in text_slices(column):
        starts, ends, text = word_spans(data, offsets, LETTERS)
        # The beginnings of a word stand for it in other forms: inflected, or part of a compound.
        longer = [np.flatnonzero(ends - starts > size) for size in STEMS]
        first_bytes = [starts[at] + size for at, size in zip(longer, STEMS, strict=True)]
        hashes = hasher(
            LOWER[data],
            np.concatenate([starts, *(starts[at] for at in longer)]),
            np.concatenate([ends, *first_bytes]),
        )
        words = hashes[: len(starts)]
        grams, owners = [hashes], [np.concatenate([text, *(text[at] for at in longer)])]
        for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
            if len(words) > gap:
                grams.append(mix64(words[:-gap] * np.uint64(factor) + words[gap:]))
                owners.append(np.where(text[:-gap] == text[gap:], text[:-gap], -1))
        owner, gram = np.concatenate(owners), np.concatenate(grams) >> shift
        if len(owner) and owner.min() < 0:
            gram, owner = gram[owner >= 0], owner[owner >= 0]
        yield first, owner, gram.astype(np.int64), len(offsets) - 1


def fit_ftrl(examples: list[np.ndarray], labels: np.ndarray, p: Ftrl) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, coordinates and weights after ``epochs`` passes in the given order."""
    bias = 1 << p.bits
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == bias, 0.0, p.l1), 0.0)
        return -shrunk / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for grams, label in zip(examples, labels, strict=True):
            at = np.append(grams, bias)
            w, seen = weight(at), n[at]
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            gradient *= p.positive_weight if label else 1.0
            z[at] += gradient - (np.sqrt(seen + gradient**2) - np.sqrt(seen)) / p.alpha * w
            n[at] = seen + gradient**2
    kept = np.flatnonzero(np.abs(z[:bias]) > p.l1)
    return float(weight(np.array([bias]))[0]), kept, weight(kept)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents.

    The ids with the smallest hashes are taken before any text is read, so what is
    broadcast to the scan of the documents is ``rows`` ids at most. Rows that share an id
    count as one, so that an id with many rows does not fill the fitting task."""
    known = labels.filter(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return held.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, usable: Column, p: Ftrl = Ftrl(), label: str = "toxic") -> DataFrame:
    """The model as rows (coordinate, weight); coordinate -1 holds the bias."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, owner, gram, texts in text_features(batch.column("text"), p.bits):
                order = np.lexsort((gram, owner))
                owner, gram = owner[order], gram[order]
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
                owner, gram = owner[new], gram[new]
                bounds = np.searchsorted(owner, np.arange(texts + 1))
                part = batch.slice(first, texts)
                grams = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(gram.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), grams], ["doc_id", "label", "grams"]
                )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(rank=mix64(rows["doc_id"].to_numpy().astype(np.uint64))).sort_values(["rank", "doc_id"])
        grams = [np.asarray(x, dtype=np.int64) for x in rows["grams"]]
        bias, at, weights = fit_ftrl(grams, rows["label"].to_numpy(), p)
        return pd.DataFrame({"coordinate": np.append(at, -1), "weight": np.append(weights, bias)})

    sample = labelled_sample(docs, labels, label, usable, p.sample)
    rows = sample.mapInArrow(features, "doc_id long, label int, grams array<int>")
    return rows.groupBy(F.lit("all").alias("all")).applyInPandas(fit, "coordinate long, weight double")


def score(docs: DataFrame, model: DataFrame, bits: int = Ftrl.bits) -> DataFrame:
    """``docs`` plus score (0 to 1, higher: toxic likelier); every word of every text counts."""
    rows = model.toPandas()  # at most 2^bits + 1 rows
    bias = float(rows.loc[rows["coordinate"] < 0, "weight"].sum())
    at = rows.loc[rows["coordinate"] >= 0, "coordinate"].to_numpy()
    weights = docs.sparkSession.sparkContext.broadcast(
        (at, rows.loc[rows["coordinate"] >= 0, "weight"].to_numpy(), bias)
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = weights.value
        dense = np.zeros(1 << bits, dtype=np.float32)
        dense[at] = values
        for batch in batches:
            sums = np.full(batch.num_rows, bias)
            for first, owner, gram, _ in text_features(batch.column("text"), bits):
                hit = np.flatnonzero(dense[gram])
                pairs = np.unique(owner[hit] << bits | gram[hit])
                np.add.at(sums, first + (pairs >> bits), dense[pairs & ((1 << bits) - 1)])
            scores = pa.array(1.0 / (1.0 + np.exp(-sums)))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    return docs.drop("score").mapInArrow(scored, with_fields(docs, "score double"))
