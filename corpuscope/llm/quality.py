"""Quality: votes of the nearest labelled documents in a latent-semantic space.

Terms of a text do not depend on its language: runs of three character classes
(capital, small, digit, blank, line end, each common mark, other) and, for every word,
whether it equals one of the two words before it and how long it is. Weighted term
counts of at most ``Lsa.sample`` labelled documents give, by a truncated singular value
decomposition, a projection to ``Lsa.rank`` latent dimensions. The projected labelled
vectors are broadcast (sample x rank floats, 2 MB by default, whatever the corpus size); every
document is compared with all of them by exact cosine products, a block of documents at
a time, and the ``neighbours`` nearest vote, each weighted by its similarity.

Defined results: null text counts as empty; a text without terms, or with no neighbour
of positive similarity, gets the share of good labels in the sample; no usable label
gives 0.5 to every text; ties in similarity go to the earlier labelled row in hash order
of its id; rows repeat in the output as in the input; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import LOWER, NOT_SPACE, SpanHasher, mix64, text_slices, with_fields, word_spans
from .toxicity import labelled_sample

MARKS = b".,!|%$&*#-:?\"'"
CLASSES = 6 + len(MARKS)
CLASS_OF = np.full(256, 5, dtype=np.int64)
CLASS_OF[ord("a") : ord("z") + 1] = 0
CLASS_OF[128:] = 0
CLASS_OF[ord("A") : ord("Z") + 1] = 1
CLASS_OF[ord("0") : ord("9") + 1] = 2
CLASS_OF[[32, 9]] = 3
CLASS_OF[[10, 13]] = 4
for _i, _mark in enumerate(MARKS):
    CLASS_OF[_mark] = 6 + _i
RUNS = CLASSES**3
WORD_LENGTHS = 24
#: Terms: class runs, then repeats of the last and second last word, then word lengths.
TERMS = RUNS + 3 + WORD_LENGTHS


@dataclass(frozen=True)
class Lsa:
    sample: int = 8_000
    rank: int = 48
    neighbours: int = 15
    block: int = 256


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Per slice: first row and a texts x TERMS table of counts of the whole texts."""
    hasher = SpanHasher()
    for first, data, offsets in text_slices(column, 1 << 18):
        texts = len(offsets) - 1
        kinds = CLASS_OF[data]
        owner = np.repeat(np.arange(texts), np.diff(offsets))
        cells = []
        if len(data) > 2:
            run = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
            whole = owner[:-2] == owner[2:]
            cells.append(owner[:-2][whole] * TERMS + run[whole])
        starts, ends, text = word_spans(data, offsets, NOT_SPACE)
        words = hasher(LOWER[data], starts, ends)
        for gap in (1, 2):
            if len(words) > gap:
                same = (words[gap:] == words[:-gap]) & (text[gap:] == text[:-gap])
                cells.append(text[gap:][same] * TERMS + RUNS + gap - 1)
        cells.append(text * TERMS + RUNS + 3 + np.minimum(ends - starts, WORD_LENGTHS) - 1)
        counts = np.bincount(np.concatenate(cells), minlength=texts * TERMS).reshape(texts, TERMS)
        yield first, counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of term shares, weighted and of unit length (zero without terms)."""
    shares = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32) * idf
    return shares / np.maximum(np.linalg.norm(shares, axis=1, keepdims=True), 1e-12)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_lsa(counts: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(used terms, their weights, projection): right singular vectors of the weighted
    counts, from the eigenvectors of the smaller of the two Gram matrices."""
    used = np.flatnonzero(counts.any(axis=0))
    idf = np.log1p(len(counts) / np.count_nonzero(counts[:, used], axis=0)).astype(np.float32)
    weighted = weigh(counts[:, used], idf).astype(np.float64)
    values, vectors = np.linalg.eigh(weighted.T @ weighted)
    keep = np.argsort(values)[::-1][: min(rank, int((values > 1e-9).sum()))]
    return used, idf, np.ascontiguousarray(vectors[:, keep]).astype(np.float32)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int, otherwise: float) -> np.ndarray:
    """Similarity-weighted share of good labels among the nearest known vectors."""
    near = vectors @ known.T
    k = min(neighbours, len(known))
    bound = np.partition(near, len(known) - k, axis=1)[:, len(known) - k, None]
    above = near > bound
    room = k - above.sum(axis=1, keepdims=True)
    tied = near == bound
    chosen = above | (tied & (np.cumsum(tied, axis=1) <= room))
    weights = np.where(chosen, np.maximum(near, 0.0), 0.0).astype(np.float64)
    total = weights.sum(axis=1)
    return np.where(total > 0, weights @ labels / np.where(total > 0, total, 1.0), otherwise)


def train(docs: DataFrame, labels: DataFrame, usable: Column, p: Lsa = Lsa(), label: str = "quality") -> DataFrame:
    """One row (used, idf, projection, known, labels): the bounded model."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts in term_counts(batch.column("text")):
                part = batch.slice(first, len(counts))
                at = [np.flatnonzero(row) for row in counts]
                bounds = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
                flat = np.concatenate(at)
                owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("label"),
                        pa.ListArray.from_arrays(bounds, pa.array(flat.astype(np.int32))),
                        pa.ListArray.from_arrays(bounds, pa.array(counts[owner, flat].astype(np.int32))),
                    ],
                    ["doc_id", "label", "terms", "counts"],
                )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(rank=mix64(rows["doc_id"].to_numpy().astype(np.uint64))).sort_values(["rank", "doc_id"])
        table = np.zeros((len(rows), TERMS), dtype=np.int32)
        for row, (terms, counts) in enumerate(zip(rows["terms"], rows["counts"], strict=True)):
            table[row, terms] = counts
        seen = np.flatnonzero(table.any(axis=0))
        used, idf, projection = fit_lsa(table[:, seen], p.rank)
        known = unit(weigh(table[:, seen[used]], idf) @ projection)
        return pd.DataFrame(
            {
                "used": [seen[used].astype(np.int32).tobytes()],
                "idf": [idf.tobytes()],
                "projection": [projection.tobytes()],
                "known": [known.astype(np.float32).tobytes()],
                "labels": [rows["label"].to_numpy().astype(np.float64).tobytes()],
            }
        )

    sample = labelled_sample(docs, labels, label, usable, p.sample)
    rows = sample.mapInArrow(counted, "doc_id long, label int, terms array<int>, counts array<int>")
    return rows.groupBy(F.lit("all").alias("all")).applyInPandas(
        fit, "used binary, idf binary, projection binary, known binary, labels binary"
    )


def score(docs: DataFrame, model: DataFrame, p: Lsa = Lsa()) -> DataFrame:
    """``docs`` plus score (0 to 1, higher: label 1 likelier)."""
    rows = model.collect()  # one row of bounded size, or none without labels
    if not rows:
        return docs.withColumn("score", F.lit(0.5))
    used, idf, projection, known, labels = (
        np.frombuffer(x, dtype=kind) for x, kind in zip(rows[0], "i4 f4 f4 f4 f8".split(), strict=True)
    )
    rank = len(projection) // max(len(used), 1)
    shared = docs.sparkSession.sparkContext.broadcast(
        (used, idf, projection.reshape(len(used), rank), known.reshape(len(labels), rank), labels)
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, idf, projection, known, labels = shared.value
        for batch in batches:
            scores = np.full(batch.num_rows, labels.mean())
            for first, counts in term_counts(batch.column("text")) if rank else ():
                vectors = unit(weigh(counts[:, used], idf) @ projection)
                for at in range(0, len(vectors), p.block):
                    block = vectors[at : at + p.block]
                    scores[first + at : first + at + len(block)] = vote(
                        block, known, labels, p.neighbours, labels.mean()
                    )
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    return docs.drop("score").mapInArrow(scored, with_fields(docs, "score double"))
