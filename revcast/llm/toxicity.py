"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are its distinct words, pairs of neighbouring words and
pairs with one word between (skip-grams), hashed to ``2**BITS`` places. FTRL
keeps a learning rate for each place; L1 leaves most weights at exactly zero,
so a model is a short list of (place, weight) that is shipped to the workers.

Learning takes a bounded sample of labelled rows, ``SAMPLE`` documents in the
order of a hash of the id, whose features one task learns from in that order,
``EPOCHS`` times; the result does not depend on partitions or cores. All rows
are scored.

Defined results: a null or empty text has the bias as its only feature; rows
without an id are scored, never learned from; of several labels of a document
the largest counts, a null label none; without any labelled row every score
is 0.5 (and predicted is 1); labels, lang, source and id are no features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, mix64
from .hashing import ALNUM, hash_words
from .pieces import steps

BITS = 20
#: Labelled documents that are learned from, at most.
SAMPLE = 20_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
EPOCHS = 4

_KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _places(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, place) of every feature; place 0 is the bias."""
    doc = np.repeat(np.arange(len(counts)), counts)
    out_doc, out = [doc], [mix64(hashes * _KINDS[0])]
    for gap in (1, 2):
        pair = doc[gap:] == doc[:-gap]
        out_doc.append(doc[gap:][pair])
        out.append(mix64(hashes[:-gap][pair] * _KINDS[gap] + mix64(hashes[gap:][pair])))
    places = (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(out_doc), np.maximum(places, 1)


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


class Ftrl:
    """FTRL-proximal with binary features."""

    def __init__(self):
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)

    def weights(self, places: np.ndarray) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        return w

    def learn(self, places: np.ndarray, label: int) -> None:
        w = self.weights(places)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[places]
        rate = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA
        self.z[places] += gradient - rate * w
        self.n[places] = n + gradient * gradient


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          learn_from: Column | None = None, sample: int = SAMPLE) -> list[tuple[int, float]]:
    """(place, weight) of all weights that are not zero."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, label_col)
    if learn_from is not None:
        known = known.where(learn_from)
    chosen = (known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
              .orderBy(F.xxhash64(id_col), id_col).limit(sample))  # bounded: at most ``sample`` rows
    rows = (docs.select(id_col, _text(text_col).alias("__text")).join(F.broadcast(chosen), id_col)
            .withColumn("__order", F.xxhash64(id_col)))
    # one text for each labelled document also where its row is repeated
    rows = rows.groupBy(id_col, "__order", "__label").agg(F.min("__text").alias("__text"))
    places = rows.mapInArrow(_featurize, "__order bigint, __label int, __places binary")
    # what one task reads is bounded by the sample
    fit = places.repartition(1).sortWithinPartitions("__order", "__label", "__places")
    return [(r[0], r[1]) for r in fit.mapInArrow(_fit, "place int, weight double").collect()]


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for k, stop, data, ends in steps(batch.column("__text")):
            doc, place = _places(*hash_words(data, ends, ALNUM))
            keys = np.unique(doc << BITS | place)
            cut = np.searchsorted(keys, np.arange(stop - k + 1) << BITS)
            places = np.insert(keys & ((1 << BITS) - 1), cut[:-1], 0).astype("<i4")  # the bias before each text's
            cut = cut + np.arange(stop - k + 1)
            out += [places[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("__order"), batch.column("__label"), pa.array(out, pa.binary())],
                                         ["__order", "__label", "__places"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Ftrl()
    rows = []  # views of the batches: the features are held once
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column("__places").cast(pa.large_binary())
        at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // 4
        places = np.frombuffer(raw.buffers()[2], "<i4")
        rows += [(places[a:b], label) for a, b, label in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("__label").to_pylist(), strict=True)]
    for _ in range(EPOCHS):
        for places, label in rows:
            model.learn(places, label)
    w = model.weights(np.arange(1 << BITS))
    used = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(w[used])], ["place", "weight"])
    del rows, model, w
    give_back()


def score(docs: DataFrame, model: list[tuple[int, float]], text_col: str = "text") -> DataFrame:
    """``docs`` with ``__score``; one pass, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(  # at most 2**BITS pairs; L1 leaves few
        (np.array([p for p, _ in model], np.int64), np.array([w for _, w in model], np.float64)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        place, weight = shipped.value
        dense[place] = weight
        active = dense != 0
        for batch in batches:
            out = []
            for k, stop, data, ends in steps(batch.column(text_col).cast(pa.string())):
                doc, place = _places(*hash_words(data, ends, ALNUM))
                hit = active[place]
                keys = np.unique(doc[hit] << BITS | place[hit])
                total = np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], stop - k) + dense[0]
                out.append(1 / (1 + np.exp(-total)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())],
                                             [*batch.schema.names, "__score"])
        give_back()

    return docs.mapInArrow(run, f"{fields}, __score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest per document; a fifth of the ids is held out of learning."""
    model = train(docs, labels, learn_from=crc_mod("doc_id", 5) != 0)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("__score").alias("score"),
        F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; learns from the rows that are not held out."""
    model = train(docs, labels, learn_from=crc_mod("doc_id", 5) != 0)
    if not model:
        return docs  # nothing was learned, so nothing is rejected
    return score(docs, model).where(F.col("__score") < threshold).select(*docs.columns)
