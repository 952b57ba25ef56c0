"""Quality classifier: logistic regression over hashed word n-grams, learned by following the regularised leader.

Features of a text are its words and pairs of words, once as they are (A-Z lower-cased) and once
by shape (letters, capitals, digits and other signs, runs as one), hashed to 2**BITS places; a
pair of equal words also counts in a place that all such pairs share.
An occurrence weighs 1 / sqrt(number of occurrences), and place 0 is the bias. LEARNERS learners
run FTRL-proximal updates over disjoint parts of the labelled sample, and their weights are
averaged. The score is the logistic of one sparse dot product, over the whole text.

The sample: of all labelled rows offered, the MAX_LABELLED whose ids have the smallest hashes.

Defined results: a null or empty text has the score of the bias alone; a label of null is no
label; without labels every score is 0.5; repeated labels each count; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barkeep.llm._text import mixed, n_grams, word_groups
from barkeep.llm._util import small_batches

BITS = 18
MAX_LABELLED, LEARNERS, EPOCHS = 16_384, 8, 3
#: Of FTRL-proximal: learning rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.1
#: Places of the pairs of equal words and of equal shapes.
REPEATED = (1, 2)

_SALTS = [np.uint64(0x5851F42D4C957F2D * (i + 1) % 2**64) for i in range(4)]


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, place, text) of all occurrences, group by group; texts count from the group's first."""
    for at, words in word_groups(texts):
        places, docs = [], []
        for view, hashes in enumerate((words.hashes(), words.shape_hashes())):
            for n in (1, 2):
                grams, doc = n_grams(hashes, words.doc, n)
                places.append((mixed(grams ^ _SALTS[2 * view + n - 1]) % np.uint64(2**BITS - 3)).astype(np.int64) + 3)
                docs.append(doc)
            twice = np.flatnonzero((hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1]))
            places.append(np.full(len(twice), REPEATED[view]))
            docs.append(words.doc[twice])
        yield at, words.n_docs, np.concatenate(places), np.concatenate(docs)


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for at, n, places, docs in features(texts):
        counts = np.maximum(np.bincount(docs, minlength=n), 1)
        out[at : at + n] = np.bincount(docs, weights[places], n) / np.sqrt(counts) + weights[0]
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def learned(texts: pa.Array, labels: np.ndarray) -> np.ndarray:
    """The weights after EPOCHS passes over the texts in their order."""
    rows = []
    for _, n, places, docs in features(texts):
        order = np.argsort(docs, kind="stable")
        for own in np.split(places[order], np.cumsum(np.bincount(docs, minlength=n))[:-1]):
            at, counts = np.unique(own, return_counts=True)
            rows.append((np.concatenate([[0], at]), np.concatenate([[1.0], counts / np.sqrt(max(1, len(own)))])))
    z, n = np.zeros(2**BITS), np.zeros(2**BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        pull = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -pull / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for (at, values), label in zip(rows, labels, strict=True):
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
            root = np.sqrt(n[at] + gradient**2)
            z[at] += gradient - (root - np.sqrt(n[at])) / ALPHA * w
            n[at] += gradient**2
    return weights(np.arange(2**BITS))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """The averaged weights. ``labels`` has the rows that may be learned from: ids and 0 or 1.

    No more than max_labelled rows are learned from, and LEARNERS arrays of 2**BITS weights reach the driver.
    """
    offered = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    sample = offered.withColumn("rank", F.xxhash64("doc_id", F.lit("sample"))).orderBy("rank", "doc_id", "label").limit(max_labelled)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").withColumn("learner", F.pmod("rank", F.lit(LEARNERS)))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "label", "text"])
        found = learned(pa.array(group["text"], pa.string(), from_pandas=True), group["label"].to_numpy())
        return pd.DataFrame({"n": [len(group)], "weights": [found.tobytes()]})

    models = rows.groupBy("learner").applyInPandas(learn, "n long, weights binary").collect()
    total = sum(m["n"] for m in models)
    return sum((np.frombuffer(m["weights"]) * (m["n"] / total) for m in sorted(models, key=lambda m: m["weights"])), np.zeros(2**BITS))


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in the column ``to``, which replaces one of that name."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS doubles
    docs = docs.drop(to)
    text_at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array(scores(batch.column(text_at), shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, to])

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema.fields)}, `{to}` double")


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
