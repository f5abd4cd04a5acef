"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

Words are runs of letters and digits, or of other signs; two streams of them, the words in lower case and
their shapes (capitals, digits, length class, whether it repeats the word before), give hashed 1-
and 2-grams. A document's features are the roots of their shares, so long texts weigh as short ones. The
model is one weight a bucket; a score is a sparse dot product and a sigmoid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytes_kit import BASE, INVERSE, buffers, forget, mix64, powers, release_memory, slices, tidied
from lectern.llm.common import bound_batches, col

#: Buckets of the hash, labelled rows that a fit reads at most, passes over them, and the share that is held out.
BUCKET_BITS, FIT_ROWS, EPOCHS = 18, 6000, 4
#: Few rows are passed over more often, for about so many updates, up to MOST_EPOCHS.
UPDATES, MOST_EPOCHS = 12_000, 50
FOLDS, THRESHOLD = 5, 0.3
PIECE = 1 << 20

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B], _DIGIT[0x30:0x3A] = True, True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and value of each feature, sorted by document and bucket."""
    data, ends = buffers(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    kind = _CLASS[data]
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[ends[:-1][np.diff(ends) > 0]] = True
    first = np.flatnonzero(begins)
    stop = np.append(first[1:], len(data))
    real = kind[first] > 0
    first, stop = first[real], stop[real]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    length = stop - first
    word = mix64((sums[stop] - sums[first]) * powers(INVERSE, len(data))[first] + length.astype(np.uint64))
    upper, digit = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _DIGIT))
    owner = np.searchsorted(ends, first, "right") - 1
    follows = np.zeros(len(first), bool)
    follows[1:] = owner[1:] == owner[:-1]
    again = np.zeros(len(first), bool)
    again[1:] = follows[1:] & (word[1:] == word[:-1])
    sign = kind[first] == 2
    shape = (
        np.where(_UPPER[data[first]], 1, 0) + np.where(upper[stop] - upper[first] > 1, 2, 0) + np.where(digit[stop] > digit[first], 4, 0)
        + 8 * np.minimum(length // 4, 7) + 64 * again + 128 * ((stop < ends[owner + 1]) & (data[np.minimum(stop, len(data) - 1)] > 0x20))
    ).astype(np.uint64)
    shape = mix64(np.where(sign, word ^ again.astype(np.uint64), shape) + np.uint64(0xA11))
    grams, whose = [], []
    for stream, salt in ((word, 11), (shape, 23)):
        grams += [mix64(stream + np.uint64(salt)), mix64(stream[1:] + (stream[:-1] ^ np.uint64(salt + 1)) * np.uint64(BASE))[follows[1:]]]
        whose += [owner, owner[1:][follows[1:]]]
    place = (np.concatenate(whose).astype(np.uint64) << np.uint64(BUCKET_BITS)) | (np.concatenate(grams) >> np.uint64(64 - BUCKET_BITS))
    place, count = np.unique(place, return_counts=True)
    owner = (place >> np.uint64(BUCKET_BITS)).astype(np.int64)
    total = np.bincount(owner, weights=count, minlength=len(ends) - 1)
    return owner, (place & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), np.sqrt(count / total[owner]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, bucket, value = features(texts)
        dots = np.bincount(owner, weights=self.weights[bucket] * value, minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(dots + self.bias, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int | None = None, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> Model:
    """FTRL-proximal over rows (buckets, values), in an order that a fixed seed gives."""
    size = (1 << BUCKET_BITS) + 1  # the last is the bias, without penalties
    z, n = np.zeros(size), np.zeros(size)
    bias = np.array([size - 1])

    def weigh(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0.0
        w[-1] = -z[size - 1] / ((beta + np.sqrt(n[size - 1])) / alpha)
        return w

    if epochs is None:
        epochs = max(EPOCHS, min(MOST_EPOCHS, -(-UPDATES // max(1, len(rows)))))
    turns = np.random.default_rng(7)
    for _ in range(epochs):
        for i in turns.permutation(len(rows)):
            at = np.concatenate([rows[i][0], bias])
            x = np.append(rows[i][1].astype(np.float64), 1.0)
            w = weigh(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[i]) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weigh(np.arange(size))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def held_out(id_column: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_column.cast("string"), "UTF-8")), F.lit(folds)) == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fit on at most `rows` labelled documents that aren't held out, those whose ids' hashes are smallest.

    Null labels and ids are passed over; an id that repeats in either table counts as often. Long texts are read whole. Without any
    labelled document, as in an empty table, the score is 0.5 for all; with one label only, the model leans to it.
    """
    bound_batches(docs.sparkSession)
    usable = labels.where(col(label_col).isNotNull() & ~held_out(col(id_col)) & col(id_col).isNotNull())
    some = usable.select(col(id_col), col(label_col).cast("double").alias("label_")).orderBy(F.xxhash64(col(id_col)), col(id_col), "label_").limit(rows)
    chosen = docs.select(col(id_col), col(text_col).cast("string").alias("text_")).join(F.broadcast(some), id_col)
    kinds = pa.schema([("id", pa.int64()), ("words", pa.int64()), ("label", pa.float64()), ("bucket", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(2), PIECE):
                owner, bucket, value = features(batch.column(2).slice(start, n))
                at = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (bucket.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, n) for i in (0, 1, 3)), *lists], schema=kinds)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for i, (id_, words, label) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                found.append((id_, label, words, *(np.array(batch.column(k)[i].values) for k in (3, 4))))
        found.sort(key=lambda x: x[:3])
        model = fit([x[3:] for x in found], np.array([x[1] for x in found]))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights], pa.list_(pa.float32())), pa.array([model.bias])], ["weights", "bias"])

    text = F.xxhash64("text_")
    ready = chosen.select(F.xxhash64(col(id_col)), text, "text_", "label_").mapInArrow(tidied(run), "id long, words long, label double, bucket array<int>, value array<float>")
    # The fit is one task on an executor, of a bounded number of rows; the driver gets the weights alone.
    told = ready.repartition(1).mapInArrow(tidied(fitted), "weights array<float>, bias double").toArrow()
    if not told.num_rows:
        return fit([], np.zeros(0))
    return Model(told["weights"].combine_chunks().values.to_numpy(), told["bias"][0].as_py())


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score and predicted. Null and empty texts are scored by the bias alone; columns of df with these names are replaced.

    Long texts are scored whole; rows that repeat get equal scores, whatever rows are beside them; an empty table gives an empty result.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("score", "predicted") and c != text_col])
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        own = Model(*shared.value)
        for texts in batches:
            scores = [own.scores(texts.slice(start, n)) for start, n in slices(texts, PIECE)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))
        release_memory()

    return df.withColumn("score", scored(col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def keep_good(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that the model accepts, with its columns; rows that repeat all stay or go, null and empty texts as the bias says."""
    return score(df, model, text_col, threshold).where("predicted = 1").select(*map(col, df.columns))
