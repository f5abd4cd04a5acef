"""Language ID: a convolutional network over bytes, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed length, the largest response of
each filter goes to a softmax layer. A text is cut into consecutive windows, all of them scored; its
language is the one with the largest mean probability, weighted by the windows' letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytes_kit import buffers, release_memory, slices, tidied
from lectern.llm.common import bound_batches, col, fresh

#: Window length in bytes, filter widths, filters of each width, size of the embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 8
#: Labelled documents that a fit reads at most, windows of each, passes over them.
FIT_ROWS, FIT_WINDOWS, EPOCHS = 3000, 4, 5
FOLDS, FOLD = 3, 1
PIECE, BLOCK = 1 << 20, 32

_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0x100)]] = 1


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0 pads and stays zero
    filters: list[np.ndarray]  # of each width: width * EMBED x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.out, self.out_bias]

    def tables(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """What each byte adds to each filter at each offset: a row a byte, widths and offsets side by side."""
        parts = [self.embed @ k[o * EMBED : (o + 1) * EMBED] for w, k in zip(WIDTHS, self.filters, strict=True) for o in range(w)]
        return np.concatenate(parts, axis=1).astype(np.float32), self.biases

    def probabilities(self, windows: np.ndarray, tables=None) -> np.ndarray:
        table, biases = tables or self.tables()
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for low in range(0, len(windows), BLOCK):
            some = windows[low : low + BLOCK]
            spread = table[some]
            pooled, at = [], 0
            for w, bias in zip(WIDTHS, biases, strict=True):
                reach = WINDOW - w + 1
                total = spread[:, :reach, at : at + FILTERS].copy()
                for o in range(1, w):
                    total += spread[:, o : o + reach, at + o * FILTERS : at + (o + 1) * FILTERS]
                pooled.append(np.maximum(total.max(axis=1) + bias, 0))
                at += w * FILTERS
            logits = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            out[low : low + BLOCK] = logits / logits.sum(axis=1, keepdims=True)
        return out


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text, padded with zeros, and the offsets by text."""
    data, ends = buffers(texts)
    count = -(-np.diff(ends) // WINDOW)
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((at[-1], WINDOW), np.uint8)
    owner = np.repeat(np.arange(len(count)), np.diff(ends))
    out.reshape(-1)[at[owner] * WINDOW + np.arange(len(data)) - ends[:-1][owner]] = data
    return out, at


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = 0.004, batch: int = 64) -> Model:
    """Adam on the cross entropy of windows, in an order that a fixed seed gives."""
    draw = np.random.default_rng(11)
    normal = lambda *shape, s=1.0: (draw.standard_normal(shape) * s).astype(np.float32)
    model = Model(
        languages, normal(256, EMBED, s=0.5), [normal(w * EMBED, FILTERS, s=(w * EMBED) ** -0.5) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS), len(languages), s=0.1), np.zeros(len(languages), np.float32),
    )
    model.embed[0] = 0
    slow, square = ([np.zeros_like(p) for p in model.parameters()] for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for low in range(0, len(order), batch):
            step += 1
            rows = order[low : low + batch]
            grads = _gradients(model, windows[rows], labels[rows])
            for p, g, m, v in zip(model.parameters(), grads, slow, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.embed[0] = 0
    return model


def _gradients(model: Model, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    n = len(windows)
    x = model.embed[windows]
    views, pooled, where = [], [], []
    for w, k, b in zip(WIDTHS, model.filters, model.biases, strict=True):
        view = np.concatenate([x[:, o : WINDOW - w + 1 + o] for o in range(w)], axis=2)
        response = view @ k + b
        best = response.argmax(axis=1)
        views.append(view)
        where.append(best)
        pooled.append(np.take_along_axis(response, best[:, None], axis=1)[:, 0])
    raw = np.concatenate(pooled, axis=1)
    hidden = np.maximum(raw, 0)
    logits = hidden @ model.out + model.out_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), labels] -= 1
    p /= n
    back = (p @ model.out.T) * (raw > 0)
    g_embed, g_filters, g_biases = np.zeros_like(model.embed), [], []
    rows = np.arange(n)[:, None]
    for i, (w, k) in enumerate(zip(WIDTHS, model.filters, strict=True)):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        at = where[i]
        picked = views[i][rows, at]  # n x FILTERS x width * EMBED
        g_filters.append(np.einsum("nf,nfd->df", g, picked))
        g_biases.append(g.sum(axis=0))
        moved = (g[:, :, None] * k.T[None]).reshape(n, FILTERS, w, EMBED)
        for o in range(w):
            np.add.at(g_embed, windows[rows, at + o].reshape(-1), moved[:, :, o].reshape(-1, EMBED))
    return [g_embed, *g_filters, *g_biases, hidden.T @ p, p.sum(axis=0)]


def held_out(id_column: Column, folds: int = FOLDS, fold: int = FOLD) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_column.cast("string"), "UTF-8")), F.lit(folds)) == fold, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Fit on FIT_WINDOWS windows of each of at most `rows` documents with a language that aren't held out.

    The documents are those whose ids' hashes are smallest; their windows lie evenly over the text.
    Windows without letters are passed over. Null texts, languages and ids are, too; an empty text has no window, rows that repeat count as often, long
    texts are read whole. Without any document, as in an empty table, the model knows no language. Further columns play no part.
    """
    bound_batches(df.sparkSession)
    usable = df.where(col(lang_col).isNotNull() & col(text_col).isNotNull() & col(id_col).isNotNull() & ~held_out(col(id_col)))
    picked = usable.select(F.xxhash64(col(id_col)).alias("h"), col(id_col).alias("i"), col(lang_col).cast("string").alias("lang"))
    picked = picked.orderBy("h", "i", "lang").limit(rows)
    texts = df.select(col(id_col).alias("i"), col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"))
    found = texts.join(F.broadcast(picked), ["i", "lang"]).select("h", "lang", "text")
    kinds = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("windows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(2), PIECE):
                windows, at = windows_of(batch.column(2).slice(start, n))
                some = []
                for i in range(n):
                    own = windows[at[i] : at[i + 1]]
                    own = own[_LETTER[own].sum(axis=1) >= WINDOW // 8] if len(own) > 1 else own
                    spots = np.unique(np.linspace(0, len(own) - 1, FIT_WINDOWS).astype(int)) if len(own) else []
                    some.append(own[spots].tobytes() if len(own) else b"")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(some, pa.binary())], schema=kinds)

    table = found.mapInArrow(tidied(run), "h long, lang string, windows binary").toArrow().sort_by([("h", "ascending"), ("lang", "ascending"), ("windows", "ascending")])
    languages = sorted(set(table["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    windows = [np.frombuffer(b, np.uint8).reshape(-1, WINDOW) for b in table["windows"].to_pylist()]
    labels = np.repeat([number[x] for x in table["lang"].to_pylist()], [len(w) for w in windows]).astype(np.int64) if windows else np.zeros(0, np.int64)
    if not len(labels):
        return fit(np.zeros((0, WINDOW), np.uint8), labels, languages or ["und"], epochs=0)
    return fit(np.concatenate(windows), labels, languages)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score, the mean probability of that language.

    A text that is null, empty or without a letter is `und` with score 0; long texts are read whole, in windows. Ties go to the first
    language by name. Rows that repeat get equal results; an empty table gives an empty one. Columns of df with these names are replaced.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("lang_pred", "score") and c != text_col])
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        tables = own.tables()
        for texts in batches:
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for start, n in slices(texts, PIECE):
                windows, at = windows_of(texts.slice(start, n))
                p = own.probabilities(windows, tables).astype(np.float64)
                weight = _LETTER[windows].sum(axis=1) + 1e-3
                owner = np.repeat(np.arange(n), np.diff(at))
                sums = np.stack([np.bincount(owner, weights=p[:, j] * weight, minlength=n) for j in range(p.shape[1])], axis=1)
                total = np.bincount(owner, weights=weight, minlength=n)
                best.append(sums.argmax(axis=1))
                score.append(np.minimum(1.0, sums.max(axis=1) / np.maximum(total, 1e-9)))
            said = [own.languages[b] if ok else "und" for b, ok in zip(np.concatenate(best), lettered, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(np.where(lettered, np.concatenate(score), 0.0))], fields=list(kinds))
        release_memory()

    (both,) = fresh(df, "told_")
    guessed = df.withColumn(both, told(col(text_col).cast("string")))
    return guessed.select(*map(col, df.columns), col(both)["lang"].alias("lang_pred"), col(both)["score"].alias("score"))
