"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over a window, each filter keeps its maximum over
the window, and a softmax layer gives languages. A whole text is read as consecutive fixed-length
windows; their log-probabilities, weighted by length, add up to the text's prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import join_small, sliced, written

WINDOW = 256
WIDTHS = (2, 3, 4)
DIM = 8
FILTERS = 16
MAX_ROWS = 120_000
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 32  # windows at a time: the unfolded input and its products stay in a processor cache


@dataclass
class ByteCNN:
    """Embedding (256, DIM), one kernel over the widest filter's span, softmax weights."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    classes: list[str]

    @classmethod
    def fresh(cls, classes: list[str], seed: int = 5) -> ByteCNN:
        rng = np.random.default_rng(seed)
        span, n = max(WIDTHS), FILTERS * len(WIDTHS)
        f32 = np.float32
        return cls(
            rng.normal(0, 0.5, (256, DIM)).astype(f32),
            (rng.normal(0, 0.2, (span * DIM, n)) * kernel_mask()).astype(f32),
            np.zeros(n, f32),
            rng.normal(0, 0.1, (n, len(classes))).astype(f32),
            np.zeros(len(classes), f32),
            classes,
        )

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(maxima, arg maxima, unfolded input) of windows of bytes, shape (n, WINDOW + span - 1)."""
        span = max(WIDTHS)
        e = self.embed[windows]
        shape = (len(windows), WINDOW, span * DIM)
        unfolded = np.lib.stride_tricks.as_strided(e, shape, (e.strides[0], e.strides[1], e.strides[2]))
        unfolded = np.ascontiguousarray(unfolded)
        conv = (unfolded.reshape(-1, span * DIM) @ self.kernel).reshape(len(windows), WINDOW, -1)
        return conv, unfolded, e

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.classes)), np.float32)
        for at in range(0, len(windows), _CHUNK):
            conv, _, _ = self.features(windows[at : at + _CHUNK])
            hidden = np.maximum(conv.max(axis=1) + self.bias, 0)
            out[at : at + _CHUNK] = _log_softmax(hidden @ self.out + self.out_bias)
        return out


def kernel_mask() -> np.ndarray:
    """Filters narrower than the span see only their first bytes."""
    span = max(WIDTHS)
    mask = np.zeros((span * DIM, FILTERS * len(WIDTHS)), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def windows_of(data: bytes) -> np.ndarray:
    """Consecutive windows of a whole text, zero-padded, each with the span's overlap into the next."""
    span = max(WIDTHS)
    n = max(1, -(-len(data) // WINDOW))
    buf = np.zeros(n * WINDOW + span - 1, np.uint8)
    buf[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(buf, (n, WINDOW + span - 1), (WINDOW, 1))


def normalise(text: str) -> bytes:
    return text.lower().encode("utf-8", "ignore")


def train(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.004, windows_per_text: int = 4, seed: int = 5) -> ByteCNN:
    """Adam on cross-entropy over windows of the labelled texts, some of them cut short."""
    classes = sorted(set(labels))
    model = ByteCNN.fresh(classes, seed)
    if len(classes) < 2:
        return model
    rng = np.random.default_rng(seed)
    span = max(WIDTHS)
    picked, y = [], []
    for text, label in zip(texts, labels, strict=True):
        data = normalise(text)
        w = windows_of(data)
        for i in rng.permutation(len(w))[:windows_per_text]:
            row = np.array(w[i])
            if rng.random() < 0.3:
                row[int(rng.integers(8, WINDOW)) :] = 0
            picked.append(row)
            y.append(classes.index(label))
    x, y = np.array(picked), np.array(y)
    names = ("embed", "kernel", "bias", "out", "out_bias")
    moments = {k: [np.zeros_like(getattr(model, k)) for _ in range(2)] for k in names}
    mask, step = kernel_mask(), 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            ids = order[at : at + batch]
            conv, unfolded, e = model.features(x[ids])
            where = conv.argmax(axis=1)
            pooled = np.take_along_axis(conv, where[:, None, :], 1)[:, 0] + model.bias
            hidden = np.maximum(pooled, 0)
            p = np.exp(_log_softmax(hidden @ model.out + model.out_bias))
            p[np.arange(len(ids)), y[ids]] -= 1
            p /= len(ids)
            d_hidden = (p @ model.out.T) * (pooled > 0)
            seen = np.take_along_axis(unfolded, where[:, :, None], 1)
            grads = {"out": hidden.T @ p, "out_bias": p.sum(0), "bias": d_hidden.sum(0), "kernel": np.einsum("bfd,bf->df", seen, d_hidden) * mask}
            d_seen = (d_hidden[:, :, None] * model.kernel.T[None]).reshape(len(ids), -1, span, DIM)
            spots = where[:, :, None] + np.arange(span)
            g = np.zeros_like(model.embed)
            np.add.at(g, x[ids][np.arange(len(ids))[:, None, None], spots], d_seen)
            grads["embed"] = g
            step += 1
            lr = rate * (0.5 ** (epoch // 2))
            for k in names:
                m, v = moments[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                getattr(model, k)[...] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return model


def training_rows(docs: DataFrame, per_language: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``per_language`` rows of each language, fewer where that would be over ``max_rows``, by a hash; held-out rows never."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text", F.lit(11)).alias("_h")
    )
    counts = written(labelled.groupBy("lang").count(), "lang-counts")
    most = min(per_language, max(1, max_rows // max(1, counts.count())))
    share = counts.select("lang", (F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(1.2 * most + 20) / F.col("count"))).alias("_below"))
    n = F.char_length("text")
    spots = F.array(F.lit(1), *[F.greatest(F.lit(1), (F.floor(n * q / 4)).cast("int")) for q in (1, 2, 3)])
    taken = F.concat_ws(" ", F.transform(spots, lambda at: F.substring(F.col("text"), at, F.lit(WINDOW))))
    rows = join_small(labelled, share, "lang", "inner", spread="_h").where(F.pmod("_h", F.lit(1 << 30)) < F.col("_below"))
    rows = rows.select("lang", "_h", F.when(n > 4 * WINDOW, taken).otherwise(F.col("text")).alias("text"))
    rows = rows.groupBy("lang", "_h").agg(F.min("text").alias("text"))  # rows that repeat are one
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).orderBy("_nth", "_h").limit(max_rows).select("lang", "text")


def held_out():
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5) == 0


def fit(docs: DataFrame, per_language: int = 600) -> ByteCNN:
    """Train on a bounded sample: at most ``per_language`` rows for each label and MAX_ROWS in all, at most
    four windows of each. The bound is the only thing that does not grow with the table."""
    rows = training_rows(docs, per_language).collect()
    rows = sorted((r["text"], r["lang"]) for r in rows)
    return train([t for t, _ in rows], [label for _, label in rows])


def predict(docs: DataFrame, model: ByteCNN) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches):
            ids, texts = batch.column(0), batch.column(2)
            langs, scores = [], []
            pending, held = [], 0
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                pending.append(text)
                held += len(text or "")
                if held > 400_000 or k == batch.num_rows - 1:
                    for lang, score in label_texts(m, pending):
                        langs.append(lang)
                        scores.append(score)
                    pending, held = [], 0
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_texts(model: ByteCNN, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, probability) of each whole text; ``und`` and 0 without text, letters or classes."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not model.classes:
        return out
    spoken = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
    at = 0
    while at < len(spoken):
        group, size = [], 0
        while at < len(spoken) and (not group or size + len(texts[spoken[at]]) < 4_000_000):
            group.append(spoken[at])
            size += len(texts[spoken[at]])
            at += 1
        data = [normalise(texts[k]) for k in group]
        counts = [max(1, -(-len(d) // WINDOW)) for d in data]
        logs = np.concatenate([model.log_probs(windows_of(d)) for d in data]) if size > 2_000_000 else model.log_probs(np.concatenate([windows_of(d) for d in data]))
        weight = np.concatenate([[*[1.0] * (c - 1), max(1, len(d) - (c - 1) * WINDOW) / WINDOW] for d, c in zip(data, counts, strict=True)])
        sums = np.add.reduceat(logs * weight[:, None], np.cumsum([0, *counts[:-1]]), axis=0)
        mean = sums / np.maximum(1.0, np.add.reduceat(weight, np.cumsum([0, *counts[:-1]])))[:, None]
        p = np.exp(_log_softmax(mean.astype(np.float64)))
        for k, row in zip(group, p, strict=True):
            best = int(row.argmax())
            out[k] = (model.classes[best], float(min(1.0, row[best])))
    return out


def identify(docs: DataFrame, per_language: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text alone.

    Learns from rows with text and lang whose crc32(doc_id as text) mod 5 is not 0. Null text or text
    without a letter is ``und`` with score 0, as is every text if nothing can be learned. Repeated
    rows are labelled each; other columns, and the row's own lang, source and doc_id, play no part.
    """
    return predict(docs, fit(docs, per_language))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """Documents that have a language, with ``lang`` being the one found in the text: ``und`` go, other columns stay.

    No score is asked for: it is low for short and for mixed texts, nearly all of them labelled rightly. The
    verdict is made where the text is, so texts are not shuffled; what stays is written, a few hundred
    rows at a time through Python. Null and wordless texts go; repeated rows are judged each; columns
    may have any names; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            text, lang = (batch.schema.get_field_index(c) for c in ("text", "lang"))
            found = pa.array([v for v, _ in label_texts(shared.value, batch.column(text).to_pylist())], pa.string())
            kept = batch.filter(pc.not_equal(found, "und"))
            yield kept.set_column(lang, kept.schema.field(lang), found.filter(pc.not_equal(found, "und")).cast(kept.schema.field(lang).type))

    return written(docs.mapInArrow(run, docs.schema), "lang-accepted")
