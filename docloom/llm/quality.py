"""Quality classifier: a byte-level convolutional network in numpy.

The whole text is cut into overlapping chunks. Learned filters run over the embedded bytes of a
chunk and are max-pooled; a document's mean, largest and smallest pooled values over all its
chunks are combined into one probability. Only bytes enter it.

Training uses at most ``max_train`` labelled rows (smallest hash of doc_id first) with their whole
texts; scoring covers every chunk of every text. Chunks are handled ``PART`` at a time, so that
memory grows with the texts' bytes only. Null and empty texts have one chunk of padding, and so a
score. Rows without a doc_id or a label take no part in training; with no usable label, or one class
only, every score is 0.5. Repeated rows are scored each; columns may have any names but ``out``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import name_apart, text_slices

CHUNK, STEP = 256, 224
EMBED, WIDTH, FILTERS = 6, 7, 48
MAX_TRAIN, EPOCHS, PART = 2400, 14, 256
#: Byte values, of which 256 is padding.
SYMBOLS = 257


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all chunks, and each row's first chunk, with the end."""
    n = np.maximum(1, -(-(np.diff(offsets) - (CHUNK - STEP)) // STEP))
    firsts = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(firsts[-1]) - firsts[row]
    at = (offsets[:-1][row] + k * STEP)[:, None] + np.arange(CHUNK)
    inside = at < offsets[1:][row][:, None]
    out = np.full(at.shape, SYMBOLS - 1, np.int16)
    out[inside] = data[at[inside]]
    return out, firsts


def _patches(model: dict, chunks: np.ndarray) -> np.ndarray:
    x = model["embed"][chunks]
    view = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), WIDTH * EMBED, axis=1)[:, ::EMBED]
    return np.ascontiguousarray(view).reshape(-1, WIDTH * EMBED)


def _pooled(model: dict, chunks: np.ndarray) -> np.ndarray:
    """Chunk x filter: the largest response in the chunk, at least 0."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for i in range(0, len(chunks), 64):
        part = chunks[i : i + 64]
        conv = (_patches(model, part) @ model["filters"]).reshape(len(part), -1, FILTERS)
        out[i : i + 64] = np.maximum(conv.max(1) + model["bias"], 0)
    return out


def _combined(pooled: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    at, n = firsts[:-1], np.diff(firsts)[:, None]
    return np.concatenate([np.add.reduceat(pooled, at) / n, np.maximum.reduceat(pooled, at), np.minimum.reduceat(pooled, at)], 1)


def predict(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A probability for each row. Rows of one length class share the work; chunks bound the memory."""
    chunks, firsts = _chunks(data, offsets)
    z = _combined(_pooled(model, chunks), firsts) @ model["out"] + model["out_bias"]
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def gradients(model: dict, x: np.ndarray, firsts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict:
    """Of the mean weighted log loss of a batch, by hand: chunks go forward and back PART at a time."""
    n, docs = np.diff(firsts), len(labels)
    top, where = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
    for i in range(0, len(x), PART):
        conv = (_patches(model, x[i : i + PART]) @ model["filters"]).reshape(len(x[i : i + PART]), -1, FILTERS)
        where[i : i + PART] = conv.argmax(1)
        top[i : i + PART] = conv.max(1) + model["bias"]
    pooled = np.maximum(top, 0)
    vec = _combined(pooled, firsts)
    p = 1 / (1 + np.exp(-(vec @ model["out"] + model["out_bias"])))
    dz = ((p - labels) * weight / docs).astype(np.float32)
    grad = {"out": vec.T @ dz, "out_bias": dz.sum()}
    dvec = dz[:, None] * model["out"]
    dpool = (dvec[:, :FILTERS] / n[:, None])[np.repeat(np.arange(docs), n)]
    for part, pick in ((1, np.argmax), (2, np.argmin)):
        for i in range(docs):
            best = firsts[i] + pick(pooled[firsts[i] : firsts[i + 1]], 0)
            dpool[best, np.arange(FILTERS)] += dvec[i, part * FILTERS : (part + 1) * FILTERS]
    dpool *= top > 0
    grad |= {"bias": dpool.sum(0), "filters": np.zeros_like(model["filters"]), "embed": np.zeros_like(model["embed"])}
    for i in range(0, len(x), PART):
        d = dpool[i : i + PART]
        # the bytes under each filter where it responded most
        symbols = x[np.arange(i, i + len(d))[:, None, None], where[i : i + PART][:, :, None] + np.arange(WIDTH)]
        grad["filters"] += np.einsum("cfk,cf->kf", model["embed"][symbols].reshape(len(d), FILTERS, -1), d, optimize=True)
        dpatch = (d[:, :, None] * model["filters"].T[None]).reshape(-1, WIDTH, EMBED)
        for e in range(EMBED):
            grad["embed"][:, e] += np.bincount(symbols.ravel(), dpatch[:, :, e].ravel(), SYMBOLS)
    return grad


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Adam on the log loss; classes weigh alike at most 3 to 1."""
    rng = np.random.default_rng(seed)
    model = {
        "embed": rng.normal(0, 0.5, (SYMBOLS, EMBED)).astype(np.float32),
        "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.05, 3 * FILTERS).astype(np.float32),
        "out_bias": np.zeros((), np.float32),
    }
    share = labels.mean() if len(labels) else 0.5
    if share in (0, 1) or not len(labels):
        return model | {"out": model["out"] * 0}
    weight = np.where(labels > 0.5, 1.0, min(3.0, max(1.0, share / (1 - share)))).astype(np.float32)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for b in range(0, len(order), 32):
            docs = order[b : b + 32]
            cells = [texts[d] for d in docs]
            x, firsts = _chunks(np.frombuffer(b"".join(cells), np.uint8), np.cumsum([0, *map(len, cells)]))
            grad = gradients(model, x, firsts, labels[docs], weight[docs])
            grad["out"] = grad["out"] + 1e-4 * model["out"]
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for k, g in grad.items():
                m, v = moment[k]
                m[...] = 0.9 * m + 0.1 * g
                v[...] = 0.999 * v + 0.001 * g * g
                model[k] = (model[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: F.Column | None = None, max_train: int = MAX_TRAIN) -> dict:
    """Fit on a bounded sample of the labelled rows for which ``keep`` holds."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if keep is not None:
        rows = rows.filter(keep)
    picked = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    sample = texts.join(F.broadcast(picked), F.col("_id") == F.col("doc_id")).select("_id", "_text", "_label")

    # doc_id may repeat in documents: the bound holds for the rows too
    found = sample.select("_id", "_label", F.coalesce("_text", F.lit("")).cast("binary").alias("_text")).orderBy(F.xxhash64("_id"), "_id", "_text").limit(max_train).collect()
    return fit([bytes(r["_text"]) for r in found], np.array([r["_label"] for r in found], np.float32))


def with_score(docs: DataFrame, model: dict, columns: list[str], out: str = "score", least: float | None = None) -> DataFrame:
    """The given columns with a score of the text; with ``least``, only rows that reach it, without the score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # texts that are given back go to the tasks once
    text = "text" if "text" in columns else name_apart(docs, "_scored_text")[0]
    source = docs.select(*columns, *([] if "text" in columns else [F.col("text").alias(text)]))
    schema = T.StructType([*docs.select(*columns).schema.fields, *([] if least is not None else [T.StructField(out, T.DoubleType())])])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch, text):
                p = predict(sent.value, data, offsets)
                arrays = batch.slice(at, end - at).columns[: len(columns)]
                if least is None:
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(p)], [*columns, out])
                else:
                    keep = pa.array(p >= least)
                    yield pa.RecordBatch.from_arrays([x.filter(keep) for x in arrays], columns)

    return source.mapInArrow(score, schema)
