"""Language identification by a byte convolutional network.

Byte embeddings, filters of several widths, max pooling over a fixed-length window, a rectifier and a softmax layer, trained
in numpy. A text is cut into overlapping windows that cover all of it; its probabilities are the mean over its windows,
weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes in a window; filters by width; size of a byte's embedding.
LENGTH, FILTERS, DIM = 256, {2: 8, 3: 12, 4: 12}, 8
WIDEST = max(FILTERS)
STEP = LENGTH - WIDEST + 1
#: The classifier is fitted on all windows of so many labelled rows of each language at most, and of so many bytes together.
SAMPLE_PER_LANG, BYTES_PER_LANG = 400, 4 << 20
UNKNOWN = "und"


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray
    conv: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the first and the second pair of bytes under the filters add, by 16-bit pair."""
        by_byte = [self.embed @ self.conv[k * DIM : (k + 1) * DIM] for k in range(WIDEST)]
        pair = lambda a, b: (by_byte[a][:, None, :] + by_byte[b][None, :, :]).reshape(65536, -1)
        return np.ascontiguousarray(pair(0, 1) + self.bias, np.float32), np.ascontiguousarray(pair(2, 3), np.float32)


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another in ``data``: each window's text, start, and bytes."""
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(1, -(-(size - WIDEST + 1) // STEP)), 0)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text] + nth * STEP
    return text, start, np.minimum(offsets[1:][text] - start, LENGTH)


def _bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(LENGTH)
    return np.where(np.arange(LENGTH) < size[:, None], data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _filter_mask() -> np.ndarray:
    """Filters narrower than the widest have no weights on the last bytes."""
    widths = np.concatenate([[w] * n for w, n in FILTERS.items()])
    return (np.repeat(np.arange(WIDEST), DIM)[:, None] < widths[None, :]).astype(np.float32)


def fit(texts: list[tuple[bytes, str]], steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network | None:
    """None if there is nothing to learn from."""
    texts = [(t, lang) for t, lang in texts if t]
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in texts})
    rows, target = [], []
    for t, lang in texts:
        data = np.frombuffer(t, np.uint8)
        _, start, size = _windows(data, np.array([0, len(data)]))
        rows.append(_bytes(data, start, size))
        target += [labels.index(lang)] * len(start)
    x, y = np.concatenate(rows), np.array(target)
    members = [np.flatnonzero(y == k) for k in range(len(labels))]
    mask, n_filters = _filter_mask(), sum(FILTERS.values())
    p = {
        "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        "conv": rng.normal(0, 0.3, (WIDEST * DIM, n_filters)).astype(np.float32) * mask,
        "bias": np.zeros(n_filters, np.float32),
        "out": rng.normal(0, 0.3, (n_filters, len(labels))).astype(np.float32),
        "out_bias": np.zeros(len(labels), np.float32),
    }
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    places = LENGTH - WIDEST + 1
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, -(-batch // len(labels))) for own in members])
        b = x[pick]
        e = p["embed"][b]
        col = np.concatenate([e[:, k : k + places] for k in range(WIDEST)], axis=2)
        z = col @ p["conv"] + p["bias"]
        top = z.argmax(1)
        pooled = np.take_along_axis(z, top[:, None, :], 1)[:, 0]
        active = np.maximum(pooled, 0)
        g = _softmax(active @ p["out"] + p["out_bias"])
        g[np.arange(len(pick)), y[pick]] -= 1
        g /= len(pick)
        back = (g @ p["out"].T) * (pooled > 0)
        seen = col[np.arange(len(pick))[:, None], top]  # text, filter, weight
        grad = {"out": active.T @ g, "out_bias": g.sum(0), "bias": back.sum(0), "conv": np.einsum("nfw,nf->wf", seen, back) * mask, "embed": np.zeros_like(p["embed"])}
        into = np.einsum("nf,wf->nfw", back, p["conv"])
        for k in range(WIDEST):
            np.add.at(grad["embed"], b[np.arange(len(pick))[:, None], top + k].ravel(), into[:, :, k * DIM : (k + 1) * DIM].reshape(-1, DIM))
        for k in p:
            gk = grad[k] + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.99 * v[k] + 0.01 * gk * gk
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Network(labels, p["embed"], p["conv"] * mask, p["out"], p["bias"], p["out_bias"])


def probabilities(net: Network, tables: tuple[np.ndarray, np.ndarray], data: np.ndarray, offsets: np.ndarray, chunk: int = 48) -> np.ndarray:
    """Per text, the mean of its windows' probabilities by bytes; zeros for empty texts."""
    text, start, size = _windows(data, offsets)
    first, second = tables
    pooled = np.empty((len(text), first.shape[1]), np.float32)
    places = LENGTH - WIDEST + 1
    for i in range(0, len(text), chunk):
        b = _bytes(data, start[i : i + chunk], size[i : i + chunk]).astype(np.int32)
        pairs = (b[:, :-1] << 8) | b[:, 1:]
        z = first[pairs[:, :places]]
        z += second[pairs[:, 2 : 2 + places]]
        z.max(1, out=pooled[i : i + chunk])
    each = _softmax(np.maximum(pooled, 0) @ net.out + net.out_bias) if len(text) else np.zeros((0, len(net.labels)))
    total = np.zeros((len(offsets) - 1, len(net.labels)))
    np.add.at(total, text, each * size[:, None])
    weight = np.zeros(len(offsets) - 1)
    np.add.at(weight, text, size)
    return total / np.maximum(weight, 1)[:, None]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    count = np.concatenate([[0], np.cumsum(ascii_letter[data], dtype=np.int64)])
    found = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, most_bytes: int = BYTES_PER_LANG) -> Network | None:
    """Fitted on rows of each language in the order of a hash of id and text: ``per_lang`` at most, and ``most_bytes`` together.

    Repeated rows count once; a row that would exceed the bytes is passed over. Rows without a letter or a language teach
    nothing. What the driver gets is bounded by these two for each language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.rlike(F.col(text_col), F.lit(r"\p{L}")))
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    once = rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("bytes"))
    rank = Window.partitionBy("lang").orderBy("h")  # each task keeps per_lang hashes of a language before the shuffle
    listed = once.where(F.col("bytes") <= most_bytes).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_lang).collect()  # per_lang * languages at most
    chosen, total = [], dict.fromkeys((r.lang for r in listed), 0)
    for r in sorted(listed, key=lambda r: (r.lang, r.r)):
        if total[r.lang] + r.bytes <= most_bytes:
            total[r.lang] += r.bytes
            chosen.append(r.h)
    wanted = rows.where(F.col("h").isin(chosen)).groupBy("lang", "h").agg(F.first("text").alias("text"))  # repeated rows once
    picked = wanted.collect()  # most_bytes * languages at most
    return fit(sorted((r.text.encode(), r.lang) for r in picked))


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``.

    A text that is null, empty or without a letter, and any text if nothing was learned, is ``und`` with score 0. Repeated
    rows get the same result, null ids are kept, other columns are ignored, an empty table gives no rows. Texts of any
    length are read whole, window by window.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for at in range(0, len(texts), 256):
                part = texts.slice(at, 256).fill_null(b"")
                offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                raw = part.buffers()[2]
                data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
                offsets = offsets - offsets[0]
                lang, score = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
                if net:
                    p = probabilities(net, tables, data, offsets)
                    known = _has_letter(data, offsets)
                    lang[known] = np.array(net.labels, object)[p.argmax(1)][known]
                    score[known] = np.clip(p.max(1)[known], 0, 1)
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
