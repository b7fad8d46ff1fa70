"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are indicators of hashed n-grams: words (1 and 2), and the words' shapes (1 to 3, and runs of eight repeat
marks). A shape tells letter case, digits, marks, the last mark, and whether the word repeats the one before it or ends
a word triple seen earlier in the text. Each indicator is scaled by its class log-count ratio; a linear hinge-loss model
is fitted by dual coordinate descent, and its margin mapped to a probability by a logistic fit on held-back rows.

Fitting uses a bounded sample of labelled rows: those with the smallest hash of doc_id, at most `fit_rows` of them and at
most `fit_bytes` of whole texts (a row that doesn't fit any more is passed over). One executor task fits; the driver gets
nothing but the weights. Scoring reads every whole text. Labels, language, source and id are never inputs.

Edge cases: null or empty text has no n-gram and scores by the bias; without labelled rows of both classes every score
is the share of ones, or 0.5; repeated rows score alike; extra columns are ignored. Where an id has several labels the
greatest counts, where it has several texts the first in order; a null id or label fits nothing, a null id isn't held
out. Texts of any length are read whole. Empty documents give no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np

from arterial.llm.common import U64, attach, bound_batches, mix, quiet_worker, slices, text_bytes, text_column, word_spans
from arterial.llm.common import _BYTE, _power_tables

BITS = 18
FIT_ROWS = 8000
#: Bytes of text, all rows of the sample together: the bound on what the fitting task holds.
FIT_BYTES = 64 << 20
SHARE_OF_ONES = 0.3  # threshold of `predicted`
LEAST_COUNT = 3

_CLASS = np.zeros(256, np.uint8)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 4
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 16
_CLASS[[0x2E, 0x2C]] = 8
_CLASS[0x80:] = 1


def ngrams(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """(text, feature) pairs without repeats, by text."""
    starts, stops, doc = word_spans(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    word = mix((total[stops] - total[starts]) * inverse[starts])
    cls = _CLASS[buf]
    shape = np.bitwise_or.reduceat(cls, starts)  # up to the next word: white space has no class
    last = buf[stops - 1].astype(np.int64)
    mark = np.where((cls[stops - 1] & 24) > 0, last, 0)

    def same_doc(k):
        ok = np.zeros(len(doc), bool)
        ok[k:] = doc[k:] == doc[:-k] if k else True
        return ok

    one, two = same_doc(1), same_doc(2)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & one[1:]
    triple = mix(word + doc.astype(U64) * U64(0x9E3779B1))
    triple[2:] ^= word[1:-1] * U64(3) + word[:-2] * U64(5)
    key = mix(triple)
    order = np.argsort(key, kind="stable")
    seen = np.zeros(len(word), bool)
    seen[order[1:]] = key[order[1:]] == key[order[:-1]]
    seen &= two
    code = (shape.astype(np.int64) | again.astype(np.int64) << 5 | seen.astype(np.int64) << 6 | mark << 7).astype(U64)
    run = np.zeros(len(word), np.int64)
    eight = same_doc(7) if len(word) > 7 else np.zeros(len(word), bool)
    if len(word) > 7:
        for k in range(8):
            run[7:] |= seen[7 - k : len(seen) - k].astype(np.int64) << k
    c = [mix(code + U64(1 << 40))]
    c.append(mix(c[0] + U64(2 << 40)))
    c[1][1:] = mix(c[0][1:] * U64(31) + c[0][:-1] + U64(2 << 40))
    c.append(np.zeros_like(c[0]))
    c[2][2:] = mix(c[1][2:] * U64(37) + c[0][:-2] + U64(3 << 40))
    pair = np.zeros_like(word)
    pair[1:] = mix(word[1:] * U64(41) + word[:-1])
    parts = [(word, slice(None)), (pair, one), (c[0], slice(None)), (c[1], one), (c[2], two & one), (mix(run.astype(U64) + U64(4 << 40)), eight)]
    mask = U64((1 << bits) - 1)
    keys = np.concatenate([doc[where].astype(np.int64) << bits | (h[where] & mask).astype(np.int64) for h, where in parts])
    keys = np.unique(keys)
    return keys >> bits, keys & ((1 << bits) - 1)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """log of (share of the indicator in class 1) / (in class 0), smoothed; 0 for rare indicators."""
    up, down = np.zeros(size), np.zeros(size)
    for f, label in zip(rows, y.tolist(), strict=True):
        (up if label > 0 else down)[f] += 1
    p, q = up + 1, down + 1
    r = np.log((p / p.sum()) / (q / q.sum()))
    r[up + down < LEAST_COUNT] = 0
    return r


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 0.1, epochs: int = 12, seed: int = 7):
    """(w, b) of the L2-regularised hinge loss, solved by coordinate ascent on the dual's box constraints."""
    w, b = np.zeros(len(scale)), 0.0
    values = [scale[f] for f in rows]
    norm = np.array([max(1e-12, float(v @ v) + 1.0) for v in values])
    alpha = np.zeros(len(rows))
    share = max(1, int((y > 0).sum())) / len(y)
    most = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / max(1e-9, 1 - share))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            gradient = y[i] * (float(w[f] @ v) + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[f] += step * v
                b += step
                moved = max(moved, abs(step))
        if moved < 1e-6:
            break
    return w * scale, b


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, c) of P(1) = 1 / (1 + exp(-(a m + c))), with smoothed targets."""
    up, down = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, c = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -30, 30)))
        g = np.array([((p - t) * margins).sum(), (p - t).sum()]) + [1e-6 * a, 0]
        k = p * (1 - p) + 1e-9
        h = np.array([[(k * margins**2).sum() + 1e-6, (k * margins).sum()], [(k * margins).sum(), k.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(c)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS):
    """(weights, offset) such that P(1) = 1 / (1 + exp(-(sum of weights + offset)))."""
    size = 1 << bits
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = 0.5 if not len(y) else float((y > 0).mean())
        return np.zeros(size, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))) if len(y) else 0.0
    held = np.arange(len(y)) % 4 == 0
    if not 0 < (y[~held] > 0).sum() < (~held).sum():
        held[:] = False
    some = [f for f, h in zip(rows, held, strict=True) if not h]
    w, b = dual_coordinate_descent(some, y[~held], log_count_ratios(some, y[~held], size))
    check = held if held.any() else ~held
    margins = np.array([w[f].sum() + b for f, h in zip(rows, check, strict=True) if h])
    a, c = logistic(margins, y[check])
    w, b = dual_coordinate_descent(rows, y, log_count_ratios(rows, y, size))
    return (a * w).astype(np.float32), a * b + c


def within(batches, fit_bytes: int):
    """(label, text) of the rows of the sample, as they come, as long as their texts fit into fit_bytes."""
    left = fit_bytes
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            if len(raw) <= left:
                left -= len(raw)
                yield label.as_py(), raw


def joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and their offsets."""
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))


def shuffled(rows: list[tuple[int, bytes]], seed: int) -> list[tuple[int, bytes]]:
    """The same order whatever order the rows came in."""
    rows = sorted(rows)
    return [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]


def _fit(batches, fit_bytes: int):
    """The fitted weights and the offset, as one row."""
    import pyarrow as pa

    quiet_worker()
    rows = shuffled(list(within(batches, fit_bytes)), 3)
    features: list[np.ndarray] = []
    for first in range(0, len(rows), 256):
        part = [t for _, t in rows[first : first + 256]]
        doc, feature = ngrams(*joined(part))
        ends = np.searchsorted(doc, np.arange(len(part) + 1))
        features += [feature[a:b].astype(np.int32) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    weights, offset = fit(features, np.array([label for label, _ in rows]))
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([float(offset)])], ["weights", "offset"])


def _score(batches, weights, offset: float):
    import pyarrow as pa

    quiet_worker()
    w = weights.value
    for batch in batches:
        texts = text_column(batch.column(1), lower=False)
        score = np.empty(len(texts))
        for first, last in slices(texts):
            doc, feature = ngrams(*text_bytes(texts.slice(first, last - first)))
            total = np.bincount(doc, w[feature], minlength=last - first) + offset
            score[first:last] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], ["doc_id", "held_out", "score"])


def labelled_sample(docs, labels, label: str, keep, most: int):
    """(text, label) of at most `most` labelled ids that `keep` (a Column of doc_id) admits, in one partition: those with
    the smallest hash of doc_id, in its order. Clashing labels: the greatest; several texts of an id: the first in order."""
    from pyspark.sql import functions as F

    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = chosen.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(most)
    one = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "place", "label").agg(F.min("text").alias("text"))
    return one.repartition(1).sortWithinPartitions("place", "doc_id").select("text", "label")


def held_out(doc_id, folds: int, fold: int):
    from pyspark.sql import functions as F

    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def train(docs, labels, label: str = "quality", keep=None, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> tuple[np.ndarray, float]:
    """(weights, offset), fitted in one executor task."""
    bound_batches(docs.sparkSession)
    from pyspark.sql import functions as F

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, fit_rows)
    got = sample.mapInArrow(partial(_fit, fit_bytes=fit_bytes), "weights binary, offset double").collect()
    if not got:
        return fit([], np.zeros(0))
    return np.frombuffer(got[0]["weights"], "<f4"), got[0]["offset"]


def classify(spark, docs, labels, label: str = "quality", folds: int = 5, fold: int = 0, threshold: float = SHARE_OF_ONES, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES):
    """One row per document: score, and whether its label was kept from fitting."""
    from pyspark.sql import functions as F

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = F.coalesce(held_out(F.col("doc_id"), folds, fold), F.lit(False))
    weights, offset = train(docs, labels, label, ~out, fit_rows, fit_bytes)
    shared = spark.sparkContext.broadcast(weights)
    scored = docs.select("doc_id", "text", out.alias("held_out")).mapInArrow(partial(_score, weights=shared, offset=offset), "doc_id long, held_out boolean, score double")
    return attach(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), shared)
