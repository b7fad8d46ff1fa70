"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and word beginnings of 4 to 10 bytes, whose smoothed log-odds of a toxic text are high.
Words are folded first (lower case, marks inside dropped, digits and marks that stand for letters put back), so obfuscated
forms meet their plain ones. Features of a text: hits, their density and strength, distinct entries, hits near a
second-person word, shares of capitals, marks and exclamations, shares of obfuscated words, and length.

Fitting uses a bounded sample of labelled rows: those with the smallest hash of doc_id, at most `fit_rows` of them and at
most `fit_bytes` of whole texts (a row that doesn't fit any more is passed over). It is cut into four folds: features of
a fitting row use the lexicon of the three folds it isn't in, so the trees see what they will meet; the scores of trees
fitted without a row's fold calibrate them. One executor task fits; the driver gets nothing but the model. Scoring reads
every whole text. Labels, language, source and id are never inputs.

Edge cases: null or empty text has features of 0 and a score like any other; without labelled rows of both classes every
score is the share of ones, or 0; repeated rows score alike. Where an id has several labels the greatest counts, where it
has several texts the first in order; a null id or label fits nothing, a null id isn't held out. Texts of any length are
read whole. Empty documents give no rows; filter_toxic() keeps extra columns and rows without an id.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np

from arterial.llm.common import U64, attach, bound_batches, mix, quiet_worker, slices, text_bytes, text_column, word_spans
from arterial.llm.common import _BYTE, _power_tables
from arterial.llm.quality_clf import held_out, joined, labelled_sample, shuffled, within

FIT_ROWS = 6000
#: Bytes of text, all rows of the sample together: the bound on what the fitting task holds.
FIT_BYTES = 32 << 20
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
LEXICON_SIZE = 600
LEAST_TEXTS = 4
LEAST_ODDS = 1.5
NEAR = 6  # words
FEATURES = ("hits", "density", "strongest", "second", "strength", "distinct", "near_person", "capitals", "marks", "shouts", "obfuscated", "words", "word_hits", "strength_density")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
for _a, _b in zip("013457$@!", "oieastsai", strict=True):
    _FOLD[ord(_a)] = ord(_b)
_KEEP = np.ones(256, bool)
_KEEP[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "$@!"]] = False
_DIGIT_OR_MARK = np.zeros(256, bool)
_DIGIT_OR_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalpha()]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Second-person words of the languages at hand.
PERSONS = ("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie ihnen usted ustedes ti tus vosotros").split()


class Words:
    """Folded words of a run of texts: hashes of each, and of its beginnings."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        self.starts, self.stops, self.doc = word_spans(buf, offsets)
        self.buf, self.offsets = buf, offsets
        keep = _KEEP[buf]
        # a final ! is a mark, within a word a letter
        if len(self.stops):
            tail = self.stops - 1
            for _ in range(3):
                keep[tail[buf[tail] == 0x21]] = False
                tail = np.maximum(tail - 1, 0)
        self.place = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(keep, out=self.place[1:])
        power, self.inverse = _power_tables(len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, U64)
        kept = np.flatnonzero(keep)
        self.kept = kept
        value = np.zeros(len(kept) + 1, U64)
        np.cumsum(_BYTE[_FOLD[buf[kept]]] * power[: len(kept)], out=value[1:])
        self.value = value
        self.begin, self.end = self.place[self.starts], self.place[self.stops]
        self.size = self.end - self.begin

    def hashes(self, length: int | None = None):
        """(index of word, hash): of whole words, or of the first `length` bytes of longer ones."""
        at = np.flatnonzero(self.size > (length or 1))
        begin = self.begin[at]
        end = self.end[at] if length is None else begin + length
        return at, mix((self.value[end] - self.value[begin]) * self.inverse[begin] + U64(length or 0))


def _hash_words(words) -> np.ndarray:
    raw = " ".join(words).encode()
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    at, h = w.hashes()
    return np.unique(h)


def _hashed_entries(buf: np.ndarray, offsets: np.ndarray):
    """(text, hash) of all distinct words and beginnings, by text."""
    w = Words(buf, offsets)
    keys = [(w.doc[at], h) for at, h in [w.hashes(), *[w.hashes(n) for n in PREFIXES]]]
    doc, h = np.concatenate([k[0] for k in keys]), np.concatenate([k[1] for k in keys])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def lexicon_entries(texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    """By text, those of its entries that a lexicon may take: the ones in LEAST_TEXTS toxic texts or more."""
    up = [i for i, t in enumerate(y) if t]
    known = np.zeros(0, U64)
    if up:
        keys, n = np.unique(np.concatenate([_hashed_entries(*joined([texts[i] for i in up[a : a + 256]]))[1] for a in range(0, len(up), 256)]), return_counts=True)
        known = keys[n >= LEAST_TEXTS]
    out: list[np.ndarray] = []
    for a in range(0, len(texts), 256):
        part = texts[a : a + 256]
        doc, h = _hashed_entries(*joined(part))
        keep = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
        doc, h = doc[keep], h[keep]
        ends = np.searchsorted(doc, np.arange(len(part) + 1))
        out += [h[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def learn_lexicon(entries: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log-odds) of the strongest entries."""
    empty = np.zeros(0, U64), np.zeros(0)
    toxic = [e for e, t in zip(entries, y, strict=True) if t]
    if not toxic or len(toxic) == len(entries):
        return empty
    up_keys, up = np.unique(np.concatenate(toxic), return_counts=True)
    up_keys, up = up_keys[up >= LEAST_TEXTS], up[up >= LEAST_TEXTS]
    if not len(up_keys):
        return empty
    down = np.zeros(len(up_keys))
    for e, t in zip(entries, y, strict=True):
        if not t:
            at = np.minimum(np.searchsorted(up_keys, e), len(up_keys) - 1)
            down[at[up_keys[at] == e]] += 1
    n_up, n_down = len(toxic), len(entries) - len(toxic)
    odds = np.log(((up + 0.5) / (n_up + 1)) / ((down + 0.5) / (n_down + 1)))
    # strength counts with the evidence for it
    worth = odds * np.sqrt(up)
    good = np.flatnonzero(odds >= LEAST_ODDS)
    good = np.sort(good[np.argsort(-worth[good], kind="stable")[:LEXICON_SIZE]])
    return up_keys[good], odds[good]


def features(buf: np.ndarray, offsets: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], persons: np.ndarray) -> np.ndarray:
    """texts x FEATURES. buf holds the texts as they are: the fold lowers ASCII letters."""
    w = Words(buf, offsets)
    n, nw = w.n, len(w.starts)
    out = np.zeros((n, len(FEATURES)))
    keys, odds = lexicon
    strength = np.zeros(nw)
    word_hit = np.zeros(nw, bool)
    best = np.full(nw, -1)
    person = np.zeros(nw, bool)
    for length in (None, *PREFIXES):
        at, h = w.hashes(length)
        if not len(at):
            continue
        if length is None:
            k = np.minimum(np.searchsorted(persons, h), len(persons) - 1)
            person[at] = persons[k] == h
        if len(keys):
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            at, k = at[hit], k[hit]
            better = odds[k] > strength[at]
            strength[at[better]] = odds[k[better]]
            best[at[better]] = k[better]
            if length is None:
                word_hit[at] = True
    words = np.bincount(w.doc, minlength=n).astype(float)
    per_word = 1 / np.maximum(words, 1)
    hit = np.flatnonzero(strength > 0)
    doc = w.doc[hit]
    out[:, 0] = np.bincount(doc, minlength=n)
    out[:, 1] = out[:, 0] * per_word
    if len(hit):
        order = np.lexsort((-strength[hit], doc))
        d, s = doc[order], strength[hit][order]
        first = np.searchsorted(d, np.arange(n))
        has = first < np.searchsorted(d, np.arange(n), "right")
        out[has, 2] = s[first[has]]
        distinct = np.unique(doc * np.int64(1 << 20) + best[hit])
        out[:, 5] = np.bincount(distinct >> 20, minlength=n)
        # the second strongest of different entries
        e_doc, e_best = distinct >> 20, distinct & ((1 << 20) - 1)
        order = np.lexsort((-odds[e_best], e_doc))
        e_doc, e_odds = e_doc[order], odds[e_best][order]
        second = np.searchsorted(e_doc, np.arange(n)) + 1
        has = second < np.searchsorted(e_doc, np.arange(n), "right")
        out[has, 3] = e_odds[second[has]]
        at = np.flatnonzero(person)
        if len(at):
            k = np.searchsorted(at, hit)
            near = np.zeros(len(hit), bool)
            for side in (np.maximum(k - 1, 0), np.minimum(k, len(at) - 1)):
                near |= (np.abs(at[side] - hit) <= NEAR) & (w.doc[at[side]] == doc)
            out[:, 6] = np.bincount(doc[near], minlength=n)
    out[:, 4] = np.bincount(doc, strength[hit], minlength=n)
    out[:, 12] = np.bincount(w.doc[word_hit], minlength=n)
    out[:, 11] = np.log1p(words)
    out[:, 13] = out[:, 4] * per_word
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def share(mask):
        c = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return (c[offsets[1:]] - c[offsets[:-1]]) / size

    out[:, 7] = share((buf >= 0x41) & (buf <= 0x5A))
    out[:, 8] = share(_DIGIT_OR_MARK[buf])
    out[:, 9] = share(buf == 0x21)
    if nw:
        inner = w.stops - w.starts > 2
        c = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_DIGIT_OR_MARK[buf], out=c[1:])
        odd = c[np.maximum(w.stops - 1, w.starts)] - c[np.minimum(w.starts + 1, w.stops)] > 0
        letters = _LETTER[buf[w.starts]] & _LETTER[buf[w.stops - 1]]
        out[:, 10] = np.bincount(w.doc[inner & odd & letters], minlength=n) * per_word
    return out


class Trees:
    """Boosted trees of fixed depth on binned features, for the logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 3.0, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0
        self.edges: list[np.ndarray] = []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(np.unique(x[:, f]), np.linspace(0, 1, self.bins)[:-1])) for f in range(x.shape[1])]
        b, total = self._bin(x), np.full(len(x), self.base)
        width = self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            nodes = 1 << self.depth
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, width, np.int64)
            at = np.ones(len(x), np.int64)
            for level in range(self.depth):
                lo, count = 1 << level, 1 << level
                best = np.full(count, 1e-6)
                for f in range(x.shape[1]):
                    key = (at - lo) * width + b[:, f]
                    gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                    hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least * 0.1) | (ht - hs < self.least * 0.1)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(count), k]
                    better = top > best
                    best[better] = top[better]
                    feature[lo : lo + count][better] = f
                    cut[lo : lo + count][better] = k[better]
                at = 2 * at + (b[np.arange(len(x)), feature[at]] > cut[at])
            leaf = at - nodes
            value = self.rate * np.bincount(leaf, g, nodes) / (np.bincount(leaf, h, nodes) + self.ridge)
            self.trees.append((feature, cut, value))
            total += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, total = self._bin(x), np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + (b[row, feature[at]] > cut[at])
            total += value[at - (1 << self.depth)]
        return total


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, values) of the best non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    points: list[list[float]] = []
    for r, t in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        points.append([t, 1.0, r, r])
        if len(points) > 1 and points[-2][3] == r:
            b = points.pop()
            points[-1] = [points[-1][0] + b[0], points[-1][1] + 1, points[-1][2], r]
        while len(points) > 1 and points[-2][0] * points[-1][1] >= points[-1][0] * points[-2][1]:
            b = points.pop()
            a = points[-1]
            points[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    x = [p for a in points for p in (a[2], a[3])]
    v = [q for a in points for q in [a[0] / a[1]] * 2]
    return np.array(x), np.array(v)


class Model:
    def __init__(self, lexicon, trees: Trees | None, curve, share: float):
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share
        self.persons = _hash_words(PERSONS)

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.share)
        raw = self.trees.raw(features(buf, offsets, self.lexicon, self.persons))
        # the raw score breaks ties inside the curve's flat parts
        flat = np.interp(raw, *self.curve)
        return np.clip(flat * 0.999 + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    y = (labels > 0).astype(float)
    if not len(y) or y.all() or not y.any():
        return Model((np.zeros(0, U64), np.zeros(0)), None, None, float(y.mean()) if len(y) else 0.0)
    persons = _hash_words(PERSONS)
    entries = lexicon_entries(texts, y)
    fold = np.arange(len(y)) % 4
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(4):
        inside, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        lexicon = learn_lexicon([entries[i] for i in rest], y[rest])
        for a in range(0, len(inside), 256):
            x[inside[a : a + 256]] = features(*joined([texts[i] for i in inside[a : a + 256]]), lexicon, persons)
    raw = np.zeros(len(y))
    for k in range(4):
        raw[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(learn_lexicon(entries, y), Trees().fit(x, y), isotonic(raw, y), float(y.mean()))


def _fit(batches, fit_bytes: int):
    """The fitted model, as one row."""
    import pyarrow as pa

    quiet_worker()
    rows = shuffled(list(within(batches, fit_bytes)), 5)
    model = fit([t for _, t in rows], np.array([label for label, _ in rows]))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def train(docs, labels, label: str = "toxic", keep=None, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """The model, fitted in one executor task."""
    bound_batches(docs.sparkSession)
    from pyspark.sql import functions as F

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, fit_rows)
    got = sample.mapInArrow(partial(_fit, fit_bytes=fit_bytes), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], np.zeros(0))


def _scores(texts, model: Model) -> np.ndarray:
    out = np.empty(len(texts))
    for first, last in slices(texts):
        out[first:last] = model.score(*text_bytes(texts.slice(first, last - first)))
    return out


def _score(batches, shared):
    import pyarrow as pa

    quiet_worker()
    for batch in batches:
        score = _scores(text_column(batch.column(1), lower=False), shared.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], ["doc_id", "held_out", "score"])


def classify(spark, docs, labels, label: str = "toxic", folds: int = 3, fold: int = 1, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES):
    """One row per document: score, and whether its label was kept from fitting."""
    from pyspark.sql import functions as F

    out = F.coalesce(held_out(F.col("doc_id"), folds, fold), F.lit(False))
    shared = spark.sparkContext.broadcast(train(docs, labels, label, ~out, fit_rows, fit_bytes))
    three = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = three.select("doc_id", "text", out.alias("held_out")).mapInArrow(partial(_score, shared=shared), "doc_id long, held_out boolean, score double")
    return attach(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), shared)


def _filter(batches, shared, threshold: float, text_col: str):
    import pyarrow as pa

    quiet_worker()
    for batch in batches:
        score = _scores(text_column(batch.column(batch.schema.names.index(text_col)), lower=False), shared.value)
        yield batch.filter(pa.array(score < threshold))


def filter_toxic(spark, docs, labels, label: str = "toxic", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES):
    """docs without those scored at the threshold or above, all columns kept; fitted on all labelled rows of the sample."""
    shared = spark.sparkContext.broadcast(train(docs, labels, label, None, fit_rows, fit_bytes))
    return attach(docs.mapInArrow(partial(_filter, shared=shared, threshold=threshold, text_col="text"), docs.schema), shared)
