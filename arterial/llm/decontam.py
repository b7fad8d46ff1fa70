"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of WINDOW words at steps of half a window; benchmark items are cut into query windows. Both are
TF-IDF vectors over hashed words. Weights come from counts of all passages of all documents. A randomised SVD (Halko et al.
2011) gives the latent space: each partition of the query windows makes its part of A^T (A Q), and one executor task adds
the parts and orthonormalises the FEATURES x RANK result. It is fitted on the windows of all benchmark items, nothing else:
it holds what tells items apart. Every passage of every document is projected and compared with every query by cosine.
Very common words carry no weight. An item that leaks widely makes its own words common: items of which a window has less
than EXACT of its words weighing are looked for without the cosine, in every passage that holds enough of their words.

Candidates are then verified on the words themselves: within some stretch of half again the item's length, the longest
common subsequence must hold `lcs` of the item's words, or `paraphrase` of them if the item's answer (its last words)
appears as well. All stretches are tried, unless the best one is known sooner.

Bounds: the driver holds and broadcasts FEATURES x RANK numbers and the items of one pass, at most PASS_WORDS words of
them. One space serves all items. A pass compares its items in blocks of BLOCK_WORDS words, one after the other, with
each batch of documents; a benchmark of more than PASS_WORDS words (a single longer item included) takes further passes.

Edge cases: null or empty texts have no passages; null and empty items match nothing;
items under LEAST_ITEM words match where they stand word for word, with a null cosine;
texts of any length are taken whole; a null doc_id or item_id is reported as null, and remove_leaks() keeps rows without
an id; repeated rows and items of one id are reported each; of places with equal shares the first is reported;
an empty benchmark or corpus gives no rows; extra columns are ignored by find_leaks() and kept by remove_leaks(), whatever
their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np

from arterial.llm.common import U64, attach, bound_batches, discard, materialize, quiet_worker, release, slices, text_bytes, text_column, word_hashes, word_spans

BITS = 14
FEATURES = 1 << BITS
RANK = 96
WINDOW, STEP = 32, 16
FIT_PARTS = 4
#: A word in more than this share of passages carries no weight.
COMMON = 0.05
COSINE = 0.6
LCS, PARAPHRASE = 0.8, 0.6
LEAST_ITEM = 5
#: Below this share of weighing words in one of its windows an item is searched in every passage.
EXACT = 0.5
#: Words of the items of a pass over the corpus, and of those compared at once.
PASS_WORDS, BLOCK_WORDS = 1 << 21, 1 << 15
#: Counts of an item's words stop here, and bound nothing where they do.
MOST_HELD = 255
SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answer boolean, start_word long, end_word long"


def hashed(buf: np.ndarray, offsets: np.ndarray):
    """(feature of each word, its text, words by text)."""
    h, doc, counts = word_hashes(buf, offsets, "alnum")
    return (h >> U64(64 - BITS)).astype(np.int64), doc, counts


def windows(counts: np.ndarray):
    """(text, first word, after last word) of all passages; word numbers count through all texts."""
    ends = np.cumsum(counts)
    begins = ends - counts
    number = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(counts)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = begins[text] + k * STEP
    return text, first, np.minimum(first + WINDOW, ends[text])


def passage_counts(feature: np.ndarray, doc: np.ndarray, counts: np.ndarray):
    """(passages that hold each feature, all passages): every one of windows(), by blocks of STEP words. A passage is two blocks
    that follow each other, or a text's only one."""
    blocks = -(-counts // STEP)
    begins = np.cumsum(blocks + 1) - blocks - 1  # a number is left out after each text
    lies_in = np.full(int((blocks + 1).sum()), 2)
    some = np.flatnonzero(blocks)
    lies_in[begins[some]] = lies_in[begins[some] + blocks[some] - 1] = 1
    block = begins[doc] + (np.arange(len(feature)) - (np.cumsum(counts) - counts)[doc]) // STEP
    key = np.sort(feature << 40 | block)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    f = key >> 40
    both = f[1:][np.diff(key) == 1]  # a passage of two blocks that hold it was counted by each
    total = np.bincount(f, lies_in[key & ((1 << 40) - 1)], FEATURES).astype(np.int64) - np.bincount(both, minlength=FEATURES)
    return total, int(np.maximum(blocks[some] - 1, 1).sum())


def _counted(batches):
    """Passages by feature, as (feature, count) rows; feature -1 counts passages."""
    import pyarrow as pa

    quiet_worker()
    total, passages = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        texts = text_column(batch.column(0))
        for first, last in slices(texts):
            feature, doc, counts = hashed(*text_bytes(texts.slice(first, last - first)))
            if not len(feature):
                continue
            times, own = passage_counts(feature, doc, counts)
            total += times
            passages += own
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1]))), pa.array(np.concatenate((total[at], [passages])))], ["feature", "n"])


def inverse_frequencies(rows) -> np.ndarray:
    """IDF by feature from (feature, count) rows; 0 for very common ones."""
    df, n = np.zeros(FEATURES), 1
    for f, c in rows:
        if f < 0:
            n = max(1, c)
        else:
            df[f] = c
    idf = np.log((n + 1) / (df + 1))
    idf[df > max(COMMON * n, 6)] = 0  # a word lies in two passages, so three places are never common
    return np.maximum(idf, 0)


def query_windows(count: int) -> list[tuple[int, int]]:
    """First and after last word of an item's query windows."""
    cuts = np.linspace(0, count, max(1, round(count / WINDOW)) + 1).round().astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _query_rows(batches):
    """Features of the query windows of benchmark items, as little-endian 16-bit numbers."""
    import pyarrow as pa

    quiet_worker()
    for batch in batches:
        texts = text_column(batch.column(0))
        for first, last in slices(texts):
            feature, _, counts = hashed(*text_bytes(texts.slice(first, last - first)))
            feature = feature.astype("<u2")
            begins = np.cumsum(counts) - counts
            out = [feature[b + i : b + j].tobytes() for b, n in zip(begins.tolist(), counts.tolist(), strict=True) if n >= LEAST_ITEM for i, j in query_windows(n)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(np.ones(len(out)))], ["features", "times"])


def project(feature: np.ndarray, begins: np.ndarray, ends: np.ndarray, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of table rows over the windows [begins, ends): one row per window. Words without weight are skipped."""
    use = weight[feature] > 0
    kept = np.concatenate(([0], np.cumsum(use)))
    f = feature[use]
    a, b = kept[begins], kept[ends]
    out = np.zeros((len(begins), table.shape[1]), np.float32)
    full = np.flatnonzero(b > a)
    if len(full):
        index = np.stack((a[full], b[full]), 1).ravel()
        rows = table[np.append(f, 0)]  # one row beyond, which no window takes
        out[full] = np.add.reduceat(rows, index, axis=0)[::2]
    return out


def _gram(batches, shared):
    """This partition's part of A^T (A Q), as one row."""
    import pyarrow as pa

    quiet_worker()
    table, weight = shared.value
    weighted, total = table * weight[:, None].astype(np.float32), np.zeros(table.shape)
    for batch in batches:
        times = batch.column(1).to_numpy()
        for k in range(0, batch.num_rows, 256):
            rows = [np.frombuffer(r.as_py(), "<u2").astype(np.int64) for r in batch.column(0)[k : k + 256]]
            add_gram(total, rows, times[k : k + 256], weighted, weight)
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], ["part"])


def add_gram(total: np.ndarray, rows: list[np.ndarray], times: np.ndarray, weighted: np.ndarray, weight: np.ndarray) -> None:
    """Add these windows' part to the total; weighted: the table's rows times their weight."""
    size = np.array([len(r) for r in rows])
    if not size.sum():
        return
    feature = np.concatenate(rows)
    ends = np.cumsum(size)
    latent = project(feature, ends - size, ends, weighted, weight) * times[:, None].astype(np.float32)
    order = np.argsort(feature, kind="stable")
    f = feature[order]
    first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
    owner = np.repeat(np.arange(len(rows)), size)[order]
    total[f[first]] += np.add.reduceat(latent[owner], first, axis=0) * weight[f[first]][:, None]


def _orthonormal(batches, rank: int):
    """The parts' sum, orthonormalised, as one row."""
    import pyarrow as pa

    quiet_worker()
    total = np.zeros((FEATURES, rank))
    for batch in batches:
        for part in batch.column(0):
            total += np.frombuffer(part.as_py(), "<f4").reshape(FEATURES, rank)
    q, r = np.linalg.qr(total)
    size = np.abs(np.diag(r))
    q[:, size <= 1e-6 * size.max()] = 0  # fewer windows than columns: the rest spans nothing of theirs
    yield pa.RecordBatch.from_arrays([pa.array([q.astype("<f4").tobytes()], pa.binary())], ["basis"])


def latent_space(spark, query_rows, weight: np.ndarray, rank: int = RANK, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """FEATURES x rank orthonormal basis of the leading right singular vectors, by randomised subspace iteration."""
    q = np.random.default_rng(seed).standard_normal((FEATURES, rank), np.float32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((q, weight))
        parts = query_rows.mapInArrow(partial(_gram, shared=shared), "part binary").repartition(1)
        got = parts.mapInArrow(partial(_orthonormal, rank=rank), "basis binary").collect()
        shared.destroy()
        if not got:
            return q
        q = np.frombuffer(got[0]["basis"], "<f4").reshape(FEATURES, rank)
    return q


def words_of(text: str) -> list[str]:
    """The same words as hashed(), as strings."""
    raw = text.lower().encode()
    starts, stops, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), "alnum")
    return [raw[a:b].decode(errors="replace") for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def common_length(masks: dict[str, int], size: int, words: list[str]) -> int:
    """Length of the longest common subsequence; masks: the places of each item word as bits (bit-parallel rows)."""
    full = (1 << size) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        if u:
            v = (v + u | v - u) & full
    return size - v.bit_count()


def verify(item: list[str], words: list[str], lcs: float = LCS, paraphrase: float = PARAPHRASE) -> tuple[float, bool, int, int] | None:
    """(share of the item in a common subsequence within one stretch of half again its length, whether the item's answer
    is at that stretch, its first, after last word): the largest share of a stretch that passes, the first of equals."""
    masks: dict[str, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    size = len(item)
    # only words of the item matter, and a best stretch begins with one
    at = [k for k, w in enumerate(words) if w in masks]
    bound = common_length(masks, size, [words[k] for k in at])
    if bound < paraphrase * size - 1e-9:
        return None
    tail = item[-max(3, size // 5) :]
    answers = [k for k in range(len(words) - len(tail) + 1) if words[k] == tail[0] and words[k : k + len(tail)] == tail]
    most = size + size // 2 + 2
    best: tuple[int, bool, int, int] | None = None
    hi = 0
    for lo, first in enumerate(at):
        while hi < len(at) and at[hi] < first + most:
            hi += 1
        answer = any(first - len(tail) <= k <= at[hi - 1] + 1 for k in answers)
        least = (paraphrase if answer else lcs) * size - 1e-9
        if hi - lo < least or (best and hi - lo <= best[0]):
            continue
        n = common_length(masks, size, [words[k] for k in at[lo:hi]])
        if n >= least and (best is None or n > best[0]):
            best = (n, answer, first, at[hi - 1] + 1)
            if n == bound:
                break
    if best is None:
        return None
    n, answer, a, b = best
    while b - a > n and common_length(masks, size, words[a : b - 1]) == n:  # drop what follows the last match
        b -= 1
    return n / size, answer, a, b


def possible(feature: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, weight: np.ndarray, least: float, common: int) -> np.ndarray:
    """Numbers of the neighbourhoods [lo, hi) that hold `least` words of an item (own: its count of each feature), and as
    many weighing ones as its `common` words without weight leave to be found."""

    def held(mark):
        total = np.concatenate(([0], np.cumsum(mark[feature])))
        return total[hi] - total[lo]

    enough = held(own > 0) >= least - 1e-9
    if least > common:
        enough &= held((own > 0) & (weight > 0)) >= least - common - 1e-9
    return np.flatnonzero(enough)


class Block:
    """Items that are compared at once: their words, the counts of their features, and their query vectors."""

    def __init__(self, items: list[tuple], basis: np.ndarray, weight: np.ndarray, exact: float):
        self.ids = [key for key, _, _ in items]
        self.texts = [" ".join(words) for _, words, _ in items]
        cuts = [(o, f[i:j]) for o, (_, _, f) in enumerate(items) for i, j in query_windows(len(f))]
        size = np.array([len(f) for _, f in cuts])
        ends = np.cumsum(size)
        q = project(np.concatenate([f for _, f in cuts]), ends - size, ends, basis * weight[:, None].astype(np.float32), weight)
        q /= np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-9)
        self.queries, self.owner = np.ascontiguousarray(q.T), np.array([o for o, _ in cuts])
        self.held = []
        for _, _, f in items:
            at, times = np.unique(f, return_counts=True)
            self.held.append((at.astype(np.int32), np.minimum(times, MOST_HELD)))
        dim = {o for o, f in cuts if (weight[f] > 0).mean() < exact}
        #: items that are looked for without the cosine, and how many of their words don't weigh
        self.exact = [(o, int((weight[items[o][2]] <= 0).sum())) for o in sorted(dim)]

    def item(self, o: int) -> list[str]:
        return self.texts[o].split(" ")


def _search(batches, shared):
    import pyarrow as pa

    quiet_worker()
    basis, weight, blocks, cosine, lcs, paraphrase = shared.value
    table = np.ascontiguousarray(basis * weight[:, None].astype(np.float32))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
    count = np.zeros(FEATURES, np.int64)  # an item's, while it is looked at
    for batch in batches:
        out: list[list] = [[] for _ in names]
        texts = text_column(batch.column(1))
        for first, last in slices(texts, 1 << 19):
            feature, _, counts = hashed(*text_bytes(texts.slice(first, last - first)))
            text, a, b = windows(counts)
            begins = np.cumsum(counts) - counts
            found: dict[tuple[int, int, int], list[tuple[int, float]]] = {}
            for n, block in enumerate(blocks):
                everywhere = []
                for o, common in block.exact:
                    size = len(block.item(o))
                    at, times = block.held[o]
                    count[at] = times
                    lo, hi = np.maximum(begins[text], a - size), np.minimum(begins[text] + counts[text], a + WINDOW + size)
                    everywhere.append((o, np.flatnonzero(block.owner == o), possible(feature, lo, hi, count, weight, paraphrase * size, common)))
                    count[at] = 0
                step = max(128, min(1024, (1 << 23) // max(1, len(block.owner))))
                for k in range(0, len(a), step):
                    v = project(feature[a[k] : b[k : k + step][-1]], a[k : k + step] - a[k], b[k : k + step] - a[k], table, weight)
                    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
                    score = v @ block.queries
                    hit = np.flatnonzero(score.ravel() >= cosine)
                    w, q = np.divmod(hit, score.shape[1])
                    for i, o, s in zip((w + k).tolist(), block.owner[q].tolist(), score.ravel()[hit].tolist(), strict=True):
                        found.setdefault((int(text[i]), n, o), []).append((int(a[i] - begins[text[i]]), s))
                    for o, pieces, w in everywhere:
                        w = w[(w >= k) & (w < k + step)]
                        for i, s in zip(w.tolist(), score[w - k][:, pieces].max(1).tolist(), strict=True):
                            found.setdefault((int(text[i]), n, o), []).append((int(a[i] - begins[text[i]]), s))
            words: list[str] = []
            of = -1
            for (t, n, o), places in sorted(found.items()):
                item = blocks[n].item(o)
                held, times = blocks[n].held[o]
                count[held] = times
                best = None
                reach = -1
                for at, _ in sorted(places):
                    lo, hi = max(0, at - len(item)), min(int(counts[t]), at + WINDOW + len(item))
                    if hi <= reach:  # a part of what was looked at
                        continue
                    # no common subsequence is longer than the item's words that occur here at all
                    here, least = feature[begins[t] + lo : begins[t] + hi], paraphrase * len(item)
                    own = count[np.unique(here)]
                    if np.count_nonzero(count[here]) < least - 1e-9 or (own.sum() < least - 1e-9 and own.max() < MOST_HELD):
                        continue
                    reach = hi
                    if t != of:
                        of, words = t, words_of(texts[first + t].as_py())
                    got = verify(item, words[lo:hi], lcs, paraphrase)
                    if got:
                        one = (got[0], got[1], lo + got[2], lo + got[3])
                        best = one if best is None or one[0] > best[0] else best
                count[held] = 0
                if best:
                    row = (batch.column(0)[first + t].as_py(), blocks[n].ids[o], max(s for _, s in places), *best)
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _search_short(batches, items):
    """Where the words of short items follow each other: the first place in each text."""
    import pyarrow as pa

    quiet_worker()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        texts = text_column(batch.column(1))
        for first, last in slices(texts, 1 << 19):
            feature, doc, counts = hashed(*text_bytes(texts.slice(first, last - first)))
            begins = np.cumsum(counts) - counts
            # by text, so that each one's words are made once
            found: dict[int, list] = {}
            for o, (_, item, marks) in enumerate(items):
                n = len(feature) - len(item) + 1
                if n > 0:
                    at = np.flatnonzero(np.logical_and.reduce([feature[k : n + k] == m for k, m in enumerate(marks)]))
                    for i in at[doc[at] == doc[at + len(item) - 1]].tolist():
                        found.setdefault(int(doc[i]), []).append((o, i))
            for t, places in sorted(found.items()):
                words = words_of(texts[first + t].as_py())
                done = set()
                for o, i in places:
                    at, (key, item, _) = i - int(begins[t]), items[o]
                    if o not in done and words[at : at + len(item)] == item:
                        done.add(o)
                        for c, x in zip(out, (batch.column(0)[first + t].as_py(), key, None, 1.0, True, at, at + len(item)), strict=True):
                            c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _passes(items):
    """The items, in order, in lists of at most PASS_WORDS words (or one longer item): (item_id, words, features) each."""
    taken, held = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        words = words_of(r["text"])
        if not words:
            continue
        if taken and held + len(words) > PASS_WORDS:
            yield taken
            taken, held = [], 0
        raw = r["text"].lower().encode()
        taken.append((r["item_id"], words, hashed(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]))
        held += len(words)
    if taken:
        yield taken


def _blocks(items: list[tuple], *about) -> list[Block]:
    cut = np.cumsum([len(words) for _, words, _ in items]) // BLOCK_WORDS
    return [Block([items[k] for k in np.flatnonzero(cut == c)], *about) for c in np.unique(cut)]


def find_leaks(spark, docs, benchmark, rank: int = RANK, cosine: float = COSINE, lcs: float = LCS, paraphrase: float = PARAPHRASE,
               exact: float = EXACT):
    """(doc_id, item_id) of documents that hold a benchmark item, with the cosine, the common share and the place."""
    bound_batches(spark)
    from pyspark.sql import functions as F

    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    counted = two.select("text").mapInArrow(_counted, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    weight = inverse_frequencies([(r["feature"], r["n"]) for r in counted])
    query_rows = materialize(spark, items.select("text").mapInArrow(_query_rows, "features binary, times double").repartition(FIT_PARTS), "windows")
    basis, result, spent = None, None, []
    for taken in _passes(items):
        short = [(key, words, f.tolist()) for key, words, f in taken if len(words) < LEAST_ITEM]
        long = [x for x in taken if len(x[1]) >= LEAST_ITEM]
        found = []
        if short:
            found.append(two.mapInArrow(partial(_search_short, items=short), SCHEMA))
        if long:
            basis = latent_space(spark, query_rows, weight, rank) if basis is None else basis
            spent.append(spark.sparkContext.broadcast((basis, weight, _blocks(long, basis, weight, exact), cosine, lcs, paraphrase)))
            found.append(two.mapInArrow(partial(_search, shared=spent[-1]), SCHEMA))
        for one in found:
            result = one if result is None else result.unionByName(one)
    discard(spark, query_rows)
    return spark.createDataFrame([], SCHEMA) if result is None else attach(result, *spent)


def remove_leaks(spark, docs, benchmark, **options):
    """docs without those that hold a benchmark item; all columns and rows without an id are kept."""
    found = find_leaks(spark, docs, benchmark, **options)
    leaks = materialize(spark, found.select("doc_id").distinct(), "leaks")
    release(spark, found)
    return attach(docs.join(leaks, "doc_id", "left_anti"), leaks)
