"""Near-duplicates by BagMinHash: weighted signatures, banding, exact checks of multiset overlap, components.

A text is the multiset of its five-word shingles (lower case, words without white space; a shorter text is one shingle).
Its weighted Jaccard similarity with another is sum(min) / sum(max) of their counts.

Signature. Each shingle owns Poisson processes over weight intervals (0,1], (1,2], (2,4], (4,8], ...; a process of
interval length r makes points at rate r for every register, in ascending order, each with a register and, by successive
halving of its interval, a weight cell of length one. A text takes the points whose cell lies below the shingle's count;
a register holds the first point that it gets. Two registers agree with probability equal to the similarity. Points
beyond the value by which all registers are filled can't matter, so a text costs about m ln m points, however long.

Groups. (1) Equal word sequences are one text, a node with a number of its own. (2) Bands of registers put nodes into
buckets; each is checked exactly against its bucket's least node, and links make components. (3) Buckets that still hold
several components compare all pairs across components, and none within one: blocks of one component's members, or of
members of several small ones, against blocks, by their signatures (registers cut to a byte) and by bounds from sizes and
binned counts, and exact checks of those that come near; first of the likeliest pair of each two components, then of every
pair still across. Pairs inside one component need no check: they can't change the classes. So no link between different
texts is lost once they share a bucket, and no group is ever expanded into all of its pairs.

Buckets are found by counts combined before the shuffle; rows of a hot bucket are joined by sort-merge joins that
adaptive execution splits. A text that meets many others goes once to each of as many salted groups as there are shuffle
partitions, not once to each pair.

Edge cases: null or empty text is the empty multiset; all such rows are equal, one class. A null doc_id has no class and
stays. Repeated rows with one id and text are one document; rows of one id with different texts are documents of their own,
each with its class. Texts of any length are signed whole. Of equal texts and in a class the least doc_id stands for all.
Extra columns are ignored, and kept by keep_one(), whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np

from arterial.llm.common import U64, attach, bound_batches, broadcast_if_small, discard, materialize, mix, partitions_for, quiet_worker, slices, text_bytes, text_column, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: A pair at the similarity misses all buckets with probability (1 - s**ROWS)**BANDS = 3e-6.
BLOCK = 256
#: Share of equal registers from which a pair across components is checked exactly: 4.8 standard deviations below.
NEAR = 0.68
#: Shingles are counted in so many bins; the sum of two texts' smaller counts bounds their overlap from above.
BINS = 256
_SIG = "doc_id long, h long, fp1 long, fp2 long, size long, bands array<long>, registers binary, bins binary"


def _times(a: int, b: int) -> np.uint64:
    return U64(a * b & 0xFFFFFFFFFFFFFFFF)


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = WORDS):
    """(text << 52 | 52-bit shingle hash) in ascending order without repeats, counts, and two fingerprints by text."""
    n = len(offsets) - 1
    word, doc, counts = word_hashes(buf, offsets)
    ends = np.cumsum(counts)
    begins = ends - counts
    # fingerprints of the whole word sequence
    place = np.arange(len(word)) - begins[doc] if len(word) else np.zeros(0, np.int64)
    fp = []
    for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        h = mix(word + mix(place.astype(U64) * U64(salt) + U64(salt)))
        total = np.zeros(len(word) + 1, U64)
        np.cumsum(h, out=total[1:])
        fp.append(mix(total[ends] - total[begins] + counts.astype(U64)))
    rolled = word.copy()
    for j in range(1, k):
        step = np.zeros_like(word)
        step[: len(word) - j] = word[j:]
        rolled = rolled * U64(0x9E3779B97F4A7C15) + step
    whole = counts >= k
    left = ends[doc] - np.arange(len(word)) if len(word) else np.zeros(0, np.int64)
    keep = whole[doc] & (left >= k) if len(word) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & ~whole)
    owner = np.concatenate((doc[keep], short)).astype(U64)
    h = np.concatenate((mix(rolled[keep]), mix(fp[0][short])))
    keys = np.sort(owner << U64(52) | h >> U64(12))
    if not len(keys):
        return keys, np.zeros(0, np.int64), fp, n
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys))), fp, n


def signatures(keys: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers of first points (inf where a text has no shingle)."""
    sig = np.full(n * registers, np.inf)
    doc = (keys >> U64(52)).astype(np.int64)
    element = keys & U64((1 << 52) - 1)
    total = np.bincount(doc, weights, minlength=n)
    reach = np.zeros(n)
    reach[total > 0] = (np.log(registers) + 4.0) / total[total > 0]
    # one row per (shingle, weight interval below its count)
    levels = int(weights.max()).bit_length() if len(weights) else 0
    parts = [(np.arange(len(keys)), 0, 1.0)] if len(keys) else []
    for level in range(1, levels + 1):
        at = np.flatnonzero(weights > (1 << (level - 1)))
        if len(at):
            parts.append((at, 1 << (level - 1), float(1 << (level - 1))))
    active = np.flatnonzero(total > 0)
    while len(active):
        chosen = np.zeros(n, bool)
        chosen[active] = True
        for at, low, rate in parts:
            at = at[chosen[doc[at]]]
            seed = mix(element[at] + _times(low, 0xD6E8FEB86659FD93))
            x = np.zeros(len(at))
            d, w = doc[at], weights[at]
            step = 0
            while len(at):
                step += 1
                u = mix(seed + _times(step * 2, 0x9E3779B97F4A7C15))
                x = x - np.log(((u >> U64(11)).astype(float) + 0.5) * 2.0**-53) / (registers * rate)
                go = x <= reach[d]
                if not go.any():
                    break
                if not go.all():
                    at, seed, x, d, w = at[go], seed[go], x[go], d[go], w[go]
                v = mix(seed + _times(step * 2 + 1, 0x9E3779B97F4A7C15))
                register = ((v >> U64(40)) * U64(registers) >> U64(24)).astype(np.int64)
                if low > 1:
                    inside = low + (v & U64(low - 1)).astype(np.int64) < w
                    np.minimum.at(sig, d[inside] * registers + register[inside], x[inside])
                else:
                    np.minimum.at(sig, d * registers + register, x)
        unfilled = np.isinf(sig.reshape(n, registers)[active]).any(1)
        active = active[unfilled]
        reach[active] *= 2.0
    return sig.reshape(n, registers)


def _signed(batches):
    import pyarrow as pa

    quiet_worker()
    names = [c.split()[0] for c in _SIG.split(", ")]
    for batch in batches:
        ids, texts, hashes = batch.column(0), text_column(batch.column(1)), batch.column(2)
        for first, last in slices(texts):
            keys, weights, fp, n = shingles(*text_bytes(texts.slice(first, last - first)))
            sig = signatures(keys, weights, n).view(U64)
            byte = (mix(sig) >> U64(56)).astype(np.uint8)
            # bands are of the same bytes that are compared later, so the first shared band is the same in both places
            rows = byte.astype(U64).reshape(n, BANDS, ROWS)
            band = np.full((n, BANDS), U64(0)) + np.arange(1, BANDS + 1, dtype=U64)
            for k in range(ROWS):
                band = band << U64(8) | rows[:, :, k]
            band = mix(band)
            size = np.bincount((keys >> U64(52)).astype(np.int64), weights, minlength=n).astype(np.int64)
            at = (keys >> U64(52)).astype(np.int64) * BINS + (keys & U64(BINS - 1)).astype(np.int64)
            bins = np.bincount(at, weights, minlength=n * BINS).reshape(n, BINS)
            fits = bins.max(1) < 256  # else the bound is left out
            bins = np.minimum(bins, 255).astype(np.uint8)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, last - first), hashes.slice(first, last - first), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), pa.array(size), bands,
                 pa.array([r.tobytes() for r in byte], pa.binary()), pa.array([r.tobytes() if f else b"" for r, f in zip(bins, fits, strict=True)], pa.binary())], names)


def similarity(a, b) -> float:
    """Weighted Jaccard of two (keys, counts) multisets with ascending keys."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) and not len(kb):
        return 1.0
    at = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
    both = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    low = np.minimum(wa[both], wb[at[both]]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def _multiset(text: str):
    raw = np.frombuffer((text or "").lower().encode(), np.uint8)
    keys, weights, _, _ = shingles(raw, np.array([0, len(raw)]))
    return keys, weights


def _checked(batches, least: float):
    """Pairs (a, b) whose texts reach the similarity. A group's rows follow each other: first the text of a alone (b is
    null), then the texts that are compared with it, so its multiset is made once."""
    import pyarrow as pa

    quiet_worker()
    held = None
    for batch in batches:
        out_a, out_b = [], []
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b is None:
                held = _multiset(text.as_py())
            elif similarity(held, _multiset(text.as_py())) >= least - 1e-12:
                out_a.append(a)
                out_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _check(spark, pairs, texts, least: float):
    """The (a, b) rows whose texts reach the similarity; texts: (node, text) of one row per node."""
    from pyspark.sql import functions as F

    n = partitions_for(spark)
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b", F.lit(5)), F.lit(n)).alias("salt"))
    asked = salted.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    owners = salted.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a")
    rows = owners.select("a", "salt", F.lit(None).cast("long").alias("b"), "text").unionByName(asked)
    rows = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(partial(_checked, least=least), "a long, b long")


def components(spark, links, rounds: int = 60):
    """(node, root): the least node that each linked node reaches. links: (a, b).

    Large-star and small-star steps (Kiveris et al. 2014), written to the shared folder each round. A step groups a
    node's neighbours only by their least, so a star of any size is combined before the shuffle.
    """
    from pyspark.sql import functions as F

    def digest(edges):
        h = F.xxhash64("u", "v")  # of distinct rows; equal only for equal sets, but for chance (2**-64)
        return edges.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")).first()

    edges = materialize(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = digest(edges)
    for _ in range(rounds):
        # large star: every larger neighbour of a node meets the node's least neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
        # written, so that both sides of the join are plain shuffles, of which adaptive execution splits a hub's
        least = materialize(spark, least, "least")
        large = edges.select(F.col("v").alias("c"), F.col("u").alias("w")).join(least, "c").select(F.col("w").alias("u"), F.col("m").alias("v"))
        # small star: a node's smaller neighbours, and the node, meet their least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(spark, small, "edges")
        before, state = state, digest(new)
        discard(spark, edges, least)
        edges = new
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")), edges


def _across(batches, best: bool, least: float):
    """Pairs of different components within a bucket's pair of blocks, whose registers agree often enough.

    A pair comes from the first band that it shares and from no other. best: of each two components only the pair that
    agrees most.
    """
    import pyarrow as pa

    quiet_worker()
    for batch in batches:
        out: list[tuple[int, int]] = []
        for row in (r for k in range(0, batch.num_rows, 8) for r in batch.slice(k, 8).to_pylist()):
            left, right = row["left"], row["right"] or row["left"]
            x = np.frombuffer(b"".join(m["registers"] for m in left), np.uint8).reshape(len(left), -1)
            y = np.frombuffer(b"".join(m["registers"] for m in right), np.uint8).reshape(len(right), -1)
            ids_x, ids_y = [m["node"] for m in left], [m["node"] for m in right]
            root_x, root_y = [m["root"] for m in left], np.array([m["root"] for m in right])
            size = np.array([m["size"] for m in right], float)
            bins = [np.frombuffer(m["bins"], np.uint8) for m in right]
            top: dict[tuple[int, int], tuple[float, int, int]] = {}
            for i in range(len(left)):
                same = y == x[i]
                share = same.mean(1)
                # the smaller total over the larger bounds the similarity
                most = np.minimum(size, left[i]["size"]) / np.maximum(size, left[i]["size"])
                near = (share >= NEAR) & (root_y != root_x[i]) & (most >= least - 1e-9)
                if row["right"] is None:
                    near[: i + 1] = False
                near = np.flatnonzero(near)
                if len(near) and left[i]["bins"]:
                    mine = np.frombuffer(left[i]["bins"], np.uint8)
                    most = np.array([np.minimum(mine, bins[j]).sum() if len(bins[j]) else size[j] for j in near], float)
                    most = np.minimum(most, np.minimum(size[near], left[i]["size"]))
                    near = near[most >= (least - 1e-9) * (size[near] + left[i]["size"] - most)]
                first = same[near].reshape(len(near), BANDS, ROWS).all(2).argmax(1)
                for j in near[first == row["band"]].tolist():
                    pair = (min(ids_x[i], ids_y[j]), max(ids_x[i], ids_y[j]))
                    if not best:
                        out.append(pair)
                        continue
                    roots = (min(root_x[i], int(root_y[j])), max(root_x[i], int(root_y[j])))
                    one = (-float(share[j]), *pair)
                    top[roots] = min(top.get(roots, one), one)
            out += [one[1:] for one in top.values()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])


def _candidates(spark, members, roots, registers, known, best: bool, least: float):
    """Unchecked pairs across components that share a bucket: (pairs, tables to discard).

    A bucket's members are cut into blocks of about BLOCK. A component of more than half a block there has blocks of its
    own; members of smaller ones share blocks. Blocks of one component never meet each other.
    """
    from pyspark.sql import functions as F

    rooted = members.join(roots, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root"))
    rooted = materialize(spark, rooted, "rooted")
    sizes = rooted.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    # -1 stands for all small components of a bucket; nodes are never negative
    own = F.when(F.col("c") > BLOCK // 2, F.col("root")).otherwise(F.lit(-1))
    sizes = materialize(spark, sizes.join(mixed, "bucket", "left_semi").withColumn("own", own), "sizes")
    parts = sizes.groupBy("bucket", "own").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("parts"))
    parts = materialize(spark, parts, "parts")
    placed = rooted.join(sizes.select("bucket", "root", "own"), ["bucket", "root"]).join(parts, ["bucket", "own"])
    placed = placed.select("bucket", "band", "node", "root", "own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    member = F.struct("node", "root", "size", "registers", "bins").alias("m")
    # a block holds about BLOCK members by hash: it is bounded, and only it is ever collected
    grouped = placed.join(registers, "node").groupBy("bucket", "band", "own", "part").agg(F.collect_list(member).alias("members"))
    grouped = materialize(spark, grouped, "blocks")
    nothing = F.lit(None).cast(grouped.schema["members"].dataType)
    alone = grouped.where("own = -1 and size(members) > 1").select("band", F.col("members").alias("left"), nothing.alias("right"))
    # which blocks meet: from the few rows of `parts`, so that nothing is made and thrown away
    mine = parts.select("bucket", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = parts.select("bucket", F.col("own").alias("other"), F.col("parts").alias("others"))
    meet = mine.join(other, "bucket").where("own < other or (own = other and own = -1 and part + 1 < others)")
    first = F.when(F.col("own") == F.col("other"), F.col("part") + 1).otherwise(0)
    meet = meet.select("bucket", "own", "part", "other", F.explode(F.sequence(first, F.col("others") - 1)).alias("other_part"))
    left = grouped.select("bucket", "band", "own", "part", F.col("members").alias("left"))
    right = grouped.select("bucket", F.col("own").alias("other"), F.col("part").alias("other_part"), F.col("members").alias("right"))
    cross = meet.join(left, ["bucket", "own", "part"]).join(right, ["bucket", "other", "other_part"]).select("band", "left", "right")
    found = alone.unionByName(cross).mapInArrow(partial(_across, best=best, least=least), "a long, b long").distinct()
    return found.join(known, ["a", "b"], "left_anti"), [rooted, sizes, parts, grouped]


def _classes(spark, docs, id_col: str, text_col: str, least: float):
    """(doc_id, h, node, root, class_id, copy_of), one row per row of docs with an id; h: a hash of the text. Different
    classes have different roots, also where one id on different texts is the least of both."""
    bound_batches(spark)
    from pyspark.sql import functions as F

    text = F.col(text_col).cast("string")
    three = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).where("doc_id is not null")
    signed = materialize(spark, three.mapInArrow(_signed, _SIG), "signatures")
    copies = signed.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "h")).alias("rep"))
    copies = materialize(spark, copies.select(F.monotonically_increasing_id().alias("node"), "fp1", "fp2", "rep.*"), "copies")
    reps = signed.where("size > 0").join(copies, ["doc_id", "h", "fp1", "fp2"])
    rows = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("bucket", "hub")
    members = materialize(spark, rows.join(buckets, "bucket").select("bucket", "band", "hub", "node").dropDuplicates(["bucket", "node"]), "members")
    # one text, and one signature, per node in any bucket
    some = materialize(spark, copies.join(members.select("node").distinct(), "node", "left_semi"), "some")
    wanted = broadcast_if_small(some.select("doc_id", "h", "node"))
    texts = three.join(wanted, ["doc_id", "h"]).select("node", "text").dropDuplicates(["node"])
    texts = materialize(spark, texts, "texts")
    registers = reps.join(some.select("node"), "node", "left_semi").select("node", "size", "registers", "bins").dropDuplicates(["node"])

    asked = materialize(spark, members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "asked")
    links = materialize(spark, _check(spark, asked, texts, least), "links")
    final, edges = components(spark, links)
    spent = [signed, copies, members, some, texts, asked, links, edges]
    # first the likeliest pair of each two components, which joins most of them; then every pair that is left
    for best in (True, False):
        pairs, tables = _candidates(spark, members, final, registers, asked, best, least)
        pairs = materialize(spark, pairs, "pairs")
        more = materialize(spark, _check(spark, pairs, texts, least), "links")
        spent += [*tables, pairs, more]
        asked = asked.unionByName(pairs)
        if not more.isEmpty():
            # what is known is a star by component: the new links join stars
            final, edges = components(spark, final.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
            spent.append(edges)

    nodes = copies.select("node", F.col("doc_id").alias("copy_of")).join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = nodes.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    by_node = nodes.join(least_id, "root").select("node", "root", "class_id", "copy_of").join(copies.select("node", "fp1", "fp2"), "node")
    out = signed.select("doc_id", "h", "fp1", "fp2").join(by_node, ["fp1", "fp2"]).select("doc_id", "h", "node", "root", "class_id", "copy_of")
    out = materialize(spark, out, "classes")
    discard(spark, *spent)
    return out


def near_duplicates(spark, docs, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY):
    """One row per document: class_id (the least doc_id of its class) and copy_of (the least doc_id with its very words)."""
    out = _classes(spark, docs, id_col, text_col, least)
    return attach(out.select("doc_id", "class_id", "copy_of"), out)


def keep_one(spark, docs, least: float = SIMILARITY):
    """docs with one document of each class: the one with the least doc_id. All columns are kept, and rows without an id."""
    from pyspark.sql import functions as F

    classes = _classes(spark, docs, "doc_id", "text", least)
    # rows of one id and text are one document; of several texts of a class's least id the first node stays
    one = classes.groupBy("doc_id", "h").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("node", "root", "class_id")])
    one = materialize(spark, one, "ids")
    heads = one.where("doc_id = class_id")
    firsts = heads.groupBy("root").agg(F.min("node").alias("stays"))
    later = heads.join(firsts, "root").where("node <> stays")
    mark = "__arterial_text_hash"
    drop = one.where("doc_id <> class_id").select("doc_id", F.col("h").alias(mark)).unionByName(later.select("doc_id", F.col("h").alias(mark)))
    kept = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).join(drop, ["doc_id", mark], "left_anti")
    twice = one.where("n > 1 and doc_id = class_id").select("doc_id", F.col("h").alias(mark))
    discard(spark, classes)
    if not twice.isEmpty():
        # rows of one id and text become one
        once = kept.join(twice, ["doc_id", mark], "left_anti")
        kept = once.unionByName(kept.join(twice, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]))
    return attach(kept.select(*docs.columns), one)
