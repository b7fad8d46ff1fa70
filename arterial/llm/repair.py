"""Token-id shards compressed by a Re-Pair grammar.

Documents are range-partitioned by id and encoded; each partition is cut into shards of about SHARD_TOKENS ids. In a shard
the most frequent pairs of adjacent symbols are replaced by new symbols (nonterminals), again and again, until no pair
occurs twice without overlap. A round takes all pairs with at least a quarter of the most frequent one's count, or of the
count that the round before asked for; where two of them overlap, the more frequent one is replaced, of equally frequent ones that of the greater hash (Re-Pair's order, in
batches). No pair is left out for being rare, and the number of rules is not bounded.

A shard's file block stores the documents' ids and lengths, the rules by round, every rule's expansion length, the final
sequence, and the place of every SAMPLE-th symbol in the decoded ids. decode(start, n) finds its first symbol by that
sample and descends only into the rules that hold wanted ids.

Block layout (little endian): magic 'RPR2'; u32 bits of a symbol, bits of a length, base (first nonterminal), rounds,
rules, symbols, docs; u64 tokens; then u32 rules by round, rule pairs, expansion lengths of the rules, symbols (these three
packed to their bits), u64 sampled places, i64 doc ids, u8 null flags, u32 doc lengths.

Edge cases: null or empty text is the end id alone; a null doc_id sorts first; rows with the same doc_id follow each
other in the order of their texts; an empty table gives no shard; a document longer than a shard makes a larger shard;
extra columns are ignored, whatever their names; vocabularies and end ids up to 2**32 - 2 symbols are kept whole, a larger
one is refused.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np

from arterial.llm.common import bound_batches, new_path, quiet_worker
from arterial.llm.tokens import ChunkEncoder, encoder, tokenizer_path

MAGIC = b"RPR2"
HEAD = "<7IQ"
SHARD_TOKENS = 1 << 20
#: Every so many symbols the block stores a place.
SAMPLE = 256
SHARD_SCHEMA = "part int, shard int, first_token long, n_docs long, n_tokens long, block binary"


def _grouped(left: np.ndarray, right: np.ndarray, place: np.ndarray):
    """(places by pair, in ascending order within each; first place of each group; places of it) of adjacent symbols."""
    wide, deep = max(int(left.max()), int(right.max())).bit_length(), max(1, int(place.max()).bit_length())
    if 2 * wide + deep <= 64:  # pair and place in one number: one sort gives both
        key = left.astype(np.uint64)
        key <<= np.uint64(wide)
        key |= right
        key <<= np.uint64(deep)
        key |= place.view(np.uint64)
        key.sort()
        at = (key & np.uint64((1 << deep) - 1)).view(np.int64)
        key >>= np.uint64(deep)
    else:
        key = left.astype(np.uint64) << np.uint64(32) | right
        order = np.lexsort((place, key))
        key, at = key[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return at, first, np.diff(first, append=len(at))


def repair(ids: np.ndarray, base: int):
    """(symbols, rules, rules by round): rule k stands for the pair of symbol base + k. Symbols are unsigned 32-bit.

    Symbols stay at their places and are linked. Places are held by pair, for pairs that occur twice; a round sorts only the
    places it gave another pair, and takes them out of where they were. That is all, as a pair that holds a new symbol is none
    of the earlier ones: those only lose places, and one that occurs once never comes to occur again.
    """
    n = len(ids)
    seq = np.append(ids, [0]).astype(np.uint32)
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # place n ends the sequence
    stale = np.zeros(n + 1, bool)  # places that a round gave another pair or none, while it lasts
    claim = np.zeros(n + 2, np.int32)  # rank of the pair at a place, while a round lasts; the last two are no places
    rules: list[np.ndarray] = []
    made, least = 0, 1 << 32
    spoilt = False  # whether the last round found pairs of which none could be replaced twice
    at, count, pairs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint32)  # places by pair, their number, its symbols
    new = np.arange(n - 1)
    while True:
        if len(new):
            found, first, size = _grouped(seq[new], seq[after[new]], new)
            many = size >= 2
            first = found[first[many]]
            at, count = np.concatenate((at, found[np.repeat(many, size)])), np.concatenate((count, size[many]))
            pairs = np.concatenate((pairs, np.stack((seq[first], seq[after[first]]), 1)))
        if not len(count):
            break
        top = int(count.max())
        least = 2 if spoilt else max(2, min(top, least) // 4)
        chosen = np.flatnonzero(count >= least)
        size, pair = count[chosen], pairs[chosen]
        place = at[np.repeat(count >= least, count)]
        group = np.repeat(np.arange(len(chosen)), size)
        # of x x x every second pair counts, from the left
        twin = np.flatnonzero(np.repeat(pair[:, 0] == pair[:, 1], size))
        if len(twin):
            p, g = place[twin], group[twin]
            fresh = np.concatenate(([True], (p[1:] != after[p[:-1]]) | (g[1:] != g[:-1])))
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))
            keep = np.ones(len(place), bool)
            keep[twin[(np.arange(len(p)) - begin) % 2 == 1]] = False
            place, group = place[keep], group[keep]
            size = np.bincount(group, minlength=len(chosen))
        # the more frequent pair goes first; by a hash, a run of equally frequent ones is cut in many places at once
        mixed = (pair[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ pair[:, 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
        rank = np.empty(len(chosen), np.int32)
        rank[np.lexsort((mixed, size))] = np.arange(1, len(chosen) + 1)
        rank[size < 2] = 0
        mine = rank[group]
        claim[place] = mine
        take = (mine > 0) & (mine >= claim[before[place]]) & (mine >= claim[after[place]])
        claim[place] = 0
        place, group = place[take], group[take]
        uses = np.bincount(group, minlength=len(chosen))
        good = uses[group] >= 2
        place, group = place[good], group[good]
        if not len(place):
            if spoilt:
                break
            spoilt, new = True, new[:0]
            continue
        spoilt = False
        used = np.flatnonzero(uses >= 2)
        number = np.zeros(len(chosen), np.uint32)
        number[used] = np.arange(base + made, base + made + len(used), dtype=np.uint32)
        rules.append(pair[used])
        made += len(used)
        seq[place] = number[group]
        gone = after[place]
        rest = after[gone]
        after[place], before[rest] = rest, place
        near = before[place]
        after[gone] = -2
        # of two replaced pairs that touch, the first is the place before the second
        stale[place] = True
        near = near[near >= 0]
        near = near[~stale[near]]
        stale[near] = stale[gone] = True
        kept = ~stale[at]
        stale[place] = stale[near] = stale[gone] = False
        new = np.concatenate((near, place[rest < n]))
        left = np.add.reduceat(kept, np.cumsum(count) - count, dtype=np.int64)
        many = left >= 2
        at, pairs = at[kept & np.repeat(many, count)], pairs[many]
        count = left[many]
    alive = after[:n] >= 0
    rounds = np.array([len(r) for r in rules], np.int64)
    return seq[:n][alive], np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), rounds


def expansion_lengths(rules: np.ndarray, base: int, rounds: np.ndarray) -> np.ndarray:
    """ids that each rule stands for; rules of a round use only symbols of earlier ones."""
    size = np.ones(base + len(rules), np.int64)
    at = 0
    for n in rounds.tolist():
        size[base + at : base + at + n] = size[rules[at : at + n]].sum(1)
        at += n
    return size[base:]


def _pack(values: np.ndarray, bits: int) -> bytes:
    """Numbers of `bits` bits each, on end."""
    out = [np.packbits((values[k : k + 65536, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8), bitorder="little") for k in range(0, len(values), 65536)]
    return b"".join(x.tobytes() for x in out)


def _unpack(data: np.ndarray, bits: int, first: int, last: int) -> np.ndarray:
    """Numbers first to last of a packed run."""
    parts = [np.zeros(0, np.uint32)]
    for k in range(first, last, 65536):
        n = min(65536, last - k)
        lo = k * bits
        raw = np.unpackbits(data[lo // 8 : -(-(lo + n * bits) // 8)], bitorder="little")[lo % 8 : lo % 8 + n * bits].reshape(n, bits)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = raw
        parts.append(np.packbits(wide, bitorder="little").view("<u4"))
    return np.concatenate(parts)


def encode_block(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    """The block of documents whose ids lie on end. base: above every id."""
    if len(ids):
        base = max(base, int(ids.max()) + 1)
    if base + len(ids) >= 1 << 32:
        raise ValueError("symbols of this vocabulary don't fit 32 bits")
    seq, rules, rounds = repair(ids, base)
    sizes = expansion_lengths(rules, base, rounds)
    bits, deep = max(1, (base + len(rules) - 1).bit_length()), max(1, int(sizes.max(initial=0)).bit_length())
    size = _sizes(seq, sizes, base)
    head = struct.pack(HEAD, bits, deep, base, len(rounds), len(rules), len(seq), len(doc_ids), len(ids))
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, head, rounds.astype("<u4").tobytes(), _pack(rules.ravel(), bits), _pack(sizes, deep), _pack(seq, bits),
                     (np.cumsum(size) - size)[::SAMPLE].astype("<u8").tobytes(), keys.tobytes(), null.tobytes(), lengths.astype("<u4").tobytes()])


def _sizes(symbols: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """ids that each symbol stands for."""
    out = np.ones(len(symbols), np.int64)
    rule = symbols >= base
    out[rule] = sizes[symbols[rule].astype(np.int64) - base]
    return out


class Block:
    """A shard's block, opened for reading."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a Re-Pair block")
        self.bits, deep, self.base, n_rounds, n_rules, self.n_symbols, n_docs, self.n_tokens = struct.unpack_from(HEAD, data, 4)
        at = 4 + struct.calcsize(HEAD)
        arrays = []
        packed = lambda n, bits: -(-n * bits // 8)
        for kind, n in (("<u4", n_rounds), ("u1", packed(2 * n_rules, self.bits)), ("u1", packed(n_rules, deep)), ("u1", packed(self.n_symbols, self.bits)),
                        ("<u8", -(-self.n_symbols // SAMPLE)), ("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.rounds, rules, sizes, self.packed, self.places, keys, null, self.lengths = arrays
        self.rules = _unpack(rules, self.bits, 0, 2 * n_rules).reshape(-1, 2)
        self.sizes = _unpack(sizes, deep, 0, n_rules)
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, null, strict=True)]

    def _expand(self, symbols: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """ids of the symbols; flat: ids of the rules so far, on end, from `begin` each."""
        size = _sizes(symbols, self.sizes, self.base)
        rule = size > 1
        out, ends, long = np.repeat(symbols, size), np.cumsum(size), size[rule]
        inner = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        out[inner + np.repeat((ends - size)[rule], long)] = flat[inner + np.repeat(begin[symbols[rule].astype(np.int64) - self.base], long)]
        return out

    def decode_all(self) -> np.ndarray:
        """All ids. Every rule is expanded once; those of a round take at most half the ids of the shard."""
        size = self.sizes.astype(np.int64)
        begin = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint32)
        at = done = 0
        for n in self.rounds.tolist():
            new = self._expand(self.rules[at : at + n].ravel(), flat, begin)
            flat[done : done + len(new)] = new
            at, done = at + n, done + len(new)
        return self._expand(_unpack(self.packed, self.bits, 0, self.n_symbols), flat, begin)

    def decode(self, start: int = 0, n: int | None = None) -> np.ndarray:
        """ids [start, start + n) of the shard. Only symbols that hold some of them are expanded, and only rules in use."""
        n = self.n_tokens - start if n is None else min(n, self.n_tokens - start)
        if n <= 0:
            return np.zeros(0, np.uint32)
        first = (int(np.searchsorted(self.places, start, "right")) - 1) * SAMPLE
        last = min(int(np.searchsorted(self.places, start + n, "left")) * SAMPLE, self.n_symbols)
        skip = start - int(self.places[first // SAMPLE])
        seq = _unpack(self.packed, self.bits, first, last)
        # a level at a time: what lies before or after the wanted ids goes, every rule left becomes its pair
        while True:
            size = _sizes(seq, self.sizes, self.base)
            ends = np.cumsum(size)
            a, b = int(np.searchsorted(ends, skip, "right")), int(np.searchsorted(ends, skip + n, "left")) + 1
            if a:
                skip -= int(ends[a - 1])
            seq, size = seq[a:b], size[a:b]
            rule = size > 1
            if not rule.any():
                return seq[skip : skip + n]
            place = np.cumsum(1 + rule) - 1 - rule
            wide = np.empty(len(seq) + int(rule.sum()), np.uint32)
            wide[place] = seq
            pair = self.rules[seq[rule].astype(np.int64) - self.base]
            wide[place[rule]], wide[place[rule] + 1] = pair[:, 0], pair[:, 1]
            seq = wide


def _shards(batches, tokenizer: str, end_id: int, shard_tokens: int):
    import pyarrow as pa
    from pyspark import TaskContext

    codec = encoder(ChunkEncoder, tokenizer)
    quiet_worker(1 << 25)  # a shard's arrays are of one size, round by round: their pages are used again
    base = codec.tokenizer.get_vocab_size(with_added_tokens=True)
    part, shard, before = TaskContext.get().partitionId(), 0, 0
    end = end_id.to_bytes(4, "little")
    keys: list = []
    parts: list[bytes] = []
    held = 0

    def flush():
        nonlocal keys, parts, held, shard, before
        lengths = np.array([len(p) // 4 for p in parts], np.int64)
        block = encode_block(keys, lengths, np.frombuffer(b"".join(parts), "<u4"), base)
        row = [[part], [shard], [before], [len(keys)], [held], [block]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        shard, before = shard + 1, before + held
        keys, parts, held = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                                          ["part", "shard", "first_token", "n_docs", "n_tokens", "block"])

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for first in range(0, len(ids), 256):
            coded = codec.encode([t or "" for t in texts[first : first + 256].to_pylist()])
            for key, one in zip(ids[first : first + 256], coded, strict=True):
                keys.append(key)
                parts.append(one + end)
                held += len(one) // 4 + 1
                if held >= shard_tokens:
                    yield flush()
    if keys:
        yield flush()


def write_shards(spark, docs, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 end_id: int = 1, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Encode docs in ascending id order and write the shards' blocks to path, one row per shard."""
    bound_batches(spark)
    from pyspark.sql import functions as F

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = two.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    run = partial(_shards, tokenizer=tokenizer or tokenizer_path("word_bpe_49k.json"), end_id=end_id, shard_tokens=shard_tokens)
    ordered.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def _documents(batches):
    import pyarrow as pa

    names = ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["block"])
            ids = block.decode_all().astype("<u4", copy=False).tobytes()
            ends = np.cumsum(block.lengths.astype(np.int64))
            starts = ends - block.lengths
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.doc_ids, pa.int64()), pa.array([row["part"]] * len(crc), pa.int32()), pa.array(starts + row["first_token"], pa.int64()),
                 pa.array(block.lengths.astype(np.int64)), pa.array(crc, pa.int64())], names)


def read_digests(spark, path: str):
    """Decode the shards at path: one row per document with its place, length and checksum.

    Token counts by partition (as many rows as partitions, never more) give each partition's first token.
    """
    from pyspark.sql import functions as F

    shards = spark.read.parquet(path)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, rows = 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    bases = F.broadcast(spark.createDataFrame(rows, "part int, base long"))
    found = shards.select("part", "first_token", "block").mapInArrow(_documents, "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long")
    return found.join(bases, "part").select("doc_id", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(spark, docs, **options):
    """Write docs as shards to the shared folder and read them back."""
    path = new_path(spark, "repair")
    write_shards(spark, docs, path, **options)
    return read_digests(spark, path)
