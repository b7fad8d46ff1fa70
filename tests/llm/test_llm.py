import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from arterial.llm import bagminhash as B, decontam as D, html_extract, packing, quality_clf as Q, quality_rules, repair, secrets, tokencount, toxicity as T
from arterial.llm.common import text_bytes, text_column, word_hashes, word_list
from arterial.llm.tokens import ChunkEncoder, OffsetEncoder, tokenizer_path

ODD = ["", "  a  b\n\n c's it's don't", "½ foo½ x²", "a\tb \r\n c", "é̀ x́y", " \n x <|endoftext|> y", "a  <|endoftext|>", " 's", "foo 's.", "a. b.c, d,", "ſecret K İstanbul ΣΑΣ ΟΔΟΣ.\nΣ", " x　y ​ z",
       "漢字 かな1２三", " \x1c a", "x  ", "foo.\n", "foo, \nbar", "naïve Café, ÉTÉ!!", "the&&& of%%% a***\nTHE!! x|y"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, sequence_id int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    e = ChunkEncoder(tokenizer_path(name))
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(ODD, add_special_tokens=False)]
    assert e.encode(ODD) == want
    assert e.encode(ODD) == want  # now from the cache


#: Other white space between words makes up for blanks in a row: as many gaps as spaces and line feeds.
OFFSET = ["a\tb\tc\n\n\nd", "a\tb\tc\n\n", "Oui\u00a0! Non\u00a0?\n\n\nfin", "x\ry  z", "a\u3000b\n\nc", "\tone two ", " one\ttwo", "a\x85b  c", "\u2028a  b"]


def test_other_white_space_does_not_pass_for_single_blanks():
    e = ChunkEncoder(tokenizer_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    texts = OFFSET + ["".join(rng.choice(["a", "Bc", "é", "1", ".", " ", " ", "\n", "\t", "\r", "\u00a0"], 14)) for _ in range(5000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want


def test_offsets_equal_library():
    e = OffsetEncoder(tokenizer_path("byte_bpe_50k.json"))
    for text, (a, b) in zip(ODD, e.spans(ODD), strict=True):
        assert [tuple(x) for x in e.tokenizer.encode(text, add_special_tokens=False).offsets] == list(zip(a.tolist(), b.tolist(), strict=True))


def test_word_hashes_follow_word_lists():
    texts = ["Ab cd  ab", "", " x\ty\n", "ÉTÉ été"]
    h, doc, counts = word_hashes(*text_bytes(text_column(pa.array(texts))))
    assert counts.tolist() == [3, 0, 2, 2] and h[0] == h[2] and h[5] == h[6] and len(set(h.tolist())) == 5
    assert word_list("Ab cd  ab") == ["ab", "cd", "ab"]


DOCS = [(1, "one two three " * 900), (2, None), (3, ""), (3, ""), (None, "x y z"), (5, "the end.\nof it")]


def test_packing_covers_every_id_once(spark):
    rows = packing.pack(table(spark, DOCS), most=512).collect()
    assert all(r.length & (r.length - 1) == 0 and r.length <= 512 and r.offset == 0 for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for key, text in ((1, DOCS[0][1]), (None, DOCS[4][1]), (5, DOCS[5][1])):
        whole = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == whole and {r.doc_tokens for r in pieces} == {len(whole) // 4}
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
    # equal lengths follow each other, with consecutive sequence ids
    for part in {r.sequence_id >> 40 for r in rows}:
        lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id) if r.sequence_id >> 40 == part]
        assert lengths == sorted(lengths)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert [r.length for r in rows if r.doc_id == 2] == [1] and len([r for r in rows if r.doc_id == 3]) == 2
    assert packing.pack(table(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table(spark, DOCS), most=1000)


def block_of(ids, base=49408):
    return repair.Block(repair.encode_block([1], np.array([len(ids)]), np.array(ids, "<u4"), base))


def test_repair_blocks_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 49408, rng.integers(1, 6)) for _ in range(50)]
    ids = np.concatenate([words[k] for k in rng.integers(0, 50, 4000)]).astype("<u4")
    b = repair.Block(repair.encode_block([7, None], np.array([len(ids) - 3, 3]), ids, 49408))
    assert (b.decode() == ids).all() and (b.decode_all() == ids).all() and b.n_symbols < len(ids) / 2 and b.doc_ids == [7, None]
    for start, n in ((0, 1), (17, 100), (len(ids) - 2, 50), (5, 0), *rng.integers(0, len(ids), (50, 2)).tolist()):
        assert (b.decode(start, n) == ids[start : start + n]).all()
    for few in ([], [5], [5, 5, 5, 5], [9] * 1001):
        assert block_of(few).decode().tolist() == block_of(few).decode_all().tolist() == few


def test_repair_goes_on_until_no_pair_occurs_twice():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 150))).astype(np.uint32)
        seq, rules, rounds = repair.repair(ids, 10)
        last = {}
        for k, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)):
            assert k - last.setdefault(pair, k) < 2, (ids, seq)
        assert sum(rounds) == len(rules)
    phrase = rng.integers(0, 40000, 1000)
    for times in (20, 64):
        b = block_of(np.tile(phrase, times))
        assert b.n_symbols < 5 and len(b.rules) < 1010 and (b.decode() == np.tile(phrase, times)).all()


def test_repair_sorts_only_places_of_new_pairs(monkeypatch):
    sizes, sort = [], repair._grouped
    monkeypatch.setattr(repair, "_grouped", lambda left, right, place: (sizes.append(len(place)), sort(left, right, place))[1])
    ids = (np.random.default_rng(7).zipf(1.3, 60_000) % 5000).astype(np.uint32)
    seq, rules, rounds = repair.repair(ids, 5000)
    # a replaced pair makes two new ones at most: its own place's and the one before
    replaced = len(ids) - len(seq)
    assert replaced > 0 and sum(sizes) <= len(ids) + 2 * replaced and sum(sizes[1:]) <= 2 * replaced
    assert (block_of(ids, 5000).decode_all() == ids).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_are_cut_once_and_forgotten_when_full(name, monkeypatch):
    import arterial.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 30)
    texts = [f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}, x{k} fin! Zu\u00df_ a_ b'." for k in range(90)] * 2
    e, o = ChunkEncoder(tokenizer_path(name)), OffsetEncoder(tokenizer_path(name))
    whole = [e.tokenizer.encode(t, add_special_tokens=False) for t in texts]
    cut, seen = e._cut, []
    monkeypatch.setattr(e, "_cut", lambda chunk: (seen.append(chunk), cut(chunk))[1])
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [w.ids for w in whole]
    assert seen.count("x80") + seen.count(" x80") == 1  # held for the batch, though the table is full
    assert [list(zip(*map(list, s), strict=True)) for s in o.spans(texts)] == [[tuple(x) for x in w.offsets] for w in whole]
    for x in (e, o):
        x.encode([])
        assert len(x.cache) + len(x.spaced) <= 30


def test_repair_keeps_large_vocabularies():
    rng = np.random.default_rng(2)
    for base in (65530, 80_000, 1 << 24, 1 << 30):
        ids = rng.integers(base - 40, base, 3000)
        assert (block_of(ids, base).decode_all() == ids).all() and (block_of(ids, 5).decode() == ids).all()
    with pytest.raises(ValueError):
        block_of([1, 2, 3], (1 << 32) - 2)


def test_repair_digests(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for end_id in (1, 70_000):
        rows = repair.round_trip(spark, table(spark, DOCS), shard_tokens=500, partitions=3, end_id=end_id).collect()
        at = 0
        order = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0))
        for (key, text), r in zip(order, sorted(rows, key=lambda r: r.start), strict=True):
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
    assert repair.round_trip(spark, table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_section_counts_add_up(spark, rule):
    docs = [(1, "aa bb\n\n\ncc  \n dd"), (2, None), (3, "one line")]
    rows = tokencount.count_tokens(table(spark, docs), rule=rule).collect()
    for key, text in docs:
        mine = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.section)
        assert sum(r.n_tokens for r in mine) == mine[0].doc_tokens
        assert mine[0].char_start == 0 and mine[-1].char_end == len(text or "")
    both = tokencount.count_tokens(table(spark, docs), fields=("text", "score"), rule=rule).where("doc_id = 3").collect()
    assert [r.name for r in sorted(both, key=lambda r: r.section)] == ["text", "score"]


def test_attribution_rules_by_hand():
    a, b, bounds = np.array([0, 2, 4]), np.array([2, 4, 9]), np.array([0, 3, 5, 10])
    assert tokencount.attribute(a, b, bounds, "first")[0].tolist() == [0, 0, 1]
    assert tokencount.attribute(a, b, bounds, "last")[0].tolist() == [0, 1, 2]
    assert tokencount.attribute(a, b, bounds, "most")[0].tolist() == [0, 0, 2]


def multiset(text):
    w = text.lower().split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def jaccard(a, b):
    x, y = multiset(a), multiset(b)
    low = sum((x & y).values())
    return low / max(1, sum(x.values()) + sum(y.values()) - low)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for t in range(40):
        w = [f"w{k}" for k in rng.integers(0, 3000, 200)]
        w = w[:60] * 3 + w[60:] if t % 2 else w
        v = list(w)
        for k in rng.integers(0, len(v), rng.integers(1, 14)):
            v[k] = f"z{k}"
        keys, counts, _, n = B.shingles(*text_bytes(text_column(pa.array([" ".join(w), " ".join(v)]))))
        s = B.signatures(keys, counts, n)
        assert np.isfinite(s).all()
        truth = jaccard(" ".join(w), " ".join(v))
        assert B.similarity(B._multiset(" ".join(w)), B._multiset(" ".join(v))) == pytest.approx(truth)
        errors.append((s[0] == s[1]).mean() - truth)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def near_docs(seed=0, n=40):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n):
        base = [f"g{g}w{k}" for k in rng.integers(0, 500, 80)]
        for _ in range(int(rng.integers(1, 6))):
            v = list(base)
            for k in rng.integers(0, 80, int(rng.integers(0, 4))):
                v[k] = f"x{rng.integers(1 << 30)}"
            out.append(" ".join(v))
            base = v if rng.random() < 0.3 else base  # chains, whose ends may be far apart
    return [(i, t) for i, t in enumerate(out)]


def test_near_duplicates_equal_brute_force(spark):
    docs = near_docs() + [(1000, None), (1001, ""), (1002, "short one"), (1003, "Short  one"), (1004, "other"), (5, near_docs()[5][1])]
    ids = {i: t or "" for i, t in docs}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(ids)
    for i in keys:
        for j in keys:
            if i < j and (jaccard(ids[i], ids[j]) >= 0.8 or ids[i].lower().split() == ids[j].lower().split()):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = B.near_duplicates(spark, table(spark, docs + [(None, "one")])).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: find(i) for i in ids}
    kept = B.keep_one(spark, table(spark, docs + [(None, "one")])).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({find(i) for i in ids}) and any(r.doc_id is None for r in kept)
    assert kept[0].asDict().keys() == {"doc_id", "text", "score", "sequence_id"}


def test_one_id_on_two_texts_loses_neither(spark):
    base = near_docs()
    docs = [(1, base[0][1]), (1, "a clean text of its own that nothing else is like"), (1, base[0][1]), (2, base[0][1] + " more"), (3, "a second clean text of its own, quite unlike")]
    rows = B.near_duplicates(spark, table(spark, docs)).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    kept = sorted((r.doc_id, r.text) for r in B.keep_one(spark, table(spark, docs)).collect())
    assert kept == sorted({docs[0], docs[1], docs[4]})


def test_components_of_a_bucket_meet_each_other_only(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 8)
    members = spark.createDataFrame([(7, 1, 0, k) for k in range(44)], "bucket long, band int, hub long, node long")
    roots = spark.createDataFrame([(k, 0) for k in range(30)] + [(k, 30) for k in range(30, 41)], "node long, root long")
    registers = spark.createDataFrame([(k, 9, bytes(B.REGISTERS), b"") for k in range(44)], "node long, size long, registers binary, bins binary")
    known = spark.createDataFrame([], "a long, b long")
    pairs, tables = B._candidates(spark, members, roots, registers, known, False, 0.8)
    root = lambda k: 0 if k < 30 else 30 if k < 41 else k
    # the members are equal, so their first shared band is 0: none comes from band 1
    assert pairs.count() == 0
    pairs, _ = B._candidates(spark, members.selectExpr("bucket", "0 as band", "hub", "node"), roots, registers, known, False, 0.8)
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in range(44) for b in range(a + 1, 44) if root(a) != root(b)}
    blocks = {(r.own, r.part): len(r.members) for r in tables[-1].collect()}
    assert sum(blocks.values()) == 44 and {own for own, _ in blocks} == {0, 30, -1}


def test_a_large_group_is_one_class_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for i in range(60):
        v = list(base)
        v[int(rng.integers(120))] = f"x{i}"
        docs.append((i, " ".join(v)))
    assert {r.class_id for r in B.near_duplicates(spark, table(spark, docs)).collect()} == {0}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 130)]
    got, _ = B.components(spark, spark.createDataFrame(links, "a long, b long"))
    m = {r.node: r.root for r in got.collect()}
    assert m == {i: 0 for i in range(1, 21)} | {k: 100 for k in range(101, 130)}
    assert B.components(spark, spark.createDataFrame([], "a long, b long"))[0].count() == 0


def words(rng, n):
    return [f"{a}{b}" for a, b in zip(rng.choice(list("bcdfghjklm"), n), rng.integers(0, 400, n), strict=True)]


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = np.random.default_rng(4)
    items = [(k, " ".join(words(rng, int(rng.integers(15, 50))))) for k in range(12)]
    docs, want = [], set()
    for i in range(150):
        w = words(rng, 150)
        if i % 10 == 0:
            k = int(rng.integers(12))
            part = items[k][1].split()
            if i % 20 == 0 and len(part) > 20:  # a paraphrase: some words changed or dropped, the answer kept
                for j in rng.integers(0, len(part) - 6, len(part) // 8):
                    part[j] = "zzz"
            w[60:60] = part
            want.add((i, k))
        docs.append((i, " ".join(w)))
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, "too few")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark, table(spark, [*docs, (500, None), (501, "")]), bench).collect()}
    assert got == want
    left = D.remove_leaks(spark, table(spark, docs), bench)
    assert left.count() == 150 - len({d for d, _ in want}) and "score" in left.columns
    assert D.find_leaks(spark, table(spark, docs), bench.limit(0)).count() == 0


def test_items_with_one_id_are_searched_in_every_block(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(words(rng, 30)) for _ in range(7)]
    items = [(k // 4, t) for k, t in enumerate(texts)]  # four and three texts of one id, in blocks of three
    docs = [(k, " ".join(words(rng, 60)) + " " + t) for k, t in enumerate(texts)] + [(50, " ".join(words(rng, 90)))]
    monkeypatch.setattr(D, "PASS_WORDS", 95)
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark, table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k // 4) for k in range(7)}


def test_an_item_held_by_a_third_of_all_rows_is_found_in_each(spark):
    rng = np.random.default_rng(12)
    items = [(k, " ".join(words(rng, 30))) for k in range(3)]
    docs, want = [], set()
    for i in range(240):
        w = words(rng, 100)
        if i % 3 == 0:
            at = int(rng.integers(0, 100))
            w[at:at] = items[0][1].split()
            want.add((i, 0))
        docs.append((i, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(spark, table(spark, docs), bench).collect()} == want
    few = table(spark, [d for d in docs if d[0] < 12])  # four copies in a small table
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(spark, few, bench).collect()} == {w for w in want if w[0] < 12}


def test_an_item_of_one_word_many_times_is_found(spark):
    rng = np.random.default_rng(13)
    for n in (256, 300):
        docs = [(k, " ".join(words(rng, 90))) for k in range(100)] + [(500, " ".join(words(rng, 40) + ["again"] * n + words(rng, 40)))]
        bench = spark.createDataFrame([(1, " ".join(["again"] * n)), (2, " ".join(words(rng, 30)))], "item_id long, text string")
        assert [(r.doc_id, r.item_id) for r in D.find_leaks(spark, table(spark, docs), bench).collect()] == [(500, 1)]


def test_short_items_match_word_for_word(spark):
    items = [(1, "Blue  whale song"), (2, "whale"), (3, ""), (4, None), (5, "to be or not")]
    docs = [(1, "a blue whale song, a blue whale song"), (2, "blue song whale"), (3, "to be, or not to be"), (4, "to be it or not"), (5, "blue"), (6, "whale song"), (7, None), (8, "")]
    rows = D.find_leaks(spark, table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word, r.end_word) for r in rows) == [(1, 1, 1, 4), (1, 2, 2, 3), (2, 2, 2, 3), (3, 5, 0, 4), (6, 2, 0, 1)]
    assert all(r.cosine is None and r.lcs == 1 and r.answer for r in rows)


def longest(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


def test_verify_equals_all_stretches_by_brute_force():
    rng = np.random.default_rng(5)
    passed = 0
    for _ in range(300):
        a, b = [str(x) for x in rng.integers(0, 9, 10)], [str(x) for x in rng.integers(0, 9, 50)]
        if rng.random() < 0.6:
            part = [w for w in a if rng.random() < 0.8] + a[-3:] * int(rng.random() < 0.3)
            k = int(rng.integers(0, 50))
            b[k:k] = part
        tail, best = a[-3:], None
        for lo in range(len(b)):
            stretch = b[lo : lo + 17]
            last = lo + max((k for k, w in enumerate(stretch) if w in a), default=0)
            answer = any(b[k : k + 3] == tail and lo - 3 <= k <= last + 1 for k in range(len(b) - 2))
            n = longest(a, stretch)
            if b[lo] in a and n >= (6 if answer else 8) and (best is None or n > best):
                best = n
        got = D.verify(a, b, 0.8, 0.6)
        assert (got and round(got[0] * 10)) == best
        passed += got is not None
        if got:
            assert longest(a, b[got[2] : got[3]]) == best
    assert 60 < passed < 290


def test_verify_finds_the_compact_match_beside_a_scattered_one():
    item = list("abcdefghij")
    words = list("abcde") + ["x"] * 30 + list("fghij") + ["x"] * 30 + list("abcdefghi")
    assert D.verify(item, words)[0] == 0.9


def test_secrets_equal_plain_patterns(spark):
    rng = np.random.default_rng(6)
    bits = ["password: ", "PASSWD=", "api_key = '", "secret", "token", ":", "=", " ", "AKIA", "ABCDEFGHIJKLMNOP", "abc123", "deadbeef" * 3, "x", "\n", "İ", "\"", "é", "apikey:abcdef"]
    texts = ["".join(rng.choice(bits, 30)) for _ in range(200)] + [None, "", "token=" * 50]
    s = secrets.Scanner()
    for t in texts:
        t = t or ""
        want = [(m.start(), m.end(), "assign") for m in secrets.RULES["assign"][1].finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(want) == sorted(x for x in s.spans(t) if x[2] in secrets.BASE)
    rows = secrets.scan(table(spark, list(enumerate(texts)))).collect()
    assert len(rows) == len(texts) and rows[-2].spans == ""


def test_checksummed_tokens_and_redaction(spark):
    body = "A" * 30
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        tail = secrets._DIGITS[d] + tail
    s = secrets.Scanner()
    good = f"x ghp_{body}{tail} y"
    assert [x[2] for x in s.spans(good)] == ["checked_token"] and s.spans(good.replace(tail, "000000")) == []
    rows = secrets.redact(spark.createDataFrame([(1, good, len(good)), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")).collect()
    assert rows[0].text == "x [checked_token] y" and rows[0].n_chars == len(rows[0].text) and rows[1].text is None and rows[2].text == "clean"


def labelled(spark, make, n=400):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(n):
        text, y = make(rng)
        rows.append((i, text))
        labels.append((i, y, y))
    return table(spark, [*rows, (n, None), (n + 1, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: y for i, y, _ in labels}


def test_quality_classifier_on_held_out_rows(spark):
    def make(rng):
        w = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(60)]
        y = int(rng.random() < 0.7)
        return " ".join(w) if y else " ".join(x.upper() + "!!" for x in w), y

    docs, labels, truth = labelled(spark, make)
    rows = Q.classify(spark, docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert Q.classify(spark, docs, labels.limit(0)).count() == 402


def test_toxicity_on_held_out_rows_and_obfuscation(spark):
    bad = ["grumblor", "snarfle", "blighter"]

    def make(rng):
        w = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(50)]
        y = int(rng.random() < 0.3)
        if y:
            for k in rng.integers(0, 50, 3):
                w[k] = str(rng.choice(bad))
        return " ".join(w), y

    docs, labels, truth = labelled(spark, make, 600)
    rows = T.classify(spark, docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    model = T.train(docs, labels)
    score = lambda t: model.score(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    assert score("abcde fedab snarf1e aaaaa bl.igh.ter") > 0.7 > score("abcde fedab aaaaa bbbbb cccc")
    kept = T.filter_toxic(spark, docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id >= 600").count() == 2
    assert T.classify(spark, docs, labels.limit(0)).count() == 602


def test_isotonic_is_monotone_and_calibrated():
    x, v = T.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 1]))
    assert (np.diff(v) >= 0).all() and np.interp(2.5, x, v) == 0.5 and v[-1] == 1


PAGE = """<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><ul><li><a href=/a>menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Head &amp; title</h1></header><p>First&nbsp;part <b>bold</b>
 text.<br>next</p><p>Second<!-- no --> part <a href=x>link</a> tail.<div class="ad">Buy</div><form><p>name</p></form><p>Third</article></main><aside>side</aside><section id="comments"><p>nice</p></section><footer>&copy; f</footer>"""


def test_html_article(spark):
    assert html_extract.main_text(PAGE) == "Head & title\nFirst part bold text. next\nSecond part link tail.\nThird"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<script>x") == html_extract.main_text("<p") == ""
    rows = html_extract.extract(spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 4)], "page_id long, url string, html string, n_chars int")).collect()
    assert rows[1].text == "" and rows[0].n_chars == len(rows[0].text)


BODY = "<p>A whole paragraph of the article that is long enough to be read, with some of the words that are in all of the texts.</p>"
BODY_TEXT = BODY[3:-4]


@pytest.mark.parametrize("page", [
    f'<article class="overflow-hidden">{BODY}</article>', f'<article><div class="overflow-hidden">{BODY}</div></article>', f'<div class="layout has-sidebar"><article>{BODY}</article></div>',
    f'<div class="post no-comments"><article>{BODY}</article></div>', f'<article><section id="alert-systems">{BODY}</section></article>', f'<main><article>{BODY.replace("<p>", "<p title=a-hidden-valley>")}</article></main>',
    f'<article>{BODY}<section class="comments"><p>I like it</p></section><div class="cookie-notice">We use them</div><div id="ad-300x250">Buy</div><p hidden>no</p><p style="display: none">no</p></article>',
    f'<article>{BODY}<ul><li><a href=1>one</a></li><li><a href=1>two</a></li><li><a href=1>three</a></li></ul></article><p>Outside of it</p>'])
def test_html_names_of_layout_drop_nothing_and_whole_names_do(page):
    assert html_extract.main_text(page) == BODY_TEXT


def test_html_keeps_captions_marks_and_linked_paragraphs_of_an_article():
    page = f"<article>{BODY}<p>&copy; law is its matter</p><figure><img><figcaption>A caption</figcaption></figure><p><a href=x>All of it a link</a></p><fieldset>kept</fieldset></article>"
    assert html_extract.main_text(page) == BODY_TEXT + "\n\xa9 law is its matter\nA caption\nAll of it a link\nkept"


def test_html_labelled_blocks_without_any_tag_that_helps():
    prose = "It was the best of the days and the people of the town were in the streets to see what there was to be seen by all of them. "
    rng = np.random.default_rng(11)
    right = wrong = missed = 0
    for _ in range(100):
        parts = [("<p><a href=a>Home</a> <a href=b>News</a></p>", 0), ("<p><a href=a>The way to all of the other pages of this site</a></p>", 0)]
        for _ in range(int(rng.integers(2, 7))):
            n = int(rng.integers(0, 4))
            parts.append(("<p>" + (prose * n if n else "A short line of it") + "</p>", 1))
        parts += [("<p>" + prose * 2 + "</p>", 1), ("<p>Terms <a href=x>Privacy</a></p>", 0), ("<p>XK-20 / 4711 / 0815 / 9999 -- 17.5 % 33 % 12 % 18 % 99 % 44 % 21 % 16 % 71 %</p>", 0)]
        got = html_extract.main_text("<body>" + "".join(x for x, _ in parts)).split("\n")
        want = [" ".join(re.sub("<[^>]*>", "", x).split()) for x, good in parts if good]
        both = sum((collections.Counter(got) & collections.Counter(want)).values())
        right, wrong, missed = right + both, wrong + len(got) - both, missed + len(want) - both
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_html_edge_rows(spark):
    rows = [(1, "u", BODY * 3000, "x"), (1, "u", BODY * 3000, "x"), (None, None, BODY, "y"), (2, None, "", None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    got.sort(key=lambda r: (r.page_id is None, r.page_id))
    got = [got[0], got[1], got[3], got[2]]
    assert len(got) == 4 and got[0].n_chars == 3000 * (len(BODY_TEXT) + 1) - 1 and got[0] == got[1] and got[2].text == BODY_TEXT and got[3].text == ""
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_without_article_uses_both_passes():
    good = "<p>" + "It was the best of the days and the people of the town were in the streets to see what there was to be seen by all of them. " * 3 + "</p>"
    links = "<p><a href=a>one of the links</a> <a href=b>and another of the links that go on</a></p>"
    page = f"<body>{links}<p>Orphan near links</p>{links}{good}<p>Short one</p>{good}</body>"
    text = html_extract.main_text(page)
    assert "Short one" in text and "Orphan" not in text and "another" not in text
    assert html_extract.inherit([True, None, False, None, None]) == [True, True, False, False, False]


def test_deep_and_unclosed_markup_is_linear():
    assert html_extract.main_text("<div>" * 20000 + "x" + "</div>" * 20000) == ""
    assert "end" in html_extract.main_text("<article>" + "<b><i>" * 5000 + "end")


def test_quality_rules_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "the", "c#", "D"], int(n))) + "\n \nx y\nx y" for n in rng.integers(0, 120, 60)] + [None, "", " \n\t", "a b c", "a b c a b c", "é\x0bù " * 60, "w" * 5000]
    rows = {r.doc_id: r for r in quality_rules.rules(table(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c, cover, seen, dup = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover)), t[:80]
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    plan = quality_rules.rules(table(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    item = " ".join(words(rng, 30))
    rows, labels = [], []
    for i in range(300):
        w = words(rng, 100)
        toxic = i % 6 == 0
        if toxic:
            w[10] = w[40] = "grumblor"
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    w = words(rng, 100)
    rows += [(400, rows[1][1], "en", "s", 0), (401, " ".join([*w[:50], item, *w[50:]]), "en", "s", 0), (402, " ".join([*words(rng, 60), "password = hunter2hunter2"]), "en", "s", 0)]
    names = {"documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": ([(1, item)], "item_id long, text string")}
    for name, (data, schema) in names.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {i for i in range(300) if i % 6} | {402} and left[402].endswith("[assign]")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left)


def test_the_pipelines_last_table_holds_the_ids(spark):
    import corpus_pipeline

    rows = corpus_pipeline.pack_documents(spark, table(spark, DOCS), None).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)


# ------------------------------------------------------------------------------- queries against brute force, odd tables


def test_leaks_equal_an_exhaustive_comparison(spark):
    """Every document against every item, over every stretch of half again the item's length."""
    rng = np.random.default_rng(21)
    items = [(k, " ".join(words(rng, int(rng.integers(14, 24))))) for k in range(5)]
    docs = []
    for i in range(60):
        w = words(rng, int(rng.integers(5, 90)))
        if i % 2:
            part = items[int(rng.integers(5))][1].split()
            for j in rng.integers(0, len(part) - (4 if i % 4 == 1 else 0), int(rng.integers(0, 9))):
                part[j] = "changed"
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = part
        docs.append((i, " ".join(w)))
    want = {}
    for i, text in docs:
        w = text.split()
        for k, item in items:
            a = item.split()
            most, tail = len(a) + len(a) // 2 + 2, a[-max(3, len(a) // 5) :]
            for lo in range(len(w)):
                if w[lo] not in a:
                    continue
                stretch = w[lo : lo + most]
                last = lo + max(j for j, x in enumerate(stretch) if x in a)
                answer = any(w[j : j + len(tail)] == tail and lo - len(tail) <= j <= last + 1 for j in range(len(w)))
                share = longest(a, stretch) / len(a)
                if share >= (0.6 if answer else 0.8) - 1e-9:
                    want[i, k] = max(want.get((i, k), 0), share)
    got = {(r.doc_id, r.item_id): r.lcs for r in D.find_leaks(spark, table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), exact=2.0).collect()}
    assert got == pytest.approx(want) and 10 < len(want) < 40
    near = {(r.doc_id, r.item_id) for r in D.find_leaks(spark, table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert near <= set(want) and len(near) >= 0.9 * len(want)


def test_odd_tables_of_documents_and_items(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(None, item), (1, None), (2, item + " and more"), (2, item + " and more"), (3, "x " * 200_000 + item), (4, "")]
    bench = spark.createDataFrame([(7, item, 1), (None, item, 2), (8, None, 3)], "item_id long, text string, doc_id int")
    rows = D.find_leaks(spark, table(spark, docs), bench).collect()
    assert collections.Counter((r.doc_id, r.item_id) for r in rows) == {(d, i): n for d, n in ((None, 1), (2, 2), (3, 1)) for i in (7, None)}
    assert {r.start_word for r in rows if r.doc_id == 3} == {200_000}
    left = D.remove_leaks(spark, table(spark, docs), bench)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "None"] and left.columns == ["doc_id", "text", "score", "sequence_id"]
    empty = table(spark, []).limit(0)
    assert D.find_leaks(spark, empty, bench).count() == 0 and D.remove_leaks(spark, empty, bench).count() == 0


def attributed(offsets, bounds, rule):
    """By section, the tokens that a plain loop gives it."""
    out = [0] * (len(bounds) - 1)
    for a, b in offsets:
        shares = [max(0, min(b, bounds[k + 1]) - max(a, bounds[k])) for k in range(len(out))]
        held = [k for k, s in enumerate(shares) if s] or [next((k for k in range(len(out)) if bounds[k] <= a < bounds[k + 1]), len(out) - 1)]
        out[held[0] if rule == "first" else held[-1] if rule == "last" else max(held, key=lambda k: (shares[k], -k))] += 1
    return out


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_section_counts_equal_the_library(spark, rule):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [*ODD, *OFFSET, "a\n\n\n  b\n", "word " * 3000 + "\n" + "line\n" * 50]
    rows = collections.defaultdict(list)
    for r in tokencount.count_tokens(table(spark, list(enumerate(texts))), rule=rule).collect():
        rows[r.doc_id].append(r)
    for i, text in enumerate(texts):
        mine = sorted(rows[i], key=lambda r: r.section)
        offsets = library.encode(text, add_special_tokens=False).offsets
        assert mine[0].doc_tokens == len(offsets)
        bounds = [r.char_start for r in mine] + [mine[-1].char_end]
        assert [r.n_tokens for r in mine] == attributed(offsets, bounds, rule), text[:50]
    assert tokencount.count_tokens(table(spark, []).limit(0), rule=rule).count() == 0
    nulls = tokencount.count_tokens(table(spark, [(None, "x"), (1, None), (1, None)]), rule=rule).collect()
    assert len(nulls) == 3 and sum(r.n_tokens for r in nulls) == 1


def clash(spark, docs, labels, name):
    """Labels that clash, repeated ids and rows, null ids and labels, in another order."""
    more = labels.unionByName(labels.limit(20).withColumn(name, F_lit(0))).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (9999, 1, 1)], labels.schema))
    twice = docs.unionByName(docs.limit(30)).unionByName(spark.createDataFrame([(None, "x", "s", 1), (3, "another text", "s", 1)], docs.schema))
    return twice, more


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def skewed_words(rng):
    """Prose of two kinds that share most of their words; each text also has words of its own."""
    y = int(rng.random() < 0.5)
    common, own = [f"w{k}" for k in range(60)], [f"{'good' if y else 'junk'}{k}" for k in range(40)]
    w = list(rng.choice(common, 60)) + list(rng.choice(own, 4)) + [f"x{rng.integers(1 << 30)}" for _ in range(20)]
    rng.shuffle(w)
    return " ".join(w), y


@pytest.mark.parametrize("operator", ["quality", "toxic"])
def test_classifiers_are_determined_by_their_tables(spark, operator):
    module = Q if operator == "quality" else T
    docs, labels, truth = labelled(spark, skewed_words, 500)
    docs, labels = clash(spark, docs, labels, operator)
    score = lambda d, la: sorted((r.doc_id is not None, r.doc_id or 0, r.score, r.held_out) for r in module.classify(spark, d, la).collect())
    one = score(docs, labels)
    assert one == score(docs.orderBy("text").repartition(5), labels.repartition(3).orderBy(operator))
    assert len(one) == docs.count() and all(not x[3] for x in one if not x[0]) and all(0 <= x[2] <= 1 for x in one)
    held = [(x[2], truth[x[1]]) for x in one if x[3] and x[1] in truth]
    up, down = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in up for b in down]) > 0.95
    assert module.classify(spark, docs.limit(0), labels).count() == 0
    few = module.classify(spark, docs, labels, fit_bytes=2000).collect()  # hardly any text fits: still a score for all
    assert len(few) == len(one)


def test_scores_are_sums_of_weights_by_text_alone():
    rng = np.random.default_rng(3)
    texts = [skewed_words(rng)[0] for _ in range(50)] + ["", "é", "one two " * 5000]
    buf, offsets = text_bytes(text_column(pa.array(texts), lower=False))
    doc, feature = Q.ngrams(buf, offsets)
    for k, text in enumerate(texts):
        alone = Q.ngrams(*text_bytes(text_column(pa.array([text]), lower=False)))[1]
        assert sorted(feature[doc == k].tolist()) == sorted(alone.tolist()) and len(set(alone.tolist())) == len(alone)


def test_toxicity_features_of_a_text_do_not_depend_on_its_neighbours():
    rng = np.random.default_rng(4)
    texts = ["You sn@rfle! GRUMBLOR you", "", "plain words only here", "sn4rfle " * 3000] + [skewed_words(rng)[0] for _ in range(20)]
    keys = T._hash_words(["snarfle", "grumblor"])
    lexicon, persons = (keys, np.array([2.0, 3.0])), T._hash_words(T.PERSONS)
    whole = T.features(*Q.joined([t.encode() for t in texts]), lexicon, persons)
    assert np.allclose(whole, np.concatenate([T.features(*Q.joined([t.encode()]), lexicon, persons) for t in texts]))
    hits = dict(zip(T.FEATURES, whole[0], strict=True))
    assert hits["hits"] == 2 and hits["distinct"] == 2 and hits["near_person"] == 2 and not whole[1].any() and whole[3][0] == 3000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library_on_random_strings(name):
    e = ChunkEncoder(tokenizer_path(name))
    rng = np.random.default_rng(17)
    bits = ["a", "The", "é", "ß", "ſ", "Σ", "漢", "1", "22", ".", ",", "!", "'s", "'", "-", "<", ">", "|", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2028", "\x1c", "\x0b", "\u200b", "\u0301", "😀", "İ", "K", "½"]
    for _ in range(6):
        texts = ["".join(rng.choice(bits, int(rng.integers(1, 16)))) for _ in range(5000)]
        want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert e.encode(texts) == want


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "x"), (1, "another text of one id that is clean", 2, "x"), (None, "no id here", 3, None), (None, None, 4, None), (2, None, 5, "y"), (3, "", 6, "y"), (4, long, 7, "z"), (5, long + " more", 8, "z")]
    schema = "doc_id long, text string, node long, root string"
    names = {"labels": ([], "doc_id long, quality int, toxic int"), "benchmark": ([], "item_id long, text string")}
    for name, (data, kind) in names.items():
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    for data, many in ((rows, 6), ([], 0)):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "packing":
                assert (out.count() == 0) == (not data)
            else:
                docs = out
                assert docs.columns == ["doc_id", "text", "node", "root"]
        left = docs.collect()
        assert len(left) == many and sorted(r.doc_id for r in left if r.doc_id) == ([1, 1, 2, 4] if data else [])


def test_no_shared_folder_is_an_error_on_a_cluster():
    from arterial.llm.common import scratch_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Spark:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError):
        scratch_dir(Spark())
    Spark.sparkContext.master = "local[2]"
    assert scratch_dir(Spark()).startswith("file:///")


def test_the_latent_space_is_fitted_on_the_whole_benchmark_and_no_sample(spark, monkeypatch):
    seen = {}

    def kept(spark, df, name, make=D.materialize):
        seen[name] = make(spark, df, name)
        return seen[name]

    monkeypatch.setattr(D, "materialize", kept)
    monkeypatch.setattr(D, "discard", lambda *a: None)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(10 + 30 * i))) for i in range(4)]
    docs = spark.createDataFrame([(i, f"before {text} after") for i, text in items] + [(i, f"other words {i} " * 20) for i in range(4, 60)], "doc_id long, text string")
    found = D.find_leaks(spark, docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(4)}
    assert [t.count() for t in seen.values()] == [sum(len(D.query_windows(10 + 30 * i)) for i in range(4))]


def test_weights_are_counted_over_every_passage():
    rng = np.random.default_rng(6)
    for _ in range(100):
        counts = rng.integers(0, 150, int(rng.integers(1, 6)))
        feature, doc = rng.integers(0, 40, counts.sum()), np.repeat(np.arange(len(counts)), counts)
        if len(feature):
            _, a, b = D.windows(counts)
            want = np.zeros(D.FEATURES, np.int64)
            for i, j in zip(a, b, strict=True):
                want[np.unique(feature[i:j])] += 1
            got, n = D.passage_counts(feature, doc, counts)
            assert n == len(a) and (got == want).all()


def test_counted_rows_hold_the_passages_between():
    # words 16 to 48 are a passage too: 80 words make four passages, not three
    text = " ".join(f"w{k}" for k in range(80))
    rows = [dict(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in D._counted(iter([pa.RecordBatch.from_arrays([pa.array([text, None, ""])], ["text"])]))]
    assert rows[0][-1] == 4 and sum(n for f, n in rows[0].items() if f >= 0) == 4 * 32
