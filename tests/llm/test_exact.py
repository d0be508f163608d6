"""Operators with exact contracts against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from plumbline.llm import decontaminate, packing, repeats, simhash

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " \n ", "one", "two words", "x" * 50_000, "a " * 3000, "Été été ÉTÉ Kelvin K 1 2 3", "a b c d e", "a b c d e"]


def docs(spark, texts, first=0):
    rows = [(first + i, t, None if i % 3 else "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int").repartition(3)


def random_texts(seed, n=40, vocabulary=3, longest=60):
    r = random.Random(seed)
    out = [" ".join(r.choice("abcdefgh"[:vocabulary]) for _ in range(r.randrange(longest))) for _ in range(n)]
    return out + out[:5] + [out[0] + " " + out[1] + " " + out[2]] + EDGE


# --- repeats ---


def brute_repeats(rows, n):
    """rows: (id, text); ids distinct."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if k in seen:
                gone.update(range(s, s + n))
            seen.add(k)
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "n", "vocabulary"), [(1, 20, 2), (2, 5, 3), (3, 9, 2), (4, 20, 4)])
def test_repeats_random(spark, seed, n, vocabulary):
    texts = random_texts(seed, vocabulary=vocabulary)
    got = repeats.remove_repeats(docs(spark, texts), min_words=n).collect()
    want = brute_repeats(list(enumerate(texts)), n)
    assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == want
    assert all(s.end - s.start >= n for r in got for s in r.spans)


def test_repeats_with_colliding_hashes(spark, monkeypatch):
    """A first hash of 6 bits: the second one keeps windows apart."""
    real = repeats._mix
    monkeypatch.setattr(repeats, "_mix", lambda x, c: real(x, c) & np.uint64(63) if c == 0xD6E8FEB86659FD93 else real(x, c))
    texts = random_texts(8, vocabulary=4)
    got = repeats.remove_repeats(docs(spark, texts), min_words=9).collect()
    assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == brute_repeats(list(enumerate(texts)), 9)


def test_repeats_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.op4_seed_extend(spark, SF).collect()}
    assert got == brute_repeats(rows, 20)
    assert sum(v[1] for v in got.values()) > 0


def test_repeats_null_ids_and_repeated_rows(spark):
    t = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, len(r.kept.split())) for r in repeats.remove_repeats(df).collect())
    assert got == [(False, 0, 30), (True, 2, 0), (True, 4, 0), (True, 4, 0)]
    df = spark.createDataFrame([(4, t), (4, t)], "doc_id long, text string")
    assert [len(r.kept.split()) for r in repeats.remove_repeats(df).collect()] == [30, 30]
    assert repeats.remove_repeats(df.limit(0)).count() == 0


# --- decontamination ---


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(rows, items, n):
    keys = defaultdict(set)
    for i, t in items:
        w = brute_words(t)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            keys[tuple(w[s : s + n])].add(i)
    sizes = {len(k) for k in keys}
    out = {}
    for i, t in rows:
        w, hit, found = brute_words(t), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if (k := tuple(w[s : s + size])) in keys:
                    hit.update(range(s, s + size))
                    found |= keys[k]
        names = sorted(str(x) for x in found if x is not None)
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
    return out


def hits(df):
    return {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.hit_spans), len(r.hit_items), hashlib.sha256(",".join(r.hit_items).encode()).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 3, 1 << 20), (2, 10, 1 << 20), (3, 4, 40)])
def test_benchmark_random(spark, monkeypatch, seed, n, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts = random_texts(seed)
    r = random.Random(seed)
    items = [(i, " ".join(r.choice("abczé") for _ in range(r.randrange(14)))) for i in range(30)] + [(30, None), (None, "b c"), (31, "A b"), (7, "c c c")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = hits(decontaminate.find_benchmark(docs(spark, texts), df, window=n))
    assert got == brute_hits(list(enumerate(texts)), items, n)


def test_benchmark_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.op5_fm_index(spark, SF).collect()}
    assert got == brute_hits(rows, items, 10)
    assert sum(v[1] > 0 for v in got.values()) > 0


def test_removal_keeps_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, f"a {text} b", 5, "x", "y"), (1, f"a {text} b", 5, "x", "y"), (2, None, 6, "x", "y"), (3, "", 7, "x", "y"), (None, "clean   text\n", 8, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, hit_spans string, text_to_search string")
    out = decontaminate.remove_benchmark(df, spark.createDataFrame([(1, text), (None, None)], "item_id long, text string"))
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == [(1, "a  b", 5, "x", "y")] * 2 + [(2, None, 6, "x", "y"), (3, "", 7, "x", "y"), (None, "clean   text\n", 8, "x", "y")]
    assert decontaminate.remove_benchmark(df.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_removal_over_several_blocks(spark, monkeypatch):
    items = ["alpha beta gamma", "delta epsilon", "zeta"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["x alpha beta gamma y, delta epsilon: zeta!", "beta gamma", None, "zeta zeta a"]
    whole = sorted(map(tuple, decontaminate.remove_benchmark(docs(spark, texts), bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 12)
    assert sorted(map(tuple, decontaminate.remove_benchmark(docs(spark, texts), bench).collect())) == whole
    assert [r[1] for r in whole] == ["x  y, !", "beta gamma", None, " a"]  # spans that touch are one


def test_benchmark_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    df = docs(spark, ["a b", None])
    assert sorted((r.doc_id, r.n_words, r.hit_spans, r.hit_items) for r in decontaminate.find_benchmark(df, empty).collect()) == [(0, 2, [], []), (1, 0, [], [])]
    assert decontaminate.find_benchmark(df.limit(0), empty).count() == 0


def test_fm_index_locates_every_substring():
    rng = np.random.default_rng(5)
    s = np.append(rng.integers(0, 4, 400), 0).astype(np.int32)
    index = decontaminate.FMIndex(s, 4)
    for size in (1, 2, 5):
        seen = defaultdict(list)
        for i in range(len(s) - size + 1):
            if (k := tuple(s[i : i + size])) and 0 not in k:
                seen[k].append(i)
        keys = list(seen)
        lo, hi = index.search(np.array(keys, np.int32), np.full(len(keys), size))
        assert [sorted(index.locate(np.arange(a, b)).tolist()) for a, b in zip(lo, hi, strict=True)] == [seen[k] for k in keys]


# --- SimHash ---


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, d):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= d:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_simhash_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, SF).collect()}
    comps = brute_components(prints, 2)
    assert got == {i: (f"{prints[i]:016x}", comps[i]) for i in prints}


def test_simhash_edges(spark):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs(spark, EDGE)).collect()}
    for i, t in enumerate(EDGE):
        assert got[i][0] % (1 << 64) == brute_print(t)
    assert got[0][1] == got[1][1] == got[2][1] == 0 and got[9][1] == 8
    assert simhash.near_duplicates(docs(spark, EDGE).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 4, 1000])
def test_close_pairs_chains_and_clusters(spark, limit):
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(150)]
    for _ in range(150):
        prints.append(prints[r.randrange(len(prints))] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) * r.randrange(2))
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in prints})
    edges = simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, limit)
    got = simhash.connected_components(edges).collect()
    want = brute_components({x: x % (1 << 64) for x in signed}, 2)
    sizes = Counter(want.values())
    assert {r.node: r.component for r in got} == {x: c for x, c in want.items() if sizes[c] > 1}


def test_deduplicated_keeps_one_of_each(spark):
    df = spark.createDataFrame([(3, "a b c d", 1), (1, "A b c d", 2), (2, "q r s t", 3), (2, "q r s t", 3), (None, "a b c d", 4), (None, "only here x", 5)], "doc_id long, text string, __fpx int")
    assert sorted(r.doc_id or 0 for r in simhash.deduplicated(df).collect()) == [0, 1, 2]


# --- packing ---


def test_packing_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = EDGE + ["a  b\n\n c", " lead trail ", "x<|endoftext|>y", "don't 's  \t z", "　a  b\x1c c", "word " * 5000]
    rows = list(enumerate(texts)) + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack(df).collect()
    by = defaultdict(list)
    for p in packed:
        by[p.doc_id].append(p)
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by[i], key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own)))
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own]).tolist()[:-1]] and sum(p.length for p in own) == len(ids)
        assert len(own) == 1 if len(ids) <= 1024 else all(p.length == 1024 for p in own[1:])
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    places = defaultdict(list)
    for p in packed:
        places[p.sequence_id].append((p.offset, p.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(p.length for p in packed) // 1024) * 1.02 + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_ids_of_a_whole_table_are_the_tokenizers():
    """Every text of a table, by both libraries and with a memo that is cleared all the time."""
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    tok = Tokenizer.from_file(path)
    want = [np.array(x.ids, "<u4").tobytes() for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    encoder = packing.Encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert encoder.encode(texts) == want
    bytes_, packing.MEMO_BYTES = packing.MEMO_BYTES, 1000
    try:
        encoder = packing.Encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
        assert [x for i in range(0, 200, 20) for x in encoder.encode(texts[i : i + 20])] == want[:200]
        assert encoder.size < 1 << 22
    finally:
        packing.MEMO_BYTES = bytes_


def test_packing_repeated_ids_and_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    monkeypatch.setattr(packing, "LEAST_SALTS", 2)
    rows = [(i % 5 or None, f"text {i % 7}" * (i % 11), "x", 1) for i in range(300)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string, before int").repartition(5)).collect()
    assert len(packed) == 300
    places = defaultdict(list)
    for p in packed:
        places[p.sequence_id].append((p.offset, p.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)]).tolist()[:-1]] and sum(n for _, n in own) <= 1024


def test_packed_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "some words", "word " * 3000, "Été"]
    packed = packing.pack(docs(spark, texts), with_ids=True).collect()
    by = defaultdict(list)
    for p in sorted(packed, key=lambda p: p.piece):
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        by[p.doc_id] += p.ids
    assert [by[i] for i in range(len(texts))] == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_packing_query_columns(spark):
    got = packing.op6_pattern_packing(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_plan_holds_exactly_the_counts():
    rng = np.random.default_rng(0)
    for top in (3, 300, 1024):
        counts = np.zeros(1025, np.int64)
        counts[rng.integers(1, top + 1, 400)] += rng.integers(1, 500, 400)
        plan = packing.plan_sequences(counts)
        held = np.zeros(1025, np.int64)
        for p, n in plan:
            assert sum(p) <= 1024 and n > 0
            for length in p:
                held[length] += n
        assert (held == counts).all()


def test_plan_comes_near_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 1025, 200_000), minlength=1025)
    used = sum(n for _, n in packing.plan_sequences(counts))
    assert used <= 1.005 * (counts * np.arange(1025)).sum() / 1024




def test_word_hashes_tell_words_apart():
    r = random.Random(5)
    words = [bytes(r.randrange(33, 256) for _ in range(n)) for n in (1, 2, 5, 63, 64, 65, 66, 200, 5000) for _ in range(40)] + [b"ab", b"ba", b"a", b"a\x00", b"\x00a"]
    words = list(dict.fromkeys(w for w in words if len(w.split()) == 1 and w.split()[0] == w))
    one = {w: int(repeats.word_hashes(w)[0]) for w in words}
    assert len(set(one.values())) == len(words)
    many = [r.choice(words) for _ in range(200_000 // 50)] * 20
    data = b"".join(w + r.choice([b" ", b"\n\t ", b"\x0b"]) for w in many)
    assert repeats.word_hashes(b"  " + data).tolist() == [one[w] for w in many] and data.split() == many
    assert len(repeats.word_hashes(b"")) == len(repeats.word_hashes(b" \n")) == 0
