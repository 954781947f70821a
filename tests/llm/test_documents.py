"""Operators on documents, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.llm import bpe, langid, ngram_join, packing, suffix_dedup, token_files, tokenizing
from basalt.llm._common import written
from basalt.llm.queries import tokenizer
from basalt.llm.tokenizing import ChunkEncoder, encoder, load

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets_of(text):
    found = WORD.findall((text or "").encode().lower())
    k = min(5, len(found))
    return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1)) if found else frozenset()


def brute_components(texts, union):
    sets = [sets_of(t) for _, t in texts]
    for i, a in enumerate(sets):
        union.find(i)
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                union.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            least[union.find(i)] = min(least.get(union.find(i), doc), doc)
    return [(doc, len(s), least.get(union.find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(texts, sets, strict=True))]


def test_ngram_join(documents, texts, union):
    found = [tuple(r) for r in ngram_join.link_documents(documents).collect()]
    assert Counter(found) == Counter(brute_components(texts, union))
    assert len({c for _, n, c in found if n}) < len([n for _, n, _ in found if n])


def test_ngram_join_of_other_widths(documents, texts, union):
    found = Counter(tuple(r)[:2] for r in ngram_join.link_documents(documents, width=1, percent=90).collect())
    assert found == Counter((d, len(set(WORD.findall((t or "").encode().lower())))) for d, t in texts)


def test_keep_one(documents, texts, union):
    kept = ngram_join.keep_one(documents)
    assert kept.columns == documents.columns
    brute_components(texts, union)
    groups = defaultdict(list)
    alone = []
    for i, (doc, text) in enumerate(texts):
        (groups[union.find(i)] if sets_of(text) else alone).append((doc, text))
    want = alone + [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=2, max_size=8))
def test_prefix_orders_lose_no_link(sets):
    arrays = [np.unique(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    count = Counter(int(t) for a in arrays for t in a)
    given_ = []
    for a in arrays:
        shared = np.array([t for t in a if count[int(t)] > 1], np.uint64)
        common = np.array([min(count[int(t)], ngram_join.CAP) for t in shared], np.uint8)
        given_.append(ngram_join.Node(shared.tobytes(), common.tobytes(), len(a), ngram_join.cuts(a, 75).tobytes()))
    i, j, _ = ngram_join.linked(given_, np.arange(len(sets)), np.full(len(sets), -1), 75)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    sides = np.arange(len(sets)) % 2
    i, j, _ = ngram_join.linked(given_, np.arange(len(sets)), sides, 75)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in want if sides[a] != sides[b]}


@pytest.mark.parametrize("size", [3, 16])
def test_ngram_join_of_large_pieces(documents, texts, union, monkeypatch, size):
    monkeypatch.setattr(ngram_join, "SLICE", size)
    assert Counter(tuple(r) for r in ngram_join.link_documents(documents).collect()) == Counter(brute_components(texts, union))


def pages_of_one_template(n, r, words):
    """Four fifths of each page are the template's, so that no two are linked; every tenth is a near copy of the one before."""
    template = [r.choice(words) for _ in range(160)]
    rows = []
    for k in range(n):
        own = rows[-1][1].split()[160:] if k % 10 == 9 else [f"{r.choice(words)}{r.randrange(10**6)}" for _ in range(36)]
        rows.append((k, " ".join(template + own[:35] + [f"x{k}"])))
    return rows


def test_pages_of_one_template(spark, words, union):
    rows = pages_of_one_template(400, random.Random(3), words)
    work = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in ngram_join.link_documents(df, work=work).collect()) == Counter(brute_components(rows, union))


def test_verified_pairs_of_a_template_grow_with_the_pages(spark, words):
    counts = []
    for n in (2000, 4000):
        r = random.Random(5)
        template = [r.choice(words) for _ in range(160)]
        rows = [(k, " ".join(template + [f"{r.choice(words)}{r.randrange(10**9)}" for _ in range(40)])) for k in range(n)]
        work = spark.sparkContext.accumulator(0)
        found = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), work=work).collect()
        assert all(r.doc_id == r.component_id for r in found)
        counts.append(work.value)
    assert counts[1] <= 2.2 * counts[0] + 10


def test_verified_pairs_of_near_copies_grow_with_the_copies(spark, words, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE", 32)
    counts = []
    for n in (600, 1200):
        r = random.Random(6)
        base = [r.choice(words) for _ in range(200)]
        rows = []
        for k in range(n):
            own = list(base)
            for _ in range(2):
                own[r.randrange(200)] = f"z{r.randrange(10**9)}"
            rows.append((k, " ".join(own)))
        work = spark.sparkContext.accumulator(0)
        found = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), work=work).collect()
        assert {r.component_id for r in found} == {0}
        counts.append(work.value)
    assert counts[1] < 3 * counts[0] and counts[1] < 0.2 * 1200**2 / 2


def test_a_root_of_most_rows_is_split(spark):
    settings_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in settings_}
    try:
        for k, v in settings_.items():
            spark.conf.set(k, v)
        root = F.when(F.col("id") % 4 != 0, 7).otherwise(F.col("id"))
        named = written(spark.range(0, 200_000, 1, 8).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("sig"), root.cast("long").alias("root"), F.col("id").alias("least")), "named")
        found = ngram_join._with_component(named)
        assert len(found.collect()) == 200_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def brute_gone(texts, length=50):
    """Each document's bytes, and which of them go."""
    first: dict[bytes, int] = {}
    raw = [(d, (t or "").encode()) for d, t in texts]
    for d, b in raw:
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                first[w] = min(first.get(w, d), d)
    for d, b in raw:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        yield d, b, gone


def brute_kept(texts, length=50):
    return [(d, bytes(x for x, g in zip(b, gone, strict=True) if not g)) for d, b, gone in brute_gone(texts, length)]


def brute_cuts(texts, length=50):
    out = []
    for (d, b, gone), (_, kept) in zip(brute_gone(texts, length), brute_kept(texts, length), strict=True):
        out.append((d, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [50, 24])
def test_suffix_dedup(documents, texts, length):
    found = Counter(tuple(r) for r in suffix_dedup.remove_repeats(documents, length).collect())
    assert found == Counter(brute_cuts(texts, length))


def test_suffix_dedup_in_small_chunks(documents, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 1000)
    data = np.frombuffer("".join(t or "" for _, t in texts[:40]).encode(), np.uint8)
    whole = suffix_dedup.anchors(data, np.array([len(data)]), 50)
    monkeypatch.undo()
    other = suffix_dedup.anchors(data, np.array([len(data)]), 50)
    runs = lambda x: sorted((int(t), w) for t, a, b in zip(*x, strict=True) for w in range(a, b + 1))
    assert runs(whole) == runs(other) and len(runs(whole)) == len(data) - 49


def test_suffix_dedup_keeps_rows(documents, texts):
    rows = suffix_dedup.remove_repeats(documents, 50, keep_text=True, keep=documents.columns).collect()
    assert Counter((r.doc_id, r.row.source, r.row.component_id) for r in rows) == Counter((i, f"s{k % 2}", "x") for k, (i, _) in enumerate(texts))
    assert all(r.kept_text == r.row.text for r in rows if not r.n_removed)


def test_too_short_runs_are_refused(documents):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(documents, 8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=16, max_size=60), min_size=1, max_size=6).map(lambda x: [bytes(c % 3 for c in b) for b in x]))
def test_longest_previous_factors(docs):
    data = np.frombuffer(b"".join(docs), np.uint8)
    owner, starts, at = [], [], 0
    for k, d in enumerate(docs):
        for i in range(len(d) - 15):
            owner.append(k)
            starts.append(at + i)
        at += len(d)
    found = suffix_dedup.longest_previous(data, np.array(starts), np.array(owner), 16)
    raw = data.tobytes()
    common = lambda s, t: next((k for k in range(16) if raw[s + k] != raw[t + k]), 16)
    want = [max((common(s, t) for t, o in zip(starts, owner, strict=True) if o < k), default=0) for s, k in zip(starts, owner, strict=True)]
    assert found.tolist() == want


def test_longest_previous_factors_lie_on_either_side():
    docs = [b"aaaabbbbccccdddd", b"aaaabbbbccccddde", b"aaaabbbbccccdddc", b"aaaabbbb\0\0\0\0\0\0\0\0"]
    found = suffix_dedup.longest_previous(np.frombuffer(b"".join(docs), np.uint8), np.arange(4) * 16, np.array([2, 0, 1, 3]), 16)
    assert found.tolist() == [15, 0, 15, 8]  # the first has its match after it, the third too, the last after it


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=40))
def test_nearest_smaller(pairs):
    value, common = (np.array(x) for x in zip(*pairs, strict=True))
    want = []
    for i in range(len(value)):
        j = max((j for j in range(i) if value[j] < value[i]), default=None)
        want.append(0 if j is None else common[j + 1 : i + 1].min())
    assert suffix_dedup.nearest_smaller(value, common).tolist() == want


def test_equal_hashes_of_different_bytes_remove_nothing(documents, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "range_hashes", lambda data, sizes: np.zeros(len(sizes), np.uint64))
    r = random.Random(2)
    segments = [bytes(r.choice(b"ab") for _ in range(52)) for _ in range(30)]
    segments += segments[:10]
    data, size, doc = np.frombuffer(b"".join(segments), np.uint8), np.array([52] * 40), np.arange(40)
    gone = sorted((int(s), int(o), int(w)) for some in suffix_dedup.match_segments(np.zeros(40, np.uint64), doc, size, data, 50) for s, o, w in zip(*some, strict=True))
    covered = defaultdict(set)
    for s, o, w in gone:
        covered[s] |= set(range(o, o + w))
    want = defaultdict(set)
    for k, x in enumerate(segments):
        for o in range(3):
            if any(x[o : o + 50] == y[p : p + 50] for y in segments[:k] for p in range(3)):
                want[k] |= set(range(o, o + 50))
    assert covered == want


@lru_cache(1)
def tiktoken_of(name):
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(documents, texts):
    library = tiktoken_of("byte_bpe_50k.tiktoken")
    rows = bpe.encode_documents(documents, tokenizer("byte_bpe_50k.tiktoken"), keep_ids=True).collect()
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    want = Counter()
    for doc, text in texts:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        want[doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert found == want


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab é'stlr1 \n\t .,#日😀"), max_size=40))
def test_bpe_of_any_text(text):
    library = tiktoken_of("byte_bpe_50k.tiktoken")
    own = bpe.text_encoder(tokenizer("byte_bpe_50k.tiktoken"), bpe.SPACED)
    ids, _ = own.encode([text])
    assert ids.tolist() == library.encode_ordinary(text) and own.decode(ids) == text.encode()


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "etaoinshr", "aé日b", "the"])
def test_long_pieces(letters):
    r = random.Random(letters)
    for text in ("abracadabra" * 400, *("".join(r.choice(letters) for _ in range(n)) for n in (2049, 5000, 20_000))):
        ids, _ = bpe.text_encoder(tokenizer("byte_bpe_50k.tiktoken"), bpe.SPACED).encode([text])
        assert ids.tolist() == tiktoken_of("byte_bpe_50k.tiktoken").encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aabeinrst"), min_size=2, max_size=30))
def test_merges_of_a_row_and_of_a_matrix_agree(text):
    own = bpe.load_ranks(tokenizer("byte_bpe_50k.tiktoken"))
    assert own._row(text.encode()) == own._matrix([text.encode()], len(text))[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab É'stlr1 \n\t .,#|<日İß"), max_size=30), min_size=1, max_size=4))
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_whole_texts(name, given_):
    own = encoder(tokenizer(name))
    ids, begins = own.encode(given_)
    want = [e.ids for e in own.tokenizer.encode_batch(given_, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_is_encoded_once(name, monkeypatch):
    own, asked = ChunkEncoder(tokenizer(name)), []
    text = "so qzxv qzxv, qzxv qzxv. qzxv; qzxv,\nso vqzé! vqzé vqzé?! qzxv"
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    tokenize = own.tokenize
    monkeypatch.setattr(own, "tokenize", lambda seen: asked.append(seen) or tokenize(seen))
    assert own.encode([text, text + " qzxv:"])[0].tolist() == want + own.tokenizer.encode(text + " qzxv:", add_special_tokens=False).ids
    assert max(Counter(asked).values()) == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_forgotten_and_met_again(name, monkeypatch):
    own = ChunkEncoder(tokenizer(name))
    monkeypatch.setattr(own, "most", 20)
    monkeypatch.setattr(tokenizing, "_SLICE", 7)
    r = random.Random(4)
    words = ["".join(r.choice("abcé") for _ in range(4)) + r.choice(["", "", ",", ".\n", "?!", "-é", "1", "'s", "日,"]) for _ in range(60)]
    given_ = [" ".join(r.choices(words, k=50)).replace("\n ", "\n").rstrip() for _ in range(30)]
    ids, begins = own.encode(given_)
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [e.ids for e in own.tokenizer.encode_batch(given_, add_special_tokens=False)]
    assert len(own.chunks) <= 20 + 14 and not own.chunks.old.old


def test_token_files(spark, documents, texts, tmp_path):
    path = f"file://{tmp_path}/tokens"
    manifest = token_files.write_tokens(documents, tokenizer("word_bpe_49k.json"), path, end_id=1, files=3)
    rows = token_files.read_tokens(spark, path, manifest, keep_ids=True).collect()
    library = load(tokenizer("word_bpe_49k.json"))
    want = Counter()
    for doc, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want[doc, len(ids) // 4, zlib.crc32(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    ids = [r.doc_id for r in ordered if r.doc_id is not None]
    assert ids == sorted(ids) and {r.doc_id for r in ordered[: len(rows) - len(ids)]} <= {None}
    first = sorted(manifest.collect())[0]
    assert token_files.read_document(path, first.file, 0).astype("<u4").tobytes() == ordered[0].ids_le32
    assert len({r.dictionary for r in manifest.collect()}) == 1


def test_token_files_of_extreme_ids(spark, tmp_path):
    ids = [-(1 << 63), (1 << 63) - 1, 0, -1, None, None, 7, 7, *range(100, 140)]
    df = spark.createDataFrame([(i, f"text {k} " * (k % 5)) for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/extreme"
    manifest = token_files.write_tokens(df, tokenizer("word_bpe_49k.json"), path, end_id=1, files=4)
    rows = sorted(token_files.read_tokens(spark, path, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, *sorted(i for i in ids if i is not None)]
    assert 1 < manifest.count() <= 4


def check_packing(rows, capacity):
    """Pieces of each document and places in each sequence have no gap; documents must have one row for each doc_id."""
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= capacity
        bins[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            pieces[r.doc_id].append((r.piece, r.start, r.length))
    for own in pieces.values():
        own.sort()
        if own[0][:2] == own[1 % len(own)][:2] and len(own) > 1:  # repeated rows
            continue
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == [0, *np.cumsum([n for _, _, n in own])[:-1].tolist()]
        assert all(n == capacity for _, _, n in own[1:])
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def best_fit_decreasing(lengths, capacity):
    room: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= x]
        left = min(fits) - x if fits else capacity - x
        if fits:
            room.remove(min(fits))
        room.append(left)
    return len(room)


def test_packing(documents, texts):
    rows = packing.pack_documents(documents, tokenizer("byte_bpe_50k.json")).collect()
    library = load(tokenizer("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for doc, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        head = len(ids) % 1024 or 1024
        bounds = [0, *range(head, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            want[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert -(-total // 1024) <= check_packing(rows, 1024) <= best_fit_decreasing([r.length for r in rows], 1024)


def bins_needed(counts, capacity):
    return sum(n for _, n in packing.plan_bins(counts, capacity))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 12), min_size=1, max_size=20))
def test_no_more_bins_than_best_fit_decreasing(counts):
    assert bins_needed(counts, 64) <= best_fit_decreasing(Counter(counts).elements(), 64)


def test_bins_of_many_histograms():
    r = random.Random(1)
    for draw, n in ((lambda: r.randint(1, 1024), 2000), (lambda: r.randint(300, 600), 3000), (lambda: int(r.gauss(400, 60)), 3000), (lambda: r.choice([200, 250, 300, 350, 400, 450, 500]), 1000), (lambda: min(1024, int(r.expovariate(1 / 300)) + 1), 3000)):
        counts = Counter(draw() for _ in range(n))
        assert bins_needed(counts, 1024) <= best_fit_decreasing(counts.elements(), 1024)
    counts = Counter({x: 10**9 + x for x in range(1, 1025)})  # the work follows the lengths, not the documents
    used = Counter()
    for chosen, times in packing.plan_bins(counts, 1024):
        for x, k in chosen.items():
            used[x] += k * times
    assert used == counts


def test_packing_of_the_given_documents(spark, data):
    rows = packing.pack_documents(spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet"), tokenizer("byte_bpe_50k.json")).collect()
    assert check_packing(rows, 1024) <= best_fit_decreasing([r.length for r in rows], 1024)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1, max_size=8))
def test_bins_use_up_all_lengths(counts):
    bins = packing.plan_bins(counts, 30)
    used = Counter()
    for chosen, times in bins:
        assert sum(x * n for x, n in chosen.items()) <= 30
        for x, n in chosen.items():
            used[x] += n * times
    assert used == Counter(counts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 3), max_size=6), st.integers(0, 40))
def test_fullest_is_the_fullest(counts, room):
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    chosen = packing.fullest(counts, room)
    assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
    assert all(n <= counts[x] for x, n in chosen.items())


def test_empty_tables(spark, nothing, tmp_path):
    assert ngram_join.link_documents(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert bpe.encode_documents(nothing, tokenizer("byte_bpe_50k.tiktoken")).count() == 0
    assert packing.pack_documents(nothing, tokenizer("byte_bpe_50k.json")).count() == 0
    assert langid.identify(nothing).count() == 0
    path = f"file://{tmp_path}/none"
    assert token_files.read_tokens(spark, path, token_files.write_tokens(nothing, tokenizer("word_bpe_49k.json"), path)).count() == 0


def test_languages_of_awkward_rows(documents, texts):
    rows = langid.identify(documents).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in texts)
    silent = {d for d, t in texts if not any(c.isalpha() for c in t or "")} - {None}
    assert all((r.lang_pred == "und") == (r.doc_id in silent) for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_languages_by_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01


def slow_prediction(model, text):
    """Language and score by the definition: one n-gram after another."""
    codes = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    total, n, shift = np.zeros(len(model.languages)), 0, 32 - (len(model.table) - 1).bit_length()
    for i in range(len(codes)):
        h = 0
        for k in range(1, 5):
            if i + k > len(codes) or not codes[i + k - 1]:
                break
            h = (h * 0x01000193 + codes[i + k - 1] + k) % 2**32
            mixed = h ^ h >> 15
            total += model.table[mixed * 0x9E3779B1 % 2**32 >> shift]
            n += 1
    if not n:
        return "und", 0.0
    z = (total / n + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return model.languages[int(z.argmax())], p.max() / p.sum()


def test_predictions_by_the_definition(spark, data, texts):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit_languages(docs)
    some = [(i, t) for i, t in enumerate([t for _, t in texts if len(t or "") < 5000] + [r.text for r in docs.limit(60).collect()])]
    found = langid.identify(spark.createDataFrame(some, "doc_id long, text string").withColumn("lang", F.lit("xx")), model).collect()
    for r in found:
        lang, score = slow_prediction(model, some[r.doc_id][1] or "")
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)


def test_only_text_and_labels_of_learned_rows_are_learned(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = docs.withColumn("source", F.lit("other")).withColumn("n_chars", F.lit(0)).withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("text", F.when(held, "zzz").otherwise(F.col("text")))
    one, other = langid.fit_languages(docs), langid.fit_languages(changed)
    assert one.languages == other.languages and "zz" not in one.languages
    assert (one.table == other.table).all() and (one.bias == other.bias).all() and one.threshold == other.threshold
    before = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    relabelled = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert before == {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(relabelled).collect()}


def test_the_sample_is_bounded_in_bytes(spark, data):
    docs = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    model = langid.fit_languages(docs, sample_bytes=1_500_000)
    rows = docs.where(langid.folds()).where("text is not null").collect()
    found, _, rejected = model.predict([r.text for r in rows])
    assert model.languages == langid.fit_languages(docs).languages
    assert np.mean([a == r.lang for a, r in zip(found, rows, strict=True)]) > 0.9


@pytest.mark.parametrize("languages", [["en", "fr", "de", "es"], ["en", "fr"], ["de"]])
def test_strange_texts_are_rejected_and_clean_ones_stay(spark, data, languages):
    docs = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet").where(F.col("lang").isin(languages))
    r = random.Random(4)
    letters = {"Cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "CJK": "".join(map(chr, range(0x4E00, 0x5200))), "random": "abcdefghijklmnopqrstuvwxyz", "consonants": "bcdfghjklmnpqrstvwxz"}
    strange = [" ".join("".join(r.choice(x) for _ in range(r.randint(3, 9))) for _ in range(n)) for x in letters.values() for n in (10, 30, 100) * 5]
    held = [x.text or "" for x in docs.where(langid.folds()).collect()]
    held, short = ([t for t in some if any(c.isalpha() for c in t)] for some in (held, [" ".join(t.split()[: r.randint(3, 8)]) for t in held]))
    rows = [(k, t) for k, t in enumerate(strange + held + short)]
    found = {x.doc_id: x.rejected for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")), langid.fit_languages(docs)).collect()}
    assert np.mean([found[k] for k in range(len(strange))]) > 0.97
    assert np.mean([found[k] for k in range(len(strange), len(rows))]) < 0.01


@pytest.mark.parametrize("bounds", [{}, {"per_language": 60, "most_languages": 8}])
def test_every_language_is_learned(spark, bounds):
    r = random.Random(6)
    syllables = [a + b for a in "bcdfghjklmnprstvz" for b in "aeiou"]
    words = {f"l{k:02}": ["".join(r.choice(own) for _ in range(3)) for _ in range(30)] for k in range(70) for own in [r.sample(syllables, 12)]}
    rows = [(k, " ".join(r.choice(words[x]) for _ in range(60)), x) for k, x in enumerate(sorted(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, **bounds)
    assert model.languages == sorted(words)
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    found, _, rejected = model.predict([t for _, t, _ in held])
    right = {x: np.mean([a == x for a, (_, _, b) in zip(found, held, strict=True) if b == x]) for x in words}
    assert min(right.values()) > 0.5 and np.mean(list(right.values())) > 0.95 and rejected.mean() < 0.01


def test_long_texts_are_read_whole():
    text = "été " * 400_000 + "zzz"
    total = langid.counts(text, 1 << 12)
    assert total.sum() == 400_000 * (3 + 2 + 1) + 6 - 0
    model = langid.Model(["a", "b"], np.random.default_rng(0).normal(size=(1 << 12, 2)), np.zeros(2), 1.0, 0.0)
    z, seen = model.logits([text, "ab", ""])
    assert np.allclose(z[0], total @ model.table / total.sum()) and seen.tolist() == [total.sum(), 3, 0]
