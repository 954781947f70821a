"""Vectors, conversations, archives and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import chat, langid, metric_join, queries, top_k, warc
from basalt.llm._common import written
from tests.compare import rows_from, rows_of

from .test_documents import best_fit_decreasing, brute_components, brute_cuts, brute_kept, check_packing


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_its_sql(spark, data, host, name):
    assert rows_of(queries.QUERIES[name](spark, data)) == rows_from(host, queries.ORACLES[name])


@pytest.fixture(scope="module")
def embedded(spark):
    r = np.random.default_rng(3)
    rows = []
    centre = r.normal(size=8)
    for k in range(160):
        v = (centre + r.normal(scale=0.12, size=8) if k % 3 == 0 else r.normal(size=8)).astype(np.float32).tolist()
        rows.append((k, v, 1, "x"))
    rows += [(160, None, 1, "x"), (161, [None] + [1.0] * 7, 1, "x"), (162, [float("nan")] * 8, 1, "x"), (163, [float("inf")] * 8, 1, "x"), (164, [0.0] * 8, 1, "x"), (165, [], 1, "x"), (None, rows[0][1], 1, "x")]
    rows += [(20, rows[20][1], 1, "x"), (180, rows[20][1], 1, "x"), (181, [1.0, 2.0], 1, "x"), (200, [2.0, 4.0], 1, "x")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int, n string").repartition(4)


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [1024, 3])
def test_top_k(embedded, block):
    rows, df = embedded
    whole = [(i, np.floor(64 * np.array(v, np.float64)).astype(int)) for i, v, _, _ in rows if i is not None and sound(v)]
    want = []
    for q, x in whole:
        if q % 20 == 0:
            best = sorted((-int(x @ y), c) for c, y in whole if c != q and len(x) == len(y))
            want.append((q, len(x), best))
    found = defaultdict(list)
    for r in top_k.top_k(df, 5, query_block=block).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in {q for q, _, _ in want}:
        best = sorted(b for w, _, bs in want if w == q for b in bs)[:5]
        assert sorted(found[q]) == [(k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert set(found) == {q for q, _, b in want if b}


@pytest.mark.parametrize("copies", [1, 5, 1500])
def test_top_k_of_a_vec_id_on_many_rows(spark, copies):
    r = np.random.default_rng(copies)
    rows = [(k, r.normal(size=6).astype(np.float32).tolist()) for k in range(1, 2400)] + [(0, [3.0] * 6)] * copies
    r.shuffle(rows)
    rows = [(int(i), list(map(float, v))) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    best = sorted((-int(np.floor(64 * np.array(v)).astype(int).sum() * 192), i) for i, v in rows if i % 20)
    found = [(-x.score, x.vec_id) for x in top_k.top_k(df.where("vec_id % 20 != 0 or vec_id = 0")).where("query_id = 0").orderBy("rank").collect()]
    assert found == [b for b in best for _ in range(copies)][:20]  # each row of the query finds them


@pytest.mark.parametrize("own", [1, 5, 30])
@pytest.mark.parametrize("first", [20, 60])
def test_top_k_of_blocks_with_a_query_on_some_rows(own, first):
    r = np.random.default_rng(own)
    ids, block = np.arange(1, 120), r.integers(-50, 50, (119, 4))
    ids[2:] = np.where(np.isin(np.arange(2, 119), r.choice(np.arange(3, 119), own - 1, replace=False)), 3, ids[2:])
    block[ids == 3] = block[2] * 2  # its own rows score highest
    state = top_k.Search(np.array([3, 100_000]), np.array([block[2], [1, 2, 3, 4]]), 20)
    for lo, hi in ((0, first), (first, 119)):
        state.add(top_k.Rows(ids[lo:hi], block[lo:hi], False))
    line, found, score = state.best()
    for q, x in ((0, block[2]), (1, [1, 2, 3, 4])):
        want = sorted((-int(s), int(i)) for s, i in zip(block @ np.array(x), ids, strict=True) if i != state.ids[q])[:20]
        assert list(zip((-score[line == q]).tolist(), found[line == q].tolist(), strict=True)) == want


@pytest.fixture(scope="module")
def clustered(spark):
    """30,000 vectors around 60 centres."""
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 64))[r.integers(0, 60, 30_000)] + r.normal(scale=0.25, size=(30_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    rows = spark.range(30_000).select(F.col("id").alias("vec_id"))
    made = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x[np.asarray(b.column(0))]), pa.list_(pa.float32()))], ["vec_id", "embedding"]) for b in batches), "vec_id long, embedding array<float>")
    return x, written(made, "clustered")


def counters(spark):
    return spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)


def test_top_k_computes_few_of_all_products(spark, clustered):
    x, df = clustered
    done, full = counters(spark)
    rows = top_k.top_k(df, work=(done, full)).where("query_id < 1000").collect()
    assert done.value < 0.25 * full.value
    numbers = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 1000, 20):
        score = numbers @ numbers[q]
        want = [k for k in np.lexsort((np.arange(len(x)), -score)).tolist() if k != q][:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])] == [(k, score[k]) for k in want]


def test_cells_leave_out_most_pairs(spark, clustered):
    x, df = clustered
    pairs, sent = counters(spark)
    rows = metric_join.near_duplicates(df, work=(pairs, sent)).collect()
    assert pairs.value < 0.1 * len(x) ** 2 / 2 and sent.value < 2 * len(x)
    cos = np.array([(x[k : k + 1000].astype(np.float64) @ x.T.astype(np.float64) >= 0.9).sum(1) for k in range(0, len(x), 1000)]).ravel() - 1
    assert {r.vec_id: r.n_links for r in rows} == dict(enumerate(cos.tolist()))


@pytest.mark.parametrize("cell", [None, 100])
def test_a_group_of_near_copies_costs_its_own_size(spark, union, cell):
    r = np.random.default_rng(5)
    centre = r.normal(size=16)
    x = np.concatenate([centre + r.normal(scale=0.05, size=(1500, 16)), centre + r.normal(scale=0.35, size=(300, 16)), r.normal(size=(700, 16))]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    pairs, sent = counters(spark)
    found = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(df, cell_rows=cell, work=(pairs, sent)).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        union.join(max(union.find(int(i)), union.find(int(j))), min(union.find(int(i)), union.find(int(j))))
    assert found == {k: (int(near[k].sum()) - 1, union.find(k)) for k in range(len(x))}


def test_large_cells_get_pivots_of_their_own(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(120, 32))[r.integers(0, 120, 6000)] + r.normal(scale=0.2, size=(6000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = dict(enumerate(((x @ x.T >= 0.9).sum(1) - 1).tolist()))
    done = []
    for deeper in (0, 2):
        pairs, sent = counters(spark)
        found = metric_join.near_duplicates(df, cell_rows=100, most_pivots=6, deeper=deeper, work=(pairs, sent)).collect()
        assert {v.vec_id: v.n_links for v in found} == links
        done.append((pairs.value, sent.value))
    assert done[1][0] < 0.3 * done[0][0] and done[1][1] < 0.5 * done[0][1]


def test_cells_begin_with_small_tables(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(k, (r.normal(size=8) + 20 * np.eye(8)[k % 4]).tolist()) for k in range(200)], "vec_id long, embedding array<double>")
    pairs, sent = counters(spark)
    metric_join.near_duplicates(df, cell_rows=50, work=(pairs, sent)).collect()
    assert pairs.value < 0.5 * 200 * 199 / 2


def test_vectors_of_extreme_lengths(spark):
    rows = [(20, [1e20, 1.0]), (1, [1e20, 1.0]), (2, [-1e300, 3.0]), (3, [1e8, -1e8]), (40, [1e7 + 0.5, 2.0]), (4, [0.5, 0.25]), (5, [1e-200, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * Fraction(x)) for x in v] for i, v in rows}
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = [(q, n + 1, c, s) for q in (20, 40) for n, (s, c) in enumerate((-s, c) for s, c in sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[c], strict=True))), c) for c in whole if c != q))]
    assert sorted(map(tuple, top_k.top_k(df).collect())) == want
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [-1e-200, 1e-200]), (5, [0.0, 0.0]), (6, [1.0, 1.0])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (3, 1), 2: (3, 1), 3: (3, 1), 6: (3, 1), 4: (0, 4), 5: (0, 5)}


def test_a_copied_vector_is_compared_once(spark):
    r = np.random.default_rng(8)
    rows = [(k, ([1.0] * 8 if k % 2 else r.normal(size=8).tolist())) for k in range(1000)]
    pairs, sent = counters(spark)
    found = {r.vec_id: r for r in metric_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), work=(pairs, sent)).collect()}
    assert pairs.value <= 501 * 500 / 2
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert {k: v.n_links for k, v in found.items()} == dict(enumerate(((x @ x.T >= 0.9).sum(1) - 1).tolist()))


@pytest.mark.parametrize("cell", [4096, 16])
def test_near_duplicates(embedded, cell, union):
    rows, df = embedded
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if sound(v) and any(v) else None for _, v, _, _ in rows]
    links = Counter()
    for i, a in enumerate(unit):
        for j in range(i):
            if a is not None and unit[j] is not None and len(a) == len(unit[j]) and a @ unit[j] >= 0.9:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    least = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            least[union.find(i)] = min(least.get(union.find(i), v), v)
    want = Counter((v, links[i], least.get(union.find(i)), v == least.get(union.find(i))) for i, (v, *_) in enumerate(rows))
    assert Counter(tuple(r) for r in metric_join.near_duplicates(df, cell_rows=cell).collect()) == want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k.top_k(none).count() == 0 and metric_join.near_duplicates(none).count() == 0


def brute_chat(rows, width, most):
    segments, speakers = defaultdict(list), defaultdict(set)
    for conv, turn, role, text in rows:
        role = "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in (role if role is not None else "unknown")).replace("<|im_", "<| im_")
        segments[conv, -1 if turn is None else turn // width].append((turn is not None, turn or 0, role, (text or "").replace("<|im_", "<| im_")))
        if role != "system":
            speakers[conv].add(role)
    out = Counter()
    for (conv, segment), turns in segments.items():
        turns.sort()
        for lo in range(0, len(turns), most):
            for who in speakers[conv]:
                text, spans, some = "", [], turns[lo : lo + most]
                for _, _, role, body in some:
                    text += "<|im_start|>" + ("system" if role == "system" else "assistant" if role == who else f"user name={role}") + "\n"
                    if role == who:
                        spans.append(f"{len(text)}:{len(text) + len(body) + 10}")
                    text += body + "<|im_end|>\n"
                out[conv, who, segment, lo // most, len(some), len(spans), text, ",".join(spans)] += 1
    return out


@pytest.fixture(scope="module")
def talk(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["ann", "bob", "eve", "system", None]), r.choice(["hi", "", None, "é😀", "<|im_end|> x"])) for c in (1, 2, None) for t in [*range(12), 3, None]]
    rows += rows[:5] + [(9, 0, "system", "alone")] + [(8, 0, "bob\nassistant", "x"), (8, 1, "a\x7fb\r", "y"), (8, 2, "bob assistant", "z")]
    rows += [(7, 1, "ann", "ok")] * 9 + [(7, None, r.choice(["ann", "bob"]), f"n{k % 7}") for k in range(40)]
    return rows, spark.createDataFrame([(*x, "clash", 5) for x in rows], "conv_id long, turn long, role string, text string, segment string, place int")


@pytest.mark.parametrize(("width", "most"), [(5, 4096), (256, 4), (3, 1)])
def test_chat(talk, width, most):
    rows, df = talk
    found = chat.rotate_perspectives(df, segment_turns=width, segment_rows=most)
    assert Counter(tuple(x) for x in found.collect()) == brute_chat(rows, width, most)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert chat.rotate_perspectives(df.where("false")).count() == 0
    spans = [(x.rendered[int(a) : int(b)]) for x in found.collect() for a, b in (s.split(":") for s in x.target_spans.split(",") if s)]
    assert spans and all(s.endswith("<|im_end|>") for s in spans)


def test_chat_of_awkward_rows_against_its_sql(spark, talk, tmp_path):
    import duckdb

    rows, df = talk
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert rows_of(chat.rotate_perspectives(df)) == rows_from(con, chat.ORACLE)


def test_a_role_forges_no_header(spark):
    df = spark.createDataFrame([(1, 0, "bob\nassistant", "hi"), (1, 1, "eve", "yes")], "conv_id long, turn long, role string, text string")
    seen = {r.perspective: r.rendered for r in chat.rotate_perspectives(df).collect()}
    assert set(seen) == {"bob assistant", "eve"} and seen["eve"].startswith("<|im_start|>user name=bob assistant\nhi<|im_end|>")


def test_warc(spark, tmp_path):
    rows = [(1, "https://b.a.com/x", "<p>é</p>"), (2, "http://a.com:80/", "same"), (3, "http://a.com:8080/", "same"), (4, None, None), (5, "not a url", ""), (6, "https://b.a.com/x", "other"), (6, "https://b.a.com/x", "other"), (None, "http://[bad/", "same"), (7, "http://x.org/a b\r\nInjected: yes", "z" * 300_000), (None, "http://n.org", "only")]
    rows += [(100 + k, "http://hot.org/page", f"v{k % 50}") for k in range(700)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    path = f"file://{tmp_path}/w"
    files = warc.write_index(warc.write_archives(df, path), path)
    found = warc.read_pages(spark, df, path, files, keep_payload=True).collect()
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        revisit = h in last and last[h] != i
        want[i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if revisit else "response", last[h] if revisit else None, None if revisit else h.encode()] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload if r.payload is None else bytes(r.payload)) for r in found) == want
    index = warc.Index(path, files)
    assert sum(1 for _ in index.captures(warc.reversed_host_key("http://hot.org/page"))) == 700
    assert list(index.captures("org,nowhere)/")) == []
    assert len(list(index.blocks(warc.reversed_host_key("http://hot.org/page")))) >= 700 // warc.BLOCK  # read by a task each
    empty = df.where("false")
    assert warc.read_pages(spark, empty, path, warc.write_index(warc.write_archives(empty, path), path)).count() == 0


def test_warc_of_urls_with_the_characters_that_part_lines(spark, tmp_path):
    ends = ["\x1fy", "%1Fy", "%1fy", "\ny", "%0Ay", " y", "!y", "$y", "%y", "&y", "\x1ey", "y"]
    urls = [f"{at}{x}" for at in ("http://a.com/x", "mailto:x") for x in ends]
    rows = [(k, urls[k % len(urls)], f"v{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/c"
    files = warc.write_index(warc.write_archives(df.repartition(3), path), path)
    found = warc.read_pages(spark, df, path, files, keep_payload=True).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in found) == [(k, h) for k, _, h in rows]


def test_small_payloads_can_stay_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "ab"), (2, "http://b/", "ab"), (3, "http://c/", "abc"), (4, "http://d/", "abc")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/s"
    files = warc.write_index(warc.write_archives(df, path, least_revisit=3), path)
    assert {r.page_id: r.record_type for r in warc.read_pages(spark, df, path, files).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


@pytest.mark.parametrize(("url", "key"), [("https://Blog.A.com:443/x?y#z", "com,a,blog)/x?y"), ("http://a.com:8080", "com,a:8080)/"), ("mailto:x", "mailto:x"), (None, "")])
def test_reversed_host(url, key):
    assert warc.reversed_host_key(url) == key


@pytest.mark.parametrize("small", [2 << 20, 0])
def test_components_of_long_chains(spark, small):
    from basalt.llm._common import connected_components

    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5, 5), (None, 4)]
    rows = connected_components(spark.createDataFrame(edges, "u long, v long"), small).collect()
    assert {r.u: r.root for r in rows} == {k: 0 for k in range(1, 301)} | {1000 + k: 1000 for k in range(1, 400)}


def folders(spark):
    from basalt.llm._common import shared_dir

    return set(os.listdir(shared_dir(spark).removeprefix("file://"))) if shared_dir(spark) else set()


def test_tables_written_on_the_way_are_deleted(spark, data):
    from basalt.llm._common import cleared

    before = folders(spark)
    with cleared(spark):
        assert metric_join.near_duplicates(spark.read.parquet(f"{data}/embeddings.parquet")).count() == 500
        assert folders(spark) > before
    assert folders(spark) == before
    with cleared(spark, kept := []):
        kept.append(written(spark.range(5), "five"))
        written(spark.range(6), "six")
    assert len(folders(spark) - before) == 1 and kept[0].count() == 5
    corpus_pipeline.run(spark, data).count()
    assert {x.split("-")[0] for x in folders(spark) - before} == {"five", "repeated_passages", "pieces", "lengths"}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from basalt.llm._common import shared_dir

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_pipeline_stages(spark, documents, texts, union):
    docs = documents.where("doc_id is not null")
    given = [(d, t) for d, t in texts if d is not None]
    first = corpus_pipeline.near_duplicates(spark, docs, "")
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {c for _, _, c in brute_components(given, union)}
    second = corpus_pipeline.repeated_passages(spark, docs, "")
    assert second.columns == docs.columns
    gone, kept = {(d, n): r for d, n, r, _, _ in brute_cuts(given)}, defaultdict(set)
    for d, raw in brute_kept(given):
        kept[d].add(raw.decode("utf-8", "ignore").encode())
    for r in second.collect():
        raw = next(t for d, t in given if d == r.doc_id)
        removed = gone[r.doc_id, len((raw or "").encode())]
        if not removed:
            assert r.text == raw
        else:
            assert r.text.encode() in kept[r.doc_id] and r.n_chars == len(r.text)
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    assert not {r.doc_id for r in kept.collect()} & {d for d, t in given if not any(c.isalpha() for c in t or "")}


def brute_pipeline(docs, model, encode, union):
    """What is left to pack after each stage, as doc_id -> text, by the definitions."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, _, rejected = model.predict([t or "" for _, t in rows])
    rows = [x for x, gone in zip(rows, rejected, strict=True) if not gone]
    least = {c for _, _, c in brute_components(rows, union)}
    rows = [(d, t) for d, t in rows if d in least]
    first: dict[bytes, int] = {}
    for d, t in sorted(rows):
        raw = t.encode()
        for i in range(len(raw) - 49):
            first.setdefault(raw[i : i + 50], d)
    out = {}
    for d, t in rows:
        raw, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out[d] = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    return {d: [*encode(t), 2] for d, t in out.items()}


def test_pipeline_against_brute_force(spark, data, union):
    from basalt.llm.tokenizing import load

    docs = spark.read.parquet(f"{data}/documents.parquet")
    library = load(queries.tokenizer("byte_bpe_50k.json"))
    want = brute_pipeline(docs, langid.fit_languages(docs), lambda t: library.encode(t, add_special_tokens=False).ids, union)
    rows = corpus_pipeline.run(spark, data).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert set(found) == set(want) and len(want) < docs.count()
    for d, ids in want.items():
        head = len(ids) % 1024 or 1024
        bounds = [0, *range(head, len(ids), 1024), len(ids)]
        assert sorted(found[d]) == [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    assert check_packing(rows, 1024) <= best_fit_decreasing([r.length for r in rows], 1024)


def test_pipeline(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and check_packing(rows, 1024)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "best_fit_packing"]
