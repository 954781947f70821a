"""Near duplicates by the Jaccard similarity of word shingles.

Multiple global orders: two sets of similarity t or more share a token among the first
n - ceil(t n) + 1 of each, whatever order all tokens are put in.  The first order goes by how many documents
have a token (up to CAP), so that a token that no other document has comes first and matches nothing; the others go by
hashes of their own, so what two documents of little likeness share by chance under one order they don't under the next.

1. Every distinct set sends its tokens once; those in two documents come back (shared_tokens).  Sets with the same shared
   tokens and the same size are one node, as they share just those: pages of one template cost one node.
2. Under each order, nodes that hold a token in their prefix are tied to the smallest node that does.  Linked nodes hang together by
   ties under every order, so the orders' components are intersected: nodes that all orders leave together are a piece.
3. Large pieces are dealt to slices, each with the same few leaders; what is linked there forms groups.  Nodes outside of a
   piece's largest group then meet all others, in pairs of slices: a group of any size that a leader holds together costs its own size.
4. Where a few nodes meet, candidate pairs must share a prefix token under every order; those are verified by their
   intersections.  A task reports only a spanning forest of the links it has found, so rows never grow with pairs.

Tokens are 64-bit hashes of shingles: exact but for two shingles of one corpus with equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared_tokens as S
from ._common import buckets_of, by_bucket, cleared, connected_components, discard, partitions, pieces, texts_of, written
from .vectors import unite

CAP = 16
ORDERS = 3
SLICE = 256  # nodes
LEADERS = 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words, or of all words where there are fewer; none without words.

    Words are what ASCII white space parts, with A-Z in lower case.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = (total ^ hashed[i : len(words) - k + 1 + i]) * _ODD[i % 5] + np.uint64(i)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def prefix(n, percent: int):
    """How many first tokens of a set of n hold one that it shares with any set of that similarity."""
    return n - (percent * n + 99) // 100 + 1


def order_key(tokens: np.ndarray, which: int) -> np.ndarray:
    x = tokens * _ODD[which % 5] + np.uint64(which)
    x ^= x >> np.uint64(31)
    return x * _ODD[(which + 1) % 5]


def cuts(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The last key of a whole set's prefix under each order but the first."""
    if not len(tokens):
        return np.zeros(ORDERS - 1, np.uint64)
    size = int(prefix(len(tokens), percent))
    return np.array([np.partition(order_key(tokens, which), size - 1)[size - 1] for which in range(1, ORDERS)], np.uint64)


class Node:
    """A set of n tokens: those that others have too, how common they are, and where its prefixes end."""

    __slots__ = ("tokens", "common", "n", "cuts")

    def __init__(self, tokens: bytes, common: bytes, n: int, ends: bytes):
        self.tokens, self.common, self.n, self.cuts = np.frombuffer(tokens, np.uint64), np.frombuffer(common, np.uint8), n, np.frombuffer(ends, np.uint64)

    def prefix(self, percent: int, which: int) -> np.ndarray:
        """Its shared tokens that lie in its prefix under an order; under the first, tokens that no other has come before them."""
        if which:
            return self.tokens[order_key(self.tokens, which) <= self.cuts[which - 1]]
        size = int(prefix(self.n, percent)) - (self.n - len(self.tokens))
        return self.tokens[np.lexsort((order_key(self.tokens, 0), self.common))[:size]] if size > 0 else self.tokens[:0]


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of a few sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = S.runs(tokens)
    sizes = np.diff(np.append(starts, len(tokens)))
    number = np.repeat(np.cumsum(sizes > 1) - 1, sizes)
    both = np.repeat(sizes > 1, sizes)
    owner, number = owner[both], number[both]
    out = np.zeros((m, m))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        a, b = np.searchsorted(number, [lo, lo + columns])
        has = np.zeros((m, columns), np.float32)
        has[owner[a:b], number[a:b] - lo] = 1
        out += has @ has.T
    return out


def linked(nodes: list[Node], group: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Linked pairs among a few nodes, and how many were verified; only pairs of different groups and, but for those of side -1, different sides."""
    n = np.array([x.n for x in nodes], np.int64)
    may = 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
    may &= np.triu(np.ones(may.shape, bool), 1)
    may &= np.not_equal.outer(group, group) & (np.not_equal.outer(side, side) | (side < 0))
    for which in range(ORDERS):
        if not may.any():
            break
        may &= overlaps([x.prefix(percent, which) for x in nodes]) > 0
    i, j = np.nonzero(may)
    if not len(i):
        return i, j, 0
    some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    both = overlaps([nodes[k].tokens for k in some])[at[: len(i)], at[len(i) :]]
    ok = 100 * both >= percent * (n[i] + n[j] - both)
    return i[ok], j[ok], len(i)


def _text_hash():
    """Tells the texts of one doc_id apart: eight bytes."""
    return F.to_binary(F.lpad(F.hex(F.xxhash64(F.col("text").cast("string"))), 16, "0"), F.lit("hex"))


_NODE = "ref long, n long, tokens binary, common binary, cuts binary"
_TYPES = [("ref", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("common", pa.binary()), ("cuts", pa.binary())]
_COLUMNS = [c for c, _ in _TYPES]


def _candidates(documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """members: doc_id, n, sig, ref, h for every row; found: distinct sets that may have a partner, with the signature `node` of what others share of them."""
    buckets = buckets_of(documents)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, seen = S.Sender(TaskContext.get().partitionId(), buckets, CAP), {}
        for batch in pieces(batches, "text"):
            n, sig, ref, first, note = [], [], [], [], []
            for text, h in zip(texts_of(batch), batch.column("h").to_pylist(), strict=True):
                tokens = shingles(text, width)
                n.append(len(tokens))
                sig.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                first.append(sig[-1] not in seen)
                if first[-1]:
                    seen[sig[-1]] = sender.add(tokens)
                    h += cuts(tokens, percent).tobytes()
                ref.append(seen[sig[-1]])
                note.append(h)
                yield from sender.flush(force=False)
            yield S.documents(S.home(np.array(ref, np.int64), buckets), batch.column("doc_id"), n, sig, ref, first, note)
        yield from sender.flush()

    def choose(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        blobs = table.filter(pa.array(kinds == S.RETURNED)).column("blob").to_pylist()
        out = []
        if blobs:
            own = table.filter(pa.array(kinds == S.DOCUMENT))
            known = dict(zip(own.column("ref").to_pylist(), zip(own.column("n").to_pylist(), own.column("blob").to_pylist(), strict=True), strict=True))
            refs, begins, tokens, common = S.received(blobs)
            for ref, a, b in zip(refs.tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                n, note = known[ref]
                if prefix(n, percent) > n - (b - a):
                    raw = tokens[a:b].tobytes()
                    out.append((ref, n, raw, common[a:b].tobytes(), note[8:], xxhash.xxh3_128_digest(raw + n.to_bytes(8, "little"))))
        return pa.table({name: pa.array([r[k] for r in out], t) for k, (name, t) in enumerate([*_TYPES, ("node", pa.binary())])})

    sent = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash().alias("h")).mapInArrow(send, S.SCHEMA)
    shared = written(by_bucket(sent, buckets).applyInArrow(S.share(buckets, CAP), S.SCHEMA), "shared")
    members = written(shared.where(F.col("kind") == S.DOCUMENT).select("doc_id", "n", "sig", "ref", "first", F.substring("blob", 1, 8).alias("h")), "members")
    returned = by_bucket(shared.where((F.col("kind") == S.RETURNED) | (F.col("first") & (F.col("n") > 0))), buckets).applyInArrow(choose, _NODE + ", node binary")
    one = members.where("first").groupBy("sig").agg(F.min("ref").alias("ref"))
    found = written(returned.join(one, "ref", "left_semi"), "candidates")
    discard(shared)
    return members, found


def _pieces_of(found: DataFrame, percent: int) -> DataFrame:
    """ref, piece, size: which nodes hang together by prefix tokens under every order; those that hang together with none are left out.

    A node stands once for each order (4 * ref + order), and all orders' ties are followed at once.
    """

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the nodes read so far the smallest of each order's token, and each node's tie to the smallest of its tokens."""
        held: list[tuple[int, np.ndarray]] = []

        def out():
            tokens = np.concatenate([t for _, t in held])
            refs = np.repeat([r for r, _ in held], [len(t) for _, t in held])
            order = np.lexsort((refs, tokens, refs & 3))
            tokens, refs = tokens[order], refs[order]
            starts = np.union1d(S.runs(tokens), S.runs(refs & 3))
            least = np.repeat(refs[starts], np.diff(np.append(starts, len(tokens))))
            ties = np.unique(np.stack([refs, least])[:, refs != least], axis=1)
            n, none = len(starts), np.zeros(ties.shape[1], np.int64)
            columns = [np.concatenate(x) for x in ((tokens[starts].view(np.int64), none), (np.full(n, -1), ties[0]), (refs[starts], ties[1]))]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["token", "u", "v"])

        size = 0
        for batch in batches:
            for ref, *node in zip(*(batch.column(c).to_pylist() for c in ("ref", "tokens", "common", "n", "cuts")), strict=True):
                own = Node(*node)
                for which in range(ORDERS):
                    held.append((4 * ref + which, own.prefix(percent, which)))
                    size += len(held[-1][1])
                if size > S.FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    ties = written(found.select(*_COLUMNS).mapInArrow(tie, "token long, u long, v long"), "ties")
    heads = ties.where("u < 0").select("token", "v", F.expr("v & 3").alias("which"))  # a row a task, order and token at most
    least = written(heads.groupBy("which", "token").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least < most").select("which", "token", "least"), "heads")
    across = heads.join(least, ["which", "token"]).where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    roots = connected_components(ties.where("u >= 0").select("u", "v").unionByName(across))
    roots = roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
    at = lambda k: F.max(F.when(F.expr("u & 3") == k, F.col("root"))).alias(f"r{k}")
    keys = [f"r{k}" for k in range(ORDERS)]
    every = written(roots.groupBy(F.shiftright("u", 2).alias("ref")).agg(*[at(k) for k in range(ORDERS)]).dropna(), "roots")
    named = written(every.groupBy(*keys).agg(F.min("ref").alias("piece"), F.count("*").alias("size")).where("size > 1"), "pieces")
    return every.join(named, keys).select("ref", "piece", "size")


def _links(found: DataFrame, percent: int, work: Accumulator | None) -> DataFrame:
    """u, v: a spanning forest of the links among nodes."""
    spark = found.sparkSession

    def verify(table: pa.Table) -> pa.Table:
        """Links in each piece of a cell, between nodes of different groups and sides."""
        names = ("piece", "ref", "own", "side", "tokens", "common", "n", "cuts")
        rows = sorted(zip(*(table.column(c).to_pylist() for c in names), strict=True), key=lambda r: r[:2])
        edges = np.append(S.runs(np.array([r[0] for r in rows], np.int64)), len(rows))
        left, right = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some = rows[a:b]
            refs = np.array([r[1] for r in some], np.int64)
            i, j, n = linked([Node(*r[4:]) for r in some], *(np.array([r[k] for r in some], np.int64) for k in (2, 3)), percent)
            if work:
                work.add(n)
            parent = unite(np.arange(len(some)), i, j)
            tree = np.flatnonzero(parent != np.arange(len(some)))
            left.append(refs[tree])
            right.append(refs[parent[tree]])
        return pa.table({"u": pa.array(np.concatenate(left)), "v": pa.array(np.concatenate(right))})

    def meet(some: DataFrame, *by: str) -> DataFrame:
        return some.select("piece", "own", "side", *_COLUMNS, *[c for c in by if c != "piece"]).groupBy(*by).applyInArrow(verify, "u long, v long")

    nodes = written(found.join(_pieces_of(found, percent), "ref"), "nodes")
    total = nodes.agg(F.sum(F.octet_length("tokens")).alias("bytes"), F.max("size").alias("size")).first()
    cells = max(8 * partitions(spark), -(-(total.bytes or 0) // (8 << 20)))
    small = nodes.where(F.col("size") <= SLICE).withColumn("own", F.col("ref")).withColumn("side", F.lit(-1))
    links = meet(small.withColumn("cell", F.pmod(F.xxhash64("piece"), F.lit(cells))), "cell")
    if (total.size or 0) > SLICE:
        for more in _large_links(nodes.where(F.col("size") > SLICE), meet):
            links = links.unionByName(more)
    return written(links, "links")


def _large_links(large: DataFrame, meet) -> list[DataFrame]:
    """Links of large pieces: first those of slices that each hold the piece's leaders, then those of what isn't in its largest group."""
    cut = written(large.withColumn("slices", F.ceil(F.col("size") / SLICE).cast("long")).withColumn("slice", F.pmod(F.xxhash64("ref"), F.col("slices"))), "slices")
    drawn = cut.select("piece", "ref", F.row_number().over(Window.partitionBy("piece").orderBy(F.xxhash64(F.lit(1), "ref"), "ref")).alias("k"))  # a task keeps only its first
    leaders = written(cut.join(written(drawn.where(F.col("k") <= LEADERS).select("ref"), "drawn"), "ref"), "leaders")
    copies = leaders.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    both = cut.join(leaders.select("ref"), "ref", "left_anti").unionByName(copies.select(*cut.columns)).withColumn("own", F.col("ref")).withColumn("side", F.lit(-1))
    first = written(meet(both, "piece", "slice"), "links")
    groups = connected_components(first).select(F.col("u").alias("ref"), F.col("root").alias("own"))
    named = written(cut.drop("slice", "slices", "size").join(groups, "ref", "left").withColumn("own", F.coalesce("own", "ref")), "named")
    most = named.groupBy("piece", "own").agg(F.count("*").alias("k")).groupBy("piece").agg(F.sum("k").alias("size"), F.max(F.struct("k", "own")).alias("top"))
    most = written(most.select("piece", F.col("top.own").alias("main"), F.ceil(F.col("top.k") / SLICE).cast("long").alias("mains"), F.ceil((F.col("size") - F.col("top.k")) / SLICE).cast("long").alias("rests")).where("rests > 0"), "groups")
    rows = named.join(most, "piece").withColumn("outer", F.col("own") != F.col("main"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("ref"), F.when(F.col("outer"), F.col("rests")).otherwise(F.col("mains"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda a, b, kind: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"))
    inner = F.transform(upto(F.col("rests")), lambda x: pair(F.least(x, F.col("slice")), F.greatest(x, F.col("slice")), 0))
    across = F.when(F.col("outer"), F.transform(upto(F.col("mains")), lambda x: pair(F.col("slice"), x, 1))).otherwise(F.transform(upto(F.col("rests")), lambda x: pair(x, F.col("slice"), 1)))
    met = rows.withColumn("at", F.explode(F.when(F.col("outer"), F.concat(inner, across)).otherwise(across))).select("piece", "own", "slice", "outer", *_COLUMNS, "at.a", "at.b", "at.kind")
    met = met.withColumn("side", F.when(F.col("kind") == 1, F.col("outer").cast("int")).when(F.col("a") == F.col("b"), -1).otherwise((F.col("slice") == F.col("b")).cast("int")))
    return [first, meet(met, "piece", "kind", "a", "b")]


def _components(documents: DataFrame, width: int, percent: int, work: Accumulator | None = None) -> tuple[DataFrame, DataFrame]:
    """members: doc_id, n, sig, ref, h for every row; component: sig, root, component.  Tables written on the way are deleted."""
    with cleared(documents.sparkSession, kept := []):
        members, found = _candidates(documents, width, percent)
        size = F.octet_length("tokens") / 8
        nodes = written(found.groupBy("node").agg(F.min("ref").alias("head"), F.count("*").alias("many")), "heads")
        in_nodes = written(found.select("ref", "node", (100 * size >= percent * (2 * F.col("n") - size)).alias("alike")).join(nodes, "node").select("ref", "head", (F.col("alike") & (F.col("many") > 1)).alias("alike")), "in_nodes")
        links = _links(found.drop("node").join(nodes.select(F.col("head").alias("ref")), "ref", "left_semi"), percent, work)
        roots = connected_components(links)
        roots = written(roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct()), "roots")
        placed = in_nodes.join(roots, in_nodes["head"] == roots["u"], "left").select("ref", F.coalesce("root", F.when(F.col("alike"), F.col("head")), "ref").alias("root"))
        sets = written(members.where("n > 0").groupBy("sig").agg(F.min("ref").alias("ref"), F.min("doc_id").alias("least")), "sets")
        named = written(sets.join(placed, "ref", "left").select("sig", "least", F.coalesce("root", "ref").alias("root")), "named")
        component = written(_with_component(named), "components")
        kept += [members, component]
    return members, component


def _with_component(named: DataFrame) -> DataFrame:
    """sig, root, component of written rows (sig, root, least): both sides of the join are read and dealt, so a root of most rows can be split."""
    smallest = written(named.groupBy("root").agg(F.min("least").alias("component")), "smallest")
    return named.join(smallest, "root").select("sig", "root", "component")


def link_documents(documents: DataFrame, width: int = 5, percent: int = 75, work: Accumulator | None = None) -> DataFrame:
    """Components of documents (doc_id, text) by links of Jaccard similarity >= percent / 100.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).  Texts
    that are null or have no words have no shingles and link with nothing.  Equal sets link; a null doc_id
    takes part but never names a component unless all are null.  Repeated rows come back one each;
    other columns are ignored; an empty table gives no rows.  `work` counts the pairs verified.
    """
    members, component = _components(documents, width, percent, work)
    return members.join(component, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The documents (doc_id, text and any other columns) without all but one of each component: that of the smallest doc_id.

    Null ids come last, and of rows that share their id and text one stays.  Documents without words stay.
    """
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), "h"]
    with cleared(documents.sparkSession, tables := []):
        members, component = _components(documents, width, percent)
        grouped = members.where("n > 0").join(component.select("sig", "root"), "sig")
        chosen = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("k"), "h")).alias("m")).select("m.k", "m.none", "m.h")
        kept = written(chosen.unionByName(members.where("n = 0").select(*key)).distinct(), "kept")
        again = members.where("n > 0").groupBy(*key).count().where("count > 1").limit(1).count()  # repeated rows are rare
        tables.append(kept)
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), _text_hash().alias("h")]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *own)
    stay = rows.join(kept, ["k", "none", "h"], "left_semi")
    if again:
        first = Window.partitionBy("k", "none", "h").orderBy("k")
        empty = ~F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        stay = stay.withColumn("i", F.row_number().over(first)).where((F.col("i") == 1) | empty)
    return stay.select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
l AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.t = y.t AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN c USING (doc_id)
"""
