"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its letters' 1- to 4-grams (lower case, within words), hashed to `buckets`
rows of an embedding.  Their average goes through a linear layer; both are learned in numpy by
stochastic gradient descent from a bounded sample of labelled rows.  A temperature and the bounds of
rejection are set on rows of the sample that the descent didn't see, whole and cut to a few words.

The softmax only compares languages, so it can't tell text of none of them.  That is told by how common a
text's n-grams are in the language that has them most, against what texts of as many n-grams show.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import cleared, pieces, texts_of, written

UNKNOWN = "und"
_ORDERS = (1, 2, 3, 4)
_SLICE = 1 << 18  # characters at once
_LEAST_ROWS = 20  # of a language, so that a draw by hashes misses none
_LEAST_STEPS = 20  # of descent, for each language
_MARGIN = 1.5  # how far beyond the least of held-back texts a text must be to be rejected


@lru_cache(1)
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _codes(text: str) -> np.ndarray:
    """Code points of the letters in lower case, 0 for anything else."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_alphabetic()[codes], codes, np.uint32(0))


def features(codes: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams and where they begin; words are bounded by zeros."""
    shift = np.uint32(32 - (buckets - 1).bit_length())
    hashed, inside = np.zeros(len(codes), np.uint32), np.ones(len(codes), bool)
    for n in _ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            return
        hashed, inside = hashed[:m] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n), inside[:m] & (codes[n - 1 :] > 0)
        at = np.flatnonzero(inside)
        mixed = hashed[at]
        mixed ^= mixed >> np.uint32(15)
        yield (mixed * np.uint32(0x9E3779B1)) >> shift, at


def counts(text: str, buckets: int) -> np.ndarray:
    return sum(counts_by_order(text, buckets))


def counts_by_order(text: str, buckets: int) -> list[np.ndarray]:
    total = [np.zeros(buckets, np.float64) for _ in _ORDERS]
    codes = _codes(text)
    for lo in range(0, len(codes), _SLICE):  # n-grams that begin in the slice
        stop = min(len(codes), lo + _SLICE)
        for n, (hashed, at) in enumerate(features(codes[lo : stop + _ORDERS[-1] - 1], buckets)):
            total[n] += np.bincount(hashed[at < stop - lo], minlength=buckets)
    return total


def few_words(text: str) -> str:
    """The first words of a text, one to eight by its checksum."""
    head = text[:400]
    return " ".join(head.split()[: 1 + zlib.crc32(head.encode("utf-8", "surrogatepass")) % 8])


@dataclass
class Familiarity:
    """How common n-grams are, and what to expect of a text."""

    table: np.ndarray  # for each bucket the logarithm of its share in the language that has it most
    usual: np.ndarray  # the mean of that for n-grams of each order
    spread: tuple[float, float]  # variance of a text's mean: of long texts, and what a single n-gram adds
    least: float  # in standard deviations

    def deviation(self, total: np.ndarray, orders: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """Standard deviations from the usual mean, by the texts' sums, n-grams of each order and distinct ones."""
        mean = (total - orders @ self.usual) / np.maximum(orders.sum(1), 1)
        return mean / np.sqrt(self.spread[0] + self.spread[1] / np.maximum(distinct, 1))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: what an n-gram of a bucket adds to each language
    bias: np.ndarray
    temperature: float
    threshold: float
    familiarity: Familiarity | None = None  # None: too few rows to tell

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the mean logits, and how many n-grams it has."""
        total, seen = self._sums(texts, self.table)
        seen = seen.sum(1)
        return total / np.maximum(seen, 1)[:, None] + self.bias, seen

    @cached_property
    def _wide(self) -> np.ndarray:
        return np.hstack([self.table, *([self.familiarity.table[:, None]] if self.familiarity else [])])

    def _sums(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of its n-grams' rows of the table, and how many n-grams of each order it has."""
        lowered = [_codes(t) for t in texts]
        total, seen = np.zeros((len(texts), table.shape[1])), np.zeros((len(texts), len(_ORDERS)))
        gap = np.zeros(1, np.uint32)
        lo = 0
        while lo < len(lowered):
            if len(lowered[lo]) > _SLICE:
                n = counts_by_order(texts[lo], len(table))
                total[lo], seen[lo] = sum(n) @ table, [x.sum() for x in n]
                lo += 1
                continue
            hi, size = lo, 0
            while hi < len(lowered) and size + len(lowered[hi]) <= _SLICE:
                size += len(lowered[hi]) + 1
                hi += 1
            hi = max(hi, lo + 1)
            begins = np.cumsum([0, *(len(c) + 1 for c in lowered[lo:hi])])
            codes = np.concatenate([x for c in lowered[lo:hi] for x in (c, gap)])
            for n, (hashed, at) in enumerate(features(codes, len(table))):
                cut = np.searchsorted(at, begins)
                some = cut[1:] > cut[:-1]
                if some.any():
                    total[lo:hi][some] += np.add.reduceat(table[hashed], cut[:-1][some], axis=0)
                    seen[lo:hi, n] += np.diff(cut)
            lo = hi
        return total, seen

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        total, orders = self._sums(texts, self._wide)
        seen = orders.sum(1)
        p = softmax((total[:, : len(self.languages)] / np.maximum(seen, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(1)
        known = seen > 0
        score = np.where(known, p[np.arange(len(p)), best], 0.0)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)], score, ~known | (score < self.threshold) | self._strange(texts, total[:, -1], orders)

    def _strange(self, texts: list[str], total: np.ndarray, orders: np.ndarray) -> np.ndarray:
        """Whether a text's n-grams are too rare for any of the languages."""
        strange = np.zeros(len(texts), bool)
        if self.familiarity:  # distinct n-grams are no more than all, so what passes with all of them passes
            for k in np.flatnonzero(self.familiarity.deviation(total, orders, orders.sum(1)) < self.familiarity.least).tolist():
                distinct = np.array([np.count_nonzero(counts(texts[k], len(self.table)))])
                strange[k] = self.familiarity.deviation(total[k : k + 1], orders[k : k + 1], distinct)[0] < self.familiarity.least
        return strange


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Sample:
    """A text's buckets, how often each, and its n-grams of each order."""

    at: np.ndarray
    n: np.ndarray
    orders: np.ndarray

    @classmethod
    def of(cls, text: str, buckets: int) -> Sample:
        by_order = counts_by_order(text, buckets)
        whole = sum(by_order)
        at = np.flatnonzero(whole)
        return cls(at.astype("<i4"), whole[at].astype("<f4"), np.array([x.sum() for x in by_order], "<f8"))

    def packed(self) -> bytes:
        return len(self.at).to_bytes(8, "little") + self.orders.tobytes() + self.at.tobytes() + self.n.tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Sample:
        n = int.from_bytes(raw[:8], "little")
        begin = 8 + 8 * len(_ORDERS)
        return cls(np.frombuffer(raw, "<i4", n, begin), np.frombuffer(raw, "<f4", n, begin + 4 * n), np.frombuffer(raw, "<f8", len(_ORDERS), 8))


def train(rows: list[tuple[str, Sample, Sample]], buckets: int, dim: int = 16, epochs: int = 6, rate: float = 1.0, reject: float = 0.001, seed: int = 7) -> Model:
    """Fit a model to (language, whole text, its first words); a fifth of the rows calibrates it."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 1.0)
    random = np.random.default_rng(seed)
    y = np.array([languages.index(r[0]) for r in rows])
    order = random.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist())
    fit = np.array([k for k in order.tolist() if k not in held])
    embedding, weight, bias = random.normal(0, 1, (buckets, dim)), np.zeros((dim, len(languages))), np.zeros(len(languages))

    def dense(some: list[Sample]) -> np.ndarray:
        x = np.zeros((len(some), buckets))
        for i, s in enumerate(some):
            if len(s.at):
                x[i, s.at] = s.n / s.n.sum()
        return x

    epochs = max(epochs, -(-_LEAST_STEPS * len(languages) // -(-len(fit) // 32)))  # few rows of many languages need more
    steps, at = epochs * -(-len(fit) // 32), 0
    for _ in range(epochs):
        random.shuffle(fit)
        for lo in range(0, len(fit), 32):
            some = fit[lo : lo + 32]
            x, lr = dense([rows[k][1] for k in some]), rate * (1 - at / steps)
            hidden = x @ embedding
            p = softmax(hidden @ weight + bias)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            used = np.flatnonzero(x.any(0))
            step = x[:, used].T @ (p @ weight.T)
            weight -= lr * hidden.T @ p
            bias -= 0.1 * lr * p.sum(0)
            embedding[used] -= 50 * lr * step  # an n-gram is a small share of its text
            at += 1
    model = Model(languages, embedding @ weight, bias, 1.0, 0.0)
    if len(held) >= 20:
        kept = [(y[k], s) for k in sorted(held) for s in rows[k][1:] if len(s.at)]
        true, texts = np.array([t for t, _ in kept], int), [s for _, s in kept]
        z = np.concatenate([np.zeros((0, len(languages))), *(dense(texts[k : k + 256]) @ model.table + bias for k in range(0, len(texts), 256))])
        grid = np.geomspace(0.001, 100, 100)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(texts)), true], 1e-12)).mean() for t in grid] if texts else [0.0]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = p.argmax(1) == true
        if right.any():  # what the share `reject` of rightly named texts falls short of, and well below
            model.threshold = float(np.quantile(p.max(1)[right], reject)) / _MARGIN
            model.familiarity = learn_familiarity([(y[k], rows[k][1]) for k in fit], texts, buckets, len(languages), reject)
    return model


def learn_familiarity(fit: list[tuple[int, Sample]], texts: list[Sample], buckets: int, languages: int, reject: float) -> Familiarity:
    """Shares of buckets from the rows learned from, what is usual from held-back texts."""
    seen = np.zeros((buckets, languages))
    for k, s in fit:
        seen[s.at, k] += s.n
    table = np.log(((seen + 0.5) / (seen.sum(0) + 0.5 * buckets)).max(1))
    total, orders = np.array([table[s.at] @ s.n for s in texts]), np.array([s.orders for s in texts])
    size, distinct = orders.sum(1), np.array([len(s.at) for s in texts])
    mean, share = (total / size).mean(), orders / size[:, None]
    ridge = 0.01 * len(texts) * np.eye(len(_ORDERS))  # orders' shares go together, so that least squares alone would wander
    usual = mean + np.linalg.solve(share.T @ share + ridge, share.T @ (total / size - mean))
    squares = ((total - orders @ usual) / size) ** 2
    long = distinct >= np.median(distinct)
    floor = float(max(squares[long].mean(), 1e-6))
    each = float(max(((squares - floor) * distinct)[~long].mean(), 1e-6)) if not long.all() else 1e-6
    found = Familiarity(table, usual, (floor, each), 0.0)
    found.least = _MARGIN * min(-1.0, float(np.quantile(found.deviation(total, orders, distinct), reject)))
    return found


def folds(doc_id="doc_id"):
    """Whether a document is held out: crc32 of its id as text, modulo 5, is 0.  A null id isn't, nor is it learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_languages(documents: DataFrame, per_language: int = 1000, most_languages: int = 64, buckets: int = 1 << 14, sample_bytes: int = 256 << 20) -> Model:
    """Learn every language from some per_language labelled rows of each, or fewer where there are over most_languages.

    The sample is bounded by the product of these parameters, or _LEAST_ROWS a language if that is more, and by the bytes of its counts, which
    the driver learns from: a share of each language is drawn by a hash of doc_id from the rows that aren't held out.  Repeated rows are drawn
    together and learned from as often as they come.  lang is what is learned, source is never read.
    """
    rows = documents.where("doc_id is not null and lang is not null and text is not null").where(~folds())
    found = rows.groupBy("lang").count().collect()  # a row a language
    bound = max(per_language * most_languages, _LEAST_ROWS * len(found))
    each = min(per_language, bound // len(found)) if found else 0
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))

    def below(shares: dict[str, float]):
        share = F.create_map(*[F.lit(x) for item in shares.items() for x in item]) if shares else F.create_map(F.lit(""), F.lit(0.0))
        return F.col("drawn") < share[F.col("lang")] * (1 << 20)

    shares = {r["lang"]: min(1.0, each / r["count"]) for r in found}

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = texts_of(batch)
            whole, head = ([Sample.of(t, buckets).packed() for t in some] for some in (texts, map(few_words, texts)))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("drawn"), pa.array(whole, pa.binary()), pa.array(head, pa.binary())], ["lang", "drawn", "whole", "head"])

    chosen = rows.select("lang", "text", drawn.alias("drawn")).where(below(shares))
    with cleared(documents.sparkSession):
        sampled = written(chosen.mapInArrow(featurize, "lang string, drawn long, whole binary, head binary"), "sample")
        sizes = {r["lang"]: (r["n"], r["bytes"]) for r in sampled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("whole") + F.octet_length("head")).alias("bytes")).collect()}
        if (total := sum(b for _, b in sizes.values())) > sample_bytes:
            sampled = sampled.where(below({x: shares[x] * max(sample_bytes / total, min(1.0, _LEAST_ROWS / n)) for x, (n, _) in sizes.items()}))
        got = sampled.limit(2 * bound).collect()
    return train([(r.lang, Sample.unpacked(r.whole), Sample.unpacked(r.head)) for r in sorted(got, key=lambda r: (r.lang, r.whole, r.head))], buckets)


def predict_languages(documents: DataFrame, model: Model) -> DataFrame:
    """Predict every document's language from its whole text: row (a struct of the documents' columns), lang_pred, score, rejected.

    A text that is null or has no letter gets `und`, a score of 0 and is rejected.  A text of none of the learned
    languages is rejected too; its score only tells how the languages compare on it.  Rows come back one each.
    """
    shared = model

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_text = (pa.RecordBatch.from_arrays([b.column("row"), pc.struct_field(b.column("row"), "text")], ["row", "text"]) for b in batches)
        for batch in pieces(with_text, "text"):
            languages, scores, rejected = shared.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(languages, pa.string()), pa.array(scores), pa.array(rejected)], ["row", "lang_pred", "score", "rejected"])

    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    schema = StructType(list(rows.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(predict, schema)


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Languages of all documents (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected.  Rows come back one each, repeated ones alike."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = model or fit_languages(rows)
    found = predict_languages(rows.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score", "rejected")
    return found.select("doc_id", folds().alias("held_out"), "lang_pred", "score", "rejected")
