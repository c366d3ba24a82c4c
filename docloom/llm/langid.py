"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords (2, 3 and 4 bytes that don't run across a gap between words) are
hashed into `2**BITS` buckets; the mean of their embeddings goes through a linear
layer and a softmax.  Embeddings and layer are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows (`train_rows`), in
one task of an executor.
A fifth of the sample is held back to set the softmax's temperature and the score
below which a prediction is rejected (`max_false_rejection` of good predictions).

Whole texts are scored, in pieces of a megabyte, so memory doesn't grow with a text.

Defined cases.  Null text, or one without letters: `und`, score 0, rejected.  Rows
without a language aren't learned from.  No labelled row at all: everything is `und`.
One language only: it is predicted with score 1.  Ties: of languages that score alike
the first by code point.  Repeated rows and ids: each row on its own.  Empty table: no
rows.  Extra and clashing columns are kept by `keep_identified`, ignored otherwise.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unpacked

BITS = 12
PIECE = 1 << 20
#: Multipliers of the three gram hashes (odd, fixed values).
MIX = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}
#: Bytes to what the model sees: a-z, bytes beyond ASCII as they are, all else a gap.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # bucket x language: embedding times layer
    bias: np.ndarray
    temperature: float
    threshold: float


def grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of the subwords of folded bytes, a pair of arrays per length."""
    gap = data == 32
    wide = data.astype(np.uint32)
    code = wide[:-1] | wide[1:] << np.uint32(8)
    for size in (2, 3, 4):
        if len(data) < size:
            return
        if size > 2:
            code = code[: len(data) - size + 1] | wide[size - 1 :] << np.uint32(8 * (size - 1))
        inner = np.zeros(len(code), bool)
        for k in range(1, size - 1):
            inner |= gap[k : k + len(code)]
        if size == 2:
            inner = gap[:-1] & gap[1:]
        start = np.flatnonzero(~inner)
        yield start, (code[start] * np.uint32(MIX[size])) >> np.uint32(32 - BITS)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and where each text begins (null: empty)."""
    column = column.cast(pa.large_binary())
    texts = [x.as_buffer() if x.is_valid else b"" for x in column]
    ends = np.cumsum([0] + [len(x) + 2 for x in texts])
    flat = np.full(ends[-1], 32, np.uint8)
    for at, x in zip(ends, texts):
        if len(x):
            flat[at + 1 : at + 1 + len(x)] = FOLD[np.frombuffer(x, np.uint8)]
    return flat, ends


def _sums(flat: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the summed rows of `table` of its subwords, and their number."""
    docs = len(ends) - 1
    total, n = np.zeros((docs, table.shape[1])), np.zeros(docs, np.int64)
    # Sums along a piece take 8 bytes a subword and language.
    size = max(32, 4 * PIECE // max(4, table.shape[1]))
    for at in range(0, len(flat), size):
        piece = flat[at : at + size + 3]
        lo = np.searchsorted(ends, at, "right") - 1
        hi = min(docs, int(np.searchsorted(ends, at + size, "left")))
        marks = np.clip(ends[lo : hi + 1] - at, 0, size)
        for start, bucket in grams(piece):
            keep = np.searchsorted(start, min(size, len(piece)), "left")
            cuts = np.searchsorted(start[:keep], marks, "left")
            run = np.zeros((keep + 1, table.shape[1]))
            np.cumsum(table[bucket[:keep]], axis=0, out=run[1:])
            total[lo:hi] += run[cuts[1:]] - run[cuts[:-1]]
            n[lo:hi] += np.diff(cuts)
    return total, n


def _scores(total: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    logits = (total / np.maximum(n, 1)[:, None] + model.bias) / model.temperature
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: tuple[str, ...], dim: int = 16, epochs: int = 12, seed: int = 7, max_false_rejection: float = 0.001) -> Model:
    """x: rows of subword shares (sum 1); y: index into `langs`."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, own = (order[:cut], order[cut:]) if len(x) >= 10 else (order, order)
    e = rng.normal(0, 0.1, (x.shape[1], dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32)
    b = np.zeros(len(langs), np.float32)
    share = np.bincount(y[own], minlength=len(langs))
    weight = (len(own) / np.maximum(share, 1) / len(langs)).astype(np.float32)
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // 32)):
            xb = x[batch]
            h = xb @ e
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            g = p * weight[y[batch], None] / len(batch)
            back = g @ w.T
            w -= np.float32(2.0 * rate) * (h.T @ g)
            b -= np.float32(0.1 * rate) * g.sum(0)
            # A subword's share is about 1 / length, hence the larger step.
            e -= np.float32(60.0 * rate) * (xb.T @ back)
    raw = x[held] @ (e @ w) + b

    def loss(t: float) -> float:
        z = raw / t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(held)), y[held]]))

    temperature = min(np.geomspace(0.05, 5, 40), key=loss)
    model = Model(langs, (e @ w).astype(np.float32), b, float(temperature), 0.0)
    p = _scores(x[held] @ model.table, np.ones(len(held)), model)
    right = p.max(1)[p.argmax(1) == y[held]]
    least = float(np.quantile(right, max_false_rejection)) if len(right) else 0.0
    return Model(langs, model.table, b, float(temperature), min(0.5, least))


def fit(docs: DataFrame, learn: Column, train_rows: int = 4000, least: int = 50, max_langs: int = 1000, **options) -> Model | None:
    """A model of a sample of the rows where `learn` holds and lang is known.

    The sample has about `train_rows` rows, in proportion to the languages but `least` of
    each if there are as many, so `train_rows + least * max_langs` at most; the most
    frequent `max_langs` languages are learned.  Rows with the smallest hashes of id and
    language make it up.  One task trains on their histograms, of 2**BITS buckets at most,
    and the driver gets the model alone.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    total = sum(r.n for r in counts)
    if not total:
        return None
    part = (train_rows + 4 * train_rows**0.5) / total
    shares = [(r.lang, int(min(1.0, max(part, 2 * least / r.n)) * (1 << 30)) + 1) for r in counts]
    cuts = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, cut bigint"))
    rank = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30))
    sample = labelled.select("lang", "text", rank.alias("rank")).join(cuts, "lang").where("rank < cut").select("lang", "text", "rank")

    def count(batches):
        for batch in batches:
            flat, ends = _texts(batch.column(1))
            ids, weights = [], []
            for a, z in zip(ends[:-1], ends[1:]):
                hist = np.zeros(1 << BITS, np.int64)
                for at in range(a, z, PIECE):
                    for start, bucket in grams(flat[at : min(z, at + PIECE + 3)]):
                        hist += np.bincount(bucket[start < PIECE], minlength=1 << BITS)
                seen = np.flatnonzero(hist)
                ids.append(seen.astype(np.uint16).tobytes())
                weights.append((hist[seen] / max(1, hist.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], ["lang", "rank", "ids", "shares"])

    def learned(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)) if r[1]]
        rows.sort()
        if not rows:
            return
        langs = tuple(sorted({r[0] for r in rows}))
        x = np.zeros((len(rows), 1 << BITS), np.float32)
        for row, r in zip(x, rows):
            row[np.frombuffer(r[1], np.uint16)] = np.frombuffer(r[2], np.float32)
        model = train(x, np.array([langs.index(r[0]) for r in rows]), langs, **options)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # A guard: where ids repeat, the hash might let more rows through.
    most = train_rows + int(4 * train_rows**0.5) + 2 * least * len(counts)
    rows = sample.mapInArrow(count, "lang string, rank bigint, ids binary, shares binary").orderBy("rank", "lang", "ids", "shares").limit(most)
    found = rows.select("lang", "ids", "shares").mapInArrow(learned, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """row (the columns of `docs` as a struct), lang, score, rejected."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    if model is None:
        return own.select("row", F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    guess = F.arrow_udf(lambda text: _guess(text, model), "struct<lang:string,score:double>")
    letters = F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))
    found = own.withColumn("g", guess(F.when(letters, F.col("row.text")))).select("row", "g.lang", "g.score")
    return found.withColumn("rejected", (F.col("lang") == "und") | (F.col("score") < model.threshold))


def _guess(text: pa.Array, model: Model) -> pa.Array:
    flat, ends = _texts(text)
    total, n = _sums(flat, ends, model.table)
    p = _scores(total, n, model)
    known = text.is_valid().to_numpy(zero_copy_only=False) & (n > 0)
    langs = [model.langs[k] if ok else "und" for k, ok in zip(p.argmax(1), known)]
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.where(known, p.max(1), 0.0))], ["lang", "score"])


def in_fold(fold: int = 2, of: int = 4, doc_id: Column | None = None) -> Column:
    """Whether a row is held out: crc32 of the id as text (null: the empty text)."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == fold


def report(docs: DataFrame, train_rows: int = 4000) -> DataFrame:
    """The contract's columns."""
    model = fit(docs, ~in_fold(), train_rows)
    found = predict(docs.select("doc_id", "text"), model)
    fold = in_fold(doc_id=F.col("row.doc_id"))
    return found.select("row.doc_id", fold.alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")


def keep_identified(docs: DataFrame, train_rows: int = 4000) -> DataFrame:
    """`docs` without the documents whose language is rejected; the same columns."""
    model = fit(docs, ~in_fold(), train_rows)
    return unpacked(predict(docs, model).where(~F.col("rejected")), docs.columns)
