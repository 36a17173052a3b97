"""Corpus language model: a log-bilinear network over frequent words on top of exact word counts.

Tokens are lower-cased words, then one end token a document. Spark counts all
training tokens. The SHORTLIST most frequent are classes of their own, the rest
one further class within which a token has its share of the add-0.1 counts. The
class is predicted from the two classes before it: a log-bilinear model, trained
in numpy by noise-contrastive estimation. Every partition of the training
documents trains a copy on all its tokens from the same start; the copies are
averaged by Spark, weighted by their tokens. The class probabilities are
normalised over all classes for every context with batched matrix products.

Null text is empty: only the end token. Null ids are training rows. Repeated
rows count and are returned as often as they occur; empty tables give no rows;
without training rows every token has the base share. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ASCII_LOWER, U64, PrefixHash, Packed, batches, byte_texts, chunks, mix, words
from .tables import fold, materialise, partitions

SHORTLIST = 1023
#: Tokens whose counts every task holds: a fixed bound of 1 MB. The counts of all others meet their tokens in a shuffle.
LISTED = 1 << 16
WIDTH, NOISE, BATCH, RATE = 16, 64, 2048, 0.05
END = U64(0xE0D5E0D5E0D5E0D5)
SHIFT = 0.1
LN10 = math.log(10)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each token in order, each document closed by END."""
    packed = Packed(texts)
    lower = ASCII_LOWER[packed.buf]
    start, end = words(lower)
    doc = packed.doc_of(start)
    at = np.searchsorted(doc, np.arange(packed.count), side="right")
    return np.insert(PrefixHash(lower).of(start, end), at, END), np.insert(doc, at, np.arange(packed.count))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _count(rows):
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches(rows):
        texts = byte_texts(batch.column("_text"))
        for a, b in chunks(texts):
            parts.append(np.unique(tokens(texts[a:b])[0], return_counts=True))
            if sum(len(k) for k, _ in parts[1:]) > 1 << 20:
                parts = [_merge(parts)]
    if parts:
        keys, n = _merge(parts)
        for i in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 17)].view(np.int64)), pa.array(n[i : i + (1 << 17)])], names=["token", "n"])


@dataclass
class Listed:
    """The most frequent tokens by hash: counts, and classes of the first SHORTLIST of them."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    n_classes: int
    total: int
    distinct: int

    @property
    def rest(self) -> float:
        """Add-0.1 mass of all tokens outside the shortlist and of one unseen token."""
        inside = self.classes < self.n_classes
        return self.total - self.counts[inside].sum() + SHIFT * (self.distinct - self.n_classes + 1)

    @property
    def unigram(self) -> np.ndarray:
        p = np.zeros(self.n_classes + 1)
        inside = self.classes < self.n_classes
        p[self.classes[inside]] = self.counts[inside]
        p[-1] = self.rest
        return p / p.sum()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in the list and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def class_of(self, h: np.ndarray) -> np.ndarray:
        at, there = self.find(h)
        return np.where(there, self.classes[at] if len(self.classes) else 0, self.n_classes)


def _contexts(classes: np.ndarray, doc: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class before and the one before that; n_classes + 1 stands before a document."""
    one, two = np.full(len(classes), n_classes + 1), np.full(len(classes), n_classes + 1)
    one[1:] = np.where(doc[1:] == doc[:-1], classes[:-1], n_classes + 1)
    two[2:] = np.where(doc[2:] == doc[:-2], classes[:-2], n_classes + 1)
    return one, two


class LogBilinear:
    """context = before1[c1] @ mix1 + before2... ; logit of class w = context . target[w] + bias[w]."""

    def __init__(self, unigram: np.ndarray, seed: int = 11):
        rng, k = np.random.default_rng(seed), len(unigram)
        self.context = rng.normal(0, 0.1, (k + 1, WIDTH)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (k, WIDTH)).astype(np.float32)
        self.mix1, self.mix2 = np.eye(WIDTH, dtype=np.float32), np.eye(WIDTH, dtype=np.float32) * 0.5
        self.bias = np.log(np.maximum(unigram, 1e-12)).astype(np.float32)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.mix1, self.mix2, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def load(self, values: np.ndarray) -> LogBilinear:
        at = 0
        for p in self.parts:
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits by first and by second context class, and the logarithm of each context pair's normaliser."""
        one = self.context @ self.mix1 @ self.target.T
        two = self.context @ self.mix2 @ self.target.T + self.bias
        top1, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        norm = np.log(np.maximum(np.exp(one - top1) @ np.exp(two - top2).T, 1e-30)) + top1 + top2.T
        return one.astype(np.float32), two.astype(np.float32), norm.astype(np.float32)


class Trainer:
    """Noise-contrastive steps with Adagrad; the noise words of a step are shared by its tokens."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int = 13):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.ladder, self.log_noise = np.cumsum(unigram), np.log(NOISE * np.maximum(unigram, 1e-12)).astype(np.float32)
        self.squares = [np.full(p.shape, 1.0, np.float32) for p in model.parts]

    def _dense(self, k: int, grad: np.ndarray) -> None:
        self.squares[k] += grad * grad
        self.model.parts[k][...] += RATE * grad / np.sqrt(self.squares[k])

    def _rows(self, k: int, index: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        grad, rows = np.add.reduceat(grad[order], first, axis=0), index[first]
        self.squares[k][rows] += grad * grad
        self.model.parts[k][rows] += RATE * grad / np.sqrt(self.squares[k][rows])

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.model
        a, b = m.context[one], m.context[two]
        r = a @ m.mix1 + b @ m.mix2
        noise = np.minimum(np.searchsorted(self.ladder, self.rng.random(NOISE) * self.ladder[-1]), len(self.ladder) - 1)
        q, qn = m.target[w], m.target[noise]
        up = 1 / (1 + np.exp(np.clip((r * q).sum(1) + m.bias[w] - self.log_noise[w], -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(r @ qn.T + (m.bias[noise] - self.log_noise[noise]), -30, 30)))
        scale = np.float32(1)
        dr = (up[:, None] * q + down @ qn) * scale
        index = np.concatenate((w, noise))
        slopes = np.concatenate((up, down.sum(0))) * scale
        self._rows(1, index, np.concatenate((up[:, None] * r * scale, down.T @ r * scale)))
        self._rows(4, index, slopes)
        d1, d2, both = a.T @ dr, b.T @ dr, np.concatenate((dr @ m.mix1.T, dr @ m.mix2.T))
        self._rows(0, np.concatenate((one, two)), both)
        self._dense(2, d1)
        self._dense(3, d2)


def _training(listed: Listed):
    def run(rows):
        unigram = listed.unigram
        model = LogBilinear(unigram)
        trainer, seen = Trainer(model, unigram), 0
        for batch in batches(rows):
            texts = byte_texts(batch.column("_text"))
            for a, b in chunks(texts):
                h, doc = tokens(texts[a:b])
                w = listed.class_of(h)
                one, two = _contexts(w, doc, listed.n_classes)
                order = trainer.rng.permutation(len(w))
                for i in range(0, len(w), BATCH):
                    part = order[i : i + BATCH]
                    trainer.step(w[part], one[part], two[part])
                seen += len(w)
        if seen:
            values = np.concatenate((model.flat() * seen, [seen]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"])

    return run


def fit(train: DataFrame) -> tuple[Listed, LogBilinear]:
    """train: _text (binary). Counts and trains on all rows."""
    counts = materialise(train.mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(LISTED).collect()
    hashes, n = np.array([r["token"] for r in top], np.int64).view(U64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(hashes)
    k = min(SHORTLIST, len(top))
    listed = Listed(hashes[order], n[order], np.where(order < k, order, k), k, int(total["n"] or 0), int(total["v"]))
    model = LogBilinear(listed.unigram)
    if listed.total:
        sums = np.zeros(len(model.flat()) + 1)
        for r in train.mapInArrow(_training(listed), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            sums[r["place"]] = r["value"]
        model.load(sums[:-1] / sums[-1])
    return listed, model


_SCHEMA = "bucket int, hashes binary, rids binary, ns binary, rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double"
_FIELDS = ("bucket", "hashes", "rids", "ns", "rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "model")


def _scoring(shared, buckets: int):
    def run(rows):
        listed, (by_one, by_two, norm) = shared.value
        logs = np.log10(listed.counts + SHIFT)
        rest = math.log10(listed.rest)
        for batch in batches(rows):
            texts, rid = byte_texts(batch.column("_text")), batch.column("rid").to_numpy()
            held = np.array(batch.column("held_out").to_pylist(), bool)
            n = len(texts)
            size, known, base, model = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            far: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in chunks(texts):
                h, doc = tokens(texts[a:b])
                at, there = listed.find(h)
                w = np.where(there, listed.classes[at] if len(logs) else 0, listed.n_classes)
                one, two = _contexts(w, doc, listed.n_classes)
                fit = (by_one[one, w] + by_two[two, w] - norm[one, two]) / LN10
                own = np.where(there, logs[at] if len(logs) else 0, 0)
                outside = w == listed.n_classes
                size[a:b] = np.bincount(doc, minlength=b - a)
                known[a:b] = np.bincount(doc, weights=there, minlength=b - a)
                base[a:b] = np.bincount(doc, weights=own, minlength=b - a)
                model[a:b] = np.bincount(doc, weights=fit + np.where(outside, own - rest, 0), minlength=b - a)
                far.append((h[~there], doc[~there] + a))
            h, doc = (np.concatenate(x) for x in zip(*far, strict=True))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate((new, [len(h)]))).astype(np.int32)
            h, doc = h[new], doc[new]
            times = np.where(held[doc], times, -times).astype("<i4")  # negative: counts as training
            bucket = (mix(h) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = [k for k in range(buckets) if cut[k + 1] > cut[k]]
            parts = [order[cut[k] : cut[k + 1]] for k in used]
            none = [None] * len(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (h, rid[doc], times)), pa.array(none, pa.int64()), pa.array(none, batch.column("doc_id").type), pa.array(none, pa.bool_()), *(pa.array(none, pa.int64()) for _ in range(2)), *(pa.array(none, pa.float64()) for _ in range(2))],
                names=_FIELDS,
            )
            none = pa.array([None] * n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((mix(rid.view(U64)) % U64(buckets)).astype(np.int32)), none, none, none, pa.array(rid), batch.column("doc_id"), pa.array(held), pa.array(size), pa.array(known), pa.array(base), pa.array(model)], names=_FIELDS)

    return run


def _gather(table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(column).to_pylist() if x is not None] or [np.zeros(0, kind)])


def _resolving(buckets: int):
    """Counts of the tokens that aren't listed, summed for each document: hashes then holds the base sums, ns the known tokens."""

    def run(table):
        h, rid, n = _gather(table, "hashes", "<u8"), _gather(table, "rids", "<i8"), _gather(table, "ns", "<i4").astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, rid, n = h[order], rid[order], n[order]
        group = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1 if len(h) else h.astype(np.int64)
        c = np.bincount(group, weights=np.maximum(-n, 0))[group] if len(h) else np.zeros(0)
        rids, back = np.unique(rid, return_inverse=True)
        sums = np.bincount(back, weights=np.abs(n) * np.log10(c + SHIFT), minlength=len(rids))
        known = np.bincount(back, weights=np.abs(n) * (c > 0), minlength=len(rids)).astype("<i8")
        bucket = (mix(rids.view(U64)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = [k for k in range(buckets) if cut[k + 1] > cut[k]]
        parts = [order[cut[k] : cut[k + 1]] for k in used]
        docs = table.filter(pc.is_valid(table.column("rid")))
        columns = {"bucket": pa.array(used, pa.int32())} | {c: pa.array([x[p].tobytes() for p in parts], pa.binary()) for c, x in (("hashes", sums), ("rids", rids), ("ns", known))}
        own = pa.table({f: columns[f] if f in columns else pa.nulls(len(used), docs.schema.field(f).type) for f in _FIELDS})
        return pa.concat_tables([own.cast(docs.schema), docs])

    return run


def _finishing(total: int, distinct: int):
    def run(table):
        docs = table.filter(pc.is_valid(table.column("rid")))
        own = docs.column("rid").to_numpy()
        order = np.argsort(own)
        rid = _gather(table, "rids", "<i8")
        at = order[np.searchsorted(own[order], rid)] if len(rid) else np.zeros(0, np.int64)
        far = np.bincount(at, weights=_gather(table, "hashes", "<f8"), minlength=len(own))
        known = docs.column("n_known").to_numpy() + np.bincount(at, weights=_gather(table, "ns", "<i8"), minlength=len(own)).astype(np.int64)
        size = docs.column("n_tokens").to_numpy()
        base = docs.column("base").to_numpy() + far - size * math.log10(total + SHIFT * (distinct + 1))
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": size, "n_known": known, "train_tokens": np.full(len(own), total), "base_score": base, "score": docs.column("model").to_numpy() + far})

    return run


def score(docs: DataFrame, listed: Listed, model: LogBilinear) -> DataFrame:
    """docs: doc_id, _text (binary), held_out, with the same training rows as in fit()."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((listed, model.tables()))  # 1 MB of counts, 3 x 1,025 x 1,025 floats
    buckets = max(partitions(spark), math.ceil(listed.total / 2e6))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _SCHEMA.format(kind=kind)
    # A token outside the shortlist but not listed has the log share (far) less log10(rest), which _scoring has taken off already.
    found = docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_scoring(shared, buckets), schema)
    found = found.groupBy("bucket").applyInArrow(_resolving(buckets), schema)
    return found.groupBy("bucket").applyInArrow(_finishing(listed.total, listed.distinct), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.col("text").cast("binary").alias("_text"), (fold(F.col("doc_id"), 10) == 0).alias("held_out"))
    listed, model = fit(docs.where(~F.col("held_out")).select("_text"))
    return score(docs, listed, model)
