"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over
hashed words and word beginnings; the document's probability is their
noisy-or. Only document labels are given, and the gradient of the noisy-or
shares the blame among sentences, which also locates the offending ones.

The classifier is fitted on at most about `per_class` labelled documents of
each label, chosen by a hash of the id. Null text is empty; an empty text is
one sentence without words. Null or other labels are not learned from.
Repeated rows give repeated results, empty tables none. Without both labels
the score is 0 everywhere. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import PrefixHash, Packed, batches, byte_texts, chunks, runs
from .tables import fold, hash_unit

BUCKETS = 1 << 18
#: Bytes of a word's beginning that are features besides the whole word.
PREFIXES = (4, 5, 6)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[97:123] = True
_IN_WORD[48:58] = True
_IN_WORD[128:] = True
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True  # line feed ! . ?


def _lowered(texts: list[bytes]) -> list[bytes]:
    return [t.decode("utf-8", "replace").lower().encode("utf-8", "replace") for t in texts]


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (words x 4), sentence of each word, document of each sentence, byte offset of each sentence in its document.

    Every document has at least one sentence.
    """
    packed = Packed(texts)
    start, end = runs(_IN_WORD[packed.buf])
    doc = packed.doc_of(start)
    stops = np.concatenate(([0], np.cumsum(_ENDS[packed.buf])))
    key = stops[start]
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    sent_doc, sent_at = doc[new], start[new] - packed.starts[doc[new]]
    empty = np.setdiff1d(np.arange(packed.count), sent_doc)
    sent_doc, sent_at = np.concatenate((sent_doc, empty)), np.concatenate((sent_at, np.zeros(len(empty), np.int64)))
    hashes = PrefixHash(packed.buf)
    features = np.empty((len(start), 1 + len(PREFIXES)), np.int32)
    features[:, 0] = hashes.of(start, end) % np.uint64(BUCKETS)
    for k, n in enumerate(PREFIXES, 1):
        features[:, k] = (hashes.of(start, np.minimum(start + n, end)) + np.uint64(k)) % np.uint64(BUCKETS)
    return features, sentence, sent_doc, sent_at


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float, known: bool = True):
        self.weights, self.bias, self.known = weights, bias, known

    @classmethod
    def train(cls, texts: list[bytes], labels: np.ndarray, epochs: int = 80, rate: float = 0.2, decay: float = 1e-4, least: float = 4.0) -> ToxicityModel:
        """Adam on the noisy-or likelihood with an L2 penalty; features whose share of documents differs between the labels by fewer than `least` standard errors have no weight."""
        if len(set(labels.tolist())) < 2:
            return cls(np.zeros(BUCKETS, np.float32), -30.0, False)
        n_doc, share = len(texts), labels.mean()
        seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for a, b in chunks(texts):
            features, sentence, sent_doc, _ = sentences(_lowered(texts[a:b]))
            pairs = np.unique(np.repeat(sent_doc[sentence], features.shape[1]).astype(np.int64) * BUCKETS + features.ravel())
            seen += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            toxic += np.bincount(pairs % BUCKETS, weights=labels[a:b][pairs // BUCKETS], minlength=BUCKETS)
        error = np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / n_doc), 0.25))
        present = np.flatnonzero((seen >= 4) & (np.abs(toxic - seen * share) >= least * error))
        number = np.full(BUCKETS, len(present), np.int32)  # the last is for all others
        number[present] = np.arange(len(present))
        kept, n_feat, n_sent = [], len(present) + 1, 0
        for a, b in chunks(texts):
            features, sentence, sent_doc, _ = sentences(_lowered(texts[a:b]))
            features = number[features]
            useful = (features < len(present)).any(1)
            kept.append((features[useful], sentence[useful] + n_sent, sent_doc + a))
            n_sent += len(sent_doc)
        features, sentence, sent_doc = (np.concatenate(x) for x in zip(*kept, strict=True))
        weights, bias = np.zeros(n_feat), -5.0
        m, v, mb, vb = np.zeros(n_feat), np.zeros(n_feat), 0.0, 0.0
        for step in range(1, epochs + 1):
            z = np.bincount(sentence, weights=weights[features].sum(1), minlength=n_sent) + bias
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            keep = np.exp(np.maximum(np.bincount(sent_doc, weights=np.log1p(-np.minimum(q, 1 - 1e-9)), minlength=n_doc), -30))
            p = np.maximum(1 - keep, 1e-9)
            slope = np.where(labels == 1, keep / p, -1.0)[sent_doc] * q
            g = np.bincount(features.ravel(), weights=np.repeat(slope[sentence], features.shape[1]), minlength=n_feat) - decay * n_doc * weights
            g[-1] = 0
            gb = slope.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            up, down = 1 - 0.9**step, 1 - 0.99**step
            weights += rate * (m / up) / (np.sqrt(v / down) + 1e-6)
            bias += rate * (mb / up) / (np.sqrt(vb / down) + 1e-6)
        table = np.zeros(BUCKETS, np.float32)
        table[present] = weights[:-1]
        return cls(table, float(bias))

    @classmethod
    def fit(cls, documents: DataFrame, marks: DataFrame, per_class: int = 3000) -> ToxicityModel:
        """documents: doc_id, text. marks: doc_id, toxic, one row per id."""
        rows = marks.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if len(sizes) < 2:
            return cls(np.zeros(BUCKETS, np.float32), -30.0, False)
        share = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
        chosen = rows.where(hash_unit(F.col("doc_id"), 7) < share).select("doc_id", "toxic")  # about 2 x per_class rows: may be broadcast
        sample = documents.join(F.broadcast(chosen), "doc_id").select(F.col("text").cast("binary").alias("text"), "toxic").toPandas()
        return cls.train([bytes(t) if t is not None else b"" for t in sample["text"]], sample["toxic"].to_numpy(np.int64))

    def sentence_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability, document and byte offset of each sentence."""
        features, sentence, sent_doc, sent_at = sentences(_lowered(texts))
        z = np.bincount(sentence, weights=self.weights[features].sum(1), minlength=len(sent_doc)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), sent_doc, sent_at

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: the noisy-or, the worst sentence's offset and its probability."""
        q, doc, at = self.sentence_scores(texts)
        p = 1 - np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(q, 1 - 1e-12)), minlength=len(texts)))
        order = np.lexsort((-at, q, doc))
        last = np.searchsorted(doc[order], np.arange(len(texts)), side="right") - 1
        return np.clip(p, 0, 1), at[order][last], q[order][last]


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, worst_offset (byte where the worst sentence begins) and worst_score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.known))  # 262,144 floats

    def run(rows):
        own = ToxicityModel(*shared.value)
        for batch in batches(rows):
            texts = byte_texts(batch.column("_text"))
            parts = [own.score(texts[a:b]) for a, b in chunks(texts, 1 << 20)]
            score, at, worst = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not own.known:
                score, worst = score * 0, worst * 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(at), pa.array(worst)], names=["doc_id", "score", "worst_offset", "worst_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("_text")).mapInArrow(run, f"doc_id {kind}, score double, worst_offset long, worst_score double")


def op7(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, worst_offset, worst_score."""
    docs = documents.select("doc_id", "text")
    marks = labels.where(fold(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = ToxicityModel.fit(docs, marks)
    out = score_toxicity(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "worst_offset", "worst_score")
