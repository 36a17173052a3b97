"""Language identification by multilingual mixture inference.

A hashed byte n-gram model of each language is counted by Spark over a bounded
sample of labelled documents (`per_language` each). A document is a mixture:
expectation-maximisation over its words estimates how much of it each language
wrote, and the set of languages is the one with the best penalised likelihood.

Null text, or text without a letter, is `und` with score 0. Repeated rows give
repeated results. Empty tables give no rows. Without any labelled document
every text is `und`. Columns other than the id, text and language are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import PrefixHash, Packed, batches, byte_texts, chunks, runs, segment_sums
from .tables import fold, hash_unit, kept_schema

BUCKETS = 1 << 16
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Letters of ASCII in lower case, and every byte of a longer UTF-8 sequence.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[97:123] = True
_IN_WORD[128:] = True


def _ngrams(packed: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word of each n-gram, and the start of each word.

    N-grams are the 2- and 3-grams of a word with one byte of margin on either side.
    """
    start, end = runs(_IN_WORD[packed.buf])
    buf = np.concatenate(([10], packed.buf))
    buf = np.where(_IN_WORD[buf], buf, 32).astype(np.uint8)
    hashes = PrefixHash(buf)
    left, right = start, end + 2  # word with its margin, in buf
    grams, owners = [], []
    for n in (2, 3):
        per = np.maximum(right - left - n + 1, 0)
        owner = np.repeat(np.arange(len(start)), per)
        at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + left[owner]
        grams.append((hashes.of(at, at + n) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner)
    return np.concatenate(grams), np.concatenate(owners), start


def _lowered(texts: list[bytes]) -> list[bytes]:
    return [t.decode("utf-8", "replace").lower().encode("utf-8", "replace") for t in texts]


def _count(rows):
    """N-gram counts of each language in this partition."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches(rows):
        texts, langs = _lowered(byte_texts(batch.column("text"))), batch.column("lang").to_pylist()
        for a, b in chunks(texts, 1 << 19):
            packed = Packed(texts[a:b])
            grams, owner, start = _ngrams(packed)
            doc = packed.doc_of(start)[owner]
            names = sorted(set(langs[a:b]))
            number = np.array([names.index(x) for x in langs[a:b]], np.int64)
            counts = np.bincount(number[doc] * BUCKETS + grams, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row in zip(names, counts, strict=True):
                totals[name] = totals.get(name, 0) + row
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(totals), pa.string()), "counts": pa.array([v.astype("<f4").tobytes() for v in totals.values()], pa.binary())})


class LanguageModel:
    """Log-probabilities of n-gram buckets for each language, in name order."""

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs

    @classmethod
    def fit(cls, labelled: DataFrame, per_language: int = 2000, smoothing: float = 0.2) -> LanguageModel:
        """labelled: doc_id, text, lang. Uses about `per_language` documents of each language, chosen by a hash of the id."""
        rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
        if not sizes:
            return cls([], np.zeros((0, BUCKETS), np.float32))
        share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
        sample = rows.where(hash_unit(F.col("doc_id"), 4) < share[F.col("lang")]).select(F.col("text").cast("binary").alias("text"), "lang").repartition(8)
        counts: dict[str, np.ndarray] = {}
        for r in sample.mapInArrow(_count, "lang string, counts binary").collect():
            counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(r["counts"], "<f4").astype(np.float64)
        names = sorted(counts)
        table = np.stack([counts[x] for x in names]) + smoothing
        return cls(names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))

    def proportions(self, texts: list[bytes], rounds: int = 6, penalty: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
        """The mixture of each document (rows sum to 1, or 0 without words), and how many languages were selected."""
        n, k = len(texts), len(self.names)
        packed = Packed(_lowered(texts))
        grams, owner, start = _ngrams(packed)
        doc = packed.doc_of(start)
        size = np.bincount(doc, minlength=n).astype(np.float64)
        likelihood = np.empty((len(start), k))
        for j in range(k):
            likelihood[:, j] = np.bincount(owner, weights=self.logs[j][grams], minlength=len(start)) if len(start) else 0
        top = likelihood.max(1, keepdims=True) if len(start) else likelihood[:, :1]
        likelihood = np.exp(np.maximum(likelihood - top, -30)).astype(np.float32)
        base = segment_sums(top[:, 0], doc, n)

        def improve(shares: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(times):
                part = likelihood * shares[doc].astype(np.float32)
                total = part.sum(1)
                shares = segment_sums(part / total[:, None], doc, n) / np.maximum(size, 1)[:, None]
            total = (likelihood * shares[doc].astype(np.float32)).sum(1)
            return shares, base + segment_sums(np.log(np.maximum(total, 1e-30)), doc, n)

        shares, _ = improve(np.full((n, k), 1 / k), rounds)
        order = np.argsort(-shares, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        best, chosen, used = np.full(n, -np.inf), np.zeros((n, k)), np.zeros(n, np.int64)
        for m in range(1, k + 1):
            mask = rank < m
            begin = np.where(mask, shares + 1e-6, 0)
            fitted, fit = improve(begin / begin.sum(1, keepdims=True), 0 if m == 1 else 2)
            fit = fit - penalty * (m - 1) * (1.0 + 0.5 * np.log(np.maximum(size, 1)))
            better = fit > best
            best[better], chosen[better], used[better] = fit[better], fitted[better], m
        chosen[size == 0] = 0
        return chosen, used


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """The columns named in `keep`, then lang_pred, score (its share of the document), n_langs and mixture."""
    keep = ["doc_id"] if keep is None else keep
    names, logs = model.names, model.logs
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # languages x 65,536 floats

    def run(rows):
        own = LanguageModel(names, shared.value)
        for batch in batches(rows):
            texts = byte_texts(batch.column("_text"))
            pred, score, used, mixture = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int32), [None] * len(texts)
            for a, b in chunks(texts, 1 << 19) if names else ():
                shares, number = own.proportions(texts[a:b])
                top = shares.argmax(1)
                for i in np.flatnonzero(shares.max(1) > 0):
                    if _LETTER.search(texts[a + i].decode("utf-8", "replace")):
                        pred[a + i], score[a + i], used[a + i] = names[top[i]], min(1.0, shares[i, top[i]]), number[i]
                        mixture[a + i] = [(names[j], float(shares[i, j])) for j in np.flatnonzero(shares[i] > 0.01)]
            columns = [batch.column(c) for c in keep]
            more = [pa.array(pred, pa.string()), pa.array(score), pa.array(used), pa.array(mixture, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns + more, names=[*keep, "lang_pred", "score", "n_langs", "mixture"])

    schema = kept_schema(docs, keep, "lang_pred string, score double, n_langs int, mixture map<string,double>")
    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema)


def op4(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_langs."""
    docs = documents.select("doc_id", "text", "lang")
    model = LanguageModel.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "n_langs")
