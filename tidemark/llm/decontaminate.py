"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words without
punctuation. A document and an item that share a seed, a run of SEED words, are
a candidate pair if their shared seeds could cover enough of the item. Tiling
then marks the longest common runs of unmarked words, found by running
Karp-Rabin with falling search lengths, over and over; an item counts as leaked
if its tiles cover at least `threshold` of its words, in whatever order they
stand in the document.

Items meet the documents in blocks of bounded size, so the benchmark may grow.
An item shorter than SEED words is its own seed; an item without words leaks
nowhere. Null texts are empty. Null ids are kept. Repeated documents or items
give a row for each pair. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, PrefixHash, Packed, batches, byte_texts, chunks, mix, runs
from .tables import kept_schema

SEED, THRESHOLD = 5, 0.5
#: Bytes of item text that are broadcast at once.
BLOCK_BYTES = 8 << 20
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = True
_IN_WORD[97:123] = True
_IN_WORD[128:] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in order, and the text of each."""
    packed = Packed([t.decode("utf-8", "replace").lower().encode("utf-8", "replace") for t in texts])
    start, end = runs(_IN_WORD[packed.buf])
    return PrefixHash(packed.buf).of(start, end), packed.doc_of(start)


def seeds(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each run of n words of one text."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    x = np.full(m, n, U64)
    for k in range(n):
        x = mix(x * U64(0x9E3779B97F4A7C15) + h[k : k + m])
    ok = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return x[ok], ok


def _longest(item: list, text: list, free_item: list[bool], free_text: list[bool], s: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal matches of at least s unmarked words, found by their rolling hashes; stops early at one of over 2 s."""
    mask, base = (1 << 61) - 1, 911382323

    def rolling(words: list, free: list[bool]) -> Iterator[tuple[int, int]]:
        high, h, run = pow(base, s - 1, mask), 0, 0
        for i, w in enumerate(words):
            if not free[i]:
                h, run = 0, 0
                continue
            if run >= s:
                h = (h - words[i - s] * high) % mask
            h = (h * base + w) % mask
            run += 1
            if run >= s:
                yield i - s + 1, h

    table = defaultdict(list)
    for i, h in rolling(text, free_text):
        table[h].append(i)
    found, longest = [], 0
    for i, h in rolling(item, free_item):
        for j in table.get(h, ()):
            n = 0
            while i + n < len(item) and j + n < len(text) and free_item[i + n] and free_text[j + n] and item[i + n] == text[j + n]:
                n += 1
            if n > 2 * s:
                return n, []
            if n >= s:
                found.append((n, i, j))
                longest = max(longest, n)
    return longest, found


def tiles(item: list, text: list, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiling: (item position, text position, length) of non-overlapping common runs of at least `least` words."""
    free_item, free_text = [True] * len(item), [True] * len(text)
    done, s = [], max(least, len(item) // 2)
    while True:
        longest, found = _longest(item, text, free_item, free_text, s)
        if longest > 2 * s:
            s = longest
            continue
        for n, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if all(free_item[i : i + n]) and all(free_text[j : j + n]):
                free_item[i : i + n] = [False] * n
                free_text[j : j + n] = [False] * n
                done.append((i, j, n))
            # what is left of an overlapped match is found again with a shorter search length
        if s > 2 * least:
            s //= 2
        elif s > least:
            s = least
        else:
            if not any(all(free_item[i : i + least]) and all(free_text[j : j + least]) for n, i, j in found if n >= least for i, j in ((i + k, j + k) for k in range(n - least + 1))):
                return done


class Items:
    """A block of benchmark items with their seeds."""

    def __init__(self, ids: list, texts: list[bytes], seed: int = SEED):
        self.ids = ids
        h, owner = tokens(texts)
        n = np.bincount(owner, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
        first = np.cumsum(n) - n
        self.words = [h[f : f + k] for f, k in zip(first, n, strict=True)]
        self.least = np.minimum(n, seed)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted(set(self.least[n > 0].tolist())):
            keep = self.least[owner] == length
            own = np.flatnonzero(keep)
            x, at = seeds(h[own], owner[own], length)
            item = owner[own][at]
            place = own[at] - first[item]
            order = np.argsort(x, kind="stable")
            self.seeds[length] = (x[order], item[order], place[order])


def _blocks(items: DataFrame) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():
        text = bytes(r["text"] or b"")
        if ids and size + len(text) > BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(text)
        size += len(text)
    if ids:
        yield Items(ids, texts)


def _tiling(shared, threshold: float, id_type: pa.DataType):
    def run(rows):
        items: Items = shared.value
        for batch in batches(rows):
            texts = byte_texts(batch.column("_text"))
            place, ids, coverage, number = [], [], [], []
            for a, b in chunks(texts):
                h, owner = tokens(texts[a:b])
                hits: dict[tuple[int, int], set] = defaultdict(set)
                for length, (known, item, at) in items.seeds.items():
                    x, position = seeds(h, owner, length)
                    low, high = np.searchsorted(known, x), np.searchsorted(known, x, side="right")
                    for k in np.flatnonzero(high > low):
                        for j in range(low[k], high[k]):
                            hits[int(owner[position[k]]), int(item[j])].add((int(at[j]), int(position[k])))
                for (doc, item), found in sorted(hits.items()):
                    words, least = items.words[item], int(items.least[item])
                    if len({i + k for i, _ in found for k in range(least)}) < threshold * len(words):
                        continue
                    # only words under a shared seed can be in a tile; a gap between them is no word
                    cover = sorted({p + k for _, p in found for k in range(least)})
                    text, last = [], None
                    for p in cover:
                        if last is not None and p != last + 1:
                            text.append(0)
                        text.append(int(h[p]))
                        last = p
                    done = tiles([int(w) for w in words], text, least)
                    if (share := sum(n for _, _, n in done) / len(words)) >= threshold:
                        place.append(a + doc)
                        ids.append(items.ids[item])
                        coverage.append(share)
                        number.append(len(done))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(place, pa.int64())), pa.array(ids, id_type), pa.array(coverage, pa.float64()), pa.array(number, pa.int32())], names=["doc_id", "item_id", "coverage", "n_tiles"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles of each document and item whose tiles cover at least `threshold` of the item."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item = "string" if kinds[1] == "string" else "bigint"
    schema = f"doc_id {kinds[0]}, item_id {item}, coverage double, n_tiles int"
    id_type = pa.string() if item == "string" else pa.int64()
    found = None
    for block in _blocks(benchmark.select(F.col("item_id").cast(item).alias("item_id"), F.col("text").cast("binary").alias("text"))):
        part = rows.mapInArrow(_tiling(spark.sparkContext.broadcast(block), threshold, id_type), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that leak no item."""
    item = "string" if benchmark.schema["item_id"].dataType.simpleString() == "string" else "long"
    items = benchmark.select(F.col("item_id").cast(item).alias("item_id"), F.col("text").cast("binary").alias("text"))
    id_type = pa.string() if item == "string" else pa.int64()
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(rows, shared=shared):
            find = _tiling(shared, threshold, id_type)
            for batch in batches(rows):
                place = pa.array(np.arange(batch.num_rows))
                leaked = [x for found in find([pa.RecordBatch.from_arrays([place, batch.column("text").cast(pa.binary())], names=["doc_id", "_text"])]) for x in found.column("doc_id").to_pylist()]
                keep = np.ones(batch.num_rows, bool)
                keep[leaked] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, kept_schema(docs, docs.columns, ""))
    return docs


def op8(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaked pair: doc_id, item_id, coverage, n_tiles."""
    return leaks(documents.select("doc_id", "text"), benchmark.select("item_id", "text"))
