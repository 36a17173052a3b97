"""Near-duplicate documents by a MinHash LSH forest.

A document's set is its distinct shingles of `size` lower-cased words. Equal
sets, by a BLAKE2b digest of the whole set, are one class. Each class representative has TREES signatures of DEPTH
minimum hashes. A tree is the order of its signatures: documents that share a
prefix of BASE values form a region, and inside it neighbours in sorted order,
which have the longest common prefixes, are candidates. A region of more than
DENSE documents is taken one value deeper, dealt into salted parts, and every
document of it is a candidate with the first of the region at either depth, so
no region meets in one task and no region emits all its pairs. Candidates are
confirmed on the full sets, first those of a few trees; in the other trees one
document stands for its component in a region, so that only candidates that
would join components still apart are made.

What the forest misses is found exactly. Take a set's shingles in a circle, in
the order of their hashes: each with the next is a link of its chain. A shingle
that one of two sets lacks breaks two links of the other's chain and one of its
own side's, so sets of similarity t share at least (2 t - 1) n links of the n of
either, and hence one of the first n - (2 t - 1) n + 1 in any one order of all
links (for t of a half or less single shingles take the links' place). The
order takes seldom shingles first, as far as a sample tells. Two unrelated sets
seldom share a link, so that the work grows with the corpus. Long sets would,
and no bitmap tells them apart: they are cut by ranges of the hash into segments
of about SEGMENT shingles, which are chained, paired and told apart by
themselves. Of two sets that are alike enough one segment at least is, as the
sums of the segments' intersections and unions are those of the sets; sets of
unlike size are cut alike at the level of the smaller one (of all levels that
a set alike enough may have). Segments of different
components that share a link are paired, those outside a link's largest component
in blocks of BLOCK with all, and pairs that a bound on the segments' intersection doesn't rule out are
confirmed on the full sets.

Null text, and text without words, has an empty set and is linked with nothing.
A null id takes no part: its component is null and it is kept. Rows with equal
ids are one vertex. Repeated rows give repeated results; empty tables give
none. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import ASCII_LOWER, U64, PrefixHash, Packed, batches, byte_texts, chunks, mix, words
from .tables import hash_unit, materialise, partitions

TREES, DEPTH, BASE, DENSE, FIRST_TREES = 20, 8, 4, 64, 3
#: Bits of a set's parity bitmap, documents of a block, buckets of the sampled shingle counts (a byte each) and documents sampled.
BITS, BLOCK, COUNTED, SAMPLED = 1024, 1024, 1 << 22, 20000
#: A set of 2**k times as many shingles and more (less than twice that) is cut into 2**k segments.
SEGMENT = 512
#: Sets of one link in a batch that meet in its bucket (more are known to be several), and links of a bucket.
HOT_BATCH, BUCKET_LINKS = 256, 500_000
#: Edges that a task brings together before rounds of stars begin.
CONTRACTED = 1 << 20
_RNG = np.random.default_rng(97)
_MULTIPLY = _RNG.integers(1, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes ordered by document, their documents, and the number of each document.

    Fewer than `size` words are one shingle; no words, none.
    """
    packed = Packed(texts)
    lower = ASCII_LOWER[packed.buf]
    start, end = words(lower)
    doc = packed.doc_of(start)
    h = PrefixHash(lower).of(start, end)
    n = np.bincount(doc, minlength=packed.count)
    first = np.cumsum(n) - n
    full = np.zeros(len(h), U64)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(h) >= size:
        m = len(h) - size + 1
        full = np.full(m, size, U64)
        for k in range(size):
            full = mix(full * U64(0x9E3779B97F4A7C15) + h[k : k + m])
        ok = doc[:m] == doc[size - 1 :]
        full, owner = full[ok], doc[:m][ok]
    else:
        full, owner = full[:0], doc[:0]
    extra = np.array([np.bitwise_xor.reduce(mix(h[first[d] : first[d] + n[d]] + np.arange(n[d], dtype=U64))) ^ U64(n[d]) for d in short], U64)
    full, owner = np.concatenate((full, extra)), np.concatenate((owner, short))
    order = np.lexsort((full, owner))
    full, owner = full[order], owner[order]
    new = np.concatenate(([True], (full[1:] != full[:-1]) | (owner[1:] != owner[:-1]))) if len(full) else np.zeros(0, bool)
    full, owner = full[new], owner[new]
    return full, owner, np.bincount(owner, minlength=packed.count)


def _signatures(full: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum hashes (rows: sets that begin at `starts`)."""
    x = (full >> U64(32)).astype(np.uint32)
    out = np.empty((len(starts), TREES * DEPTH), np.uint32)
    for j in range(TREES * DEPTH):
        y = x * _MULTIPLY[j] + _ADD[j]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(12)
        out[:, j] = np.minimum.reduceat(y, starts)
    return out


def _bitmaps(full: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A row of BITS bits for each of n sets: the parity of how many shingles fall on each bit."""
    out = np.zeros(n * BITS // 8, np.uint8)
    at = (mix(full + U64(0x6A09E667)) % U64(BITS)).astype(np.int64) + owner * BITS
    np.bitwise_xor.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return out.reshape(n, BITS // 8)


def _digests(full: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two words of digest for each set that has shingles."""
    ends = np.cumsum(n)
    sums = [hashlib.blake2b(full[b - k : b], digest_size=16).digest() for k, b in zip(n.tolist(), ends.tolist(), strict=True) if k]
    return np.frombuffer(b"".join(sums), "<u8").reshape(-1, 2)


def segments(full: np.ndarray, owner: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles by segment (in order of owner, level and hash) and their segments; the segments' owners and names (level and number).

    A set is cut at its own level and at that of the smallest set that is alike enough.
    """
    level = lambda m: np.maximum(np.frexp(np.maximum(m, 1) / SEGMENT)[1].astype(np.int64) - 1, 0)
    low, high = level((percent * n + 99) // 100), level(n)
    shingle, of, name = [], [], []
    for k in range(int(low.min(initial=0)), int(high.max(initial=0)) + 1):
        at = (low[owner] <= k) & (k <= high[owner])
        shingle.append(full[at])
        of.append(owner[at])
        number = full[at] >> U64(64 - k) if k else np.zeros(int(at.sum()), U64)
        name.append((U64(1) << U64(k)) + number)
    shingle, of, name = np.concatenate(shingle), np.concatenate(of), np.concatenate(name)
    order = np.lexsort((shingle, name, of))
    shingle, of, name = shingle[order], of[order], name[order]
    new = np.concatenate((np.ones(min(len(of), 1), bool), (of[1:] != of[:-1]) | (name[1:] != name[:-1])))
    return shingle, np.cumsum(new) - 1, of[new], name[new]


def _named(digest: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The segment's identity: that of the set and the segment's name; an uncut set's is its digest."""
    return np.where(name == 1, digest, mix(digest + mix(name)))


def _sets(size: int, percent: int):
    """doc_id, n_shingles, digest of the set (d1, d2), of its segments identity, size and bitmap, and for each tree the region and the order of the rest of the signature."""

    def run(rows):
        for batch in batches(rows):
            texts = byte_texts(batch.column("_text"))
            total = len(texts)
            count, d1, d2 = np.zeros(total, np.int64), np.zeros(total, U64), np.zeros(total, U64)
            region, fifth, rest = (np.zeros((total, TREES), np.int64) for _ in range(3))
            parts = [np.zeros(0, np.int64)] * total
            sizes, bits = [np.zeros(0, np.int64)] * total, [[]] * total
            for a, b in chunks(texts):
                full, owner, n = shingles(texts[a:b], size)
                count[a:b] = n
                if not len(full):
                    continue
                have = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[have]
                d1[a + have], d2[a + have] = _digests(full, n).T
                shingle, segment, of, name = segments(full, owner, n, percent)
                identity, m, maps = _named(d1[a + of], name).view(np.int64), np.bincount(segment), _bitmaps(shingle, segment, len(of))
                cut = np.searchsorted(of, np.arange(b - a + 1))
                for i in have.tolist():
                    x, y = cut[i], cut[i + 1]
                    parts[a + i], sizes[a + i], bits[a + i] = identity[x:y], m[x:y], [z.tobytes() for z in maps[x:y]]
                sig = _signatures(full, starts).reshape(len(have), TREES, DEPTH).astype(U64)
                key = np.zeros((len(have), TREES), U64)
                for k in range(BASE):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, :, k])
                region[a + have] = key.view(np.int64)
                fifth[a + have] = sig[:, :, BASE].astype(np.int64)
                rest[a + have] = ((sig[:, :, BASE + 1] << U64(31)) | (sig[:, :, BASE + 2] >> U64(1))).astype(np.int64)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), TREES).cast(pa.list_(pa.int64())) for x in (region, fifth, rest)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(parts, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.binary())), *lists], names=["doc_id", "n_shingles", "d1", "d2", "part", "size", "bits", "region", "fifth", "rest"])

    return run


def _confirm(size: int, percent: int):
    """Pairs of which 100 x intersection is at least percent x union."""

    def run(rows):
        for batch in batches(rows):
            left, right = byte_texts(batch.column("text_a")), byte_texts(batch.column("text_b"))
            linked = np.zeros(len(left), bool)
            for a, b in chunks([x + y for x, y in zip(left, right, strict=True)]):
                one, own1, n1 = shingles(left[a:b], size)
                two, own2, n2 = shingles(right[a:b], size)
                h, owner = np.concatenate((one, two)), np.concatenate((own1, own2))
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                both = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=b - a)
                linked[a:b] = (100 * both >= percent * (n1 + n2 - both)) & (both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("lo").filter(pa.array(linked)), batch.column("hi").filter(pa.array(linked))], names=["lo", "hi"])

    return run


def _frequencies(size: int):
    """Shingles of this partition by bucket of their hash, 255 at most."""

    def run(rows):
        total = np.zeros(COUNTED, np.uint32)
        for batch in batches(rows):
            texts = byte_texts(batch.column("_text"))
            for a, b in chunks(texts):
                total += np.bincount((shingles(texts[a:b], size)[0] % U64(COUNTED)).astype(np.int64), minlength=COUNTED).astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"counts": [np.minimum(total, 255).astype(np.uint8).tobytes()]})

    return run


def links(full: np.ndarray, owner: np.ndarray, n: np.ndarray, percent: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and owners of the links of which two sets that are alike enough share one. full is ordered by owner."""
    first = np.cumsum(n) - n
    rarity = counts[(full % U64(COUNTED)).astype(np.int64)]
    if percent > 50:
        following = np.arange(1, len(full) + 1)
        following[(first + n - 1)[n > 0]] = first[n > 0]
        key, shared = mix(full * U64(0x9E3779B97F4A7C15) + mix(full[following])), ((2 * percent - 100) * n + 99) // 100
        rarity = np.minimum(rarity, rarity[following])
    else:
        key, shared = full, (percent * n + 99) // 100
    order = np.lexsort((key, rarity, owner))
    chosen = order[np.arange(len(full)) - first[owner] < (n - np.maximum(shared, 1) + 1)[owner]]
    return key[chosen], owner[chosen]


def _linked(size: int, percent: int, shared, buckets: int):
    """Links with the identities of their segments, by bucket; of a link with very many segments the further ones go straight on (over)."""

    def run(rows):
        counts = shared.value
        for batch in batches(rows):
            texts = byte_texts(batch.column("_text"))
            keys, digests = [], []
            for a, b in chunks(texts):
                full, owner, n = shingles(texts[a:b], size)
                if len(full):
                    digest = _digests(full, n)[np.cumsum(n > 0) - 1, 0]
                    shingle, segment, of, name = segments(full, owner, n, percent)
                    key, at = links(shingle, segment, np.bincount(segment), percent, counts)
                    # segments of one name only meet
                    keys.append(np.where(name[at] == 1, key, mix(key + mix(name[at]))))
                    digests.append(_named(digest[of], name)[at])
            if not keys:
                continue
            key, digest = _distinct(np.concatenate(keys), np.concatenate(digests))
            over = np.arange(len(key)) - np.searchsorted(key, key) >= HOT_BATCH
            for far in (False, True):
                k, d = key[over == far], digest[over == far]
                bucket = (mix(d if far else k) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero(cut[1:] > cut[:-1])
                parts = [order[cut[i] : cut[i + 1]] for i in used]
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([far] * len(used), pa.bool_()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (k, d))], names=["bucket", "over", "keys", "digests"])

    return run


def _distinct(key: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In order of key, each set of a link once."""
    order = np.lexsort((digest, key))
    key, digest = key[order], digest[order]
    new = np.concatenate((np.ones(min(len(key), 1), bool), (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
    return key[new], digest[new]


def _several(table):
    """key and part of links that more than one segment has."""
    over = pc.fill_null(table.column("over"), False)
    near, far = ([np.frombuffer(b"".join(part.column(c).to_pylist()), "<u8") for c in ("keys", "digests")] for part in (table.filter(pc.invert(over)), table.filter(over)))
    key, digest = _distinct(*near)
    keep = np.searchsorted(key, key, side="right") - np.searchsorted(key, key) > 1
    return pa.table({"key": np.concatenate((key[keep], far[0])).view(np.int64), "part": np.concatenate((digest[keep], far[1])).view(np.int64)})


def _paired(percent: int):
    """Pairs of one link and cell, left with right, of different components, that size and bitmaps don't rule out."""

    def run(table):
        table = table.combine_chunks().sort_by([("key", "ascending"), ("one", "ascending"), ("two", "ascending"), ("side", "ascending")])
        key, one, two, side, n = (table.column(c).to_numpy() for c in ("key", "one", "two", "side", "size"))
        other = table.column("other").to_numpy(zero_copy_only=False)
        comp = table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        ids = table.column("rep").combine_chunks().dictionary_encode()
        doc = ids.indices.to_numpy().astype(np.int64)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(len(key), BITS // 64)
        cell = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])))) - 1
        right = np.flatnonzero(side == 1)
        begin, end = (np.searchsorted(cell[right], np.arange(cell[-1] + 1), side=s) for s in ("left", "right"))
        left = np.flatnonzero(side == 0)
        times = (end - begin)[cell[left]]
        total, found, i = np.cumsum(times), [np.zeros(0, np.int64)], 0
        while i < len(left):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 16), side="right")))
            y = np.repeat(left[i:j], times[i:j])
            x = right[np.repeat(begin[cell[left[i:j]]], times[i:j]) + np.arange(len(y)) - np.repeat(np.cumsum(times[i:j]) - times[i:j], times[i:j])]
            ok = (comp[x] != comp[y]) & (~other[x] | (doc[x] > doc[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            # sets differ in at least as many shingles as their bitmaps in bits
            both = (n[x] + n[y] - np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)) // 2
            ok = 100 * both >= percent * (n[x] + n[y] - both)
            x, y = doc[x[ok]], doc[y[ok]]
            found.append(np.unique(np.minimum(x, y) * len(key) + np.maximum(x, y)))
            i = j
        pair = np.unique(np.concatenate(found))
        return pa.table({"a": ids.dictionary.take(pa.array(pair // max(len(key), 1))), "b": ids.dictionary.take(pa.array(pair % max(len(key), 1)))})

    return run


def _spanning(rows):
    """Edges (lo, hi) from the smallest vertex of each component to its others, of CONTRACTED edges at a time."""
    held, size = [], 0
    for batch in rows:
        held.append(batch)
        size += batch.num_rows
        if size >= CONTRACTED:
            yield _stars(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield _stars(pa.Table.from_batches(held))


def _stars(edges: pa.Table) -> pa.RecordBatch:
    """The components of these edges as stars, each around its smallest vertex."""
    ends = pa.concat_arrays([c for name in ("lo", "hi") for c in edges.column(name).chunks])
    vertices = pc.unique(ends)
    vertices = vertices.take(pc.sort_indices(vertices))
    a, b = pc.index_in(ends, vertices).to_numpy().astype(np.int64).reshape(2, -1)
    least = np.arange(len(vertices))
    while True:
        x, y = least[a], least[b]
        new, m = least.copy(), np.minimum(x, y)
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if np.array_equal(new, least):
            break
        least = new
    rest = np.flatnonzero(least != np.arange(len(least)))
    return pa.RecordBatch.from_arrays([vertices.take(pa.array(least[rest])), vertices.take(pa.array(rest))], names=["lo", "hi"])


def _ends(edges: DataFrame) -> DataFrame:
    """v, u: each edge from both its ends."""
    return edges.select(F.col("lo").alias("v"), F.col("hi").alias("u")).unionByName(edges.select(F.col("hi").alias("v"), F.col("lo").alias("u")))


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (smallest vertex) of all vertices with an edge (lo, hi): stars of the edges in each task's hands, then alternating large and small stars until only stars are left.

    Joins are merged: a broadcast, a thread of the driver each, would be one more for each of many rounds.
    """
    kind = edges.schema["lo"].dataType.simpleString()
    edges = edges.where(F.col("lo") != F.col("hi")).select("lo", "hi")
    edges = materialise(edges.mapInArrow(_spanning, f"lo {kind}, hi {kind}"), clean=True)
    while True:
        # large star: every larger neighbour of v moves to the smallest of v and its neighbours
        both = _ends(edges)
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least.hint("merge"), "v").where(F.col("u") > F.col("v")).select(F.col("m").alias("lo"), F.col("u").alias("hi")).where("lo != hi")
        # small star: v and its smaller neighbours move to the smallest of them; one shuffle by v serves all of it
        large = large.repartition("hi").distinct()
        small = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")).hint("merge"), "hi")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("hi")))).alias("x")).select("x.*")
        edges = materialise(small.where("lo != hi").distinct(), clean=True)
        # a vertex of a star is either its middle or the larger end of one edge
        ends = _ends(edges).groupBy("v").agg(F.count("*").alias("n"), F.sum(F.when(F.col("u") < F.col("v"), 1).otherwise(0)).alias("above"))
        if ends.where("above > 0 AND n > 1").isEmpty():
            break
    return edges.select(F.col("hi").alias("vertex"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct())


def apart_only(forest: DataFrame) -> DataFrame:
    """One document of each component in each region, and regions of several components only, as a table. forest: also comp."""
    mixed = forest.groupBy("tree", "region").agg(F.min("comp").alias("_least"), F.max("comp").alias("_most")).where("_least != _most").select("tree", "region")
    one = forest.join(mixed.hint("merge"), ["tree", "region"]).groupBy("tree", "region", "comp").agg(F.min(F.struct("doc_id", "fifth", "rest")).alias("x"))
    return materialise(one.select("x.doc_id", "tree", "region", "x.fifth", "x.rest"), clean=True)


def candidates(forest: DataFrame) -> DataFrame:
    """lo, hi: pairs that are neighbours in some tree, or a document of a dense region and a leader of it. forest: doc_id, tree, region, fifth, rest.

    The documents of shared regions are a table: three branches read them, and a plan that holds their joins in each is
    kept by the driver, with all its metrics, as often as one of its stages ends.
    """
    sizes = forest.groupBy("tree", "region").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).where("n > 1")
    shared = materialise(forest.join(sizes.hint("merge"), ["tree", "region"]), clean=True)
    sparse, dense = shared.where(F.col("n") <= DENSE), shared.where(F.col("n") > DENSE)
    w = Window.partitionBy("tree", "region").orderBy("fifth", "rest", "doc_id")
    near = sparse.select("doc_id", F.lag("doc_id", 1).over(w).alias("p1"), F.lag("doc_id", 2).over(w).alias("p2"))
    near = near.select(F.col("doc_id").alias("a"), F.explode(F.array("p1", "p2")).alias("b"))
    # a dense region one value deeper, in parts of about DENSE documents
    deeper = dense.groupBy("tree", "region", "fifth").agg(F.count("*").alias("m"), F.min("doc_id").alias("second"))
    parts = dense.join(deeper.hint("merge"), ["tree", "region", "fifth"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / DENSE)))
    w = Window.partitionBy("tree", "region", "fifth", "part").orderBy("rest", "doc_id")
    chained = parts.select("doc_id", "leader", "second", F.lag("doc_id", 1).over(w).alias("p1"), F.lag("doc_id", 2).over(w).alias("p2"))
    # each partner once, and only one that there is
    partners = F.array_except(F.array("leader", "second", "p1", "p2"), F.array(F.col("doc_id"), F.lit(None)))
    chained = chained.select(F.col("doc_id").alias("a"), F.explode(partners).alias("b"))
    pairs = near.unionByName(chained).where(F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def _block(table: pa.Table) -> pa.Table:
    """The words of one block in their places."""
    word, out = table.column("word").to_numpy(), np.zeros(1024, np.int64)
    out[word & 1023] = table.column("value").to_numpy()
    return pa.table({"block": [int(word[0]) >> 10], "words": [out.tobytes()]})


def _perhaps(ids: DataFrame, bits: int = 1 << 24):
    """A condition on a column of ids: false only for ids that aren't in `ids`.

    A Bloom filter of fixed size (2 MB, so it may be broadcast) with three places an id, put together by an aggregation over
    its 262,144 words. With more ids it lets more rows through, which the join after it removes; it only saves moving texts
    that no candidate needs.
    """
    places = F.array(*(F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(bits)) for k in (1, 2, 3)))
    words = ids.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("value"))
    filled = np.zeros(bits // 64, np.int64)
    # the driver gets 256 blocks of 1,024 words at most, not a row for each, and in one job
    for r in words.groupBy(F.shiftright("word", 10).alias("block")).applyInArrow(_block, "block long, words binary").collect():
        filled[r["block"] << 10 : (r["block"] + 1) << 10] = np.frombuffer(r["words"], np.int64)
    shared = ids.sparkSession.sparkContext.broadcast(filled.view(U64))

    @F.pandas_udf("boolean")
    def there(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        at = np.stack([x.to_numpy(np.int64) for x in (a, b, c)])
        return pd.Series(((shared.value[at >> 6] >> (at & 63).astype(U64)) & U64(1)).all(0))

    return there(*(places[k] for k in range(3)))


def missed(rows: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """lo, hi: every pair in different components that can be alike enough.

    rows: doc_id, _text. reps: rep, comp, n_shingles, part, size, bits (arrays: of each segment) of one row of each class.
    """
    spark, kind = rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    state = reps.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).first()
    share = SAMPLED / max(state["n"], SAMPLED)
    counts = np.zeros(COUNTED, np.uint16)
    # a bounded sample: SAMPLED rows, four tables of counts
    for r in rows.where(hash_unit(F.col("doc_id"), 17) < share).repartition(4).mapInArrow(_frequencies(size), "counts binary").toLocalIterator():
        counts += np.frombuffer(r["counts"], np.uint8)
    shared = spark.sparkContext.broadcast(np.minimum(counts, 255).astype(np.uint8))
    buckets = max(partitions(spark), -(-int(state["s"] or 0) // BUCKET_LINKS))
    entries = rows.where("doc_id IS NOT NULL").mapInArrow(_linked(size, percent, shared, buckets), "bucket int, over boolean, keys binary, digests binary")
    several = materialise(entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_several, "key long, part long"), clean=True)
    cut = reps.select("rep", "comp", F.explode(F.arrays_zip("part", "size", "bits")).alias("x")).select("rep", "comp", "x.*")
    tagged = materialise(several.join(cut.select("part", "rep", "comp").hint("merge"), "part").select("key", "part", "rep", "comp"), clean=True)
    mixed = tagged.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.max("m").alias("most"), F.max_by("comp", "m").alias("largest"), F.count("*").alias("k")).where("k > 1").drop("k")
    dealt = tagged.join(mixed.hint("merge"), "key").withColumn("other", F.col("comp") != F.col("largest"))
    all_blocks, other_blocks = F.ceil(F.col("m") / BLOCK), F.ceil((F.col("m") - F.col("most")) / BLOCK)
    # cell (one, two): the others of block two on the left, all of block one on the right
    right = F.transform(F.sequence(F.lit(0).cast("long"), other_blocks - 1), lambda x: F.struct(F.lit(1).alias("side"), F.pmod(F.xxhash64("rep"), all_blocks).alias("one"), x.alias("two")))
    left = F.transform(F.sequence(F.lit(0).cast("long"), all_blocks - 1), lambda x: F.struct(F.lit(0).alias("side"), x.alias("one"), F.pmod(F.xxhash64("rep", F.lit(5)), other_blocks).alias("two")))
    cells = dealt.select("key", "part", "rep", "comp", "other", F.explode(F.concat(right, F.when(F.col("other"), left).otherwise(F.slice(left, 1, 0)))).alias("x")).select("key", "part", "rep", "comp", "other", "x.*")
    cells = materialise(cells, clean=True)
    buckets = max(partitions(spark), -(-cells.count() // 10000))
    full = cells.join(cut.select("part", "rep", "size", "bits").hint("merge"), ["part", "rep"]).drop("part").withColumn("bucket", F.pmod(F.xxhash64("key", "one", "two"), F.lit(buckets)).cast("int"))
    pairs = full.groupBy("bucket").applyInArrow(_paired(percent), f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = materialise(rows.mapInArrow(_sets(size, percent), f"doc_id {kind}, n_shingles long, d1 long, d2 long, part array<long>, size array<long>, bits array<binary>, region array<long>, fifth array<long>, rest array<long>"))
    sets = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    digest = ["d1", "d2", "n_shingles"]
    classes = sets.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    ids = materialise(classes.select(F.col("rep").alias("doc_id")).distinct(), clean=True)

    def forest(known: DataFrame, begin: int, end: int) -> DataFrame:
        """Trees begin .. end - 1 of the representatives, with the columns of `known` (unique doc_id)."""
        some = sets.select("doc_id", *(F.slice(c, begin + 1, end - begin).alias(c) for c in ("region", "fifth", "rest"))).join(known.hint("merge"), "doc_id")
        more = [c for c in known.columns if c != "doc_id"]
        out = some.select("doc_id", *more, F.posexplode(F.arrays_zip("region", "fifth", "rest")).alias("_at", "x"))
        return out.select("doc_id", *more, (F.col("_at") + begin).alias("tree"), "x.region", "x.fifth", "x.rest")

    def confirmed(some: DataFrame) -> DataFrame:
        ids = materialise(some.select(F.explode(F.array("lo", "hi")).alias("doc_id")).distinct(), clean=True)
        texts = materialise(rows.where(_perhaps(ids)).join(ids.hint("merge"), "doc_id", "left_semi"), clean=True)
        left, right = (texts.select(F.col("doc_id").alias(c), F.col("_text").alias(f"text_{x}")) for c, x in (("lo", "a"), ("hi", "b")))
        return materialise(some.select("lo", "hi").join(left.hint("merge"), "lo").join(right.hint("merge"), "hi").mapInArrow(_confirm(size, percent), f"lo {kind}, hi {kind}"), clean=True)

    def with_component(joined: DataFrame) -> DataFrame:
        return ids.join(joined.withColumnRenamed("vertex", "doc_id").hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp"))

    first = components(confirmed(materialise(candidates(forest(ids, 0, FIRST_TREES)), clean=True)))
    labelled = materialise(with_component(first), clean=True)
    more = confirmed(materialise(candidates(apart_only(forest(labelled, FIRST_TREES, TREES))), clean=True))
    joined = components(more.unionByName(first.select(F.col("component").alias("lo"), F.col("vertex").alias("hi"))))
    apart = sets.select("doc_id", "n_shingles", "part", "size", "bits").join(with_component(joined).hint("merge"), "doc_id")
    apart = materialise(apart.select(F.col("doc_id").alias("rep"), "comp", "n_shingles", "part", "size", "bits"), clean=True)
    others = materialise(missed(rows, apart, size, percent), clean=True)
    last = confirmed(others)
    joined = components(last.unionByName(joined.select(F.col("component").alias("lo"), F.col("vertex").alias("hi"))))
    known = classes.join(joined.hint("merge"), classes.rep == joined.vertex, "left").select(*digest, F.coalesce("component", "rep").alias("_component"))
    known = materialise(known, clean=True)
    # rows with one id but different sets are one vertex
    out = base.select("doc_id", *digest).join(known.hint("merge"), digest, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9(documents: DataFrame) -> DataFrame:
    """Shingles of two words, links from 80 of 100."""
    return near_duplicates(documents.select("doc_id", "text"), 2, 80)
