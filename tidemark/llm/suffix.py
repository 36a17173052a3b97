"""Exact removal of byte strings that occur earlier in the corpus, by a distributed suffix sort.

Every 100-byte window has an anchor: its 40-byte string of the smallest hash,
the leftmost of equal ones. Equal windows have equal anchors at equal distance.
A segment is the run of windows, at most SPAN, of one occurrence of an anchor,
so however periodic a text, its segments are short and repeat as wholes.
Segments of one anchor, distance and BLAKE2b digest of their bytes need no
comparison: all but the first are removed. Only where an anchor has different
segments are their suffixes sorted: a mergesort inside each anchor and distance
compares two suffixes by prefix polynomial hashes, whose common extension a
binary search finds in logarithmic time. Neighbours in the sorted order are
then compared byte by byte: this proves the order and the classes of equal
windows, and where hashes collided the windows themselves are compared. All
but the first of a class are removed. Of an anchor with more than HOT different
segments each window is dealt out singly, by a 64-bit hash and a second one
modulo two primes, so that no group grows with the corpus.

Order is by doc_id (null last), then by row, then by position. Null text is
empty. Texts under 100 bytes lose nothing. Repeated rows are later copies of
the first and are removed whole if long enough; empty tables give no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, PrefixHash, Packed, batches, byte_texts, chunks, mix
from .tables import materialise, partitions

LENGTH, GRAM = 100, 40
SPAN = LENGTH - GRAM + 1
#: Different segments of one anchor, in one batch or in all, from which its windows are dealt out singly.
HOT_BATCH, HOT = 64, 1000
#: Bytes of text whose segments meet in one bucket, and windows that are sorted at once (one anchor's stay together).
BUCKET_BYTES, SORTED = 8 << 20, 1 << 18
#: Bytes of text for each task of a shuffle.
TASK_BYTES = 16 << 20
LAST = (1 << 63) - 1
_SEGMENT = [("anchor", "<u8"), ("c1", "<u8"), ("c2", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("start", "<i4"), ("count", "u1"), ("lead", "u1"), ("flag", "u1")]
_WINDOW = [("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("start", "<i4")]
_CONTEXT = [("anchor", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("start", "<i4"), ("count", "u1"), ("lead", "u1")]
HOT_FLAG = 1
SPANS, DETAIL = 1, 0


def _pack(columns: list[np.ndarray], layout: list[tuple[str, str]]) -> bytes:
    return b"".join([np.int64(len(columns[0])).tobytes(), *(np.ascontiguousarray(c, kind).tobytes() for c, (_, kind) in zip(columns, layout, strict=True))])


def _unpack(parts: list[bytes], layout: list[tuple[str, str]]) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = [[] for _ in layout]
    for p in parts:
        n, at = int(np.frombuffer(p, np.int64, 1)[0]), 8
        for k, (_, kind) in enumerate(layout):
            found[k].append(np.frombuffer(p, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(f) if f else np.zeros(0, kind) for f, (_, kind) in zip(found, layout, strict=True)]


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least, the leftmost of equal ones, of each `width` neighbours."""
    least, at, reach = values, np.arange(len(values), dtype=np.int64), 1
    while reach < width:
        step = min(reach, width - reach)
        further = least[step:] < least[:-step]
        at, least = np.where(further, at[step:], at[:-step]), np.minimum(least[step:], least[:-step])
        reach += step
    return at


def segments(texts: list[bytes]) -> list[np.ndarray]:
    """anchor, digest (two words), document, start (in its document), count and distance to the anchor of the segments of all windows."""
    packed = Packed(texts)
    long = np.flatnonzero(packed.ends - packed.starts >= LENGTH)
    if not len(long):
        return [np.zeros(0, k) for k in (U64, U64, U64, np.int64, np.int64, np.int64, np.int64)]
    hashes = PrefixHash(packed.buf)
    n = len(packed.buf)
    at = np.arange(n - GRAM + 1)
    grams = mix(hashes.raw(at, at + GRAM))
    place = _leftmost_least(grams, SPAN)  # of the window that begins here
    inside = np.zeros(n + 1, np.int8)
    inside[packed.starts[long]] += 1
    inside[packed.ends[long] - LENGTH + 1] -= 1
    window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    own = place[window]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1))))
    start, anchor = window[first], own[first]
    count = np.diff(np.concatenate((first, [len(window)])))
    doc = packed.doc_of(start)
    whole, digest = packed.buf.tobytes(), hashlib.blake2b
    sums = b"".join([digest(whole[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)])
    content = np.frombuffer(sums, "<u8").reshape(-1, 2)
    return [grams[anchor], content[:, 0], content[:, 1], doc, start - packed.starts[doc], count, anchor - start]


_PRIMES, _BASES = (2147483647, 2147483629), (1362509239, 1907384551)
#: For each prime the powers of its base and of the base's inverse, as far as they were needed.
_residues: list[list[np.ndarray]] = [[np.ones(1, U64), np.ones(1, U64)] for _ in _PRIMES]


def modular(buf: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of `length` bytes modulo two primes, together 62 bits."""
    out = np.zeros(len(start), U64)
    for prime, base, powers in zip(_PRIMES, _BASES, _residues, strict=True):
        p = U64(prime)
        for k, b in enumerate((base, pow(base, -1, prime))):
            while len(powers[k]) < len(buf):
                powers[k] = np.concatenate((powers[k], powers[k] * U64(pow(b, len(powers[k]), prime)) % p))
        sums = np.concatenate((np.zeros(1, U64), np.cumsum((buf.astype(U64) + U64(1)) * powers[0][: len(buf)] % p, dtype=U64)))
        out = (out << U64(31)) | ((sums[start + length] - sums[start]) % p * powers[1][start] % p)
    return out


def _later(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of _SEGMENT in order, whether a row has an earlier one of equal bytes, and the number of the row's anchor."""
    anchor, c1, c2, doc, rid, start, count, lead, _ = columns
    order = np.lexsort((start, rid, doc, count, lead, c2, c1, anchor))
    columns = [c[order] for c in columns]
    if not len(order):
        return columns, np.zeros(0, bool), np.zeros(0, np.int64)
    new = columns[0][1:] != columns[0][:-1]
    differs = np.logical_or.reduce([new, *(columns[k][1:] != columns[k][:-1] for k in (1, 2, 6, 7))])
    return columns, np.concatenate(([False], ~differs)), np.cumsum(np.concatenate(([True], new))) - 1


def _by_row(rid: np.ndarray, columns: list[np.ndarray], layout: list[tuple[str, str]]):
    """One payload for each rid."""
    order = np.argsort(rid, kind="stable")
    rid, columns = rid[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate(([True], rid[1:] != rid[:-1], [True]))) if len(rid) else np.zeros(1, np.int64)
    return rid[cut[:-1]], [_pack([c[a:b] for c in columns], layout) for a, b in zip(cut[:-1], cut[1:], strict=True)]


_SPAN_LAYOUT = [("start", "<i4"), ("stop", "<i4")]
_DETAIL_LAYOUT = [("anchor", "<u8"), ("start", "<i4"), ("count", "u1"), ("lead", "u1"), ("flag", "u1")]


def _joined_spans(rid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Overlapping or touching spans of a row as one."""
    order = np.lexsort((start, rid))
    rid, start, stop = rid[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    if not len(rid):
        return [rid, start, stop]
    owner = np.cumsum(np.concatenate(([True], rid[1:] != rid[:-1])))
    reach = np.maximum.accumulate(stop + owner * (1 << 33)) - owner * (1 << 33)
    new = np.concatenate(([True], (rid[1:] != rid[:-1]) | (start[1:] > reach[:-1])))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(rid) - 1]))
    return [rid[new], start[new], reach[last]]


def _rows(bucket, rid, kind: int, payload) -> pa.RecordBatch:
    n = len(payload)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(rid, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(payload, pa.binary())], names=["bucket", "rid", "kind", "payload"])


def _dealt(columns: list[np.ndarray], layout, key: np.ndarray, buckets: int):
    bucket = (mix(key) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = [b for b in range(buckets) if cut[b + 1] > cut[b]]
    return used, [_pack([c[order[cut[b] : cut[b + 1]]] for c in columns], layout) for b in used]


def _spans_of(columns: list[np.ndarray], same: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """rid and packed spans of the segments that are later copies."""
    start = columns[5][same].astype(np.int64)
    spans = _joined_spans(columns[4][same], start, start + columns[6][same] + LENGTH - 1)
    return _by_row(spans[0], spans[1:], _SPAN_LAYOUT)


def _scan(buckets: int):
    """Segments of each batch: spans of later copies, rows for the anchors' buckets, and details of what is hot already."""

    def run(rows):
        for batch in batches(rows):
            texts = byte_texts(batch.column("_text"))
            rids, docs = batch.column("rid").to_numpy(), batch.column("_order").to_numpy()
            parts = []
            for a, b in chunks(texts):
                found = segments(texts[a:b])
                found[3] = found[3] + a
                parts.append(found)
            anchor, c1, c2, doc, start, count, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
            columns, same, group = _later([anchor, c1, c2, docs[doc], rids[doc], start, count, lead, np.zeros(len(doc), np.uint8)])
            if not len(same):
                continue
            rid, payload = _spans_of(columns, same)
            yield _rows((mix(rid.view(U64)) % U64(buckets)).astype(np.int32), rid, SPANS, payload)
            columns, group = [c[~same] for c in columns], group[~same]
            number = np.bincount(group)[group]
            place = np.arange(len(group)) - np.searchsorted(group, group)
            columns[8] = columns[8] | np.where(number > HOT_BATCH, HOT_FLAG, 0).astype(np.uint8)
            sent = place < HOT_BATCH
            used, payload = _dealt([c[sent] for c in columns], _SEGMENT, columns[0][sent], buckets)
            yield _rows(used, [None] * len(used), DETAIL, payload)
            more = [c[~sent] for c in columns]
            rid, payload = _by_row(more[4], [more[0], *more[5:]], _DETAIL_LAYOUT)
            yield _rows((mix(rid.view(U64)) % U64(buckets)).astype(np.int32), rid, DETAIL, payload)

    return run


def _meet(table):
    """All segments of the bucket's anchors: spans of later copies, and details where an anchor has different segments."""
    known = table.filter(pc.is_valid(table.column("rid")))
    columns, same, group = _later(_unpack(table.filter(pc.is_null(table.column("rid"))).column("payload").to_pylist(), _SEGMENT))
    rid, payload = _spans_of(columns, same)
    out = [known.select(["rid", "kind", "payload"]), pa.table({"rid": pa.array(rid, pa.int64()), "kind": pa.array([SPANS] * len(rid), pa.int32()), "payload": pa.array(payload, pa.binary())})]
    if len(group):
        # a later copy's flag counts for its anchor too
        flagged = np.bincount(group, weights=columns[8] & HOT_FLAG) > 0
        columns, group = [c[~same] for c in columns], group[~same]
        number = np.bincount(group)
        hot = (number > HOT) | flagged
        keep = ((number > 1) | hot)[group]
        flag = np.where(hot[group], HOT_FLAG, 0).astype(np.uint8)
        rid, payload = _by_row(columns[4][keep], [c[keep] for c in (columns[0], *columns[5:8], flag)], _DETAIL_LAYOUT)
        out.append(pa.table({"rid": pa.array(rid, pa.int64()), "kind": pa.array([DETAIL] * len(rid), pa.int32()), "payload": pa.array(payload, pa.binary())}))
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def _ranges(count: np.ndarray) -> np.ndarray:
    """0..count-1 of each, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _details(buckets: int):
    """Bytes of the segments to compare, dealt by anchor; windows of hot anchors dealt singly by their hashes."""

    def run(rows):
        for batch in batches(rows):
            texts, payloads = byte_texts(batch.column("_text")), batch.column("payloads").to_pylist()
            rids, docs = batch.column("rid").to_numpy(), batch.column("_order").to_numpy()
            for a, b in chunks(texts):
                packed, per = Packed(texts[a:b]), [_unpack(p, _DETAIL_LAYOUT) for p in payloads[a:b]]
                doc = np.repeat(np.arange(b - a), [len(p[0]) for p in per]) + a
                anchor, start, count, lead, flag = (np.concatenate([p[k] for p in per]) for k in range(5))
                hot = (flag & HOT_FLAG) > 0
                at, count = packed.starts[doc - a] + start, count.astype(np.int64)
                if hot.any():
                    n = count[hot]
                    each = np.repeat(at[hot], n) + _ranges(n)
                    owner, begin = np.repeat(doc[hot], n), np.repeat(start[hot], n) + _ranges(n)
                    h1, h2 = PrefixHash(packed.buf).of(each, each + LENGTH), modular(packed.buf, each, LENGTH)
                    order = np.lexsort((begin, rids[owner], docs[owner], h2, h1))
                    h1, h2, owner, begin = h1[order], h2[order], owner[order], begin[order]
                    later = np.concatenate(([False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])))
                    spans = _joined_spans(rids[owner[later]], begin[later], begin[later] + LENGTH)
                    rid, payload = _by_row(spans[0], spans[1:], _SPAN_LAYOUT)
                    yield _rows((mix(rid.view(U64)) % U64(buckets)).astype(np.int32), rid, SPANS, payload)
                    owner, begin, h1, h2 = owner[~later], begin[~later], h1[~later], h2[~later]
                    used, payload = _dealt([h1, h2, docs[owner], rids[owner], begin], _WINDOW, h1, buckets)
                    yield _rows(used, [None] * len(used), 2, payload)
                cold = np.flatnonzero(~hot)
                if len(cold):
                    bucket = (mix(anchor[cold]) % U64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    used = [k for k in range(buckets) if cut[k + 1] > cut[k]]
                    out = []
                    for k in used:
                        own = cold[order[cut[k] : cut[k + 1]]]
                        size = count[own] + LENGTH - 1
                        body = packed.buf[np.repeat(at[own], size) + _ranges(size)]
                        out.append(_pack([anchor[own], docs[doc[own]], rids[doc[own]], start[own], count[own], lead[own]], _CONTEXT) + body.tobytes())
                    yield _rows(used, [None] * len(used), 3, out)

    return run


class SuffixSort:
    """Mergesort of suffixes inside groups; two suffixes are compared up to LENGTH bytes."""

    def __init__(self, buf: np.ndarray):
        self.buf, self.hashes = buf, PrefixHash(buf)

    def common(self, x: np.ndarray, y: np.ndarray, known: int = 8) -> np.ndarray:
        """Length of the common extension of suffixes at x and y that share `known` bytes, by binary search on prefix hashes."""
        low, high = np.full(len(x), known), np.full(len(x), LENGTH)
        sums, inverse = self.hashes.sums, self.hashes.inverse
        x0, y0, xi, yi = sums[x], sums[y], inverse[x], inverse[y]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            equal = (sums[x + middle] - x0) * xi == (sums[y + middle] - y0) * yi
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def less(self, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether element x stands before element y; equal windows keep the order of their elements."""
        a, b = at[x], at[y]
        n = self.common(a, b)
        a, b = self.buf[np.minimum(a + n, len(self.buf) - 1)], self.buf[np.minimum(b + n, len(self.buf) - 1)]
        return np.where(n == LENGTH, x < y, a < b)

    def order(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Elements by group (ascending in the input), inside each by suffix."""
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        base = (np.cumsum(size) - size)[group]
        offset, size = np.arange(len(group)) - base, size[group]
        result, width = np.arange(len(group)), 1
        active = np.flatnonzero(size > 1)
        while len(active):
            place, o, n = base[active], offset[active], size[active]
            run = o // width
            other = (run ^ 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            first = low.copy()
            element = result[active]
            while len(todo := np.flatnonzero(low < high)):
                middle = (low[todo] + high[todo]) >> 1
                # ties keep the elements' order, so no two elements are equal
                before = self.less(at, result[place[todo] + middle], element[todo])
                low[todo], high[todo] = np.where(before, middle + 1, low[todo]), np.where(before, high[todo], middle)
            merged = result.copy()
            merged[place + (run & ~1) * width + (o - run * width) + (low - first)] = element
            result, width = merged, width * 2
            active = active[n > width]
        return result


def repeats(buf: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of windows at `at`, in order of precedence inside each group (ascending): those whose bytes an earlier one of the group has."""
    if not len(at):
        return np.zeros(0, bool)
    # the first eight bytes, as a number, are a suffix's rank so far: only equal ones need comparisons
    head = np.lib.stride_tricks.sliding_window_view(buf, 8)[at].view(">u8").ravel()
    ranked = np.lexsort((head, group))
    at, group, head = at[ranked], group[ranked], head[ranked]
    group = np.cumsum(np.concatenate(([True], (group[1:] != group[:-1]) | (head[1:] != head[:-1])))) - 1
    order = SuffixSort(buf).order(at, group)
    x, y = order[:-1], order[1:]
    near = np.flatnonzero(group[x] == group[y])
    # bytes of neighbours prove the order and the classes: a first difference must ascend, equal windows keep their precedence
    views = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)
    same, wrong = np.zeros(len(x), bool), [np.zeros(0, np.int64)]
    for i in range(0, len(near), 1 << 14):
        pick = near[i : i + (1 << 14)]
        a, b = views[at[x[pick]]], views[at[y[pick]]]
        differs = a != b
        where, rows = differs.argmax(1), np.arange(len(pick))
        same[pick] = ~differs[rows, where]
        wrong.append(group[x[pick[np.where(same[pick], x[pick] > y[pick], a[rows, where] > b[rows, where])]]])
    later = np.zeros(len(at), bool)
    later[y[same]] = True
    for g in np.unique(np.concatenate(wrong)):  # hashes collided: compare the group's windows themselves
        seen: set[bytes] = set()
        for e in np.flatnonzero(group == g):
            later[e] = (w := views[at[e]].tobytes()) in seen
            seen.add(w)
    out = np.empty(len(later), bool)
    out[ranked] = later
    return out


def _compare(table):
    kinds = np.array(table.column("kind").to_pylist())
    payload = table.column("payload").to_pylist()
    out = [table.filter(pa.array(kinds == SPANS)).select(["rid", "kind", "payload"])]

    def add(rid, start):
        rid, start, stop = _joined_spans(rid, start, start + LENGTH)
        rid, packed = _by_row(rid, [start, stop], _SPAN_LAYOUT)
        out.append(pa.table({"rid": pa.array(rid, pa.int64()), "kind": pa.array([SPANS] * len(rid), pa.int32()), "payload": pa.array(packed, pa.binary())}))

    h1, h2, doc, rid, start = _unpack([payload[i] for i in np.flatnonzero(kinds == 2)], _WINDOW)
    order = np.lexsort((start, rid, doc, h2, h1))
    h1, h2, rid, start = h1[order], h2[order], rid[order], start[order]
    later = np.concatenate(([False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]))) if len(h1) else np.zeros(0, bool)
    add(rid[later], start[later])
    rows, bodies = [], []
    width = 8
    for i in np.flatnonzero(kinds == 3):
        n = int(np.frombuffer(payload[i], np.int64, 1)[0])
        size = width + n * sum(np.dtype(k).itemsize for _, k in _CONTEXT)
        rows.append(payload[i][:size])
        bodies.append(payload[i][size:])
    if rows:
        anchor, doc, rid, start, count, lead = _unpack(rows, _CONTEXT)
        buf, count, lead = np.frombuffer(b"".join(bodies), np.uint8), count.astype(np.int64), lead.astype(np.int64)
        size = count + LENGTH - 1
        place = np.cumsum(size) - size
        order = np.lexsort((start, rid, doc, anchor))
        anchor, rid, start, count, lead, size, place = (c[order] for c in (anchor, rid, start, count, lead, size, place))
        number = np.cumsum(np.concatenate(([True], anchor[1:] != anchor[:-1]))) - 1
        windows, last = np.cumsum(count), np.concatenate((np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]))
        begin = 0
        while begin < len(anchor):
            # whole anchors up to SORTED windows, at least one
            limit = (windows[begin - 1] if begin else 0) + SORTED
            ends = last[(last > begin) & (windows[last - 1] <= limit)]
            end = int(ends[-1]) if len(ends) else int(last[last > begin][0])
            own, n = slice(begin, end), count[begin:end]
            part = buf[np.repeat(place[own], size[own]) + _ranges(size[own])]
            inner, offset = np.repeat(np.cumsum(size[own]) - size[own], n), _ranges(n)
            key = np.repeat(number[own] - number[begin], n) * SPAN + np.repeat(lead[own], n) - offset
            order = np.argsort(key, kind="stable")
            later = order[repeats(part, (inner + offset)[order], key[order])]
            add(np.repeat(rid[own], n)[later], (np.repeat(start[own], n) + offset)[later])
            begin = end
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def _removing(rows):
    for batch in batches(rows):
        texts, payloads = byte_texts(batch.column("_text")), batch.column("payloads").to_pylist()
        removed, number, digest = [], [], []
        for text, parts in zip(texts, payloads, strict=True):
            if parts:
                start, stop = _unpack(parts, _SPAN_LAYOUT)
                _, start, stop = _joined_spans(np.zeros(len(start), np.int64), start, stop)
                at, kept = 0, hashlib.sha256()
                for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                removed.append(int((stop - start).sum()))
                number.append(len(start))
                digest.append(kept.hexdigest())
            else:
                removed.append(0)
                number.append(0)
                digest.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered documents (rid, doc_id, _text, _order), and rid with payloads (packed spans to remove)."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("binary").alias("_text"))
    # numbered once: every job below reads the same numbers
    rows = materialise(rows.withColumn("_order", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))))
    size = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    buckets, tasks = (max(partitions(spark), -(-size // n)) for n in (BUCKET_BYTES, TASK_BYTES))
    # the numbers are never null; said so, both joins below take the same exchange
    numbered, rows = rows, rows.withColumn("rid", F.coalesce("rid", F.lit(0).cast("long"))).repartition(tasks, "rid")
    schema = "rid long, kind int, payload binary"

    def by_bucket(df: DataFrame, run, function) -> DataFrame:
        return df.mapInArrow(run, f"bucket int, {schema}").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(function, schema)

    met = materialise(by_bucket(numbered, _scan(buckets), _meet))
    detail = met.where(F.col("kind") == DETAIL).groupBy("rid").agg(F.collect_list("payload").alias("payloads"))
    compared = by_bucket(rows.join(detail, "rid"), _details(3 * buckets), _compare)
    spans = met.where(F.col("kind") == SPANS).unionByName(compared).groupBy("rid").agg(F.collect_list("payload").alias("payloads"))
    return rows, spans


def op6(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, spans = repeated_spans(documents.select("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, "rid", "left").mapInArrow(_removing, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
