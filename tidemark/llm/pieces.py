"""SentencePiece encoding with seeded merge-dropout, and decoding.

The pieces and scores are those of a public model file, which is read and never
trained. A text is cut into units: spaces with the word after them. In a unit
the best-scored neighbouring pair is merged, again and again; every candidate
merge on the agenda is skipped if a keyed hash of the seed, the variant, the
unit and the candidate's place and pieces falls under `dropout`. The same key
gives the same pieces on every machine; variants of a unit differ. Characters
without a piece are bytes, so every text is decoded to itself.

All units of a batch are merged at once in numpy, long ones by a heap. Null
text is empty and has no pieces. Repeated rows give repeated results; empty
tables give none. A document's variant is a hash of its id (null: 0), modulo
`variants`. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, batches, chunks, mix
from .tables import kept_schema

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f" *[^ {SPACE}]+| +|{SPACE}")
LONG = 48
_C1, _C2 = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(self.n)]
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(self.n)]
        number = {t: i for i, t in enumerate(texts) if normal[i]}
        rank = np.empty(self.n, np.int64)
        rank[np.argsort([-model.get_score(i) for i in range(self.n)], kind="stable")] = np.arange(self.n)
        self.rank = rank
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        pairs = {}
        for t, i in number.items():
            if len(t) == 1:
                self.char[ord(t)] = i
            for k in range(1, len(t)):
                if t[:k] in number and t[k:] in number:
                    pairs[number[t[:k]] * self.n + number[t[k:]]] = i
        self.char[ord(SPACE)], self.char[32] = -1, number.get(SPACE, -1)
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        spelled = [t.replace(SPACE, " ").encode() if normal[i] else b"" for i, t in enumerate(texts)]
        for b in range(256):
            spelled[self.byte[b]] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.fromiter(map(len, spelled), np.int64, self.n)
        self.place = np.cumsum(self.length) - self.length

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, without the space that encoding puts before it."""
        n = self.length[ids]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.place[ids], n)
        return self.spelled[at].tobytes()[1:]


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    return Pieces(path)


def _skipped(unit: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int) -> np.ndarray:
    """Whether the keyed hash drops the candidate merge; place is the left piece's first character."""
    h = mix(unit + place.astype(U64) * U64(_C1) + mix((left.astype(np.int64).view(U64) << U64(32)) ^ right.astype(np.int64).view(U64)) * U64(_C2))
    return (h >> U64(1)) < U64(limit >> 1)


def _unit_keys(codes: np.ndarray, length: np.ndarray, seed: int, variant: int) -> np.ndarray:
    first = np.cumsum(length) - length
    inner = np.arange(len(codes)) - np.repeat(first, length)
    sums = np.add.reduceat(mix(codes.astype(U64) * U64(_C1) + inner.astype(U64) * U64(_C2)), first)
    return mix(sums + U64((seed * _C2 + variant * _C1 + 1) & (1 << 64) - 1))


def _by_heap(p: Pieces, symbols: np.ndarray, key: int, limit: int) -> list[int]:
    """One unit's pieces by an agenda of candidate merges, best score first, then leftmost."""
    ids, n = symbols.tolist(), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def propose(places: list[int]) -> None:
        places = [i for i in places if i >= 0 and after[i] < n]
        if places:
            left, right = np.array([ids[i] for i in places]), np.array([ids[after[i]] for i in places])
            merged = p.merge(left, right)
            drop = _skipped(np.full(len(places), key, U64), np.array(places), left, right, limit)
            for i, a, b, m, d in zip(places, left.tolist(), right.tolist(), merged.tolist(), drop.tolist(), strict=True):
                if m >= 0 and not d:
                    heapq.heappush(agenda, (int(p.rank[m]), i, a, b, m))

    propose(list(range(n)))
    gone = [False] * n
    while agenda:
        _, i, a, b, m = heapq.heappop(agenda)
        j = after[i]
        if gone[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], gone[j], after[i] = m, True, after[j]
        if after[i] < n:
            before[after[i]] = i
        propose([before[i], i])
    return [x for x, g in zip(ids, gone, strict=True) if not g]


def encode_units(p: Pieces, units: list[str], dropout: float, seed: int, variant: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, and where each unit's begin and how many they are."""
    if not units:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    limit = min(int(dropout * 2**64), 2**64 - 1)
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, units), np.int64, len(units))
    first = np.cumsum(length) - length
    keys = _unit_keys(codes, length, seed, variant)
    symbols = p.char[codes].astype(np.int64)
    symbols = np.where(symbols < 0, -1 - codes.astype(np.int64), symbols)  # no piece: the character's number
    parts: list[np.ndarray] = []
    who: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    for low, high in ((1, 4), (5, 8), (9, 12), (13, 18), (19, 28), (29, LONG)):
        pick = np.flatnonzero((length >= low) & (length <= high))
        for c in range(0, len(pick), 1 << 15):
            own = pick[c : c + (1 << 15)]
            n = length[own].copy()
            columns = np.arange(high)
            inside = columns < n[:, None]
            ids = np.where(inside, symbols[np.minimum(first[own][:, None] + columns, len(symbols) - 1)], -(1 << 40))
            place = np.broadcast_to(columns, ids.shape).copy()
            unit = np.broadcast_to(keys[own][:, None], ids.shape)

            def candidates(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
                """Rank-ordered key of the candidate at column `at` of each row, or a large number."""
                left, right = ids[rows, at], ids[rows, at + 1]
                merged = p.merge(left, right)
                good = np.flatnonzero(merged >= 0)
                value = np.full(len(rows), 1 << 60)
                if len(good):
                    keep = good[~_skipped(unit[rows[good], at[good]], place[rows[good], at[good]], left[good], right[good], limit)]
                    value[keep] = p.rank[merged[keep]]
                return value

            best = np.full((len(own), max(high - 1, 1)), 1 << 60)
            rows, at = np.nonzero(inside[:, 1:])
            best[rows, at] = candidates(rows, at)
            live = np.arange(len(own))
            while len(live):
                at = best[live].argmin(1)
                good = best[live, at] < 1 << 60
                live, at = live[good], at[good]
                if not len(live):
                    break
                ids[live, at] = p.merge(ids[live, at], ids[live, at + 1])
                shift = np.minimum(columns + (columns > at[:, None]), high - 1)
                ids[live] = np.take_along_axis(ids[live], shift, 1)
                place[live] = np.take_along_axis(place[live], shift, 1)
                best[live] = np.take_along_axis(best[live], np.minimum(shift[:, : best.shape[1]], best.shape[1] - 1), 1)
                n[live] -= 1
                ids[live, n[live]] = -(1 << 40)
                best[live, np.maximum(n[live] - 1, 0)] = 1 << 60
                for side in (at - 1, at):
                    ok = (side >= 0) & (side + 1 < n[live])
                    best[live[ok], side[ok]] = candidates(live[ok], side[ok])
            parts.append(ids[columns < n[:, None]])
            who.append(own)
            sizes.append(n)
    for k in np.flatnonzero(length > LONG).tolist():
        parts.append(np.array(_by_heap(p, symbols[first[k] : first[k] + length[k]], int(keys[k]), limit), np.int64))
        who.append(np.array([k]))
        sizes.append(np.array([len(parts[-1])]))
    flat, wide = _with_bytes(p, np.concatenate(parts))
    ends = np.concatenate(([0], np.cumsum(wide)))
    size = np.concatenate(sizes)
    last = np.cumsum(size)
    place, number = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
    order = np.concatenate(who)
    place[order] = ends[last - size]
    number[order] = ends[last] - ends[last - size]
    return flat, place, number


def _with_bytes(p: Pieces, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with characters that have no piece as the bytes of their UTF-8 form, and how many ids each became."""
    code = np.maximum(-1 - ids, 0)
    wide = np.where(ids >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
    at = np.repeat(np.arange(len(ids)), wide)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
    n, c = wide[at], code[at]
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0])[n]
    byte = np.where(inner == 0, lead | (c >> (6 * (n - 1))), 0x80 | ((c >> (6 * (n - 1 - inner))) & 0x3F))
    return np.where(ids[at] >= 0, ids[at], p.byte[byte & 0xFF]).astype(np.int32), wide


class Encoder:
    """Encodes texts, keeping the units seen so far; the store is emptied when it holds `most` units."""

    def __init__(self, path: str = MODEL, dropout: float = 0.1, seed: int = 1, most: int = 1 << 20):
        self.pieces, self.dropout, self.seed, self.most = load(path), dropout, seed, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, dict[str, int]] = {}
        self.flat, self.place, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str], variants: list[int]) -> list[np.ndarray]:
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        if sum(map(len, self.known.values())) > self.most:
            self._clear()
        for v in sorted(set(variants)):
            known = self.known.setdefault(v, {})
            new = sorted({u for own, w in zip(units, variants, strict=True) if w == v for u in own}.difference(known))
            if new:
                flat, place, length = encode_units(self.pieces, new, self.dropout, self.seed, v)
                known.update(zip(new, range(len(self.length), len(self.length) + len(new)), strict=True))
                self.place = np.concatenate((self.place, place + len(self.flat)))
                self.length = np.concatenate((self.length, length))
                self.flat = np.concatenate((self.flat, flat))
        out = []
        for own, v in zip(units, variants, strict=True):
            at = np.fromiter(map(self.known[v].__getitem__, own), np.int64, len(own))
            n = self.length[at]
            out.append(self.flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.place[at], n)])
        return out


def _encoding(path: str, dropout: float, seed: int, with_ids: bool):
    def run(rows):
        encoder = Encoder(path, dropout, seed)
        for batch in batches(rows):
            raw, variants = batch.column("_text").to_pylist(), batch.column("_variant").to_pylist()
            texts = [(t or b"").decode("utf-8", "surrogatepass") for t in raw]
            number, digest, lossless, lists = [], [], [], []
            for a, b in chunks([t or b"" for t in raw]):
                for ids, text in zip(encoder.encode(texts[a:b], variants[a:b]), raw[a:b], strict=True):
                    number.append(len(ids))
                    digest.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                    lossless.append(encoder.pieces.decode(ids) == (text or b""))
                    if with_ids:
                        lists.append(ids)
            more = [batch.column("_variant"), pa.array(number, pa.int64()), pa.array(digest, pa.string()), pa.array(lossless, pa.bool_())]
            names = ["variant", "n_pieces", "ids_sha256", "lossless"]
            if with_ids:
                more.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            keep = [c for c in batch.schema.names if c not in ("_text", "_variant")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], names=[*keep, *names])

    return run


def encode(docs: DataFrame, keep: list[str], path: str = MODEL, dropout: float = 0.1, seed: int = 1, variants: int = 4, with_ids: bool = False) -> DataFrame:
    """The columns named in `keep`, then variant, n_pieces, ids_sha256 (of little-endian 32-bit ids), lossless and, if asked for, ids."""
    variant = F.coalesce(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(variants)), F.lit(0)).cast("int")
    schema = kept_schema(docs, keep, "variant int, n_pieces long, ids_sha256 string, lossless boolean" + (", ids array<int>" if with_ids else ""))
    return docs.select(*keep, F.col("text").cast("binary").alias("_text"), variant.alias("_variant")).mapInArrow(_encoding(path, dropout, seed, with_ids), schema)


def decode(rows: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """The rows with `text` decoded from the column of ids (null: null)."""

    def run(batch_rows):
        pieces = load(path)
        for batch in batches(batch_rows):
            texts = [None if x is None else pieces.decode(np.array(x, np.int64)).decode("utf-8", "surrogatepass") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, text string")


def op3(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, variant, n_pieces, ids_sha256, lossless."""
    return encode(documents.select("doc_id", "text"), ["doc_id"])
