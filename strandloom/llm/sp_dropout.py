"""SentencePiece encoding and decoding with seeded merge-dropout.

Encoding follows a merge-type (BPE) model: from single characters, the adjacent pair whose piece has the best score merges
first, the leftmost of equals. With dropout each candidate merge is skipped when its keyed hash falls below the rate. The
key is the seed, the document's id and copy number, and the candidate's places in the document, so every occurrence of a
word is drawn by itself, yet the same seed always cuts a document the same way, on any executor and after any loss. Rows
equal in id, copy and text are one document. Rate 0 gives the plain encoding of the SentencePiece library.

Texts are cut into parts between characters that are neighbours in no piece, so no merge is lost by it. A worker keeps the
plain encoding of the parts it met, at most ``KEPT`` of at most ``LONG`` characters, some 30 MB. A plain piece was made by merges that the
piece alone decides; if an occurrence skips none of them it is cut plainly, and else its part goes through the agenda with
that occurrence's own draws: many parts a step, or, for parts beyond ``LONG`` characters, one by one from a heap.

Lossless: what the model lacks, and the blank mark itself where the text has it, is written as byte pieces; decoding gives
the text's bytes back. A null text counts as empty, and an empty text has no pieces; decoding gives null for null pieces
and U+FFFD for bytes that are no text. A column named as the result is replaced, others stay. The model is read from its
path by the driver (it is small) and sent along; it is not trained or copied.
"""

from __future__ import annotations

import heapq
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

MARK, KEPT, MODEL = "▁", 120_000, "/opt/tokenizers/piece_bpe_32k.model"
#: Parts beyond so many characters are cut one by one and never kept; texts are taken up to so many characters, and rows, at a time.
LONG, AT_ONCE, ROWS = 48, 1 << 18, 250
#: A symbol is a piece's id, or this + code point for a character that is no piece. A text's own blank mark gets a code
#: point that no text has.
_LACKING, _OWN_MARK, _NEVER = 1 << 20, 0x110000, np.int64(1 << 62)
#: Multipliers of the 64-bit keyed hash: of a candidate's start, middle and end, and of the two rounds after.
_ALL, _PLACES, _ROUNDS = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _places(a, b, c):
    """The places' share of the hash, for arrays of unsigned numbers."""
    return a * np.uint64(_PLACES[0]) + b * np.uint64(_PLACES[1]) + c * np.uint64(_PLACES[2])


def _drawn(x: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the hash of key and places; changes ``x``."""
    for m in _ROUNDS:
        x ^= x >> np.uint64(33)
        x *= np.uint64(m)
    return x >> np.uint64(32)


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, ``n`` numbers."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Pairs:
    """A number for each of some keys, by two hashes: a key is in one of its two places or nowhere."""

    def __init__(self, numbers: dict[int, int]):
        self.shift = np.uint64(64 - max(4, (3 * len(numbers)).bit_length()))
        self.factors = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
        size = 1 << int(64 - int(self.shift))
        held: list[dict[int, int]] = [{}, {}]
        spot = lambda k, side: (k * int(self.factors[side]) & _ALL) >> int(self.shift)
        for k in numbers:
            side = 0
            for _ in range(1000):  # who is in the place moves to its other one
                at = spot(k, side)
                k, held[side][at] = held[side].get(at, -1), k
                if k < 0:
                    break
                side = 1 - side
            else:
                raise ValueError("the pairs found no places")
        self.keys = [np.full(size, -1, np.int64) for _ in held]
        self.made = [np.full(size, -1, np.int32) for _ in held]
        for side, own in enumerate(held):
            at = np.fromiter(own.keys(), np.int64, len(own))
            self.keys[side][at] = np.fromiter(own.values(), np.int64, len(own))
            self.made[side][at] = np.fromiter((numbers[k] for k in own.values()), np.int32, len(own))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        u = key.view(np.uint64)
        one, two = ((u * f >> self.shift).view(np.int64) for f in self.factors)
        return np.where(self.keys[0][one] == key, self.made[0][one], np.where(self.keys[1][two] == key, self.made[1][two], np.int32(-1)))


class Model:
    """The pieces of a merge-type model with byte pieces."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.ids, score, raw, self.byte = {}, {}, [], [-1] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                self.ids[piece], score[piece] = i, sp.get_score(i)
                raw.append(piece.replace(MARK, " ").encode())
        if min(self.byte) < 0:
            raise ValueError("the model has no byte pieces, so not every text could be decoded")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has pieces across blanks")
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

        # neighbours inside pieces; between any other two characters no merge can ever be
        joined = {ord(p[i]) << 21 | ord(p[i + 1]) for p in self.ids for i in range(len(p) - 1)}
        #: Characters in pieces by number, 0 for all others, and which numbers can be neighbours.
        letters = sorted({c for p in self.ids for c in map(ord, p)})
        self.letter = np.zeros(_OWN_MARK + 1, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        both = np.array([*joined], np.int64)
        self.joined[self.letter[both >> 21], self.letter[both & ((1 << 21) - 1)]] = True

        # all merges as numbers, and each piece's place among them from the best score down
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.symbol(piece[:k]), self.symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 21 | b] = i
        self.pairs, self.made = _Pairs(pairs), pairs
        scores = sorted({-s for s in score.values()})
        place = {-s: k for k, s in enumerate(scores)}
        self.rank, self.chars = np.full(len(raw), _NEVER >> 32, np.int64), np.ones(len(raw), np.int64)
        for piece, i in self.ids.items():
            self.rank[i], self.chars[i] = place[score[piece]], len(piece)
        self.alone = np.arange(_LACKING, _LACKING + _OWN_MARK + 1, dtype=np.int32)
        self.alone[_OWN_MARK] = _LACKING + ord(MARK)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.alone[ord(piece)] = i

    def symbol(self, piece: str) -> int | None:
        return self.ids.get(piece, _LACKING + ord(piece) if len(piece) == 1 else None)

    def _merges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair of symbols; -1 and a rank behind all where they make no piece."""
        made = self.pairs.find(a.astype(np.int64) << 21 | b)
        return made, np.where(made >= 0, self.rank[made], _NEVER >> 32)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the texts, each led by a blank, blanks as the mark; and how many each has."""
        n = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        got = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
        mark = ord(MARK)
        own = got == mark
        out = np.where(got == 32, np.uint32(mark), got)
        out[own] = _OWN_MARK
        return out, n

    def cuts(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where parts start: at ``begin`` and wherever two characters are neighbours in no piece."""
        letter = self.letter[codes]
        first = np.ones(len(codes), bool)
        first[1:] = ~self.joined[letter[:-1], letter[1:]]
        first[begin] = True
        return np.flatnonzero(first)

    def symbols(self, codes: np.ndarray, start: np.ndarray, n: np.ndarray, base: np.ndarray, at: np.ndarray, least: int, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the parts, one after another, and the number of each part's. A part is ``n`` of the code points from
        ``start`` and stands at ``at`` in the document of key ``base``. ``merges`` takes (part, start, middle, end)."""
        if not len(n):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        zero = np.cumsum(n) - n
        which = _runs(start, n)
        sym = self.alone[codes[which]]
        end = zero + n
        long = np.flatnonzero(n > LONG)
        for r in long.tolist():
            self._one(sym[zero[r] : end[r]], least, int(base[r]), int(at[r]))
        size = len(sym)
        # the agenda: of each symbol with the next one the piece's rank and the place; behind all if there is no such piece
        agenda, made = np.full(size, _NEVER), np.full(size, -1, np.int32)
        after, ahead = np.arange(1, size + 1), np.arange(-1, size - 1)
        pair = np.ones(size, bool)
        pair[end - 1] = False
        for r in long.tolist():
            pair[zero[r] : end[r]] = False
        i = np.flatnonzero(pair)
        made[i], rank = self._merges(sym[i], sym[i + 1])
        agenda[i] = rank << 32 | i
        left = np.flatnonzero((n > 1) & (n <= LONG))
        held, spots, begins = -1, np.empty(0, np.int64), np.empty(0, np.int64)
        while len(left):
            if held < 0 or len(left) < 0.7 * held:
                held, spots = len(left), _runs(zero[left], n[left])
                begins = np.cumsum(n[left]) - n[left]
                asked = left
            best = np.minimum.reduceat(agenda[spots], begins)
            open_ = best < (_NEVER >> 32 << 32)
            left = asked[open_]
            if not len(left):
                break
            i = best[open_] & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            if least:
                move = at[left] - zero[left]
                go = _drawn(base[left] + _places(*((x + move).astype(np.uint64) for x in (i, j, k)))) >= least
                agenda[i[~go]] = _NEVER
                i, j, k, own = i[go], j[go], k[go], left[go]
            else:
                own = left
            if merges is not None:
                merges.append((own, i - zero[own], j - zero[own], k - zero[own]))
            sym[i], sym[j], agenda[j], agenda[i], after[i] = made[i], -1, _NEVER, _NEVER, k
            right = k < end[own]
            ahead[k[right]] = i[right]
            back = i > zero[own]
            x = np.concatenate([i[right], ahead[i[back]]])
            y = np.concatenate([k[right], i[back]])
            made[x], rank = self._merges(sym[x], sym[y])
            agenda[x] = rank << 32 | x
        there = sym >= 0
        return sym[there], np.add.reduceat(there, zero, dtype=np.int64)

    def _one(self, sym: np.ndarray, least: int, base: int, at: int) -> None:
        """The same for the symbols of one part, in place, from a heap: the time of n log n."""
        (ka, kb, kc), (m1, m2), pairs, rank = _PLACES, _ROUNDS, self.made.get, self.rank
        own, n = sym.tolist(), len(sym)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            made = pairs(own[a] << 21 | own[b])
            if made is not None:
                heapq.heappush(heap, (int(rank[made]), a, b, after[b], made))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, c, made = heapq.heappop(heap)
            if own[a] < 0 or own[b] < 0 or after[a] != b or after[b] != c:
                continue
            if least:
                x = base + (at + a) * ka + (at + b) * kb + (at + c) * kc & _ALL
                x = (x ^ x >> 33) * m1 & _ALL
                x = (x ^ x >> 33) * m2 & _ALL
                if x >> 32 < least:
                    continue
            own[a], own[b], after[a] = made, -1, c
            if c < n:
                ahead[c] = a
                offer(a, c)
            if ahead[a] >= 0:
                offer(ahead[a], a)
        sym[:] = own

    def as_numbers(self, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many belong to each run of ``count`` symbols; what is no piece as its byte pieces."""
        lacks = np.flatnonzero(sym >= _LACKING)
        if not len(lacks):
            return sym, count
        codes, back = np.unique(sym[lacks] - _LACKING, return_inverse=True)
        made = [[self.byte[x] for x in chr(c).encode("utf-8", "surrogatepass")] for c in codes.tolist()]
        size = np.array([len(x) for x in made])
        flat = np.array([i for x in made for i in x], np.int32)
        n = np.ones(len(sym), np.int64)
        n[lacks] = size[back]
        last = np.cumsum(n)
        out = np.repeat(sym, n)
        out[_runs((last - n)[lacks], size[back])] = flat[_runs((np.cumsum(size) - size)[back], size[back])]
        return out, np.diff(np.concatenate([[0], last])[np.cumsum(count)], prepend=0)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of runs of ``count`` ids and how many each has; the blank put before a text is taken off."""
        ids = ids.astype(np.int64)
        size = self.raw_size[ids]
        out = self.raw[_runs(self.raw_start[ids], size)]
        n = np.diff(np.concatenate([[0], np.cumsum(size)])[np.cumsum(count)], prepend=0)
        first = (np.cumsum(n) - n)[n > 0]
        led = first[out[first] == 32]
        keep = np.ones(len(out), bool)
        keep[led] = False
        n[np.flatnonzero(n > 0)[out[first] == 32]] -= 1
        return out[keep], n


class _Plain:
    """Plain symbols of the parts that a worker met, by number, and of their merges the places' share of the hash. Number 0
    stands for all parts that are too long to be kept."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sym, self.size, self.start = np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.share, self.merges, self.first = np.empty(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, parts: list[bytes]) -> None:
        n = np.array([len(k) for k in parts], np.int64) // 4
        zero, merges = np.zeros(len(n), np.int64), []
        sym, size = self.model.symbols(np.frombuffer(b"".join(parts), np.uint32), np.cumsum(n) - n, n, zero.view(np.uint64), zero, 0, merges)
        part, *places = (np.concatenate(x) for x in zip(*merges, strict=True)) if merges else [zero[:0]] * 4
        by, count = np.argsort(part, kind="stable"), np.bincount(part, minlength=len(n))
        self.number.update(zip(parts, range(len(self.size), len(self.size) + len(n))))
        self.start = np.concatenate([self.start, len(self.sym) + np.cumsum(size) - size])
        self.first = np.concatenate([self.first, len(self.share) + np.cumsum(count) - count])
        self.size, self.merges = np.concatenate([self.size, size]), np.concatenate([self.merges, count])
        self.sym, self.share = np.concatenate([self.sym, sym]), np.concatenate([self.share, _places(*(x[by].astype(np.uint64) for x in places))])

    def numbers(self, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The number of each part, learning those that are new."""
        ends = np.append(cuts, len(codes)).astype(np.int32) * 4
        parts = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(codes)]).dictionary_encode()
        _, offsets, data = parts.dictionary.buffers()
        at, raw = np.frombuffer(offsets, np.int32, len(parts.dictionary) + 1).tolist(), data.to_pybytes()
        keys = [raw[a:b] if b - a <= 4 * LONG else b"" for a, b in zip(at, at[1:])]
        if len(self.number) + len(keys) > KEPT:
            self._clear()
        self.number[b""] = 0
        found = [*map(self.number.get, keys)]
        if None in found:
            self._learn([k for k, i in zip(keys, found) if i is None])
            found = [*map(self.number.__getitem__, keys)]
        return np.array(found, np.int64)[parts.indices.to_numpy()]


@lru_cache(1)
def _model(proto: bytes) -> Model:
    return Model(proto)


@lru_cache(1)
def _plain(proto: bytes) -> _Plain:
    return _Plain(_model(proto))


def _encode(model: Model, plain: _Plain, texts: list[str], least: int, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, one after another, and the number of each text's."""
    codes, chars = model.codes(texts)
    if not len(codes):
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    text_start = np.cumsum(chars) - chars
    cuts = model.cuts(codes, text_start[chars > 0])
    number = plain.numbers(codes, cuts)
    doc = np.repeat(np.arange(len(texts)), chars)[cuts]  # of each part
    anew = number == 0
    at = cuts - text_start[doc]
    if least:  # parts with a skipped merge go through the agenda
        n, u = plain.merges[number], at.astype(np.uint64)
        x = plain.share[_runs(plain.first[number], n)]
        x += np.repeat(bases[doc] + _places(u, u, u), n)
        some = np.flatnonzero(n)
        if len(some):
            anew[some[np.logical_or.reduceat(_drawn(x) < least, (np.cumsum(n) - n)[some])]] = True
    size = plain.size[number]
    sym = plain.sym[_runs(plain.start[number], size)]
    own = np.flatnonzero(anew)
    if len(own):
        count = size.copy()
        got, count[own] = model.symbols(codes, cuts[own], np.diff(cuts, append=len(codes))[own], bases[doc[own]], at[own], least)
        out, to = np.empty(count.sum(), np.int32), np.cumsum(count) - count
        mine = _runs(to[own], count[own])
        stay = np.ones(len(out), bool)
        stay[mine] = False
        out[mine], out[stay] = got, sym[np.repeat(~anew, size)]
        sym, size = out, count
    return model.as_numbers(sym, np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64))


def _rows(kind: pa.DataType, data: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """An array of binary (or text) values of these sizes in bytes, one after another."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(kind, len(sizes), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode_array(proto: bytes, texts: pa.Array, rate: float, seed: str, variants: pa.Array, plain: _Plain | None = None) -> pa.Array:
    """Ids of each text as little-endian 32-bit numbers. ``variants``: the number that tells each document from others."""
    model = _model(proto)
    plain = _Plain(model) if plain is None else plain
    least, got = int(rate * (1 << 32)), []
    for s in range(0, len(texts), ROWS):
        some, own = texts[s : s + ROWS].to_pylist(), variants[s : s + ROWS].to_pylist()
        bases = np.array([xxhash.xxh64_intdigest(f"{seed}:{v}".encode()) for v in own], np.uint64)
        held = size = 0
        for i, text in enumerate(some, 1):
            size += len(text)
            if size >= AT_ONCE or i == len(some):
                ids, n = _encode(model, plain, some[held:i], least, bases[held:i])
                got.append(_rows(pa.binary(), ids.astype("<i4").view(np.uint8), 4 * n))
                held, size = i, 0
    return pa.concat_arrays(got) if got else pa.array([], pa.binary())


def encode_texts(proto: bytes, texts: list[str], rate: float = 0.0, seed: str = "", variants: list[int] | None = None) -> list[bytes]:
    """:func:`encode_array` for lists."""
    return encode_array(proto, pa.array(texts, pa.string()), rate, seed, pa.array([0] * len(texts) if variants is None else variants, pa.int64())).to_pylist()


def encode_text(proto: bytes, text: str, rate: float = 0.0, seed: str = "", variant: int = 0) -> bytes:
    return encode_texts(proto, [text], rate, seed, [variant])[0]


def decode_array(proto: bytes, pieces: pa.Array) -> pa.Array:
    """The text of each row's ids; bytes that are no text as U+FFFD."""
    model, got = _model(proto), []
    for s in range(0, len(pieces), ROWS):
        some = pieces[s : s + ROWS]
        n = np.array(pc.fill_null(pc.binary_length(some), 0), np.int64) // 4
        ids = np.frombuffer(b"".join(x for x in some.to_pylist() if x), "<i4")
        data, sizes = model.decode(ids, n)
        rows = _rows(pa.binary(), data, sizes, np.array(some.is_null()))
        try:
            got.append(rows.cast(pa.string()))
        except pa.ArrowInvalid:
            got.append(pa.array([None if x is None else x.decode("utf-8", "replace") for x in rows.to_pylist()], pa.string()))
    return pa.concat_arrays(got) if got else pa.array([], pa.string())


@cache
def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", into: str = "pieces", rate: float = 0.1, seed: str = "0", copy_col: str | None = None, model: str = MODEL) -> DataFrame:
    """``df`` with the ids of the text's pieces, as little-endian 32-bit numbers. ``copy_col`` numbers the rows that
    repeat a document, so that each is drawn by itself."""
    if not 0 <= rate < 1:
        raise ValueError("rate must be from 0 to below 1")
    proto = read_model(model)

    @F.arrow_udf("binary")  # by batches, so that decoding runs in the same worker
    def run(texts: pa.Array, variants: pa.Array) -> pa.Array:
        try:
            return encode_array(proto, texts, rate, seed, variants, _plain(proto))
        finally:
            give_back()

    copy = F.lit(0) if copy_col is None else F.col(f"`{copy_col}`").cast("int")
    variant = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), copy)
    return df.withColumn(into, run(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), variant))


def decode(df: DataFrame, pieces_col: str = "pieces", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text of the pieces."""
    proto = read_model(model)

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        try:
            return decode_array(proto, ids)
        finally:
            give_back()

    return df.withColumn(into, run(F.col(f"`{pieces_col}`")))


def n_pieces(pieces: Column) -> Column:
    return (F.octet_length(pieces) / 4).cast("bigint")
