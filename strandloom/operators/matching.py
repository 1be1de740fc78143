"""Best match of several patterns in a string, over whole Arrow batches.

A row of bytes per read; each pattern is compared with all rows at once. The choice follows the patterns' order: a pattern
is tried where the best match so far has fewer equal bytes than the pattern is long, and wins with strictly more equal
bytes than the best; a perfect match ends the search for its row. So an early short perfect match stands against a later,
longer one, and a match of no equal byte never counts.

Alignments are exact affine-gap dynamic programs: equal +1, unequal -1, a gap -2 for its first and -1 for each further
byte. Letters are compared in upper case; N equals N alone. Of alignments of equal score the diagonal step goes before
gaps and the leftmost start before others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .patterns import MatchType

#: Strings are taken in groups of like length (up to twice the shortest) and of so many bytes at most, so that a batch takes
#: memory by its bytes and not by its longest string; alignments hold some 100 bytes for each.
CELLS = 1 << 20
RESULT = "struct<choice:int,start:int,end:int,pattern:string>"


def _matrix(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, right-padded by 0, and lengths."""
    n = np.array([len(s) for s in strings], np.int64)
    if not len(strings) or not n.max():
        return np.zeros((len(strings), 0), np.uint32), n
    return np.array(strings).view(np.uint32).reshape(len(strings), -1), n


def _hamming(m: np.ndarray, n: np.ndarray, p: np.ndarray, place: str) -> tuple[np.ndarray, np.ndarray]:
    """Equal bytes (-1: the pattern does not fit) and where the window begins."""
    size, rows = len(p), len(n)
    if place == "whole" or place == "prefix":
        fits = n == size if place == "whole" else n >= size
        got = (m[:, :size] == p).sum(1) if m.shape[1] >= size else np.zeros(rows, np.int64)
        return np.where(fits, got, -1), np.zeros(rows, np.int64)
    if place == "suffix":
        at = n - size
        if m.shape[1] < size:
            return np.full(rows, -1), at
        own = np.take_along_axis(m, np.maximum(at, 0)[:, None] + np.arange(size), 1)
        return np.where(at >= 0, (own == p).sum(1), -1), at
    best, at = np.full(rows, -1), np.zeros(rows, np.int64)
    for o in range(m.shape[1] - size + 1):
        got = np.where(o + size <= n, (m[:, o : o + size] == p).sum(1), -1)
        better = got > best
        best[better], at[better] = got[better], o
    return best, at


#: A state of the dynamic program is one number, so that the better of two is the greater: from the top its score, which way
#: it came, how far left it begins, equal columns, columns.
_WAY, _BEGIN, _EQUAL = 45, 25, 13
_SCORE, _LEFTMOST, _ZERO = 47, (1 << 20) - 1, 1 << 14
_NO_WAY = ~(3 << _WAY)


def _state(begin: int, score: int = 0, columns: int = 0) -> int:
    return (_ZERO + score) << _SCORE | (_LEFTMOST - begin) << _BEGIN | columns


def _cost(score: int, equal: int = 0) -> int:
    return (score << _SCORE) + (equal << _EQUAL) + 1


def align(p: np.ndarray, s: np.ndarray, start: str, end: str) -> dict[str, np.ndarray]:
    """Align a pattern with rows of equal length.

    ``start``: ``both`` ends anchored, ``read`` may be skipped at first, or ``any`` (local). ``end``: ``both`` to the end,
    ``pattern`` may stop early with the read at its end, or ``any``. Returns score, equal, columns, begin and stop (of the
    read) of each row's best alignment.
    """
    rows, width = s.shape
    if width > _LEFTMOST or len(p) > 4000:
        raise ValueError("alignments take patterns up to 4000 and strings up to 1048575 bytes")
    full = lambda x: np.full(rows, x, np.int64)
    never = full(_state(0, -_ZERO // 2))
    best, stop = full(0), full(0)
    opened, longer = _cost(-2), _cost(-1)
    equal_cost, unequal_cost = _cost(1, 1), _cost(-1)
    letters = [np.where(s == c, equal_cost, unequal_cost) for c in np.unique(p)] if len(p) else []
    which = np.searchsorted(np.unique(p), p)

    def offer(i: int, j: int, cell: np.ndarray) -> None:
        nonlocal best, stop
        if end == "any" or (j == width and (end == "pattern" or i == len(p))):
            better = cell > best
            best, stop = np.where(better, cell, best), np.where(better, j, stop)

    # of the pattern's bytes so far, for each place in the read: the best state, and the best that ends in a gap of the read
    cells, ups = [], []
    for j in range(width + 1):
        if j == 0 or start != "both":
            cells.append(full(_state(j)))
        else:
            cells.append(full(_state(0, -1 - j, j)))
        ups.append(never)
        offer(0, j, cells[j])
    for i in range(1, len(p) + 1):
        new_cells, new_ups, left = [], [], never
        pay = letters[which[i - 1]]
        for j in range(width + 1):
            up = np.maximum(cells[j] + opened, ups[j] + longer)
            if j:
                before = np.maximum(cells[j - 1], _state(j - 1)) if start == "any" else cells[j - 1]
                diag = before + pay[:, j - 1]
                left = np.maximum(new_cells[-1] + opened, left + longer)
                cell = np.maximum(np.maximum(diag | 2 << _WAY, up | 1 << _WAY), left) & _NO_WAY
            else:
                cell = np.maximum(up, _state(0)) if start == "any" else up
            new_cells.append(cell)
            new_ups.append(up)
            offer(i, j, cell)
        cells, ups = new_cells, new_ups
    return {
        "score": (best >> _SCORE) - _ZERO, "equal": best >> _EQUAL & 4095, "columns": best & 8191,
        "begin": _LEFTMOST - (best >> _BEGIN & _LEFTMOST), "stop": stop,
    }


def _end_alignment(p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pattern's beginning with the read's end: equal, columns and where in the read it begins. First the best
    alignment of the pattern from its start that may stop anywhere gives the read's start; where it stops short of the
    read's end, the read is aligned from there to its end, the pattern's tail left over."""
    width = s.shape[1]
    one = align(p, s, "read", "any")
    equal, columns, begin = one["equal"], one["columns"], one["begin"]
    short = (one["stop"] < width) & (one["score"] > 0)
    for b in np.unique(begin[short]):
        own = np.flatnonzero(short & (begin == b))
        two = align(p, s[own][:, b:], "both", "pattern")
        equal[own], columns[own] = two["equal"], two["columns"]
    return equal, columns, begin


def _aligned(m: np.ndarray, n: np.ndarray, p: np.ndarray, kind: MatchType) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = len(n)
    score, start, end = np.full(rows, -1), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    size = len(p)
    width = np.minimum(n, kind.window(size)) if kind.place in ("prefix", "suffix") else n
    if kind.place == "search":  # what pads shorter strings equals no byte, so no local alignment gains by it
        width = np.full(rows, m.shape[1])
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if kind.place == "suffix":
            s = np.take_along_axis(m[own], (n[own] - w)[:, None] + np.arange(w), 1) if w else m[own][:, :0]
            equal, columns, begin = _end_alignment(p, s)
            a, b = n[own] - w + begin, n[own]
        elif kind.place == "prefix":
            equal, columns, begin = _end_alignment(p[::-1], m[own][:, :w][:, ::-1])
            a, b = np.zeros(len(own), np.int64), w - begin
        else:
            got = align(p, m[own][:, :w], *(("both", "both") if kind.place == "whole" else ("any", "any")))
            equal, columns, a, b = got["equal"], got["columns"], got["begin"], got["stop"]
            if kind.place == "whole":
                a, b = np.zeros(len(own), np.int64), np.full(len(own), w)
        fits = (columns > 0) & (equal / np.maximum(columns, 1) >= kind.identity) & (equal / size >= kind.overlap)
        score[own] = np.where(fits, equal, -1)
        start[own], end[own] = a, b
    return score, start, end


def choose(strings: list[str | None], patterns: list[list[str] | str], kind: MatchType) -> pa.Array:
    """For each string (None: passed over) the pattern that is chosen, and where it is; null if none is. A pattern is one
    text for all rows or one for each. Alignments take patterns up to 4000 and strings up to 1,048,575 bytes, more fail."""
    out: list[dict | None] = [None] * len(strings)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        if s is not None:
            by_length.setdefault(len(s).bit_length(), []).append(i)
    for bits, rows in by_length.items():
        some = max(1, CELLS >> bits)
        for k in range(0, len(rows), some):
            _choose(strings, np.array(rows[k : k + some]), patterns, kind, out)
    return pa.array(out, pa.struct([("choice", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string())]))


def _choose(strings: list[str | None], rows: np.ndarray, patterns: list[list[str] | str], kind: MatchType, out: list[dict | None]) -> None:
    """Put the choices of some rows into ``out``."""
    own = [strings[i] for i in rows]
    if kind.family == "aln":
        own = [s.upper() for s in own]
    m, n = _matrix(own)
    best, choice = np.zeros(len(own), np.int64), np.full(len(own), -1)
    start, end = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    text: list[str | None] = [None] * len(own)
    done = np.zeros(len(own), bool)
    for k, pattern in enumerate(patterns):
        groups = {pattern: np.arange(len(own))} if isinstance(pattern, str) else {}
        if not isinstance(pattern, str):
            by: dict[str, list[int]] = {}
            for i, r in enumerate(rows):
                by.setdefault(pattern[r], []).append(i)
            groups = {p: np.array(x) for p, x in by.items()}
        for p, some in groups.items():
            some = some[~done[some] & (best[some] < len(p))]
            if not len(some):
                continue
            code = np.array([ord(c) for c in (p.upper() if kind.family == "aln" else p)], np.uint32)
            if kind.family == "hamming":
                got, at = _hamming(m[some], n[some], code, kind.place)
                got = np.where(got >= kind.threshold.least(len(p)), got, -1)
                stop = at + len(p)
            else:
                got, at, stop = _aligned(m[some], n[some], code, kind)
            won = got > best[some]
            at_rows = some[won]
            best[at_rows], choice[at_rows], start[at_rows], end[at_rows] = got[won], k, at[won], stop[won]
            for r in at_rows:
                text[r] = p
            done[at_rows] = best[at_rows] >= len(p)
    for i, r in enumerate(rows):
        if choice[i] >= 0:
            out[r] = {"choice": int(choice[i]), "start": int(start[i]), "end": int(end[i]), "pattern": text[i]}
