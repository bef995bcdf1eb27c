"""Cutting of oversized texts at natural boundaries, with overlaps.

Recursive bisection over the tokens of a text: cut at the strongest boundary near the
midpoint, go on with each half that still exceeds the limit less the overlap, then put
the overlap before each piece but the first. Cuts and overlaps lie between characters.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import SP, TOKENIZER_DIR, WS, Chunk, Coder, Cuts, chunks, coder, small_letters

# Marks that end a sentence or a clause.
ENDS, CLAUSES = ".!?…。！？।", ",;:，、；："
PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, PIECE, INSIDE = 6, 5, 4, 3, 2, 1, 0
#: Strengths of the cuts between characters, the strongest first: 1 more than their kind, 0 standing for places inside a character.
KINDS = range(PARAGRAPH + 1, INSIDE, -1)
#: A cut lies at most this share of a range from its middle.
NEAR = 0.25


@functools.cache
def _mark_kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: strength of a cut in white space after it; strength of a cut right after it in scripts without blanks."""
    spaced, bare = np.full(0x110000, BLANK, np.int8), np.zeros(0x110000, np.int8)
    spaced[[ord(c) for c in CLAUSES]] = CLAUSE
    spaced[[ord(c) for c in ENDS + ")”\"»"]] = SENTENCE
    bare[[ord(c) for c in "，、；："]] = CLAUSE
    bare[[ord(c) for c in "。！？।"]] = SENTENCE
    return spaced, bare


def _strengths(cuts: Cuts) -> np.ndarray:
    """Strength of a cut before each code point; white space stays with the text before a line's
    start and with the word after it elsewhere."""
    cp, n = cuts.cp, len(cuts.cp)
    out = np.zeros(n + 1, np.int8)
    out[cuts.piece_start] = PIECE
    if not n:
        return out
    spaced, bare = _mark_kinds()
    newline = cp == 10
    white = (cuts.sym == SP) | (cuts.sym == WS) | newline
    turn = np.flatnonzero(white[1:] != white[:-1]) + 1
    gap = turn[white[turn]]  # where white space follows text
    at = turn[~white[turn]]  # where text follows white space
    # the gap before each such text, and the line breaks in it
    first = np.searchsorted(gap, at) - 1
    begin = np.where(first >= 0, gap[np.maximum(first, 0)], 0) if len(gap) else np.zeros(len(at), np.int64)
    lines = np.concatenate([[0], np.cumsum(newline)])
    breaks = lines[at] - lines[begin]
    out[at[breaks == 1]] = LINE
    out[at[breaks > 1]] = PARAGRAPH
    plain = at[breaks == 0]
    out[plain] = np.maximum(out[plain], BLANK)
    # inside a line the cut is before the white space; a sentence goes on where a small letter follows
    value = spaced[cp[gap - 1]]
    follow = np.minimum(np.searchsorted(at, gap), max(len(at) - 1, 0))
    if len(at):
        value = np.where((value == SENTENCE) & small_letters()[cp[at[follow]]], BLANK, value)
        broken = (breaks[follow] > 0) & (at[follow] > gap)
        out[gap[~broken]] = value[~broken]
    else:
        out[gap] = value
    after = np.flatnonzero(bare[cp[:-1]] > 0) + 1
    after = after[~white[after]]
    out[after] = np.maximum(out[after], bare[cp[after - 1]])
    return out


def _nearest(places: np.ndarray, mid: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each range [x, y) the one of the sorted ``places`` in it that is nearest to ``mid``, the first of two; -1 if none."""
    if not len(places):
        return np.full(len(mid), -1, np.int64)
    i = np.searchsorted(places, mid, "right")
    left, right = places[np.maximum(i - 1, 0)], places[np.minimum(i, len(places) - 1)]
    has_left, has_right = (i > 0) & (left >= x), (i < len(places)) & (right < y)
    return np.where(has_left & (~has_right | (mid - left <= right - mid)), left, np.where(has_right, right, -1))


class _Places:
    """Tokens of a chunk at which a text may be cut: those of each strength, the strongest first, and all of them."""

    def __init__(self, strength: np.ndarray):
        self.kinds = [at for v in KINDS if len(at := np.flatnonzero(strength == v))]
        self.every = np.flatnonzero(strength)
        # the last token at or before each one that begins a character
        self.floor = np.maximum.accumulate(np.where(strength > 0, np.arange(len(strength)), -1))


def _bisect(places: _Places, lo: np.ndarray, hi: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the ranges [lo, hi) of tokens, each of at most ``room`` tokens, in order: all ranges are cut at once, level by level.

    A range that can be cut nowhere between characters stays whole."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(lo):
        over = hi - lo > room
        done.append((lo[~over], hi[~over]))
        lo, hi, room = lo[over], hi[over], room[over]
        mid = (lo + hi) // 2
        reach = np.maximum(1, ((hi - lo) * NEAR).astype(np.int64))
        x, y = np.maximum(lo + 1, mid - reach), np.minimum(hi, mid + reach + 1)
        # the strongest kind that occurs near the middle; if none does, the nearest place at all
        cut, left = np.full(len(lo), -1, np.int64), np.arange(len(lo))
        for at in places.kinds:
            cut[left] = _nearest(at, mid[left], x[left], y[left])
            left = left[cut[left] < 0]
            if not len(left):
                break
        cut[left] = _nearest(places.every, mid[left], lo[left] + 1, hi[left])
        ok = cut >= 0
        done.append((lo[~ok], hi[~ok]))
        lo, hi, room = np.concatenate([lo[ok], cut[ok]]), np.concatenate([cut[ok], hi[ok]]), np.tile(room[ok], 2)
    lo, hi = (np.concatenate(z) for z in zip(*done)) if done else (lo, hi)
    order = np.argsort(lo, kind="stable")
    return lo[order], hi[order]


class _Counter:
    """Tokens of ranges of texts encoded alone, from the tokens of the whole texts.

    Only the pieces of the pre-tokenizer that the ends of a range cut differ; they are runs of one kind of
    character, so their parts are pieces too. Ranges for which that may not be so are encoded afresh, all
    together: those that end inside white space or a contraction, or begin at an apostrophe.
    """

    def __init__(self, chunk: Chunk, c: Coder):
        self.c, self.total, self.cuts = c, chunk.total, chunk.cuts
        self.whole = np.zeros(int(chunk.total[-1]) + 1, bool)
        self.whole[chunk.total] = True  # whether a token begins a piece

    def _of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens of the code points [a, b), each range part of one piece."""
        data, at = self.cuts.data, self.cuts.byte_at
        return self.c.part_counts([data[i:j] for i, j in zip(at[a].tolist(), at[b].tolist())])

    def __call__(self, t0: np.ndarray, t1: np.ndarray, x: np.ndarray, y: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of the code points [x, y), which are tokens [t0, t1) of the chunk; ``end``: where their text ends."""
        cuts, total, cp, white = self.cuts, self.total, self.cuts.cp, self.cuts.white
        n, exact = t1 - t0, np.zeros(len(t0), bool)
        s = np.flatnonzero(~self.whole[t0])  # the start cuts a piece
        p = np.searchsorted(total, t0[s], "right") - 1
        odd = (cp[cuts.piece_start[p]] == 39) | (cp[x[s]] == 39) | (cuts.piece_end[p] >= y[s])
        exact[s[odd]] = True
        s, p = s[~odd], p[~odd]
        n[s] += self._of(x[s], cuts.piece_end[p]) - total[p + 1] + t0[s]
        inner = y < end
        e = np.flatnonzero(inner & ~self.whole[t1] & ~exact)  # the end cuts a piece
        q = np.searchsorted(total, t1[e], "right") - 1
        odd = (cp[cuts.piece_start[q]] == 39) | white[y[e] - 1]
        exact[e[odd]] = True
        e, q = e[~odd], q[~odd]
        n[e] += self._of(cuts.piece_start[q], y[e]) - t1[e] + total[q]
        if self.c.blank_joins:
            # a run of white space before a word is two pieces, its last character being the second; with nothing after it, it is one
            w = np.flatnonzero(inner & ~exact & (y - x > 1))
            w = w[self.whole[t1[w]] & white[y[w] - 1] & white[y[w] - 2] & ~white[y[w]]]
            if len(w):
                run = cuts.white_from[y[w] - 1]
                odd = (run <= x[w]) | (cp[y[w] - 1] == 32)
                exact[w[odd]] = True
                w, run = w[~odd], run[~odd]
                n[w] += self._of(run, y[w]) - self._of(run, y[w] - 1) - self._of(y[w] - 1, y[w])
        if exact.any():
            n[exact] = self.c.count([cuts.joined[i:j] for i, j in zip(x[exact].tolist(), y[exact].tolist())])
        return n


#: Columns of the arrays of pieces.
COLUMNS = ("limit_id", "text", "piece_no", "piece_lo", "core_lo", "piece_hi", "n_tokens", "overlap")


def _pieces(limit_id: int, most: int, overlap: int, docs: np.ndarray, first: np.ndarray, places: _Places, at: np.ndarray, base: np.ndarray, end: np.ndarray, count) -> np.ndarray:
    """Pieces of the texts ``docs`` as rows of COLUMNS.

    ``first``: first token of each text, one more at the end; ``at``: code point of each token; ``base``, ``end``: where
    each text begins and ends; ``count``: tokens of ranges encoded alone. A piece that has more than ``most`` alone is cut again.
    """
    lo, hi = _bisect(places, first[docs], first[docs + 1], np.full(len(docs), most - overlap))
    done: list[np.ndarray] = []
    while len(lo):
        d = np.searchsorted(first, lo, "right") - 1
        opens, closes = lo == first[d], hi == first[d + 1]
        start = np.where(opens, lo, np.maximum(places.floor[np.maximum(lo - overlap, first[d])], first[d]))
        core, y = np.where(opens, base[d], at[lo]), np.where(closes, end[d], at[np.where(closes, 0, hi)])
        x = np.where(start == first[d], base[d], at[start])
        n = count(start, hi, x, y, end[d])
        again = (n > most) & (hi - lo > 1)
        a, b = _bisect(places, lo[again], hi[again], (hi - lo + 1)[again] // 2)
        if len(a) == again.sum():  # none of them can be cut
            a, b, again = a[:0], b[:0], np.zeros(len(lo), bool)
            while len(k := np.flatnonzero((n > most) & (start < lo))):  # the limit holds before the overlap does
                start[k] = places.every[np.searchsorted(places.every, start[k], "right")]
                x[k] = at[start[k]]
                n[k] = count(start[k], hi[k], x[k], y[k], end[d[k]])
        keep = ~again
        done.append(np.stack([lo, d, x - base[d], core - base[d], y - base[d], n, lo - start], 1)[keep])
        lo, hi = a, b
    out = np.concatenate(done) if done else np.zeros((0, 7), np.int64)
    out = out[np.argsort(out[:, 0], kind="stable")]
    begins = np.flatnonzero(np.diff(out[:, 1], prepend=-1))
    number = np.arange(len(out)) - np.repeat(begins, np.diff(np.append(begins, len(out))))
    return np.column_stack([np.full(len(out), limit_id), out[:, 1], number, out[:, 2:]])


def split_texts(texts: list[str], c: Coder, limits: list[tuple[int, int, int]], cuts: Cuts | None = None) -> np.ndarray:
    """Rows of COLUMNS, one per piece of every text beyond a limit; text: its index.

    ``limits``: (limit_id, max_tokens, overlap_tokens). ``cuts``: the texts' pieces, if already found.
    """
    chunk = Chunk(cuts or Cuts(texts, c.blank_joins), c)
    cuts = chunk.cuts
    counts, first = chunk.counts(), chunk.total[cuts.doc_piece]
    if not any((counts > most).any() for _, most, _ in limits):
        return np.zeros((0, len(COLUMNS)), np.int64)
    if not hasattr(cuts, "strength"):  # the same for every tokenizer that shares these cuts
        cuts.strength = _strengths(cuts)
    at = chunk.places(c.id_bytes)
    places = _Places(np.where(at >= 0, cuts.strength[np.maximum(at, 0)] + 1, 0))
    base = cuts.doc_at
    end = np.append(base[1:] - 1, len(cuts.cp))
    alone = _Counter(chunk, c)
    return np.concatenate([_pieces(i, most, overlap, np.flatnonzero(counts > most), first, places, at, base, end, alone) for i, most, overlap in limits])


def split_by_library(text: str, c: Coder, limits: list[tuple[int, int, int]]) -> np.ndarray:
    """As ``split_texts`` for one text that the tokenizer's normaliser changes: token places come from its library."""
    enc = c.whole.encode(text, add_special_tokens=False)
    if all(len(enc.ids) <= most for _, most, _ in limits):
        return np.zeros((0, len(COLUMNS)), np.int64)
    at = np.array([o[0] for o in enc.offsets], np.int64)
    fits = np.concatenate([[True], at[1:] > at[:-1]])
    places = _Places(np.where(fits, _strengths(Cuts([text], c.blank_joins))[at] + 1, 0))
    count = lambda t0, t1, x, y, end: c.count([text[i:j] for i, j in zip(x.tolist(), y.tolist())])
    one, first = np.zeros(1, np.int64), np.array([0, len(at)])
    return np.concatenate([_pieces(i, most, overlap, one, first, places, at, one, np.array([len(text)]), count) for i, most, overlap in limits if len(enc.ids) > most])


SCHEMA = "limit_id int, {id} {kind}, piece_no int, piece_lo int, core_lo int, piece_hi int, n_tokens int, overlap_tokens int"


def split_corpus(df: DataFrame, limits: list[tuple[int, str, int, int]], id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, with_text: bool = False) -> DataFrame:
    """Pieces of every text with more tokens than a limit, for each limit (limit_id, tokenizer, max_tokens, overlap_tokens).

    piece_lo, core_lo, piece_hi are code points: [core_lo, piece_hi) of a text's pieces cover it without
    gap; [piece_lo, core_lo) repeats the end of the piece before, overlap_tokens tokens of it (more only
    where that many would begin inside a character, fewer only where a piece that can't be cut any more would
    exceed the limit otherwise). n_tokens is the count of the piece encoded alone and at most max_tokens;
    only a single character of more tokens than a limit could exceed it. Null, empty
    and short texts have no pieces; repeated rows are cut each. Other columns are dropped. No shuffle.
    """
    usable = [(i, t, m, max(0, min(o or 0, m - 1))) for i, t, m, o in limits if i is not None and t is not None and m is not None and m > 0]

    def run(batches):
        by: dict[str, list] = {}
        for i, t, m, o in usable:
            by.setdefault(t, []).append((i, m, o))
        lowest = min((m for _, t, m, _ in usable if t != "word_bpe_49k"), default=0)
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                found: list[np.ndarray] = []

                def add(rows: np.ndarray, of: list[int], found=found) -> None:
                    rows[:, 1] = np.array(of, np.int64)[rows[:, 1]]
                    found.append(rows)

                byte_cuts: tuple[list[int], Cuts] | None = None
                for name, ls in sorted(by.items(), key=lambda x: x[0] == "word_bpe_49k"):
                    c = coder(name, folder)
                    least = min(m for _, m, _ in ls)
                    if c.blank_joins:
                        if byte_cuts is None:  # shared by the byte-level tokenizers; a token has at least one byte
                            long = [i for i in range(lo, hi) if len(texts[i]) * 4 > lowest]
                            byte_cuts = long, Cuts([texts[i] for i in long], True)
                        long, cuts = byte_cuts
                        add(split_texts([texts[i] for i in long], c, ls, cuts), long)
                        continue
                    # case folding and composing at most triple a character's bytes
                    ready = {i: c.prepared(texts[i]) for i in range(lo, hi) if len(texts[i]) * 12 > least}
                    if byte_cuts is not None:
                        over = {byte_cuts[0][k] for k in np.flatnonzero(c.over(byte_cuts[1], least)).tolist()}
                        known = set(byte_cuts[0])
                        ready = {i: t for i, t in ready.items() if t is None or i in over or i not in known}
                    fast = [i for i, t in ready.items() if t is not None]
                    if fast:
                        add(split_texts([ready[i] for i in fast], c, ls), fast)
                    for i in [i for i, t in ready.items() if t is None]:
                        add(split_by_library(texts[i], c, ls), [i])
                rows = np.concatenate(found) if found else np.zeros((0, len(COLUMNS)), np.int64)
                if len(rows):
                    arrays = [pa.array(rows[:, 0], pa.int32()), ids.take(pa.array(rows[:, 1])), *(pa.array(rows[:, k], pa.int32()) for k in range(2, len(COLUMNS)))]
                    names = ["limit_id", id_col, "piece_no", "piece_lo", "core_lo", "piece_hi", "n_tokens", "overlap_tokens"]
                    if with_text:
                        arrays.append(pa.array([texts[d][x:y] for d, x, y in rows[:, [1, 3, 5]].tolist()], pa.string()))
                        names.append("piece")
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, SCHEMA.format(id=f"`{id_col}`", kind=kind) + ", piece string" * with_text)
