"""Whole-corpus encoding with public tokenizers.

Pre-tokenisation uses no regular expression. Texts of a batch are joined to one
array of code points, each code point is mapped to a symbol class, and the
classes drive a finite automaton. A class *is* a function from state to state,
and composition of functions is associative, so the state before every code
point comes from a blocked prefix scan over these functions instead of a
sequential walk. Token boundaries are a table look-up on (state, symbol). The
slices go through a cache of merged pieces; only a piece never met before is
merged. Token byte lengths are kept, so every token's place in the text is known.
"""

from __future__ import annotations

import base64
import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Distinct pieces a worker remembers; beyond it the cache starts anew. Bounds memory, not results.
CACHE_PIECES = 300_000
#: Code points scanned at once (a longer single text is scanned alone).
CHUNK_CHARS = 400_000

L, N, SP, WS, O, A1, A2, RESET = range(8)
K = 9
START, IN_L, IN_N, IN_O, AFTER_SP, AFTER_WS, ONE_MORE, TWO_MORE, CLOSED = range(K)
# White_Space code points of the Unicode standard.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _tables_of_code_points() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.array([unicodedata.category(c) for c in map(chr, range(0x110000))], "S2")
    t = np.full(0x110000, O, np.uint8)
    first = kinds.astype("S1")
    t[first == b"L"], t[first == b"N"] = L, N
    t[WHITE] = WS
    t[32] = SP
    return t, kinds == b"Ll"


def symbol_table() -> np.ndarray:
    """Class of each code point: letter, number, blank, other white space, other."""
    return _tables_of_code_points()[0]


def small_letters() -> np.ndarray:
    """Whether each code point is a small letter."""
    return _tables_of_code_points()[1]


@functools.cache
def _tables(blank_joins: bool) -> tuple[np.ndarray, np.ndarray]:
    """(transition[symbol, state], boundary-before[symbol, state]) of a pre-tokenizer.

    blank_joins: a single blank belongs to the token after it and numbers run on
    (byte-level pre-tokenizer); else white space is dropped and each number stands
    alone (word pre-tokenizer).
    """
    t, b = np.zeros((8, K), np.uint8), np.ones((8, K), bool)
    t[N], t[SP], t[WS], t[O], t[RESET] = IN_N, AFTER_SP, AFTER_WS, IN_O, START
    t[L] = IN_L
    t[L, TWO_MORE], t[L, ONE_MORE] = ONE_MORE, CLOSED
    t[A1], t[A2] = ONE_MORE, TWO_MORE
    held = [IN_O, AFTER_SP] if blank_joins else [IN_O]
    t[A1, held] = t[A2, held] = IN_O
    b[L, [IN_L, ONE_MORE, TWO_MORE]] = False
    b[[O, A1, A2], IN_O] = False
    if blank_joins:
        b[[L, O, A1, A2, N], AFTER_SP] = False
        b[N, IN_N] = False
        for s in (SP, WS):
            b[s, [AFTER_SP, AFTER_WS]] = False
    return t, b


def scan_states(symbols: np.ndarray, step: np.ndarray, block: int = 128) -> np.ndarray:
    """State before each symbol: prefix composition of the symbols' transition functions.

    Blocks are composed for all start states at once, block functions are combined
    by a doubling scan, and a second pass replays each block from its known state.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.uint8)
    blocks = -(-n // block)
    s = np.full(blocks * block, RESET, np.uint8)
    s[:n] = symbols
    s = np.ascontiguousarray(s.reshape(blocks, block).T).astype(np.intp) * K
    flat = step.ravel()
    f = np.tile(np.arange(K, dtype=np.uint8), (blocks, 1))
    for row in s:
        f = flat[row[:, None] + f]
    hop = 1
    while hop < blocks:  # f[b] := f[b] after f[b - hop]
        f[hop:] = np.take_along_axis(f[hop:], f[:-hop].astype(np.intp), 1)
        hop *= 2
    out = np.empty((block, blocks), np.uint8)
    state = np.concatenate([[START], f[:-1, START]]).astype(np.uint8)
    for j, row in enumerate(s):
        out[j] = state
        state = flat[row + state]
    return out.T.ravel()[:n]


class Cuts:
    """Texts of a chunk and the places of their pieces, as arrays over the joined text.

    piece_start, piece_end: code points; piece_ix: each piece's place in ``words``, looked up once
    for all tokenizers that cut alike; data: the texts' bytes; byte_at: byte of each doc_at: first code point of each text; doc_piece: first piece of each text (one more at the end).
    """

    def __init__(self, texts: list[str], blank_joins: bool):
        step, before = _tables(blank_joins)
        self.joined = "\n".join(texts)
        self.cp = cp = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens + 1) - 1
        self.doc_at = ends - lens
        self.sym = sym = symbol_table()[cp]
        seps = ends[:-1]
        sym[seps] = RESET
        white = (sym == SP) | (sym == WS)
        # apostrophes that open a contraction: one or two given letters follow
        for i in np.flatnonzero(cp == 39):
            two = self.joined[i + 1 : i + 3]
            if two and two[0] in "stmd":
                sym[i] = A1
            elif two in ("re", "ve", "ll"):
                sym[i] = A2
        edge = before[sym, scan_states(sym, step)]
        self.white = white
        keep = np.ones(len(cp), bool)
        if blank_joins:
            # the last of several white-space characters stands apart if text follows
            edge[:-1] |= white[:-1] & ~white[1:] & (sym[1:] != RESET)
        else:
            edge |= white
            keep = ~white
        edge[seps] = True
        keep[seps] = False
        at = np.flatnonzero(edge)
        nxt = np.append(at[1:], len(cp))
        keep = keep[at]
        self.piece_start, self.piece_end = at[keep], nxt[keep]
        width = np.ones(len(cp), np.int8)
        for top in (0x80, 0x800, 0x10000):
            width += cp >= top
        self.byte_at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width, out=self.byte_at[1:])
        self.data = self.joined.encode()
        self.words = words_of(blank_joins)
        # all pieces as one Arrow array over the texts' bytes: equal ones are found there, and each distinct one is looked up once
        offsets = np.append(self.byte_at[at], self.byte_at[-1])
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])
        coded = every.filter(pa.array(keep)).dictionary_encode()
        place = np.fromiter(map(self.words.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        self.piece_ix = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int64)
        self.doc_piece = np.searchsorted(self.piece_start, np.append(self.doc_at, len(cp) + 1))

    @functools.cached_property
    def white_from(self) -> np.ndarray:
        """For each code point of white space, where its run begins; for any other, the next place."""
        return np.maximum.accumulate(np.where(self.white, 0, np.arange(1, len(self.white) + 1)))


class Words(dict):
    """Places of the distinct pieces met so far, in ``pieces``; the tokenizers keep what they know of each by its place."""

    def __init__(self):
        super().__init__()
        self.pieces: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        i = self[piece] = len(self.pieces)
        self.pieces.append(piece)
        return i


_WORDS: dict[bool, Words] = {}


def words_of(blank_joins: bool) -> Words:
    """The pieces that a pre-tokenizer has met in this worker, or none where they have become too many."""
    if len(_WORDS.get(blank_joins, ())) > CACHE_PIECES or blank_joins not in _WORDS:
        _WORDS[blank_joins] = Words()
    return _WORDS[blank_joins]


class Chunk:
    """The tokens of a chunk by one tokenizer."""

    def __init__(self, cuts: Cuts, coder: Coder):
        self.cuts, self.table = cuts, coder.table(cuts.words)
        self.piece_n = self.table.count[cuts.piece_ix]
        self.total = np.concatenate([[0], np.cumsum(self.piece_n)])

    def counts(self) -> np.ndarray:
        """Tokens of each text."""
        return np.diff(self.total[self.cuts.doc_piece])

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, index of each text's first, one more at the end)."""
        where = np.repeat(self.table.at[self.cuts.piece_ix] - self.total[:-1], self.piece_n) + np.arange(self.total[-1])
        return self.table.flat[where], self.total[self.cuts.doc_piece]

    def places(self, widths: np.ndarray) -> np.ndarray:
        """Code point at which each token begins, -1 if inside one; ``widths``: bytes of the text that each id stands for."""
        cuts, n = self.cuts, self.piece_n
        ids, _ = self.ids()
        byte = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(widths[ids], out=byte[1:])
        first = np.repeat(byte[self.total[:-1][n > 0]], n[n > 0])
        place = np.repeat(cuts.byte_at[cuts.piece_start], n) + byte[:-1] - first
        at = np.full(cuts.byte_at[-1] + 1, -1, np.int64)
        at[cuts.byte_at] = np.arange(len(cuts.byte_at))
        return at[np.minimum(place, cuts.byte_at[-1])]


class Pieces:
    """Merged pieces of ``words``: the ids of piece i lie in ``flat[at[i] : at[i] + count[i]]``."""

    def __init__(self, words: Words, merge):
        self.words, self.merge, self.known = words, merge, 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def fill(self) -> Pieces:
        """Merges the pieces that are new."""
        new = [self.merge(p) for p in self.words.pieces[self.known :]]
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            last, used = self.known + len(new), self.used + int(sizes.sum())
            while last > len(self.at):
                self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
            while used > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.count[self.known : last] = sizes
            self.at[self.known : last] = self.used + np.cumsum(sizes) - sizes
            self.flat[self.used : used] = [i for ids in new for i in ids]
            self.known, self.used = last, used
        return self


class Alone:
    """Tokens that the word tokenizer gives to each piece of ``words``, counted when asked for; before that, as many as its
    bytes, or twice as many where small letters may take more bytes than capitals."""

    def __init__(self, words: Words, count):
        self.words, self.of, self.known = words, count, 0
        self.at_most, self.counted = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)

    def most(self, ix: np.ndarray) -> np.ndarray:
        new = self.words.pieces[self.known :]
        last = self.known + len(new)
        while last > len(self.at_most):
            self.at_most, self.counted = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at_most, self.counted))
        self.at_most[self.known : last] = np.fromiter((len(p) if p.isascii() else 2 * len(p) for p in new), np.int64, len(new))
        self.known = last
        return self.at_most[ix]

    def count_all(self, ix: np.ndarray) -> None:
        for i in np.unique(ix[~self.counted[ix]]).tolist():
            self.at_most[i] = self.of(self.words.pieces[i].decode())
            self.counted[i] = True


class Counts(dict):
    """Numbers of tokens of pieces that stand alone."""

    def __init__(self, count):
        super().__init__()
        self.of = count

    def __missing__(self, piece) -> int:
        n = self[piece] = self.of(piece)
        return n


def _byte_names() -> dict[int, str]:
    """Names of bytes in a byte-level vocabulary: printable Latin-1 characters stand for themselves, the rest are numbered from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_NAMES = _byte_names()
_WHITE = "".join(map(chr, WHITE))


class Coder:
    """One tokenizer: its automaton, its merges, its cache."""

    def __init__(self, name: str, folder: str):
        self.name, self.folder = name, folder
        self.blank_joins = name != "word_bpe_49k"
        if self.blank_joins:
            ranks = read_ranks(os.path.join(folder, f"{name}.tiktoken"))
            self.vocab = [b""] * (max(ranks.values()) + 1)
            for k, v in ranks.items():
                self.vocab[v] = k
            self.merge = merger(ranks)
        else:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
            self.whole.encode_special_tokens = True
            model = self.whole.model
            # the piece is cut and of plain form already, so its bytes' names go straight to the pair merging
            self.merge = lambda piece: [t.id for t in model.tokenize(piece.decode() if piece.isalnum() else piece.decode("latin-1").translate(_BYTE_NAMES))]
        self._pieces: Pieces | None = None
        self._parts = Counts(lambda piece: len(self.merge(piece)))
        self._alone: Alone | None = None

    def table(self, words: Words) -> Pieces:
        """The tokenizer's ids of all pieces that ``words`` holds now."""
        if self._pieces is None or self._pieces.words is not words:
            self._pieces = Pieces(words, self.merge)
        return self._pieces.fill()

    def _count_alone(self, piece: str) -> int:
        """Tokens by the word tokenizer of a piece of the byte-level pre-tokenizer: case and blanks make no difference, digits stand alone."""
        t = self.prepared(piece)
        if t is None:
            return len(self.whole.encode(piece, add_special_tokens=False).ids)
        t = t.strip(_WHITE)
        if not t:
            return 0
        digits = symbol_table()[ord(t[-1])] == N
        return int(self.part_counts([x.encode() for x in (t if digits else [t])]).sum())

    def part_counts(self, parts: list[bytes]) -> np.ndarray:
        """Tokens of parts of pieces."""
        if len(self._parts) > CACHE_PIECES:
            self._parts.clear()
        return np.fromiter(map(self._parts.__getitem__, parts), np.int64, len(parts))

    def over(self, cuts: Cuts, most: int) -> np.ndarray:
        """Whether each text has more than ``most`` tokens by the word tokenizer, from the pieces of the byte-level pre-tokenizer.

        Both cut texts alike, but for an apostrophe that opens a contraction in only one of them: after a blank, or
        before a capital. Texts that have one count as over, so that whoever asks counts them exactly. A piece that has
        not been counted yet has at most as many tokens as bytes; it is counted where that does not settle a text.
        Only for texts that ``prepared`` does not refuse."""
        if self._alone is None or self._alone.words is not cuts.words:
            self._alone = Alone(cuts.words, self._count_alone)
        first = cuts.doc_piece
        sums = lambda: np.diff(np.concatenate([[0], np.cumsum(self._alone.most(cuts.piece_ix))])[first])
        open_ = np.flatnonzero(sums() > most)
        inside = np.zeros(len(cuts.piece_ix), bool)
        for d in open_.tolist():
            inside[first[d] : first[d + 1]] = True
        self._alone.count_all(cuts.piece_ix[inside])
        out = sums() > most
        marks = np.flatnonzero(cuts.cp == 39)
        opens = marks[(marks > 0) & (cuts.sym[np.maximum(marks - 1, 0)] == SP)].tolist()
        capital = [i for i in marks.tolist() if (two := cuts.joined[i + 1 : i + 3]) and two.lower() != two]
        out[np.searchsorted(cuts.doc_at, np.array(opens + capital, np.int64), "right") - 1] = True
        return out

    @functools.cached_property
    def id_text(self) -> list[bytes]:
        """The bytes that each id stands for; at a word's end of the word tokenizer a blank."""
        if self.blank_joins:
            return self.vocab
        names = self.whole.get_vocab()
        byte_of = {chr(b): b for b in range(256) if b not in _BYTE_NAMES} | {c: b for b, c in _BYTE_NAMES.items()}
        out = [b""] * (max(names.values()) + 1)
        for k, v in names.items():
            if set(k.removesuffix("</w>")) <= byte_of.keys():
                out[v] = bytes(byte_of[c] for c in k.removesuffix("</w>")) + b" " * k.endswith("</w>")
        return out

    @functools.cached_property
    def id_bytes(self) -> np.ndarray:
        """Bytes of the text that each id stands for."""
        if self.blank_joins:
            return np.fromiter(map(len, self.vocab), np.int64, len(self.vocab))
        # a byte of the text is one character of a token's name; the mark of a word's end is no text
        names = self.whole.get_vocab()
        out = np.zeros(max(names.values()) + 1, np.int64)
        for k, v in names.items():
            out[v] = len(k.removesuffix("</w>"))
        return out

    def prepared(self, text: str) -> str | None:
        """The text as the automaton takes it, of the same length; None if the tokenizer's
        own normaliser would move characters, so that its library must encode the text."""
        if self.blank_joins:
            return text
        if text.isascii():
            return text.lower()
        low = text.lower()
        plain = len(low) == len(text) and "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
        return low if plain else None

    def chunk(self, texts: list[str]) -> Chunk:
        return Chunk(Cuts(texts, self.blank_joins), self)

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends, _ = encoded(self, texts)
        i, e = ids.tolist(), ends.tolist()
        return [i[x:y] for x, y in zip(e, e[1:])]

    def count(self, texts: list[str]) -> np.ndarray:
        ready = [self.prepared(t) for t in texts]
        fast = [i for i, t in enumerate(ready) if t is not None]
        out = np.zeros(len(texts), np.int64)
        if fast:
            out[fast] = self.chunk([ready[i] for i in fast]).counts()
        for i, t in enumerate(ready):
            if t is None:
                out[i] = len(self.whole.encode(texts[i], add_special_tokens=False).ids)
        return out

    def decode(self, ids) -> str:
        """Text of ids; ids cut inside a character give the replacement character there. Of the word tokenizer, which keeps
        neither case nor white space, the words with a blank between them."""
        text = b"".join(map(self.id_text.__getitem__, ids)).decode(errors="replace")
        return text if self.blank_joins else text.removesuffix(" ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merger(ranks: dict[bytes, int]):
    """Byte-pair merging of one piece. The library's merge loop is used where present;
    ``merge_pairs`` gives the same ids."""
    try:
        import tiktoken
    except ImportError:
        return lambda piece: merge_pairs(piece, ranks)
    one = tiktoken.Encoding("own", pat_str=r"[^\x00]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return one


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges of a piece, lowest rank first, with a heap: n log n also for a piece of many thousand bytes."""
    import heapq

    if piece in ranks:
        return [ranks[piece]]
    part: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
    heap = [(r, i, part[i] + part[i + 1]) for i in range(len(part) - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i]
        if part[i] is None or j >= len(part) or part[i] + part[j] != pair:
            continue
        part[i], part[j], right[i] = pair, None, right[j]
        if right[i] < len(part):
            left[right[i]] = i
        for a in (left[i], i):
            if a >= 0 and right[a] < len(part):
                new = part[a] + part[right[a]]
                if (r := ranks.get(new)) is not None:
                    heapq.heappush(heap, (r, a, new))
    return [ranks[p] for p in part if p is not None]


@functools.cache
def coder(name: str, folder: str = TOKENIZER_DIR) -> Coder:
    """The tokenizer ``name`` of a folder; made once a worker."""
    if name not in ("byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k"):
        raise ValueError(f"no such tokenizer: {name}")
    return Coder(name, folder)


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` code points together, a longer one alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, with_offsets: bool = False) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row, without special tokens; strings of special tokens are plain text.

    A null and an empty text both give an empty list, a null id stays null, repeated
    rows stay repeated, other columns are dropped whatever their names. No shuffle:
    each Arrow batch is encoded where it is read. A text of any length is encoded whole.
    ``with_offsets``: a last column starts ARRAY<INT>, the code point in which each token begins.
    """

    def run(batches):
        c = coder(tokenizer, folder)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            at, flat, starts = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for lo, hi in chunks(texts):
                ids, ends, places = encoded(c, texts[lo:hi], with_offsets)
                flat.append(ids.astype(np.int32))
                starts.append(places.astype(np.int32))
                at.append(ends[1:] + at[-1][-1])
            offsets = pa.array(np.concatenate(at), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (flat, starts)[: 1 + with_offsets]]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=[id_col, "ids", "starts"][: 2 + with_offsets])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", starts array<int>" * with_offsets)


def encoded(c: Coder, texts: list[str], with_offsets: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts one after another, index of each text's first and one more, code point in which each begins if wanted)."""
    none = np.zeros(0, np.int64)
    ready = [c.prepared(t) for t in texts]
    if None not in ready:
        chunk = c.chunk(ready)
        ids, ends = chunk.ids()
        if not with_offsets:
            return ids, ends, none
        # a token that begins inside a character counts as beginning at it; every text's first token begins between characters
        at = np.maximum.accumulate(chunk.places(c.id_bytes))
        return ids, ends, at - np.repeat(chunk.cuts.doc_at, np.diff(ends))
    each, places = [], []
    for t, r in zip(texts, ready):
        if r is None:  # the tokenizer's own normaliser moves characters
            e = c.whole.encode(t, add_special_tokens=False)
            each.append(np.array(e.ids, np.int64))
            places.append(np.array([o[0] for o in e.offsets], np.int64))
        else:
            i, _, p = encoded(c, [t], with_offsets)
            each.append(i)
            places.append(p)
    return np.concatenate([none, *each]), np.concatenate([[0], np.cumsum([len(e) for e in each])]), np.concatenate([none, *places]) if with_offsets else none


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, text) of every row of ids; null ids give a null text, an empty list an empty one."""

    def run(batches):
        c = coder(tokenizer, folder)
        for b in batches:
            texts = [None if i is None else c.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_tripped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, text) of every row, encoded and decoded again where it is read; a null text comes back empty. No shuffle."""

    def run(batches):
        c = coder(tokenizer, folder)
        for b in batches:
            texts, back = [t or "" for t in b.column(1).to_pylist()], []
            for lo, hi in chunks(texts):
                ids, ends, _ = encoded(c, texts[lo:hi])
                i, e = ids.tolist(), ends.tolist()
                back += [c.decode(i[x:y]) for x, y in zip(e, e[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def count_corpus(df: DataFrame, id_col: str, text_col: str, tokenizer: str, folder: str = TOKENIZER_DIR, keep: list[str] | None = None, with_quality: bool = True) -> DataFrame:
    """(id_col, kept columns, n_tokens BIGINT, quality DOUBLE) of every row.

    n_tokens is 0 for null and empty texts. quality, if wanted, is the share of letters among the
    characters that are not white space, from 0.25 (none) to 1; 0.25 for blank texts.
    """
    keep = keep or []

    def run(batches):
        c = coder(tokenizer, folder)
        names = [id_col, *keep, "n_tokens"] + ["quality"] * with_quality
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            n, q = [np.zeros(0, np.int64)], [np.zeros(0)]
            for lo, hi in chunks(texts):
                part = texts[lo:hi]
                n.append(c.count(part))
                if with_quality:
                    q.append(letter_share(part))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(n)), *([pa.array(np.concatenate(q))] if with_quality else [])], names=names)

    kinds = [f"`{x}` {df.schema[x].dataType.simpleString()}" for x in (id_col, *keep)]
    return df.select(id_col, *keep, F.col(text_col).alias("_text")).mapInArrow(run, ", ".join([*kinds, "n_tokens bigint", *["quality double"] * with_quality]))


def letter_share(texts: list[str]) -> np.ndarray:
    """Share of letters among each text's characters that are not white space, from 0.25 to 1."""
    sym = symbol_table()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    letters, seen = (np.concatenate([[0], np.cumsum(x)]) for x in (sym == L, (sym != SP) & (sym != WS)))
    return 0.25 + 0.75 * np.diff(letters[ends]) / np.maximum(np.diff(seen[ends]), 1)
