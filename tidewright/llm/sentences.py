"""Sentence units in any of the corpus's languages and scripts.

Candidates are the places after stops (with their closing marks) and, in scripts
without word blanks, the blanks themselves. A maximum-entropy classifier decides each
from its neighbours: tokens, case, length, digits, script, kind of mark and gap. It is
trained on reliable boundaries only: the end of one whole value joined to the start of
another is a boundary; a stop before a small letter, after a token that never ends a
value, or before one that never starts one, is none. Text inside closed quotation marks
or brackets is never cut.
"""

from __future__ import annotations

import functools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .glyphs import BLANKS, LOOK_ALIKES
from .sampling import first_by_hash

#: Rows whose values train the classifier, the first ones by a hash of their id.
TRAIN_ROWS = 3000
BITS = 16
#: Texts whose sentences a worker remembers; beyond it the memory starts anew. Bounds memory, not results.
REMEMBERED = 5_000
# Marks that may end a sentence, closing marks, pairs of quotation marks and brackets.
STOPS = ".!?…。！？｡।॥"
CLOSERS = ")]）］」』”“\"»’'"
PAIRS = {"(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“"}
INVISIBLE = re.compile("[­͏؜​-‏‪-‮⁠-⁯︀-️﻿]")
CJK = "々〇぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ⺀-⿕"
_CJK = re.compile(f"[{CJK}]")
_STOP = re.compile(rf"[{STOPS}]+[{re.escape(CLOSERS)}]*(?:[{STOPS}]+[{re.escape(CLOSERS)}]*)*(?: ?[»”])?")
_GAP = re.compile(r"\s+")
_ENUM = re.compile(r"\(?(?:[0-9]{1,3}|[a-z]|[ivx]{1,5})[.)](?=\s|$|[" + CJK + "])")
_FILE = re.compile(r"[\w-]+\.[a-z]{1,4}\b|[`\\$\[@]|[a-z]+[A-Z]")
_TABLE = {ord(k): v for k, v in LOOK_ALIKES.items() if len(v) == 1} | {c: " " for c in BLANKS if c != 0x3000} | {0xFF01 + i: chr(0x21 + i) for i in range(94) if chr(0xFF01 + i) not in "！？（），：；"}
_ODD = re.compile("[^\x00-\x7e]")
_MAPPED = re.compile("[" + "".join(re.escape(chr(c)) for c in _TABLE) + "]")
_MARKS = re.compile("[\"" + "".join(re.escape(c) for ab in PAIRS.items() for c in ab) + "]")


def folded(text: str) -> tuple[str, list[int] | None]:
    """(text of plain look, place of each of its characters in ``text`` or None if unchanged)."""
    if not _ODD.search(text):
        return text, None
    t = text.translate(_TABLE) if _MAPPED.search(text) else text
    if not INVISIBLE.search(t):
        return t, None
    at = [i for i, c in enumerate(t) if not INVISIBLE.match(c)]
    return "".join(t[i] for i in at), at


def enclosed(t: str) -> list[tuple[int, int]]:
    """(opening, closing) places of closed pairs, outermost ones only. A mark without partner is none."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []  # the closing marks awaited
    straight = -1
    for m in _MARKS.finditer(t):
        c, i = m.group(), m.start()
        if c == '"':
            if straight >= 0:
                out.append((straight, i))
            straight = -1 if straight >= 0 else i
            continue
        k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), -1)
        if k >= 0:
            out.append((stack[k][1], i))
            del stack[k:]
        elif c in PAIRS:
            stack.append((PAIRS[c], i))
    out.sort()
    top: list[tuple[int, int]] = []
    for a, b in out:
        if not top or a > top[-1][1]:
            top.append((a, b))
    return top


def _shape(tok: str) -> str:
    return tok if tok.isalpha() else re.sub(r"\d+", "9", tok)


def _cjk(c: str) -> bool:
    return c > "\u2e7f" and bool(_CJK.match(c))


def _left(t: str, end: int) -> str:
    """Token before place ``end``, at most 16 characters: in scripts without blanks its last two characters."""
    s = t[max(0, end - 16) : end]
    tok = s.split()[-1] if s and not s[-1].isspace() else ""
    if not tok.isalnum():
        tok = tok[max(map(tok.rfind, "(（“„«\"[")) + 1 :]
    if tok and _cjk(tok[-1]):
        return tok[-2:]
    if len(tok) == 1 and tok.isalpha():  # initials and spaced abbreviations keep their case and their first part
        j = end - 1
        return t[j - 3 : j] + tok if j >= 3 and t[j - 2 : j] == ". " and t[j - 3].isalpha() and not t[max(0, j - 4)].isalpha() else tok
    return _shape(tok.lower())[-10:]


def enumerator(t: str, at: int):
    """Match of an enumerator at a place; only digits, small letters and opening brackets begin one."""
    return _ENUM.match(t, at) if at < len(t) and ("a" <= (c := t[at]) <= "z" or c == "(" or "0" <= c <= "9") else None


def _right(t: str, at: int) -> tuple[str, str]:
    """(token from place ``at``, its kind)."""
    if at >= len(t):
        return "", "end"
    c = t[at]
    if enumerator(t, at):
        return "1)", "enum"
    if c in "(（":
        tok, kind = _right(t, at + 1)
        return tok, "(" + kind
    if c in "\"“„«「『¿¡":
        return c, "quote"
    if _cjk(c):
        return t[at : at + 2], "cjk"
    s = t[at : at + 16]
    tok = s.split(None, 1)[0] if not c.isspace() else ""
    if not tok.isascii():
        m = _CJK.search(tok)
        tok = tok[: m.start()] if m else tok
    if _FILE.match(tok):
        return "`", "code"
    kind = "digit" if c.isdigit() else "up" if c.isupper() else "low" if c.islower() else "deva" if "ऀ" <= c <= "ॿ" else "other"
    return _shape(tok.strip(".,;:!?।。"))[:12], kind


def candidates(t: str):
    """(start of mark, end of mark, next text, features' key) of each place where a sentence may end, in order."""
    spans = enclosed(t)
    k, n = 0, len(t)
    found: list[tuple[int, int, int, tuple]] = []
    wide = not t.isascii() and bool(_CJK.search(t))
    loose = "。" not in t
    marks = [(m.start(), m.end(), True) for m in _STOP.finditer(t)]
    if wide:
        ends = {e for _, e, _ in marks}
        marks += [(m.start(), m.start(), False) for m in _GAP.finditer(t) if m.start() not in ends and 0 < m.start() and m.end() < n]
        marks.sort()
    for s, e, stop in marks:
        # a closing mark that opens something else is no closing mark; nor is one that closes nothing
        while stop and e > s + 1 and t[e - 1] == '"' and any(a == e - 1 for a, _ in spans):
            e -= 1
        x = e
        while x < n and t[x].isspace():
            x += 1
        if x >= n:
            continue
        while k < len(spans) and spans[k][1] < s:
            k += 1
        if any(a < s and x <= b for a, b in spans[max(0, k - 1) : k + 2]):
            continue
        if stop and x == e and s > 0 and (t[x].isdigit() or t[x] in ",;:，、；：-/*_=" or (t[s] == "." and t[x].islower())) and t[s] in ".!?":
            continue
        gap = t[e:x]
        g = "" if not gap else "w" if "　" in gap else "n" if "\n" in gap else " " if len(gap) == 1 else "  "
        body = s
        while body > 0 and t[body - 1] == " " and stop and body == s:
            body -= 1
        left = _left(t, body)
        if left[-1:] in ")]）］”»」" and not stop:
            left = left[-1:]
        right, kind = _right(t, x)
        if stop:
            m = "".join(dict.fromkeys(t[s:e]))
        else:  # whether the text is written without stops, and whether the blank stands between two words of a script with word blanks
            m = "blank" + "sl"[loose] + "wc"[_cjk(t[s - 1]) or _cjk(t[x])]
        if t[s:e].startswith(".."):
            m = "…" + m[1:]
        found.append((s, e, x, (m, g, left, right, kind)))
    return found


class Lexicon:
    """How often a token ends a whole value against all its stops, starts one against all places after stops,
    and stands without a stop: an abbreviation hardly ever does."""

    def __init__(self):
        self.end, self.stop, self.start, self.after, self.plain = Counter(), Counter(), Counter(), Counter(), Counter()

    def short(self, left: str) -> bool:
        return self.plain[left] <= 0.1 * (self.stop[left] + self.end[left])

    def e(self, left: str) -> float:
        return (self.end[left] + 0.02) / (self.end[left] + self.stop[left] + 0.5)

    def s(self, right: str) -> float:
        return (self.start[right] + 0.02) / (self.start[right] + self.after[right] + 0.5)


def _bucket(p: float, n: int) -> str:
    return ("?" if n == 0 else "0" if p < 0.01 else "1" if p < 0.05 else "2" if p < 0.2 else "3") + ("." if n < 5 else "")


def features(key: tuple, lex: Lexicon) -> list[str]:
    m, g, left, right, kind = key
    e, s = _bucket(lex.e(left), lex.end[left] + lex.stop[left]), _bucket(lex.s(right), lex.start[right] + lex.after[right])
    script = "c" if left and _CJK.match(left[-1]) else "d" if left and "ऀ" <= left[-1] <= "ॿ" else "l"
    e += "ab"[lex.short(left)]
    letters = "1" if left[-1:].isalpha() and len(left) in (1, 4) and left[-2:-1] in ("", " ") else "9" if left == "9" else "."
    return [
        "b", f"m{m}", f"g{g}", f"m{m}g{g}k{kind}", f"k{kind}", f"s{script}k{kind}m{m}", f"l{left}", f"r{right}", f"n{min(len(left), 6)}{letters}", f"n{letters}k{kind}s{s}",
        f"e{e}", f"s{s}", f"e{e}s{s}", f"e{e}k{kind}", f"s{s}k{kind}m{m}", f"e{e}s{s}k{kind}m{m}", f"l{left}k{kind}", f"l{letters}r{right}",
    ]


def _slots(fs: list[str]) -> list[int]:
    return [zlib.crc32(f.encode()) & ((1 << BITS) - 1) for f in fs]


class Splits(dict):
    """Places of the sentences of texts met lately: values of one document's results are often the same."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, text: str) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[text] = split(text, self.model)
        return got


class Model:
    """Weights and lexicon; decisions are remembered by their features' key."""

    def __init__(self, weights: np.ndarray, lex: Lexicon):
        self.weights, self.lex, self.known = weights, lex, {}

    def ends(self, key: tuple) -> bool:
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[key] = float(self.weights[_slots(features(key, self.lex))].sum()) > 0
        return got

    def __getstate__(self):
        return {"weights": self.weights, "lex": self.lex, "known": {}}


def fit_logistic(rows: list[list[int]], y: np.ndarray, bits: int, epochs: int = 7, rate: float = 0.3, decay: float = 1e-5, seed: int = 0) -> np.ndarray:
    """Weights of a logistic regression on hashed features, by stochastic steps with per-weight rates, in a fixed order."""
    w, h = np.zeros(1 << bits, np.float64), np.full(1 << bits, 1e-3)
    arrays = [np.array(r, np.int64) for r in rows]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(arrays)):
            ix = arrays[i]
            own = w.take(ix)
            z = own.sum()
            grad = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y[i]) + decay * own
            past = h.take(ix) + grad * grad
            h[ix] = past
            w[ix] = own - rate * grad / np.sqrt(past)
    return w.astype(np.float32)


def train(values: list[str], seed: int = 0) -> Model:
    """A model from a sample of whole values of any languages. Without values it falls back on marks alone."""
    rnd = random.Random(seed)
    lex = Lexicon()
    texts = [folded(v)[0].strip() for v in dict.fromkeys(values) if v and v.strip()]
    found = [candidates(t) for t in texts]
    groups: dict[str, list[tuple[str, str]]] = {}
    for t, cs in zip(texts, found):
        right, kind = _right(t, 0)
        lex.start[right] += 1
        for tok in t.split():
            if tok[-1] not in STOPS + CLOSERS:
                lex.plain[_left(tok, len(tok.rstrip(",;:")))] += 1
        for _, _, _, (m, g, left, r, k) in cs:
            if m[0] in "!?！？。।" and k != "low" and m[-1] not in "\"”“»」":  # stops that end nothing but sentences
                lex.start[r] += 1
            else:
                lex.after[r] += 1
            if m[0] in ".…" and g == "  " and k in ("up", "(up"):  # writers who leave two blanks do so after sentences
                lex.end[left] += 1
            elif m[0] in ".…":
                lex.stop[left] += 1
        m = re.search(rf"[{STOPS}]+[{re.escape(CLOSERS)}]*$", t)
        script = "c" if _CJK.search(t) else "d" if re.search("[ऀ-ॿ]", t) else "l"
        if m and m.start():
            mark = m.group()
            body = t[: m.start()].rstrip(" ")
            left = _left(t, len(body))
            if mark[0] in ".…":
                lex.end[left] += 1
            name = "".join(dict.fromkeys(mark))
            groups.setdefault(script, []).append((("…" + name[1:]) if mark.startswith("..") else name, left))
        groups.setdefault(script + "s", []).append((right, kind))
    rows, y = [], []
    for script, gaps in (("l", [" ", " ", " ", "  ", "n", ""]), ("c", ["", "", "", " ", "n"]), ("d", [" ", " ", "n", "  "])):
        ends, starts = groups.get(script, []), groups.get(script + "s", [])
        for _ in range(min(6000, 3 * len(ends)) if starts else 0):
            (m, left), (right, kind) = rnd.choice(ends), rnd.choice(starts)
            rows.append((m, rnd.choice(gaps), left, right, kind))
            y.append(1)
            if kind == "up" and rnd.random() < 0.1:  # the same with a small letter after it: the sentence goes on
                rows.append((m, rnd.choice(gaps) or " ", left, right.lower(), "low"))
                y.append(0)
                rows.append((m + rnd.choice("\"”»"), " ", left, right.lower(), "low"))
                y.append(0)
    for t, cs in zip(texts, found):
        loose = "。" not in t
        for s, e, x, key in cs:
            m, g, left, right, kind = key
            if m.startswith("blank"):
                latin = not _CJK.match(t[s - 1]) and not _CJK.match(t[x])
                if g in "wn" and loose or (loose and (_CJK.match(t[s - 1]) or t[s - 1] in "）)%" or t[s - 1].isalnum()) and _CJK.match(t[x]) and not _ENUM.match(t[max(0, s - 4) : s + 1].lstrip())):
                    rows.append(key)
                    y.append(1)
                elif latin or not loose:
                    rows.append(key)
                    y.append(0)
                continue
            never_ends = m == "." and lex.end[left] == 0 and lex.stop[left] >= 12 and (lex.short(left) or kind == "enum")
            never_starts = m[0] in ".…" and lex.start[right] == 0 and lex.after[right] >= 6 and kind not in ("code", "enum", "(up", "quote")
            if kind == "low" and g or kind == "digit" and g and m == "." and lex.e(left) < 0.05 or never_ends or never_starts or (m[-1] in CLOSERS and m[-1] not in ")）" and kind in ("cjk", "deva") and g == ""):
                rows += [key] * (2 if never_ends or never_starts else 1)
                y += [0] * (2 if never_ends or never_starts else 1)
    if not rows:
        rows, y = [(".", " ", "x", "X", "up"), (".", " ", "x", "x", "low"), ("。", "", "文", "文", "cjk")], [1, 0, 1]
    w = fit_logistic([_slots(features(k, lex)) for k in rows], np.array(y, float), BITS, seed=seed)
    return Model(w, lex)


def split(text: str, model: Model) -> list[int]:
    """Places of the first characters of the sentences of ``text`` (code points, 0-based). A blank text has none."""
    t, at = folded(text)
    n = len(t)
    first = 0
    while first < n and t[first].isspace():
        first += 1
    if first >= n:
        return []
    out = [first]
    skip = -1
    m = enumerator(t, first)
    if m:
        skip = m.end()
    for s, e, x, key in candidates(t):
        if s < skip or x <= out[-1]:
            continue
        if key[0].startswith("blank") and t[s - 1] in ",;:，、；：":
            continue
        if model.ends(key):
            out.append(x)
            m = enumerator(t, x)
            if m:
                skip = m.end() + 1
    return out if at is None else [at[i] for i in out]


def sample_values(results: DataFrame, rows: int = TRAIN_ROWS) -> list[str]:
    """Values of at most ``rows`` results, the first by a hash of their id: the bound of what comes to the driver."""
    got = first_by_hash(results.where("result_id is not null").select("result_id", "original", "final", "hops"), "result_id", rows)
    return [v for r in got for v in (r[1], r[2], *(r[3] or [])) if v]


SENT = "array<struct<field: string, hop_no: int, sent_at: int>>"


def sentences(results: DataFrame, model: Model) -> DataFrame:
    """(result_id, field, hop_no, sent_at) of every sentence of original, final and hops.

    A null value has no sentence, nor has an empty or blank one. A row delivered twice
    counts once: its sentences are packed to one row before the only shuffle, which
    carries no text. Rows with a null result_id are left out. Other columns are dropped.
    """

    def run(batches):
        places = Splits(model)
        for b in batches:
            fields, hops, ats, offsets = [], [], [], [0]
            for o, f, hs in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                for field, no, v in (("original", -1, o), ("final", -1, f), *(("hops", i, h) for i, h in enumerate(hs or []))):
                    if v:
                        p = places[v]
                        fields += [field] * len(p)
                        hops += [no] * len(p)
                        ats += p
                offsets.append(len(ats))
            s = pa.StructArray.from_arrays([pa.array(fields, pa.string()), pa.array(hops, pa.int32()), pa.array(ats, pa.int32())], names=["field", "hop_no", "sent_at"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), s)], names=["result_id", "s"])

    packed = results.where("result_id is not null").select("result_id", "original", "final", "hops").mapInArrow(run, f"result_id bigint, s {SENT}")
    return packed.dropDuplicates(["result_id"]).select("result_id", F.inline("s"))
