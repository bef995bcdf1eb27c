"""Values whose end is missing because storage or transfer stopped inside a word or sentence.

Intact values of a sample are cut artificially (inside words, between words, at a length
limit, with and without a mark of the cut); a logistic regression on hashed features of
the closing characters, the last words, the punctuation left open, the length against
the limits found in the field, and what the other values of the row show of the missing
end learns to tell cut from intact ones. Every value is then scored.
"""

from __future__ import annotations

import bisect
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import align
from .sampling import first_by_hash
from .sentences import _MARKS, CJK, CLOSERS, PAIRS, REMEMBERED, STOPS, Lexicon, _bucket, _left, _slots, fit_logistic, folded, split
from .sentences import Model as Splitter

#: Results whose values train the classifier, the first ones by a hash of their id.
TRAIN_ROWS = 3000
BITS = 16
#: Share of cut values that is assumed where the threshold is chosen.
PRIOR = 0.03
#: Share of the values longer than a limit that are also cut at one.
AT_LIMIT = 0.4
#: Share of artificial cuts that are put after a stop or colon inside a sentence, where there is one.
INNER = 0.05
# Marks that a cut may leave behind.
CUT_MARK = re.compile(r"\s*(?:\[…\]|\[\.\.\.\]|…|\.\.\.|�+)\s*$")
_END = re.compile(rf"[{STOPS}]+[\s{re.escape(CLOSERS)}]*[{STOPS}]*$")
_TRAIL = STOPS + CLOSERS + " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_COMBINING = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x20000) if unicodedata.combining(chr(c))) + "]+")
# accents of the Latin script are sought apart, as they are the most frequent
_ACCENTS, _BEYOND_LATIN = re.compile("[\u0300-\u036f]+"), re.compile("[\u0483-\u1fff\u2c00-\uffff\U00010000-\U0001ffff]")
_DIGITS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹–‐", "0123456789--")
_DIGIT = re.compile("[⁰¹²³⁴⁵⁶⁷⁸⁹–‐]")


def uncut(t: str) -> str:
    """A text without what marks a cut at its end."""
    return CUT_MARK.sub("", t) if t.rstrip().endswith(("…", "...", "�", "[...]", "[…]")) else t


def ending(t: str) -> int:
    """Place from which a text consists of stops and closing marks only, a stop first; -1 if it does not end so."""
    at = len(t.rstrip(_TRAIL))
    m = _END.search(t, at)
    return m.start() if m else -1


def closing(t: str) -> str:
    """Kind of the end of a folded text."""
    t = t.rstrip()
    if not t:
        return "none"
    if t[-1] == "�":
        return "broken"
    if t.endswith(("[…]", "[...]")):
        return "bracketed"
    at = ending(t)
    m = _END.match(t, at) if at >= 0 else None
    if m:
        return "dots" if re.match(r"\s?(?:…|\.\.)", t[at:]) or "…" in m.group() or ".." in m.group() else "stop"
    c = t[-1]
    if c in ":：":
        return "colon"
    if c in ",;，、；":
        return "comma"
    if c in "([（「『«„“":
        return "open"
    if c in CLOSERS:
        return "close"
    return "digit" if c.isdigit() else "letter" if c.isalpha() or unicodedata.category(c)[0] == "M" else "other"


def plain(text: str) -> str:
    """Text for comparison with its siblings: no case, accents, layout or fragments."""
    t = folded(align.FRAGMENT.sub("~", text) if align.FRAGMENT_SIGN.search(text) else text)[0]
    if not t.isascii():
        t = _ACCENTS.sub("", unicodedata.normalize("NFKD", t.translate(_DIGITS) if _DIGIT.search(t) else t))
        t = _COMBINING.sub("", t) if _BEYOND_LATIN.search(t) else t
    return " ".join(t.lower().replace("!", ".").replace("?", ".").split())


class Look:
    """What is computed once for a text: folded and comparable forms, the latter without a mark of a cut, language, kind of its end."""

    __slots__ = ("folded", "plain", "bare", "lang", "kind")

    def __init__(self, text: str, languages: align.Languages):
        self.folded = folded(text)[0]
        self.plain = plain(text)
        self.bare = uncut(self.plain).rstrip(" .")
        self.lang, self.kind = languages.of(self.folded), closing(self.folded)


class Memory:
    """What has been computed for texts met lately: their looks, sentences, words. Bounds memory, not results."""

    def __init__(self, model: Model):
        self.model, self.looks, self.ends, self.words, self.sources, self.tails = model, {}, {}, {}, {}, {}

    def _kept(self, of: dict, text: str, make):
        got = of.get(text)
        if got is None:
            if len(of) > REMEMBERED:
                of.clear()
            got = of[text] = make(text)
        return got

    def look(self, text: str) -> Look:
        return self._kept(self.looks, text, lambda t: Look(t, self.model.tables.languages))

    def own_words(self, text: str) -> set[str]:
        return self._kept(self.words, text, lambda t: set(re.findall(r"[\w]+(?:[-'’.]\w+)*", folded(t)[0].lower())))

    def sentence_ends(self, text: str) -> set[int]:
        """Comparable lengths of a text up to each of its sentences' ends."""
        return self._kept(self.ends, text, lambda t: {len(plain(t[:a]).rstrip(" .")) for a in [*split(t, self.model.splitter)[1:], len(t)]})

    def source(self, text: str) -> tuple[list[list[str]], list[int], dict]:
        """(bags of words, lengths, index) of an original's sentences."""

        def make(t: str):
            at, bags = align.source_bags(t, self.model.splitter)
            marks = align.numbered(t)
            sizes = [len(folded(align.with_numbers(t, x, y, marks))[0]) for x, y in zip(at, [*at[1:], len(t)])]
            return bags, sizes, align.index_of(bags)

        return self._kept(self.sources, text, make)

    def tail(self, bare: str) -> tuple[list[str], int] | None:
        """(words, length) of a text's last sentence."""

        def make(t: str):
            h = split(t, self.model.splitter)
            last = folded(t[h[-1] :])[0] if h else ""
            return (align.bag(last), len(last)) if h else None

        return self._kept(self.tails, bare, make)


class Model:
    def __init__(self, weights, lex: Lexicon, words: set, limits: dict, ratio: dict, splitter: Splitter, tables: align.Tables):
        self.least = 0.0
        self.weights, self.lex, self.words, self.limits, self.ratio, self.splitter, self.tables = weights, lex, words, limits, ratio, splitter, tables

    def score(self, feats: list[str]) -> float:
        """Above 0: cut."""
        return sum(map(_Weights.of(self).__getitem__, feats)) - self.least

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}


class _Weights(dict):
    """Weights of the features met lately, by their names."""

    @classmethod
    def of(cls, model: Model) -> _Weights:
        known = model.__dict__.get("_known")
        if known is None or known.weights is not model.weights or len(known) > 500_000:
            known = model._known = cls()
            known.weights = model.weights
        return known

    def __missing__(self, feature: str) -> float:
        w = self[feature] = float(self.weights[_slots([feature])[0]])
        return w


_CLOSING = sorted(set(PAIRS.values()))
_LAST = re.compile(rf"[^\W{CJK}]+(?:[-'’.][^\W{CJK}]+)*$")


def _last_word(t: str) -> str:
    """The word in lower case that a text ends with, or nothing."""
    if not t or not (t[-1].isalnum() or t[-1] == "_"):
        return ""
    m = _LAST.search(t[-80:].split()[-1])
    return m.group().lower() if m else ""


def _bin(x: float, edges: tuple) -> int:
    return bisect.bisect_right(edges, x)


class Row:
    """A result's values."""

    def __init__(self, original: str | None, final: str | None, hops: list | None, source: str | None = None):
        self.original, self.source = original or "", source
        self.values = [("final", -1, final)] if final and final.strip() else []
        self.values += [("hops", i, h) for i, h in enumerate(hops or []) if h and h.strip()]

    def with_values(self, texts: list[str], source: str | None = None) -> Row:
        out = Row(self.original, None, None, source or self.source)
        out.values = [(f, no, t) for (f, no, _), t in zip(self.values, texts)]
        return out

    def features(self, field: str, no: int, text: str, model: Model, memory: Memory | None = None) -> list[str]:
        memory = memory or Memory(model)
        look = memory.looks.get(text) or memory.look(text)
        t, p, lang, kind = look.folded, look.plain, look.lang, look.kind
        o, op, okind = "", "", "none"
        if self.original.strip():
            of_original = memory.look(self.original)
            o, op, okind = of_original.folded, of_original.plain, of_original.kind
        bare = uncut(t).rstrip()
        end = ending(bare) if kind == "stop" else -1
        body = (bare[:end] if end >= 0 else bare.rstrip(":：") if kind == "colon" else bare).rstrip()
        lex, last = model.lex, _last_word(body)
        left = _left(body, len(body))
        ends = lex.end[left]
        e = "?" if ends + lex.plain[left] < 3 else str(_bin(ends / (ends + lex.plain[left] + 1), (0.02, 0.1, 0.3, 0.6)))
        # an abbreviation or the whole part of a decimal: a stop after it hardly ever ends anything
        of = model.splitter.lex
        doubt = _bucket(of.e(left), of.end[left] + of.stop[left]) + "ab"[of.short(left)] if kind == "stop" else ""
        known = "" if not last else "o" if last in memory.own_words(self.original) else "k" if last in model.words else "u"
        limits = [model.limits.get((field, i, self.source)) for i in (0, 1)]
        at = at_limit(text, limits[0] or set(), limits[1] or set()) if any(limits) else ""
        opened = "o" if _MARKS.search(t) and (t.count('"') % 2 or kind != "stop" and sum(map(t.count, PAIRS)) > sum(map(t.count, _CLOSING))) else ""
        # the other values of the row in the same language, or the original of an untranslated one
        rel, rest = "none", ""
        comparable = look.bare
        sib_kind = "none"
        for f2, n2, v in [*self.values, ("original", -1, self.original)]:
            if (f2, n2) == (field, no) or not v:
                continue
            other = memory.looks.get(v) or memory.look(v)
            q, qc = other.plain, other.bare
            if other.lang != lang or not q:
                continue
            sib_kind = other.kind
            if qc == comparable:
                rel = "same" if rel != "inside" else rel
            elif len(comparable) > 3 and q.startswith(comparable):
                after = q[len(comparable) :]
                rest = "stop" if after[:1] in "..。।…" and (len(after) < 2 or after.lstrip(".。।…)”\"»]")[:1] in " ~" or re.match(f"[{CJK}]", after[1:2])) and kind in ("stop", "dots", "close", "colon") and len(comparable) in memory.sentence_ends(v) else "mid"
                rel = "inside"
            elif comparable.startswith(qc) and len(qc) > 3:
                rel = "longer" if rel == "none" else rel
            elif rel == "none":
                rel = "other"
        out = ["b", f"k{kind}", f"k{kind}o{okind}", f"k{kind}o{okind}f{lang}", f"e{e}k{kind}", f"l{left}{'.' if kind in ('stop', 'colon') else ''}", f"q{doubt}k{kind}", f"q{doubt}r{rel}{rest}", f"w{known}k{kind}", f"a{at}", f"a{at}k{kind}", f"p{opened}k{kind}", f"r{rel}{rest}", f"r{rel}{rest}k{kind}", f"r{rel}s{sib_kind}k{kind}", f"c{bare[-1:]}k{kind}", f"d{bare[-2:]}", f"t{bare[-3:]}", f"e{e}w{known}r{rel}", f"x{t[-1:].isspace()}"]
        r = len(p) / max(len(op), 1) / model.ratio.get(lang, 1.0)
        rb = _bin(r, (0.4, 0.6, 0.75, 0.87, 0.95, 1.1, 1.3))
        out += [f"n{rb}k{kind in ('stop', 'colon')}", f"n{rb}r{rel}k{kind in ('stop', 'colon')}"]
        # how much of the sentence that the last one renders is there
        if (kind != "stop" or doubt[:1] in "01") and op and (lang != align.ORIGINALS or rel in ("none", "other")) and (tail := memory.tail(bare)):
            words, length = tail
            src, sizes, index = memory.source(self.original)
            to, back_to = model.tables.sides(lang)
            single = align.index_of([words])
            there = [x.get(0, 0.0) for x in align.covers(src, single, to)]
            (back,) = align.covers([words], index, back_to)
            i = max(range(len(src)), key=lambda k: there[k] + back.get(k, 0.0), default=None)
            cover, away = (there[i], back.get(i, 0.0)) if i is not None else (0.0, 0.0)
            size = length / max(1, sizes[i]) / model.ratio.get(lang, 1.0) if i is not None else 1.0
            c, s = _bin(cover, (0.2, 0.4, 0.55, 0.7, 0.8, 0.9)), _bin(size, (0.3, 0.5, 0.7, 0.85, 1.0))
            out += [f"v{c}k{kind}", f"v{c}z{s}", f"v{c}k{kind}o{okind}", f"y{_bin(away, (0.3, 0.6))}v{c}", f"v{c}z{s}e{e}k{kind}", f"v{c}l{lang}"]
        return out


def _inner_stops(t: str, starts: list[int]) -> list[int]:
    """Places after stops and colons of ``t`` where none of its sentences ends: abbreviations, decimals, colons."""
    ends = {len(t[:a].rstrip()) for a in starts}
    return [m.end() for m in re.finditer(rf"[{STOPS}:：]", t.rstrip()[:-2]) if m.end() >= 6 and m.end() not in ends]


def cut_somewhere(t: str, rnd: random.Random, limit: int | None, splitter: Splitter | None = None) -> str | None:
    """``t`` cut inside a word or sentence, in one of the ways in which storage and transfer cut; None if too short.

    With a splitter a cut may also leave a stop or colon that ends no sentence."""
    n = len(t.rstrip())
    if n < 14:
        return None
    way = rnd.random()
    if limit is not None and n > limit and way < 0.4:
        k = limit
    elif way < 0.75:
        k = rnd.randint(max(6, n // 4), n - 2)
    else:
        k = rnd.randint(max(6, n - 30), n - 2)
    if rnd.random() < 0.25:  # between words
        j = t.rfind(" ", 6, k)
        k = j + rnd.randint(0, 1) if j > 0 else k
    starts = split(t, splitter) if splitter else []
    if splitter and rnd.random() < INNER and (inner := _inner_stops(t, starts)):
        k = rnd.choice(inner)
    out = t[:k]
    ended = bool(_END.search(out.rstrip())) or out.rstrip()[-1:] in ":："
    if len(out.strip()) < 5 or ended and (not splitter or len(out.rstrip()) in {len(t[:a].rstrip()) for a in starts}):
        return None
    if ended:
        return out
    x = rnd.random()
    if x < 0.08:
        return out.rstrip() + rnd.choice(["…", "..."])
    if x < 0.14:
        return out.rstrip() + " […]"
    if x < 0.24 and not t.isascii():
        return out + "�"
    return out


def _sources(runs: DataFrame) -> DataFrame:
    """(run_id, source): the model of each run, once for a run delivered twice."""
    return runs.where("run_id is not null").groupBy("run_id").agg(F.max("model").alias("source")).where("source is not null")


def limits_of(results: DataFrame, runs: DataFrame) -> dict:
    """(field, unit, source) -> lengths, in code points (unit 0) and bytes (1), at which the field's values of a source
    pile up against their neighbours. All results are counted, a text once for each field and source; the shuffles
    carry hashes and lengths, and what comes to the driver are the limits."""
    size = lambda v: (F.xxhash64(v).alias("h"), F.length(v).alias("n0"), F.octet_length(v).alias("n1"))
    one = lambda f, v: F.struct(F.lit(f).alias("field"), *size(v))
    every = results.where("result_id is not null and run_id is not null").select("run_id", F.explode(F.concat(F.array(one("final", F.col("final"))), F.coalesce(F.transform("hops", lambda v: one("hops", v)), F.array()))).alias("v")).select("run_id", "v.*").where("n0 is not null")
    texts = every.join(_sources(runs), "run_id").select("source", "field", "h", "n0", "n1").distinct()
    n = texts.select("source", "field", F.posexplode(F.array("n0", "n1")).alias("unit", "k")).groupBy("source", "field", "unit", "k").agg(F.count("*").alias("c"))
    near = Window.partitionBy("source", "field", "unit").orderBy("k").rangeBetween(-12, 12)
    found = n.withColumn("beside", F.sum("c").over(near) - F.col("c")).where("k >= 64 and c >= 6 and c > 4 * beside / 24 + 3")
    out: dict = {}
    for field, unit, source, k in found.select("field", "unit", "source", "k").collect():
        out.setdefault((field, unit, source), set()).add(k)
    return out


def at_limit(text: str, chars: set, size: set) -> str:
    """Which limits a value's length meets: "0" in code points, "1" in bytes, "2" one in bytes that backs off to a
    character's start or leaves a mark of a broken character."""
    bare = text.rstrip("�")
    n, broken = len(text.encode()), len(bare) < len(text)
    out = "0" * (len(text) in chars) + "1" * (n in size)
    if size and not out and not bare.isascii():
        # up to three bytes of a character are lost; each mark takes three
        m = len(bare.encode()) if broken else n
        out = "2" * any(0 < k - m <= 3 for k in size)
    elif size and broken and any(0 < k - len(bare.encode()) <= 3 for k in size):
        out += "2"
    return out


def cut_at(t: str, unit: int, limit: int, rnd: random.Random) -> str | None:
    """``t`` cut at a limit in code points or bytes; a character that a byte limit breaks is dropped or leaves a mark."""
    out = t[:limit] if unit == 0 else t.encode()[:limit].decode(errors=rnd.choice(("ignore", "replace")))
    return out if len(out) < len(t) and len(out.strip()) >= 5 else None


def train(rows: list[tuple], splitter: Splitter, tables: align.Tables, seed: int = 0, limits: dict | None = None) -> Model:
    """A model from sampled results (original, final, hops and, with limits, source). Without rows nothing is marked."""
    rnd = random.Random(seed)
    lex, words = Lexicon(), Counter()
    made = [Row(*r) for r in rows]
    of_lang = lambda v: tables.languages.of(folded(v)[0])
    every = [(f, v) for r in made for f, _, v in r.values] + [("original", r.original) for r in made if r.original.strip()]
    limits = limits or {}
    of_field: dict[str, list[tuple[int, int, str]]] = {}
    for (f, unit, source), ks in sorted(limits.items()):
        of_field.setdefault(f, []).extend((unit, k, source) for k in sorted(ks))
    ratios: dict[str, list[float]] = {}
    for f, v in every:
        t = folded(v)[0].rstrip()
        bare = (t[: ending(t)] if ending(t) >= 0 else t).rstrip().rstrip(":：")
        lex.end[_left(bare, len(bare))] += 1
        toks = t.split()
        for tok in toks[:-1]:
            lex.plain[_left(tok.rstrip(".,;:!?"), len(tok.rstrip(".,;:!?")))] += 1
        words.update(w.lower() for w in re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", t[: t.rfind(" ")]))
    for r in made:
        if r.original.strip():
            for _, _, v in r.values:
                ratios.setdefault(of_lang(v), []).append(len(plain(v)) / max(1, len(plain(r.original))))
    ratio = {k: float(np.median(v)) for k, v in ratios.items()}
    model = Model(np.zeros(1 << BITS, np.float32), lex, {w for w, n in words.items() if n > 1}, limits, ratio, splitter, tables)
    model.weights[_slots(["b"])] = -1
    x, y, of, memory = [], [], [], Memory(model)
    for k, r in enumerate(made):
        for f, no, v in r.values:
            feats = r.features(f, no, v, model, memory)
            kind = memory.look(v).kind
            if any(z.startswith("rinsidemid") for z in feats) or any(z in feats for z in ("kbroken", "kbracketed", "kcomma", "kopen")):
                continue  # no intact value
            okind = closing(folded(r.original)[0])
            if r.original.strip() and okind in ("stop", "colon") and kind in ("letter", "digit") and "。" not in r.original and not re.search(f"[{CJK}]", v):
                continue
            x.append(_slots(feats))
            y.append(0.0)
            of.append(k)
            # a value longer than a limit is cut there too, as if it came from the limit's source
            over = [z for z in of_field.get(f, ()) if (len(v) if z[0] == 0 else len(v.encode())) > z[1]]
            at = [rnd.choice(over)] if over and rnd.random() < AT_LIMIT else []
            for unit, limit, source in [(0, 0, None)] * 2 + at:
                cut = cut_at(v, unit, limit, rnd) if source else cut_somewhere(v, rnd, None, splitter)
                if source and cut and len(cut.rstrip()) in {len(v[:a].rstrip()) for a in split(v, splitter)}:
                    cut = None  # a whole sentence's end
                if cut:
                    # values that say the same are often made from one another: the cut may be in both
                    both = rnd.random() < 0.4 and [w if memory.look(w).plain != memory.look(v).plain else cut for _, _, w in r.values]
                    row = r.with_values(both or [w for _, _, w in r.values], source) if both or source else r
                    x.append(_slots(row.features(f, no, cut, model, memory)))
                    y.append(1.0)
                    of.append(k)
    if not x or not any(y):
        return model
    # values taken for intact that look cut all the same are left out
    w = fit_logistic(x, np.array(y), BITS, epochs=2, seed=seed)
    keep = [i for i in range(len(x)) if y[i] or w[x[i]].sum() < 1.0]
    fit = [i for i in keep if of[i] % 4]
    w = fit_logistic([x[i] for i in fit], np.array([y[i] for i in fit]), BITS, epochs=10, seed=seed)
    model.weights, model.least = w, _threshold([(float(w[x[i]].sum()), y[i]) for i in range(len(x)) if not of[i] % 4])
    return model


def _threshold(held: list[tuple[float, float]]) -> float:
    """Score from which the F1 of held-out rows is best, if cut values are PRIOR of all."""
    cut, whole = np.sort([s for s, z in held if z]), np.sort([s for s, z in held if not z])
    if not len(cut) or not len(whole):
        return 0.0
    best = (0.0, 0.0)
    for t in np.arange(0.0, 6.0, 0.1):
        hit = PRIOR * (1 - np.searchsorted(cut, t, "right") / len(cut))
        false = (1 - PRIOR) * (1 - np.searchsorted(whole, t, "right") / len(whole))
        best = max(best, (2 * hit / (hit + false + PRIOR), -t))
    return float(-best[1])


def sample_rows(results: DataFrame, rows: int = TRAIN_ROWS, runs: DataFrame | None = None) -> list[tuple]:
    """(original, final, hops, source) of at most ``rows`` results, the first by a hash of their id: the bound of what comes to the driver."""
    got = first_by_hash(results.where("result_id is not null").select("result_id", "original", "final", "hops", "run_id"), "result_id", rows, seed=1)
    seen = {r[0]: r for r in got}
    wanted = sorted({r[4] for r in seen.values() if r[4] is not None})
    source = dict(map(tuple, _sources(runs.where(F.col("run_id").isin(wanted))).collect())) if runs is not None and wanted else {}
    return [(*r[1:4], source.get(r[4])) for r in seen.values()]


def scored(results: DataFrame, model: Model, runs: DataFrame | None = None) -> DataFrame:
    """(result_id, run_id, n_values, cut array<struct<field, hop_no>>) of every result, one row for a row
    delivered twice. n_values counts the values of final and hops that are not null; empty and
    blank ones are never cut. Rows with a null result_id are left out, other columns dropped.
    With runs a value is held against its source's limits: only the runs of sources that have limits are broadcast.
    """

    def run(batches):
        memory = Memory(model)
        for b in batches:
            n, fields, hops, offsets = [], [], [], [0]
            for o, f, hs, source in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                r = Row(o, f, hs, source)
                n.append((f is not None) + sum(h is not None for h in hs or []))
                for field, no, v in r.values:
                    if model.score(r.features(field, no, v, model, memory)) > 0:
                        fields.append(field)
                        hops.append(no)
                offsets.append(len(fields))
            s = pa.StructArray.from_arrays([pa.array(fields, pa.string()), pa.array(hops, pa.int32())], names=["field", "hop_no"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), s)], names=["result_id", "run_id", "n_values", "cut"])

    rows = results.where("result_id is not null").select("result_id", "run_id", "original", "final", "hops")
    limited = sorted({source for _, _, source in model.limits})
    if runs is not None and limited:
        rows = rows.join(F.broadcast(_sources(runs).where(F.col("source").isin(limited))), "run_id", "left").select(*rows.columns, "source")
    else:
        rows = rows.withColumn("source", F.lit(None).cast("string"))
    return rows.mapInArrow(run, "result_id bigint, run_id bigint, n_values int, cut array<struct<field: string, hop_no: int>>").dropDuplicates(["result_id"])


def rates(found: DataFrame, runs: DataFrame) -> DataFrame:
    """(model, n_values, n_cut, share) for each source: the model of the run, 'unknown' without a run or a model.

    Values are added up by run before the join with the runs, of which a row delivered twice counts once."""
    by_run = found.groupBy("run_id").agg(F.sum("n_values").alias("n"), F.sum(F.size("cut")).alias("c"))
    one = runs.where("run_id is not null").groupBy("run_id").agg(F.max("model").alias("model"))
    m = by_run.join(one, "run_id", "left").groupBy(F.coalesce("model", F.lit("unknown")).alias("model"))
    return m.agg(F.sum("n").alias("n_values"), F.sum("c").alias("n_cut"), F.try_divide(F.sum("c"), F.sum("n")).alias("share"))
