"""Pairs of sentences that render one another in two languages.

Every sentence becomes a weighted bag of target words through learned translation
tables (expectation maximisation over word pairs, one table per language and
direction). Inverted indexes over the words of the other side retrieve each sentence's
best partner in both directions; matches that agree are kept, and sentences beside a
kept pair are merged into it where they explain what the pair leaves unexplained.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import first_by_hash, first_of_each
from .sentences import CJK, REMEMBERED, Model, folded, split

#: Rows of each pivot language in a sample of pairs, the first ones by a hash of their id; the most characters of an original in it.
TRAIN_ROWS = 2000
TRAIN_CHARS = 400
#: Share of a sentence's weight that its partner must render: for two sentences that
#: choose each other, for a merge of neighbours, and for a part that has moved away from its other part.
MUTUAL, MERGE, FAR = 0.34, 0.42, 0.62
#: Weight of a word that the tables have not seen.
UNSEEN = 4.0
#: Language of the originals.
ORIGINALS = "en"
FRAGMENT_SIGN = re.compile(r"[`$\[\\]")
# Protected fragments, which stand as [[0]], [[1]] ... in a translation.
FRAGMENT = re.compile(r"`[^`\n]+`|\$[^$\n]+\$|\[@[^\]\s]+\]|\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{[^}]*\}|\[\[\d+\]\]")
_LETTERS = re.compile(r"[^\W\d_]+")
_CJKRUN = re.compile(f"[{CJK}]+")
_SPLIT = re.compile(rf"\[\[\d+\]\]|[{CJK}]+|\d+(?:[.,]\d+)*|[^\W\d_{CJK}]+(?:[^\W_{CJK}]|[ऀ-ॣ]|-(?=\w))*")


def numbered(text: str) -> list[tuple[int, int, str]]:
    """(start, end, [[n]]) of the protected fragments of an original, numbered from the left."""
    return [(m.start(), m.end(), f"[[{i}]]") for i, m in enumerate(FRAGMENT.finditer(text))] if FRAGMENT_SIGN.search(text) else []


def words(text: str) -> list[str]:
    """Words of a text: numbers without separators, runs of scripts without blanks as pairs of characters."""
    out: list[str] = []
    for t in _SPLIT.findall(text.lower()):
        c = t[0]
        if c.isdigit():
            out.append("#" + re.sub(r"\D", "", t))
        elif c >= "⺀" and _CJKRUN.match(t):
            out += [t[i : i + 2] for i in range(len(t) - 1)] or [t]
        else:
            out.append(t)
    return out


class Languages:
    """Tells a text's language from the words and the characters beyond ASCII that it shares with labelled texts.

    A naive Bayes classifier: which languages there are is learnt from the labels, the runs' pivots. Without labels every
    text has the language "". A text of nothing known has the language with most texts."""

    def __init__(self, labelled: list[tuple[str, str]]):
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, name in labelled:
            counts[name].update(self.features(text))
        self._fit(counts)

    @classmethod
    def counted(cls, counts: dict[str, Counter]) -> Languages:
        """The languages of texts whose features were counted elsewhere: how many texts of each language have each."""
        got = cls.__new__(cls)
        got._fit(counts)
        return got

    def _fit(self, counts: dict[str, Counter]) -> None:
        self.names = sorted(counts) or [""]
        every = sum(counts.values(), Counter())
        self.place = {f: i for i, f in enumerate(f for f, n in every.items() if n > 1)}
        self.weight = np.zeros((len(self.place), len(self.names)))
        for k, name in enumerate(self.names):
            total = sum(counts[name].values()) + 0.1 * len(every)
            self.weight[:, k] = np.log([(counts[name][f] + 0.1) / max(total, 1) for f in self.place])
        self.usual = max(self.names, key=lambda n: sum(counts[n].values()))

    @staticmethod
    def features(text: str) -> set[str]:
        t = text.lower()
        return {*_LETTERS.findall(t), *(() if t.isascii() else (c for c in set(t) if c > "\x7f" and c.isalpha()))}

    def of(self, text: str) -> str:
        if len(self.names) == 1:
            return self.names[0]
        ix = [i for f in self.features(text) if (i := self.place.get(f)) is not None]
        return self.names[int(self.weight.take(ix, 0).sum(0).argmax())] if ix else self.usual


def with_numbers(text: str, lo: int, hi: int, marks: list[tuple[int, int, str]]) -> str:
    """text[lo:hi] with its fragments as numbered marks."""
    if not marks:
        return text[lo:hi]
    out, at = [], lo
    for a, b, m in marks:
        if a >= lo and b <= hi:
            out += [text[at:a], f" {m} "]
            at = b
    out.append(text[at:hi])
    return "".join(out)


class _Side:
    """What the words of one side mean on the other: each word's weight, its meanings, and whether the tables lack it."""

    def __init__(self, table: dict, weight: dict):
        self.table, self.weight, self.known = table, weight, {}

    def __getstate__(self):
        return {"table": self.table, "weight": self.weight, "known": {}}

    def of(self, w: str) -> tuple[float, dict[str, float], bool]:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            own, means = _own(w), self.table.get(w)
            x = 2.5 if w[0] in "#[" else 5.0 if own else self.weight.get(w, UNSEEN)
            got = self.known[w] = (x, {w: 1.0} if own or means is None else means, not own and means is None)
        return got


class Tables:
    """For each language: how strongly a word of either side means one of the other (0 to 1), and weighs among its own."""

    def __init__(self, to: dict, back: dict, weight: dict, weight_back: dict, languages: Languages | None = None):
        self.to, self.back = ({k: _Side(t, w.get(k, {})) for k, t in x.items()} for x, w in ((to, weight), (back, weight_back)))
        self.languages = languages or Languages([])

    def sides(self, lang: str) -> tuple[_Side, _Side]:
        return self.to.get(lang) or _Side({}, {}), self.back.get(lang) or _Side({}, {})


def train(pairs: list[tuple], rounds: int = 6, least: float = 0.04, keep: int = 12) -> Tables:
    """Tables from texts that render each other: (original, hop, language of the hop). A pair of unknown language, or given
    without one, has that which its words tell. Without pairs the tables are empty, and only words that are written alike
    (names, numbers, marks) match. ``learning.train_whole`` gives the same for the pairs of a whole table."""
    labelled = [(h, p[2]) for p in pairs for h in (p[1],) if len(p) > 2 and p[2]]
    languages = Languages(labelled + [(p[0], ORIGINALS) for p in pairs if labelled])
    by: dict[str, list[tuple[list[str], list[str]]]] = defaultdict(list)
    for p in pairs:
        o, h = folded(p[0])[0], folded(p[1])[0]
        a, b = words(with_numbers(o, 0, len(o), numbered(o))), words(h)
        if a and b:
            by[languages.of(p[1])].append((list(dict.fromkeys(a)), list(dict.fromkeys(b))))
    to, back, wa, wb = {}, {}, {}, {}
    for lang, rows in by.items():
        va = {w: i for i, w in enumerate(dict.fromkeys(w for a, _ in rows for w in a))}
        vb = {w: i for i, w in enumerate(dict.fromkeys(w for _, b in rows for w in b))}
        na, nb = len(va), len(vb)
        df_a, df_b = np.zeros(na), np.zeros(nb)
        sa, sb, row, row_b, k = [], [], [], [], 0
        for a, b in rows:
            x, y = np.array([va[w] for w in a]), np.array([vb[w] for w in b])
            df_a[x] += 1
            df_b[y] += 1
            sa.append(np.repeat(x, len(y)))
            sb.append(np.tile(y, len(x)))
            row.append(np.repeat(np.arange(k, k + len(x)), len(y)))
            row_b.append(np.tile(np.arange(len(y)), len(x)) + (row_b[-1].max() + 1 if row_b else 0))
            k += len(x)
        sa, sb, row, row_b = map(np.concatenate, (sa, sb, row, row_b))
        pair, inv = np.unique(sa.astype(np.int64) * nb + sb, return_inverse=True)
        pa_, pb_ = pair // nb, pair % nb

        def learn(given: np.ndarray, group: np.ndarray, n_given: int) -> np.ndarray:
            """p(other | given), each word of the other side drawn from the words given in its row."""
            p = np.ones(len(pair))
            n_group = int(group.max()) + 1
            for _ in range(rounds):
                z = p[inv]
                z = z / np.bincount(group, z, n_group)[group]
                c = np.bincount(inv, z, len(pair))
                p = c / np.maximum(np.bincount(given, c, n_given), 1e-9)[given]
            return p

        def table(p, given, other, n_given, names_g, names_o):
            top = np.zeros(n_given)
            np.maximum.at(top, given, p)
            rel = p / np.maximum(top[given], 1e-9)
            ok = np.flatnonzero((rel > 0.15) & (p > least))
            ok = ok[np.argsort(-rel[ok], kind="stable")]
            out: dict[str, dict[str, float]] = defaultdict(dict)
            for i in ok:
                d = out[names_g[given[i]]]
                if len(d) < keep:
                    d[names_o[other[i]]] = round(float(rel[i]), 3)
            return dict(out)

        la, lb = list(va), list(vb)
        to[lang] = table(learn(pa_, row_b, na), pa_, pb_, na, la, lb)
        back[lang] = table(learn(pb_, row, nb), pb_, pa_, nb, lb, la)
        n = len(rows)
        wa[lang] = {w: float(np.log((n + 1) / (df_a[i] + 0.5))) for w, i in va.items()}
        wb[lang] = {w: float(np.log((n + 1) / (df_b[i] + 0.5))) for w, i in vb.items()}
    return Tables(to, back, wa, wb, languages)


def _own(w: str) -> bool:
    """Whether a word is written alike in either language: a number, a mark, a coined term."""
    return w[0] in "#[" or "-" in w or any(c.isdigit() for c in w)


def bag(sentence: str) -> list[str]:
    """The distinct words of a sentence, in order."""
    return list(dict.fromkeys(words(sentence)))


def index_of(bags: list[list[str]]) -> dict[str, list[int]]:
    """The sentences that have each word."""
    index: dict[str, list[int]] = {}
    for j, b in enumerate(bags):
        for w in b:
            index.setdefault(w, []).append(j)
    return index


def covers(bags: list[list[str]], index: dict[str, list[int]], side: _Side) -> list[dict[int, float]]:
    """For each sentence the share of its weight that each sentence of the other side renders, of those that render any of it.

    The inverted index of the other side's words leads from each target word of a bag to the sentences that have it; a word
    that several bags have is looked up once."""
    known, there = side.known, index.keys()
    links: dict[str, tuple[float, list[tuple[int, float]]]] = {}
    out = []
    for own in bags:
        total, sums = 0.0, {}
        for w in own:
            got = links.get(w)
            if got is None:
                x, means, unsure = known.get(w) or side.of(w)
                if unsure and w not in index:
                    x *= 0.3  # a word the tables don't know tells little
                best: dict[int, float] = {}
                for t in means.keys() & there:
                    p = x * means[t]
                    for j in index[t]:
                        if p > best.get(j, 0.0):
                            best[j] = p
                got = links[w] = (x, list(best.items()))
            total += got[0]
            for j, v in got[1]:
                sums[j] = sums.get(j, 0.0) + v
        out.append({j: v / total for j, v in sums.items()} if total else {})
    return out


def _both(p: float, q: float) -> float:
    """How well two sentences render each other: one cut off or joined renders, or is rendered by, only a part of its partner."""
    return math.sqrt(p * q) * 0.5 + max(p, q) * 0.5


def _share(own: list[str], other: set[str], side: _Side) -> float:
    """Share of a sentence's weight that one other sentence renders: what ``covers`` gives for the two alone."""
    total = got = 0.0
    known = side.known
    for w in own:
        x, means, unsure = known.get(w) or side.of(w)
        if unsure and w not in other:
            x *= 0.3
        total += x
        hit = means.keys() & other
        if hit:
            got += x * max(map(means.__getitem__, hit))
    return got / total if total else 0.0


def align(a: list[list[str]], b: list[list[str]], tables: Tables, lang: str) -> list[tuple[int, int]]:
    """Indexes of the sentences of either side, given as bags of words, that render one another. Only pairs that share a
    word through the indexes are looked at."""
    if not a or not b:
        return []
    to, from_ = tables.sides(lang)
    n, m = len(a), len(b)
    if n == m == 1:
        return [(0, 0)] if _both(_share(a[0], set(b[0]), to), _share(b[0], set(a[0]), from_)) >= MUTUAL else []
    ib, ia = index_of(b), index_of(a)
    there, back = covers(a, ib, to), covers(b, ia, from_)
    score: list[dict[int, float]] = [{} for _ in range(n)]
    both: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j in {(i, j) for i, x in enumerate(there) for j in x} | {(i, j) for j, x in enumerate(back) for i in x}:
        p, q = there[i].get(j, 0.0), back[j].get(i, 0.0)
        both[i][j] = _both(p, q)
        score[i][j] = both[i][j] - abs(i / n - j / m) * 0.02  # of repeated sentences the nearer place
    fwd = [max(x, key=lambda j: (x[j], -j)) if x else -1 for x in score]  # noqa: B023
    bwd, top = [-1] * m, [-1.0] * m
    for i, x in enumerate(score):
        for j, v in x.items():
            if v > top[j]:
                bwd[j], top[j] = i, v
    of_i: list[set[int]] = [set() for _ in range(n)]
    of_j: list[set[int]] = [set() for _ in range(m)]

    def keep(i: int, j: int) -> None:
        of_i[i].add(j)
        of_j[j].add(i)

    for i, j in enumerate(fwd):
        if j >= 0 and bwd[j] == i and both[i][j] >= MUTUAL:
            keep(i, j)
    # merges grow from agreed pairs to their neighbours while any is found
    grown = True
    while grown:
        grown = False
        for i in range(n):
            if not of_i[i] and there[i]:
                j = max((j for k in (i - 1, i + 1) if 0 <= k < n for j in of_i[k]), key=lambda j: score[i].get(j, -1.0), default=None)  # noqa: B023
                if j is not None and there[i].get(j, 0.0) >= max(MERGE, 0.85 * max(there[i].values())):
                    keep(i, j)
                    grown = True
        for j in range(m):
            if not of_j[j] and back[j]:
                i = max((i for k in (j - 1, j + 1) if 0 <= k < m for i in of_j[k]), key=lambda i: score[i].get(j, -1.0), default=None)  # noqa: B023
                if i is not None and back[j].get(i, 0.0) >= max(MERGE, 0.85 * max(back[j].values())):
                    keep(i, j)
                    grown = True
    # a part that has moved away from the part beside it is merged into the agreed pair that both render
    for i in range(n):
        if not of_i[i] and fwd[i] >= 0 and of_j[fwd[i]] and there[i].get(fwd[i], 0.0) >= FAR:
            of_i[i].add(fwd[i])
    for j in range(m):
        if not of_j[j] and bwd[j] >= 0 and of_i[bwd[j]] and back[j].get(bwd[j], 0.0) >= FAR:
            of_i[bwd[j]].add(j)
    return sorted((i, j) for i, js in enumerate(of_i) for j in js)


def source_bags(original: str, model: Model) -> tuple[list[int], list[list[str]]]:
    """Places of an original's sentences, and their bags of words, protected fragments as numbered marks."""
    at, marks = split(original, model), numbered(original)
    return at, [bag(folded(with_numbers(original, x, y, marks))[0]) for x, y in zip(at, [*at[1:], len(original)])]


def align_values(original: str, hop: str, model: Model, tables: Tables, source: tuple[list[int], list[list[str]]] | None = None) -> list[tuple[int, int]]:
    """(place in the original, place in the hop) of the first characters of sentences that render one another."""
    o_at, src = source or source_bags(original, model)
    h_at = split(hop, model)
    tgt = [folded(hop[x:y])[0] for x, y in zip(h_at, [*h_at[1:], len(hop)])]
    return [(o_at[i], h_at[j]) for i, j in align(src, [bag(t) for t in tgt], tables, tables.languages.of(" ".join(tgt)))]


class Aligned(dict):
    """Alignments of (original, hop) met lately, and the bags of the originals: a document's runs share its originals."""

    def __init__(self, model: Model, tables: Tables):
        super().__init__()
        self.model, self.tables, self.sources = model, tables, {}

    def __missing__(self, pair: tuple[str, str]) -> list[tuple[int, int]]:
        if len(self) > REMEMBERED:
            self.clear()
            self.sources.clear()
        source = self.sources.get(pair[0])
        if source is None:
            source = self.sources[pair[0]] = source_bags(pair[0], self.model)
        got = self[pair] = align_values(*pair, self.model, self.tables, source)
        return got


def sample_pairs(results: DataFrame, runs: DataFrame | None = None, rows: int = TRAIN_ROWS) -> list[tuple[str, str, str | None]]:
    """(original, first hop, pivot) of at most ``rows`` results of each pivot language, the first by a hash of their id: the
    bound of what comes to the driver, as there are few languages. Only translated rows of a size that tables can be learnt from.

    For trials: the queries learn from all results (``learning.train_whole``). Without runs the rows are drawn from all languages together. Rows of no known run are drawn with those of a null pivot.
    Only ids are joined and counted; the texts of the chosen rows are read by a second scan."""
    ok = results.where(f"result_id is not null and translated and length(original) < {TRAIN_CHARS}").select("result_id", "run_id", "original", F.try_element_at("hops", F.lit(1)).alias("h")).where("h is not null and h <> ''")
    if runs is None:
        return [(o, h, None) for o, h in {r[0]: (r[2], r[3]) for r in first_by_hash(ok, "result_id", rows)}.values()]
    pivot = runs.where("run_id is not null").groupBy("run_id").agg(F.max(F.lower(F.try_element_at("pivot_chain", F.lit(1)))).alias("pivot"))
    known = ok.select("result_id", "run_id").join(pivot, "run_id", "left").select("result_id", "pivot")
    chosen = first_of_each(known, "result_id", "pivot", rows)
    ids = results.sparkSession.createDataFrame([(r[0], r[1]) for r in chosen], "result_id bigint, pivot string")
    got = ok.join(F.broadcast(ids), "result_id").select("result_id", "original", "h", "pivot").collect()  # at most the chosen rows and their redeliveries
    return [tuple(r[1:]) for r in {r[0]: r for r in sorted(got, key=lambda r: (r[0], r[2]))}.values()]


def aligned(results: DataFrame, model: Model, tables: Tables) -> DataFrame:
    """(result_id, original_at, hop_at) of sentences of original and hops[0] that render one another.

    Rows whose original or first hop is null, empty or blank have none. A row delivered twice
    counts once: its pairs are packed to one row before the only shuffle, which carries no
    text. Rows with a null result_id are left out, other columns are dropped.
    """

    def run(batches):
        pairs = Aligned(model, tables)
        for b in batches:
            oat, hat, offsets = [], [], [0]
            for o, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if o and h:
                    for x, y in pairs[o, h]:
                        oat.append(x)
                        hat.append(y)
                offsets.append(len(oat))
            s = pa.StructArray.from_arrays([pa.array(oat, pa.int32()), pa.array(hat, pa.int32())], names=["original_at", "hop_at"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), s)], names=["result_id", "s"])

    rows = results.where("result_id is not null").select("result_id", "original", F.try_element_at("hops", F.lit(1)).alias("hop"))
    packed = rows.mapInArrow(run, "result_id bigint, s array<struct<original_at: int, hop_at: int>>")
    return packed.dropDuplicates(["result_id"]).select("result_id", F.inline("s"))
