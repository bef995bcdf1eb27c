"""Translation tables learnt from all results, without a sample and whatever the length of a text.

Expectation maximisation over the word pairs of every row, as in ``align.train``, spread by the word that is explained: all
counts of a word lie in one partition, and a row goes with its whole other side to each partition that explains one of its
words. So a round needs of the other partitions nothing but the total of each explaining word. Rows stay on disk as blocks of
local word numbers; a partition reads them one block at a time and holds only the counts of its word pairs.
"""

from __future__ import annotations

import operator
import pickle
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import ORIGINALS, Languages, Tables, _own, numbered, with_numbers, words
from .sentences import folded

#: Word pairs of rows that a block of a task holds, a longer row takes several; as many times those in a block that is merged of several. Bounds memory, not results.
BLOCK_PAIRS, MERGED = 1 << 21, 16
#: Word pairs that are worked on at once, and cells of their table, so that a core's cache holds them.
SLICE_PAIRS, SLICE_CELLS = 1 << 17, 1 << 19
#: Word pairs that a partition counts at most, as far as rows and vocabularies tell beforehand.
PART_PAIRS = 1 << 24


def all_pairs(results: DataFrame, runs: DataFrame) -> DataFrame:
    """(original, h, pivot, n) of all translated results with an original and a first hop: each distinct text once, with the
    number of its results. A row delivered twice counts once, a run that is not known has a null pivot."""
    ok = results.where("result_id is not null and translated and original is not null").select("result_id", "run_id", "original", F.try_element_at("hops", F.lit(1)).alias("h")).where("h is not null and h <> ''")
    pivot = runs.where("run_id is not null").groupBy("run_id").agg(F.max(F.lower(F.try_element_at("pivot_chain", F.lit(1)))).alias("pivot"))
    one = ok.groupBy("result_id").agg(F.max(F.struct("original", "h", "run_id")).alias("r")).select("r.*")
    return one.join(pivot, "run_id", "left").groupBy("original", "h", "pivot").agg(F.count("*").alias("n"))


def _features(batches):
    """(name, feature, n) of the labelled texts, summed over a batch; originals stand under null."""
    for b in batches:
        counts: dict = defaultdict(Counter)
        for o, h, name, n in zip(*(c.to_pylist() for c in b.columns)):
            for k, t in ((None, o), (name, h)) if name else ((None, o),):
                for f in Languages.features(t):
                    counts[k][f] += n
        rows = [(k, f, n) for k, c in counts.items() for f, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["name", "f", "n"])


def languages_of(pairs: DataFrame) -> Languages:
    """The languages, learnt from all first hops by their pivots and from all originals."""
    counts: dict[str, Counter] = defaultdict(Counter)
    got = pairs.mapInArrow(_features, "name string, f string, n bigint").groupBy("name", "f").agg(F.sum("n").alias("n")).collect()
    if any(r.name for r in got):
        for r in got:
            counts[r.name or ORIGINALS][r.f] += r.n
    return Languages.counted(counts)


def _bags(languages: Languages):
    def run(batches):
        for b in batches:
            out = []
            for o, h, _, n in zip(*(c.to_pylist() for c in b.columns)):
                o_, h_ = folded(o)[0], folded(h)[0]
                x = list(dict.fromkeys(words(with_numbers(o_, 0, len(o_), numbered(o_)))))
                y = list(dict.fromkeys(words(h_)))
                if x and y:
                    out.append((languages.of(h), x, y, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()))], names=["lang", "a", "b", "n"])

    return run


class _Block:
    """Rows of one partition: the words that explain, and those of its explained words that each row has; packed as local numbers."""

    def __init__(self):
        self.a, self.la, self.b, self.lb, self.n, self.pairs = [], [], [], [], [], 0

    def full(self, a: list[int], b: list[int]) -> bool:
        return bool(self.n) and self.pairs + len(a) * len(b) > BLOCK_PAIRS

    def add(self, a: list[int], b: list[int], n: int) -> None:
        self.a += a
        self.b += b
        self.la.append(len(a))
        self.lb.append(len(b))
        self.n.append(n)
        self.pairs += len(a) * len(b)

    def packed(self) -> bytes:
        of = lambda v, most: np.asarray(v).astype(np.uint16 if most < 1 << 16 else np.uint32)
        (x, a), (y, b) = (np.unique(np.array(v, np.int64), return_inverse=True) for v in (self.a, self.b))
        return pickle.dumps((x, y, of(a, len(x)), of(self.la, max(self.la)), of(b, len(y)), of(self.lb, max(self.lb)), np.array(self.n, np.float64)), protocol=5)


def _blocks(batches, ids, parts):
    """(part, block) of rows: ``ids`` has the numbers of the words by language and side, ``parts`` the partitions by (side, language)."""
    ids = ids.value
    open_: dict[int, _Block] = {}
    schema = ["part", "block"]
    for batch in batches:
        out = []
        for lang, a, b, n in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = [ids[lang, 0][w] for w in a], [ids[lang, 1][w] for w in b]
            for side, x, y in ((0, a, b), (1, b, a)):
                first, k = parts[side, lang]
                of: dict[int, list[int]] = {first: y} if k == 1 else defaultdict(list)
                for w in y if k > 1 else ():
                    of[first + w % k].append(w)
                most = max(1, BLOCK_PAIRS // len(x))
                for part, ws in of.items():
                    for i in range(0, len(ws), most):
                        block = open_.setdefault(part, _Block())
                        if block.full(x, ws[i : i + most]):
                            out.append((part, block.packed()))
                            block = open_[part] = _Block()
                        block.add(x, ws[i : i + most], n)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=schema)
    for part, block in open_.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block.packed()], pa.binary())], names=schema)


def _merged(records):
    """Fewer blocks of a partition: those of several tasks together, with their words in order."""

    def one():
        xs, ys = np.unique(np.concatenate([h[0] for h in held])), np.unique(np.concatenate([h[1] for h in held]))
        a, b = (np.concatenate([np.searchsorted(to, h[i])[h[2 + 2 * i]] for h in held]) for i, to in enumerate((xs, ys)))
        of = lambda v, most: v.astype(np.uint16 if most < 1 << 16 else np.uint32)
        return part, pickle.dumps((xs, ys, of(a, len(xs)), np.concatenate([h[3] for h in held]), of(b, len(ys)), np.concatenate([h[5] for h in held]), np.concatenate([h[6] for h in held])), protocol=5)

    held, pairs = [], 0
    for part, block in records:
        block = pickle.loads(block)
        more = int((block[3].astype(np.int64) * block[5]).sum())
        if held and pairs + more > MERGED * BLOCK_PAIRS:
            yield one()
            held, pairs = [], 0
        held.append(block)
        pairs += more
    if held:
        yield one()


def _slices(block: tuple):
    """The word pairs of a block's rows, by explained words and as many at a time as a core's cache holds: their cells (explained
    word, explaining word) as numbers from a first one on; where the pairs of each explained word of a row begin, how many
    they are, and how many results have the row; the first cell, and the one behind the last."""
    x, _, a, la, b, lb, n = block
    la, a = la.astype(np.int64), a.astype(np.int64)
    order = np.argsort(b, kind="stable")
    b, row = b[order].astype(np.int64) * len(x), np.repeat(np.arange(len(la)), lb)[order]
    size, start, n = la[row], (np.cumsum(la) - la)[row], n[row]
    ends, lo = np.cumsum(size), 0
    while lo < len(b):
        hi = max(lo + 1, min(np.searchsorted(ends, ends[lo] + SLICE_PAIRS), np.searchsorted(b, b[lo] + max(0, SLICE_CELLS - len(x)), side="right")))
        many, low = size[lo:hi], b[lo]
        first = np.cumsum(many) - many
        at = np.arange(first[-1] + many[-1])
        at += np.repeat(start[lo:hi] - first, many)
        cell = a[at]
        cell += np.repeat(b[lo:hi] - low, many)
        yield cell, first, many, n[lo:hi], low, b[hi - 1] + len(x)
        lo = hi


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    """The distinct numbers, in order; far faster than ``np.unique`` for numbers that come nearly in order."""
    k = np.sort(np.concatenate(keys), kind="stable")
    return k[np.append(True, k[1:] != k[:-1])] if len(k) else k


def _found(part: int, records, names: list, vocabulary: dict):
    """The word pairs of a partition as sorted numbers, of which the differences are kept."""
    side, lang = names[part]
    n, keys, more = vocabulary[lang, side], np.zeros(0, np.int64), []
    for _, block in records:
        block = pickle.loads(block)
        x, y = block[:2]
        for cell, _, _, _, low, high in _slices(block):
            there = np.zeros(high - low, bool)
            there[cell] = True
            u = np.flatnonzero(there) + low
            more.append(y[u // len(x)] * n + x[u % len(x)])
        if sum(map(len, more)) > max(1 << 21, len(keys)):
            keys, more = _distinct([keys, *more]), []
    steps = np.diff(_distinct([keys, *more]), prepend=0)
    yield part, steps.astype(np.uint32) if len(steps) and steps.max() < 1 << 32 else steps


def _chances(keys: np.ndarray, counts: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """p(explained | explaining) of a partition's word pairs."""
    return counts / np.maximum(total[keys % n], 1e-9)


def _round(part: int, records, names: list, vocabulary: dict, totals):
    """A partition's counts after a round, and their totals: each explained word of a row is shared out among the words that
    explain it. The records are the counts before (none in the first round), the word pairs and the blocks."""
    side, lang = names[part]
    n = vocabulary[lang, side]
    before = next(records)[1] if totals else None
    keys = np.cumsum(next(records)[1], dtype=np.int64)
    p = _chances(keys, before, n, totals.value[side, lang]) if totals else np.ones(len(keys))
    counts, place, chance = np.zeros(len(keys)), np.full(n, -1), np.zeros(0)
    for _, block in records:
        block = pickle.loads(block)
        x, y = block[:2]
        # the partition's pairs of the block's words, and their cells
        lo, hi = np.searchsorted(keys, y * n), np.searchsorted(keys, (y + 1) * n)
        at = np.arange((hi - lo).sum()) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        place[x] = np.arange(len(x))
        local = place[keys[at] - np.repeat(y * n, hi - lo)]
        place[x] = -1
        known = local >= 0
        at, there = at[known], (np.repeat(np.arange(len(y)) * len(x), hi - lo) + local)[known]
        for cell, first, many, times, low, high in _slices(block):
            if len(chance) < high - low:
                chance = np.zeros(high - low)
            i, j = np.searchsorted(there, (low, high))
            own, of = there[i:j] - low, at[i:j]
            chance[own] = p[of]  # of every cell that the rows have; what another slice left in others is not read
            z = chance[cell]
            z *= np.repeat(times / np.add.reduceat(z, first), many)
            counts[of] += np.bincount(cell, z, high - low)[own]
    yield part, counts, np.bincount(keys % n, counts, n)


def _tops(part: int, records, names: list, vocabulary: dict, totals):
    """For each explaining word its best chance in a partition."""
    side, lang = names[part]
    n = vocabulary[lang, side]
    counts, keys = next(records)[1], np.cumsum(next(records)[1], dtype=np.int64)
    top = np.zeros(n)
    np.maximum.at(top, keys % n, _chances(keys, counts, n, totals.value[side, lang]))
    yield (side, lang), top


def _meanings(part: int, records, names: list, vocabulary: dict, totals, tops, apart, least: float):
    """(side, language, explaining word, explained word, chance against the best) of the pairs that a table may hold."""
    side, lang = names[part]
    n = vocabulary[lang, side]
    counts, keys = next(records)[1], np.cumsum(next(records)[1], dtype=np.int64)
    p, x = _chances(keys, counts, n, totals.value[side, lang]), keys % n
    rel = p / np.maximum(tops.value[side, lang][x], 1e-9)
    for i in np.flatnonzero((rel > 0.15) & (p > least) & ~apart.value[lang, side][x]):
        yield side, lang, int(x[i]), int(keys[i] // n), float(rel[i])


def train_whole(results: DataFrame, runs: DataFrame, rounds: int = 6, least: float = 0.04, keep: int = 12) -> Tables:
    """What ``align.train`` gives for the pairs of all results. To the driver come the vocabularies, of each round one number
    for each word, and the tables."""
    spark = results.sparkSession
    sc = spark.sparkContext
    pairs = all_pairs(results, runs).persist(StorageLevel.DISK_ONLY)
    languages = languages_of(pairs)
    bags = pairs.mapInArrow(_bags(languages), "lang string, a array<string>, b array<string>, n bigint").persist(StorageLevel.DISK_ONLY)
    sizes = {r.lang: (r.n, r.pairs) for r in bags.groupBy("lang").agg(F.sum("n").alias("n"), F.sum(F.size("a").cast("bigint") * F.size("b")).alias("pairs")).collect()}
    pairs.unpersist()
    if not sizes:
        bags.unpersist()
        return Tables({}, {}, {}, {}, languages)
    vocab: dict = {}  # of (language, side): words by falling number of rows, so that partitions get alike shares of the frequent ones
    for side, c in enumerate("ab"):
        for r in bags.select("lang", "n", F.explode(c).alias("w")).groupBy("lang", "w").agg(F.sum("n").alias("n")).collect():
            vocab.setdefault((r.lang, side), []).append((-r.n, r.w))
    for v in vocab.values():
        v.sort()
    vocabulary = {k: len(v) for k, v in vocab.items()}
    ids = sc.broadcast({k: {w: i for i, (_, w) in enumerate(v)} for k, v in vocab.items()})
    apart = sc.broadcast({k: np.array([_own(w) for _, w in v]) for k, v in vocab.items()})
    every = sum(p for _, p in sizes.values())
    parts, names = {}, []
    for side in (0, 1):
        for lang, (_, p) in sorted(sizes.items()):
            k = max(1, round(sc.defaultParallelism * p / every), -(-min(p, vocabulary[lang, 0] * vocabulary[lang, 1]) // PART_PAIRS))
            parts[side, lang] = len(names), k
            names += [(side, lang)] * k
    blocks = bags.mapInArrow(partial(_blocks, ids=ids, parts=parts), "part int, block binary").rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(len(names), int)
    blocks = blocks.mapPartitions(_merged, preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)
    found = blocks.mapPartitionsWithIndex(partial(_found, names=names, vocabulary=vocabulary), preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)
    counts = totals = None
    for _ in range(rounds):
        # of one partitioner: a partition's counts, its pairs and then its blocks
        rows = found.union(blocks) if counts is None else counts.union(found).union(blocks)
        if rows.getNumPartitions() != len(names):
            raise RuntimeError("the counts and the blocks have come apart")
        after = rows.mapPartitionsWithIndex(partial(_round, names=names, vocabulary=vocabulary, totals=totals), preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)
        totals = sc.broadcast(after.map(lambda s: (names[s[0]], s[2])).reduceByKey(operator.add).collectAsMap())
        if counts is not None:
            counts.unpersist()
        counts = after
    last = counts.union(found)
    tops = sc.broadcast(last.mapPartitionsWithIndex(partial(_tops, names=names, vocabulary=vocabulary, totals=totals)).reduceByKey(np.maximum).collectAsMap())
    best = last.mapPartitionsWithIndex(partial(_meanings, names=names, vocabulary=vocabulary, totals=totals, tops=tops, apart=apart, least=least)).collect()
    for x in (counts, found, blocks, bags):
        x.unpersist()
    meant: tuple = {k: {} for k in sizes}, {k: {} for k in sizes}
    for side, lang, x, y, rel in sorted(best, key=lambda r: (r[:3], -r[4], r[3])):
        d = meant[side][lang].setdefault(vocab[lang, side][x][1], {})
        if len(d) < keep:
            d[vocab[lang, 1 - side][y][1]] = round(rel, 3)
    weight = [{k: {w: float(np.log((sizes[k][0] + 1) / (0.5 - n))) for n, w in vocab[k, side] if not _own(w)} for k in sizes} for side in (0, 1)]
    return Tables(*meant, *weight, languages)
