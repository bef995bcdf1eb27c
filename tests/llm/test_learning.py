"""Translation tables of whole tables: every result counts, however many there are and however long; equal to learning in one place."""

import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import align, learning, queries

RESULT = "result_id bigint, run_id bigint, original string, hops array<string>, translated boolean"


def _name(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(3))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, i % 2, f"the lamp reads ko{_name(i // 2)} in {i} runs", [f"la lampe lit ra{_name(i // 2)} dans {i} essais"], True) for i in range(4600)]
    # beyond 400 characters and 60 words
    parts = [(" ".join(f"so{_name(j)}" for j in range(i, i + 90)), " ".join("la lampe lit" + f" ta{_name(j)}" for j in range(i, i + 150))) for i in range(0, 60, 20)]
    rows += [(5000 + i, 0, o, [h], True) for i, (o, h) in enumerate(parts)]
    rows += [(7000 + i, 9, f"the table hides run {i}", [f"der tisch verbirgt lauf {i}"], True) for i in range(1500)]
    rows += [(6000, 9, "the table", ["der tisch"], True), (6001, None, "the report", ["le rapport"], True), (6002, 0, "never", ["jamais"], False), (6003, 0, None, ["x"], True), (6004, 0, "o", None, True), (None, 0, "o", ["x"], True)]
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows + rows[:50] + rows[-6:], RESULT).write.parquet(f"{d}/segment_results.parquet")
    spark.createDataFrame([(0, ["FR", "de"]), (1, ["fr"]), (1, ["fr"]), (9, ["de"])], "run_id bigint, pivot_chain array<string>").write.parquet(f"{d}/runs.parquet")
    return d, [(o, h[0], {0: "fr", 1: "fr", 9: "de"}.get(r)) for i, r, o, h, t in rows if i is not None and t and o is not None and h]


def test_tables_come_from_all_results(spark, folder):
    d, pairs = folder
    got = queries._tables(spark, d)
    to, back = got.sides("fr")
    assert all(f"ko{_name(i)}" in to.weight and f"ra{_name(i)}" in back.weight for i in range(2300))
    assert all(f"so{_name(i)}" in to.weight for i in range(130)) and all(f"ta{_name(i)}" in back.weight for i in range(190))
    assert "never" not in to.weight and to.of("lamp")[1] == to.table["lamp"] and "lampe" in to.table["lamp"]
    want = align.train(pairs)
    assert got.languages.names == want.languages.names and sorted(got.to) == sorted(want.to)
    for text in (p[1] for p in pairs[::97]):
        assert got.languages.of(text) == want.languages.of(text)
    for lang in want.to:
        for a, b in zip(got.sides(lang), want.sides(lang)):
            assert a.weight == pytest.approx({w: x for w, x in b.weight.items() if not align._own(w)})
            for w, means in b.table.items():
                if not align._own(w) and len(means) < 12:  # of more that are equally likely either may be kept
                    assert a.table[w] == pytest.approx(means, abs=0.0011)


def test_tables_without_results(spark, folder):
    d, _ = folder
    t, runs = spark.read.parquet(f"{d}/segment_results.parquet"), spark.read.parquet(f"{d}/runs.parquet")
    assert not learning.train_whole(t.limit(0), runs).to
    unknown = learning.train_whole(t.where("result_id in (1, 2, 6001)"), runs.limit(0))
    assert unknown.languages.names == [""] and "lamp" in unknown.to[""].weight


@pytest.mark.parametrize("pairs, cells, at_once", [(1 << 21, 1 << 19, 1 << 17), (40, 60, 7), (1, 1, 1)])
def test_rounds_in_parts_and_blocks(monkeypatch, pairs, cells, at_once):
    monkeypatch.setattr(learning, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(learning, "SLICE_CELLS", cells)
    monkeypatch.setattr(learning, "SLICE_PAIRS", at_once)
    rnd = random.Random(5)
    rows = [(rnd.sample(range(30), rnd.randint(1, 12)), rnd.sample(range(40), rnd.randint(1, 25)), rnd.randint(1, 3)) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"lang": [""] * 60, "a": [[str(w) for w in a] for a, _, _ in rows], "b": [[str(w) for w in b] for _, b, _ in rows], "n": [n for *_, n in rows]})
    ids = SimpleNamespace(value={("", 0): {str(i): i for i in range(30)}, ("", 1): {str(i): i for i in range(40)}})
    names, vocabulary = [(0, "")] * 3 + [(1, "")] * 2, {("", 0): 30, ("", 1): 40}
    blocks = defaultdict(list)
    for b in learning._blocks([batch], ids, {(0, ""): (0, 3), (1, ""): (3, 2)}):
        for part, block in zip(*(c.to_pylist() for c in b.columns)):
            blocks[part].append((part, block))
    blocks = {k: list(learning._merged(iter(v))) for k, v in blocks.items()}
    found = {k: next(learning._found(k, iter(v), names, vocabulary)) for k, v in blocks.items()}
    counts, totals = {}, None
    want = {0: Counter(), 1: Counter()}
    for _ in range(3):
        counts = {k: next(learning._round(k, iter([*([counts[k]] if totals else []), found[k], *v]), names, vocabulary, totals)) for k, v in blocks.items()}
        totals = SimpleNamespace(value={n: sum(c[2] for k, c in counts.items() if names[k] == n) for n in set(names)})
        for side in (0, 1):  # the same word by word; p is counts over their sum by explaining word
            last, now, total = want[side], Counter(), Counter()
            for (x, _), v in last.items():
                total[x] += v
            for a, b, n in rows:
                for y in (b, a)[side]:
                    p = {x: last[x, y] / total[x] if last else 1.0 for x in (a, b)[side]}
                    for x in p:
                        now[x, y] += n * p[x] / sum(p.values())
            want[side] = now
            got = {}
            for k, c in counts.items():
                if names[k][0] == side:
                    keys = np.cumsum(found[k][1], dtype=np.int64)
                    got |= {(int(q % vocabulary["", side]), int(q // vocabulary["", side])): v for q, v in zip(keys, c[1])}
            assert got == pytest.approx(dict(now))
