"""Operators over small tables: spans, masks, repairs, reports, graph, cache, round trip, streams, files."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright import session
from tidewright.functions import text as T
from tidewright.operators import graph, masking, mining, repair, report, spans
from tidewright.operators.cache import through_cache
from tidewright.plans import backends, project, translate
from tidewright.sources import base, files
from tidewright.streaming import incremental

DOC = "doc_id bigint, text string, path string, fragment boolean"
PROSE = "The first sentence of this paragraph has enough words in it.\n\nAnd `code` with [a link](http://x.y) keeps its place in the second paragraph here.\n"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_splice_and_complement(spark):
    d = spark.createDataFrame([(1, "abcdef", "a.md", False), (2, "", "b.md", False), (3, None, "c.md", False), (4, "xyz", "d.md", False)], DOC)
    r = spark.createDataFrame([(1, 1, 3, "__"), (1, 4, 5, None), (1, 1, 3, "__")], "doc_id bigint, start int, end int, new string")
    assert rows(spans.splice(d, r)) == [(1, "a__def"), (2, ""), (3, None), (4, "xyz")]
    n = d.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    assert rows(spans.complement(r.select("doc_id", "start", "end").distinct(), n)) == [(1, 0, 1), (1, 3, 4), (1, 5, 6), (4, 0, 3)]
    assert spans.splice(d.limit(0), r).count() == 0


def test_islands_and_violations(spark):
    s = spark.createDataFrame([(1, 0, 2), (1, 1, 5), (1, 7, 8), (1, 20, 21)], "doc_id bigint, start int, end int")
    assert rows(spans.merge_islands(s, F.col("start") <= F.col("reach") + 2)) == [(1, 0, 8), (1, 20, 21)]
    assert rows(spans.violations(s)) == [(1, 1, 5, "overlapping")]


def test_disabled_regions(spark):
    md = "one\n<!-- tidewright: off -->\ntwo\n<!-- Tidewright: OFF -->\nthree\n<!-- tidewright: on -->\nfour\n<!-- tidewright: on -->\n<!-- tidewright: off -->\nend"
    tex = "a\n% tidewright: off please\nb\n"
    d = spark.createDataFrame([(1, md, "a.md", False), (2, tex, "a.tex", True), (3, "no marker", "b.md", False)], DOC)
    got = {(i, lo): (md if i == 1 else tex)[lo:hi] for i, lo, hi in rows(spans.disabled_spans(d))}
    assert got == {(1, 4): md[4 : md.index("four") - 1], (1, md.rindex("<!--")): md[md.rindex("<!--") :], (2, 2): tex[2:]}
    left = [r.text for r in base.segments(d, drop_disabled="tidewright").where("doc_id = 1").orderBy("start").collect()]
    assert left == ["one", "four"]


def test_even_sample(spark):
    s = spark.range(10).select(F.lit(1).alias("g"), "id")
    assert [r.id for r in spans.even_sample(s, "g", ["id"], sample=3).orderBy("id").collect()] == [0, 3, 6]
    assert [r.id for r in spans.even_sample(s, "g", ["id"], limit=3).orderBy("id").collect()] == [0, 1, 2]
    assert spans.even_sample(s, "g", ["id"], sample=99).count() == 10


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab`$[]()!@^<>/&; \\{}%\n0", max_size=60))
def test_mask_restores(text):
    for fmt in masking.RULES:
        m, mapping, _ = masking.mask(text, masking.rules_for(fmt, ["ab", "0a"]))
        back = dict(mapping)
        assert masking.MARK.sub(lambda x: back.get(x.group(), x.group()), m) == text


def test_mask_labels_and_collisions(spark):
    m, mapping, groups = masking.mask(r"see \href{https://example.com/x}{example} and \emph{e} [[0]]", masking.rules_for("latex"))
    assert m == "see [[1]]example[[2]] and [[3]]e[[4]] [[0]]" and groups == [("[[1]]", "[[2]]"), ("[[3]]", "[[4]]")]
    d = spark.createDataFrame([("a `b` [[0]]",), (None,), ("",)], "t string").withColumn("m", masking.masker(["KV cache"])("t", F.lit("markdown")))
    assert [r.v for r in d.select(masking.unmask(F.col("m.text"), F.col("m.mapping")).alias("v")).collect()] == ["a `b` [[0]]", None, ""]
    assert masking.mask("the kv CACHE uncached", masking.rules_for("markdown", ["cache", "KV cache"]))[1] == [("[[0]]", "kv CACHE")]


def fixed(spark, col, **values):
    """(text, fixed) of a repair over one row of strings, mappings as lists of pairs."""
    kinds = {str: "string", type(None): "string"}
    schema = ", ".join(f"{k} {kinds.get(type(v)) or 'array<struct<key:string,frag:string>>' if k != 'groups' else 'array<struct<open:string,close:string>>'}" for k, v in values.items())
    r = spark.createDataFrame([tuple(values.values())], schema).select(col(*map(F.col, values)).alias("r")).first().r
    return (r.text, r.fixed) if hasattr(r, "text") else r


def test_restored_words(spark):
    spell = lambda a, b: fixed(spark, repair.restored_spelling, a=a, b=b)
    assert spell("we emphasised it", "We Emphasized it") == ("We Emphasised it", ["spelling Emphasized -> Emphasised"])
    assert spell("nothing here", "the center") == ("the center", [])
    assert spell("colour labelled analyse", "COLOR labeled analyze, color") == ("COLOUR labelled analyse, colour", ["spelling COLOR -> COLOUR", "spelling labeled -> labelled", "spelling analyze -> analyse", "spelling color -> colour"])
    # a word that the source has itself is no variant, and of two variants the first rule's wins
    assert spell("center centre", "center")[0] == "center" and spell("", "x") == ("x", []) and spell("a", "") == ("", [])
    assert fixed(spark, repair.restored_capitals, a="Related Work at NASA", b="Related work at nasa") == ("Related Work at NASA", ["capitalisation work -> Work", "capitalisation nasa -> NASA"])


def test_persona_rules(spark):
    rules = lambda t, f=(), o=(): fixed(spark, lambda c: repair.persona_rules(c, list(f), list(o)), t=t)
    assert rules("However, it is — so.", [("—", ",")], ["However,"]) == ("It is, so.", ["replaced '—'", "dropped opener 'However,'"])
    assert rules("It is so. however, not.  then no", (), ["However,"])[0] == "It is so. Not. Then no"
    assert rules("a  b ,\nc") == ("a b,\nc", []) and rules("x", [("", "y")], [""]) == ("x", [])
    assert rules("Moreover. it", (), ["However,"]) == ("Moreover. it", [])


def test_tightened(spark):
    tight = lambda o, t, m: fixed(spark, repair.tightened, o=o, t=t, m=m)
    assert tight("note[^1]", "note [[0]]", [("[[0]]", "[^1]")]) == "note[[0]]"
    assert tight("a [x] b", "a [[0]] b", [("[[0]]", "[x]")]) == "a [[0]] b"
    assert tight("- [x] b", "[[0]]  b", [("[[0]]", "[x] ")]) == "[[0]]b"
    # a gap between two placeholders is cut from whichever side is tight
    assert tight("a[1][2] b", "a [[0]] [[1]] b", [("[[0]]", "[1]"), ("[[1]]", "[2]")]) == "a[[0]][[1]] b"
    assert tight("none", "plain", []) == "plain" and tight("x", "[[7]] y", []) == "[[7]] y"


def test_wrapped(spark):
    wrap = lambda t, m, g, w=12: fixed(spark, lambda t, mapping, groups: repair.wrapped(t, F.lit(w), mapping, groups), t=t, mapping=m, groups=g)
    assert wrap("aa [[0]]b c[[1]] dd", [("[[0]]", "["), ("[[1]]", "](x)")], [("[[0]]", "[[1]]")]) == "aa [[0]]b c[[1]]\ndd"
    assert wrap("aa [[0]]b c[[1]], dd", [("[[0]]", "["), ("[[1]]", "](long/link)")], [("[[0]]", "[[1]]")]) == "aa\n[[0]]b c[[1]],\ndd"
    assert wrap("one two three", [], [], 7) == "one two\nthree" and wrap(" ", [], []) == " "
    assert wrap("a [[0]] b", [("[[0]]", "x")], [("[[0]]", "[[5]]")]) == "a [[0]] b"
    long = "word " * 12 + "\n" + "word " * 12
    assert fixed(spark, lambda o, t, mapping, groups: repair.wrapped_as(o, t, mapping, groups), o=long, t="x " * 70, mapping=[], groups=[]).count("\n") == 2
    assert fixed(spark, lambda o, t, mapping, groups: repair.wrapped_as(o, t, mapping, groups), o="one line", t="x " * 70, mapping=[], groups=[]) == "x " * 70


def test_multiset_delta(spark):
    d = spark.createDataFrame([(["b", "a", "b"], ["b", "c"]), ([], ["x", "x"]), (["q"], ["q"]), ([], []), (None, ["a"])], "a array<string>, b array<string>")
    got = [r.d and [tuple(x) for x in r.d] for r in d.select(T.multiset_delta(F.array_sort("a"), F.array_sort("b")).alias("d")).collect()]
    assert got == [[("a", 1), ("b", 1), ("c", -1)], [("x", -2)], [], [], None]
    assert d.select(T.multiset_minus(F.array_sort("b"), F.array_sort("a")).alias("m")).collect()[1].m == ["x", "x"]


def test_round_trip(spark):
    d = spark.createDataFrame([(1, PROSE, "a.md", False), (2, "# Short\n", "b.md", False), (3, None, "c.md", False), (4, "", "d.md", False), (5, PROSE, "e.txt", False)], DOC)
    r = session.cut(translate.round_trip(d, ["fr"]))
    got = {x.original.split()[0]: x for x in r.collect()}
    assert set(got) == {"The", "And", "Short"} and not got["Short"].translated and got["The"].translated
    out = dict(rows(translate.rendered(d, r)))
    assert out[3] is None and out[5] == PROSE and "`code`" in out[1] and "](http://x.y)" in out[1] and out[1] != PROSE
    same = spans.splice(d, r.select("doc_id", "start", "end", F.col("original").alias("new")))
    assert dict(rows(same)) == {x.doc_id: x.text for x in d.collect()}


def test_cached_hops_are_called_once(spark):
    d = spark.createDataFrame([(1, PROSE, "a.md", False), (2, PROSE, "b.md", False)], DOC)
    m = session.cut(translate.masked_segments(d))
    cache = spark.createDataFrame([], "key string, value string")
    done, fresh = translate.hops_through_cache(m, ["de"], lambda x: x.withColumn("out", T.rotate_words(F.col("text"))), cache, "mock")
    assert done.count() == 4 and fresh.count() == 4
    again, more = translate.hops_through_cache(m, ["de"], lambda x: x.withColumn("out", F.raise_error(F.lit("called")).cast("string")), fresh, "mock")
    assert more.count() == 0 and again.where("reason = ''").count() == done.where("reason = ''").count()
    assert rows(translate.pending(m, ["de"], fresh, "mock")) == [(1, 2, 2, 0), (2, 2, 2, 0)]


def test_cache_nulls(spark):
    r = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, k string")
    out, fresh = through_cache(r, F.col("k"), spark.createDataFrame([], "key string, value string"), lambda x: x.withColumn("out", F.lit("v")))
    assert rows(out.select("id", "out")) == [(1, "v"), (2, None), (3, "v")] and fresh.count() == 1


def test_mining(spark):
    p = spark.createDataFrame([("low-rank x", "rank x")] * 4 + [("Net5 a", "net5 b")] * 3 + [(None, "x"), ("y-z", None)], "original string, final string")
    assert rows(mining.mine(p)) == [("low-rank", 4, 0, 0.0)]
    assert mining.mine(p.limit(0)).count() == 0


def test_glossary_file(spark, tmp_path):
    p = spark.createDataFrame([("low-rank x Net5", "rank x")] * 4 + [("Net5 a", "net5 b")] * 9, "original string, final string")
    mining.write_glossary(mining.mine(p), "runs", str(tmp_path / "g"))
    text = "".join(x.read_text() for x in (tmp_path / "g").glob("part*"))
    assert text.startswith("# Terms this round trip") and text.endswith("low-rank    # survived 0/4\n")
    assert [r.term for r in files.read_glossary(spark, str(tmp_path / "g")).collect()] == ["low-rank"]
    assert mining.glossary(mining.mine(p.limit(0)), "x").count() == 1


def test_what_fails_is_tried_again(spark):
    docs = spark.createDataFrame([(1, PROSE, "a.md", False)], DOC)
    m = session.cut(translate.masked_segments(docs))
    # greedy calls lose the placeholders, warmer ones keep them; only greedy ones are stored
    ask = backends.get("client", connect=lambda: lambda system, text, temperature: text.replace("[[", "((") if temperature == 0 else text)
    done, fresh = translate.hops_through_cache(m, ["de"], ask, spark.createDataFrame([], "key string, value string"), "m")
    got = {r.text.split()[0]: (r.attempts, r.reason, len(r.hops)) for r in done.collect()}
    assert got == {"The": (1, "", 2), "And": (2, "", 2)} and fresh.count() == 3
    worse = backends.get("client", connect=lambda: lambda system, text, temperature: "")
    done, _ = translate.hops_through_cache(m, ["de"], worse, spark.createDataFrame([], "key string, value string"), "m")
    assert {(r.attempts, r.reason.split(";")[0]) for r in done.collect()} == {(2, "en->de: nonempty: model returned nothing")}
    kept = translate.finish(done)
    assert kept.where("final = original and not translated").count() == 2
    with pytest.raises(ValueError):
        translate.hops_through_cache(m, ["de"], worse, fresh, "m", attempts=0)


def test_include_graph(spark):
    f = spark.createDataFrame([("main.tex", r"\input{sec/a} \include{missing} % \input{sec/b}"), ("sec/a.tex", r"\input{shared} \input{../main} \input{../../etc/passwd}"), ("sec/b.tex", ""), ("sec/shared.tex", "")], "path string, text string")
    e = graph.resolve(graph.include_edges(f), f)
    assert rows(e.select("src", "name", "dst")) == [("main.tex", "missing", None), ("main.tex", "sec/a", "sec/a.tex"), ("sec/a.tex", "../../etc/passwd", None), ("sec/a.tex", "../main", "main.tex"), ("sec/a.tex", "shared", "sec/shared.tex")]
    got, warned = graph.closure(f.where("path = 'main.tex'").select("path"), e)
    assert rows(got) == [("main.tex", "main.tex", 0), ("main.tex", "sec/a.tex", 1), ("main.tex", "sec/shared.tex", 2)]
    assert rows(warned) == [("main.tex", "main.tex", "missing include", "missing"), ("main.tex", "sec/a.tex", "missing include", "../../etc/passwd")]
    # depth and number of files are bounded, and what lies beyond is said
    chain = spark.createDataFrame([(f"f{i:02d}", f"f{i + 1:02d}") for i in range(9)] + [("f09", "f00")], "src string, dst string").withColumn("name", F.col("dst"))
    one = spark.createDataFrame([("f00",), ("f00",), (None,)], "path string")
    got, warned = graph.closure(one, chain, max_depth=3)
    assert [r[1:] for r in rows(got)] == [(f"f{i:02d}", i) for i in range(4)] and rows(warned) == [("f00", "f03", "too deep", "f04")]
    got, warned = graph.closure(one, chain, max_files=4)
    assert got.count() == 4 and rows(warned) == [("f00", "f00", "too many files", "10")]
    got, warned = graph.closure(one.limit(0), chain)
    assert got.count() == warned.count() == 0


def test_planned(spark):
    doc = r"\begin{document}\input{part}\end{document}"
    f = spark.createDataFrame([("main.tex", doc), ("zeta.tex", doc), ("part.tex", "p"), ("alone.tex", "q"), ("read.md", "m"), ("read.md", "m"), (None, "x"), ("empty.tex", None)], "path string, text string")
    plan, warned = graph.planned(f)
    assert rows(plan.select("path", "fragment", "root", "depth")) == [("alone.tex", False, "alone.tex", 0), ("empty.tex", False, "empty.tex", 0), ("main.tex", False, "main.tex", 0), ("part.tex", True, "main.tex", 1), ("read.md", False, "read.md", 0), ("zeta.tex", False, "zeta.tex", 0)]
    assert {(r.path, r.problem) for r in warned.collect()} == {("alone.tex", "bare fragment"), ("empty.tex", "bare fragment")}
    plan, warned = graph.planned(f, follow=False, whole_fragments=True)
    assert {r.path for r in plan.where("fragment").collect()} == {"part.tex", "alone.tex", "empty.tex"} and warned.count() == 0
    assert graph.planned(f.limit(0))[0].count() == 0


def test_reports(spark):
    s = spark.createDataFrame([(i, x) for i, x in enumerate([0.95, 0.5, 0.65, 0.85])], "result_id int, similarity double")
    assert rows(report.overlap_statistics(s)) == [(4, 0.7375, 0.85, 0.5)]
    assert dict(rows(report.histogram(s))) == {"0.90+": 1, "0.80-0.90": 1, "0.70-0.80": 0, "0.60-0.70": 1, "below 0.60": 1}
    assert rows(report.overlap_statistics(s.limit(0)).select("changed")) == [(None,)] or rows(report.overlap_statistics(s.limit(0)).select("changed")) == [(0,)]
    e = spark.createDataFrame([(1, 1, 10.0, 100), (2, 1, 0.1, 50), (3, 1, 20.0, 100)], "id int, run int, elapsed_s double, chars int")
    eta = [r.remaining_s for r in report.running_eta(e, "run", ["id"]).orderBy("id").collect()]
    one = 18.6 + 8.57
    assert eta[0] == pytest.approx(10 / one * (18.6 + 150 * 0.0857)) and eta[1] == pytest.approx(10 / one * one) and eta[2] == 0


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_bytes(b"one\r\ntwo")
    (tmp_path / "in/sub/b.tex").write_text("x")
    (tmp_path / "in/c.png").write_text("x")
    (tmp_path / "in/sub/bad.md").write_bytes(b"caf\xe9 \xff!")
    d = files.read_documents(spark, str(tmp_path / "in"))
    assert rows(d.select("doc_id", "fmt", "text", "fragment")) == [("a.md", "markdown", "one\r\ntwo", False), ("sub/b.tex", "latex", "x", True), ("sub/bad.md", "markdown", "caf\ufffd \ufffd!", False)]
    assert [r.relative for r in files.read_documents(spark, str(tmp_path / "in"), str(tmp_path / "in/sub")).select("relative").distinct().orderBy("relative").collect()] == ["a.md", "sub/b.tex", "sub/bad.md"]
    files.write_documents(d, str(tmp_path / "out"))
    assert (tmp_path / "out/a.md").read_bytes() == b"one\r\ntwo"
    (tmp_path / "out/a.md.report.json").write_text(json.dumps({"path": "a.md", "segments": [{"original": "a", "final": "b", "translated": True}, {"original": "a", "final": "a", "translated": True}]}))
    r = files.read_reports(spark, str(tmp_path / "out"))
    assert rows(files.changed_pairs(r)) == [("a", "b")]
    (tmp_path / "out/b.tex.report.json").write_text(json.dumps({"path": "b.tex", "segments_total": 3, "segments_fallback": 1, "interrupted": True}))
    assert rows(files.report_totals(files.read_reports(spark, str(tmp_path / "out")))) == [(2, 3, 0, 1, 0, 1)]
    assert rows(files.report_totals(files.read_reports(spark, str(tmp_path / "out/b.tex.report.json")))) == [(1, 3, 0, 1, 0, 1)]
    (tmp_path / "g.txt").write_text("# head\nKV cache  # why\n\nfoo\n")
    assert [x.term for x in files.read_glossary(spark, str(tmp_path / "g.txt")).collect()] == ["KV cache", "foo"]
    a = spark.createDataFrame([("refs.bib",), (".git/x",), ("a.aux",), ("main.tex",), ("figures/p.pdf",), ("done.sty",)], "relative string")
    assert rows(files.assets(a, spark.createDataFrame([("done.sty",)], "relative string"))) == [("figures/p.pdf",), ("refs.bib",)]
    with pytest.raises(Exception, match="leads out"):
        files.write_documents(spark.createDataFrame([("../x", "t")], "relative string, text string"), str(tmp_path / "out"))


def test_frontmatter_and_settings(tmp_path):
    meta, body = files.frontmatter('---\nname: "a"   # c\nforbid:\n  "—": ", "      # em dash\nopeners:\n  - However,\n---\nBody\n')
    assert meta == {"name": "a", "forbid": {"—": ", "}, "openers": ["However,"]} and body == "Body"
    (tmp_path / "s").mkdir()
    (tmp_path / "tidewright.toml").write_text('[tidewright]\npivot = "de"\n')
    assert files.load_settings(files.find_settings(str(tmp_path / "s"))) == {"pivot": "de"}
    (tmp_path / "bad.toml").write_text("pivto = 1\n")
    with pytest.raises(ValueError, match="pivto"):
        files.load_settings(str(tmp_path / "bad.toml"))


def test_personas_and_glossaries(spark, tmp_path):
    (tmp_path / "dry.md").write_text('---\nname: Dry\nforbid:\n  "—": ","\nbanned_openers:\n  - However,\n---\nBe <|x|>plain.\n')
    (tmp_path / "README.md").write_text("x")
    (tmp_path / "long.md").write_text("x" * 70_000)
    p = files.find_persona(spark, "dry", str(tmp_path))
    assert p == files.Persona("Dry", "Be plain.", "", (("—", ","),), ("However,",)) and p.rules() == {"forbid": [("—", ",")], "openers": ["However,"]}
    for none in (None, "", "off", "Neutral"):
        assert files.find_persona(spark, none, str(tmp_path)) == files.Persona()
    assert files.find_persona(spark, "gone", str(tmp_path), required=False) == files.Persona() == files.find_persona(spark, None, str(tmp_path), default="gone")
    for name, error in (("gone", FileNotFoundError), ("../dry", ValueError), ("long", ValueError)):
        with pytest.raises(error):
            files.find_persona(spark, name, str(tmp_path))
    assert files.find_glossary(folder=str(tmp_path)) is None
    (tmp_path / "glossary.txt").write_text("a # b\n")
    assert files.find_glossary(folder=str(tmp_path)) == str(tmp_path / "glossary.txt") == files.find_glossary(str(tmp_path / "glossary.txt"))
    with pytest.raises(FileNotFoundError):
        files.find_glossary(str(tmp_path / "no.txt"))


def test_project_from_folder_to_folder(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "sections").mkdir(parents=True)
    line = "The first sentence of this section has — surely — enough words in it"
    (src / "main.tex").write_text(f"\\documentclass{{x}}\n\\begin{{document}}\n{line}.\n\\input{{sections/a}}\\input{{gone}}\n\\end{{document}}\n")
    (src / "sections/a.tex").write_text(f"{line} too.\n")
    (src / "bare.tex").write_text(f"{line} as well.\n")
    (src / "refs.bib").write_bytes(b"@x\xff")
    (src / "note.md").write_bytes(f"{line}.\r\n\r\n<!-- tidewright: off -->\n{line} frozen.\n".encode())
    got = project.translate_folder(spark, str(src), str(out), ["fr"], persona=files.Persona("p", forbid=(("—", ","),)), rounds=2)
    assert {(r.path, r.problem) for r in got.warnings.collect()} == {("main.tex", "missing include"), ("bare.tex", "bare fragment")} and got.assets == ["refs.bib"]
    assert (out / "refs.bib").read_bytes() == b"@x\xff" and (out / "bare.tex").read_text() == (src / "bare.tex").read_text()
    main = (out / "main.tex").read_text()
    assert main.startswith("\\documentclass{x}\n\\begin{document}\nsentence of this section has, surely, enough words in it. The first\n\\input") or "—" not in main
    assert "—" not in (out / "sections/a.tex").read_text() and (out / "sections/a.tex").read_text() != (src / "sections/a.tex").read_text()
    assert (out / "note.md").read_bytes().endswith(f"<!-- tidewright: off -->\n{line} frozen.\n".encode())
    r = {x.path: x for x in files.read_reports(spark, str(out)).collect()}
    assert set(r) == {"main.tex", "sections/a.tex", "bare.tex", "note.md"} and r["sections/a.tex"].segments_translated == 1 and r["bare.tex"].segments_total == 0
    # stopped after the first of many rounds: what is done is there and says so
    n = iter([False] + [True] * 99)
    seen = []
    part = project.translate_folder(spark, str(src), str(tmp_path / "part"), ["fr"], rounds=8, should_stop=lambda: next(n), on_round=lambda x: seen.append(x.count()), limit=1)
    assert part.interrupted and part.assets == [] and len(seen) == 1
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.png").write_text("x")
    assert project.translate_folder(spark, str(empty), str(tmp_path / "e"), ["fr"]).results.count() == 0


def test_backends(spark):
    assert {"mock", "client"} <= set(backends.available())
    with pytest.raises(KeyError, match="mock"):
        backends.get("unknown")
    d = spark.createDataFrame([("a [[0]] b c",)], "t string")
    assert d.select(backends.get("mock")(F.col("t")), backends.get("mock", lose_marks=True)(F.col("t"))).first()[:] == ("b [[0]] c a", "b c a")
    docs = spark.createDataFrame([(1, PROSE, "a.md", False), (2, "# Short\n", "b.md", False)], DOC)
    m = session.cut(translate.masked_segments(docs))
    ask = backends.get("client", connect=lambda: lambda system, text, temperature: text if "into English" in system and temperature == 0.0 else text)
    done, fresh = translate.hops_through_cache(m, ["de"], ask, spark.createDataFrame([], "key string, value string"), "mock", guidance="Be plain.")
    assert sorted(r.reason for r in done.collect()) == ["", "", "under 7 words, nothing to round-trip"] and fresh.count() == 4


def test_subset_and_judge(spark):
    s = spark.range(6).selectExpr("id % 2 as doc_id", "cast(id div 2 as int) as seg_id")
    assert rows(spans.subset(s, [0, 2, 2])) == [(0, 0), (0, 2), (1, 0), (1, 2)]
    assert rows(spans.subset(s, spark.createDataFrame([(1, 1)], "doc_id bigint, seg_id int"))) == [(1, 1)] and spans.subset(s, []).count() == 0
    p = spark.createDataFrame([(1, "long text", "b"), (2, "longer text", "c"), (3, "same", "same"), (4, "x", None), (5, "tiny", "d")], "result_id int, original string, final string")
    said, tally = report.judged(p, lambda d: d.withColumn("reply", F.when(F.col("result_id") == 1, "I say weaker.").otherwise("hm")), limit=2)
    assert rows(said) == [(1, "WEAKER"), (2, "UNCLEAR")] and dict(rows(tally)) == {"SAME": 0, "WEAKER": 1, "CHANGED": 0, "UNCLEAR": 1}
    a = spark.createDataFrame([("a", r"\x{1} 2"), ("b", "t"), ("c", None)], "relative string, text string")
    b = spark.createDataFrame([("a", r"\y{1} 2 3"), ("d", "t")], "relative string, text string")
    assert rows(report.compared_files(a, b)) == [("a", "macros", True, 1, 1), ("a", "numbers", False, 1, 1), ("b", "missing", True, 1, 0), ("d", "missing", True, 0, 1)]


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([(1, PROSE, "a.md", False)], DOC)
    d.write.parquet(str(tmp_path / "in"))
    q = incremental.translate_arriving(incremental.arriving(spark, str(tmp_path / "in"), d.schema), ["fr"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    r = spark.createDataFrame([(1, True, "2025-01-01 00:00:00"), (1, True, "2025-01-02 00:00:00"), (2, False, "2025-01-01 00:00:00")], "result_id bigint, translated boolean, t string").select("result_id", "translated", F.to_timestamp("t").alias("loaded_at"))
    r.write.parquet(str(tmp_path / "r"))
    q = incremental.once(incremental.arriving(spark, str(tmp_path / "r"), r.schema)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from once").first()[0] == 2
