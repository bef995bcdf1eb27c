"""Queries of projects, files, regions, caches and reports, with the SQL that gives the same result in DuckDB."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import graph, report, spans
from ..session import cut, table
from ..sources import base, files
from . import project, translate
from .catalog import BOTH, ONCE, S_SPANS, STORED, _lengths, _span_rows, add, q, raw, s_strip, s_structure, s_words, scalar

# ---- includes: the LaTeX files of a project as a tree, each file including two others, itself and one that is missing


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """(path, text) of the LaTeX files: file n of its project, by path, includes files 2n and 2n + 1; the first is a document."""
    docs = table(spark, d, "documents").where("fmt = 'tex' and path is not null").select(F.coalesce("project", F.lit("")).alias("project"), "path", F.lit("").alias("text"))
    n = cut(graph.roots_first(docs, "project").select("project", "path", "ordinal"))
    child = n.select("project", (F.floor(F.col("ordinal") / 2)).cast("int").alias("ordinal"), F.struct("ordinal", F.regexp_replace("path", r"\.tex$", "").alias("stem")).alias("c")).groupBy("project", "ordinal").agg(F.sort_array(F.collect_list("c")).alias("c"))
    j = n.join(child, ["project", "ordinal"], "left")
    named = F.array_join(F.transform(F.coalesce("c", F.array().cast(child.schema["c"].dataType)), lambda c: F.concat(F.lit("\\input{"), c["stem"], F.lit("}"))), "\n")
    text = F.concat(F.when(F.col("ordinal") == 1, F.lit("\\begin{document}\n")).otherwise(""), named, F.lit("\n% \\input{commented}\n\\include{missing-"), F.col("ordinal").cast("string"), F.lit("} \\subfile{"), F.element_at(F.split("path", "/"), -1), F.lit("}\n"))
    return cut(j.select("path", text.alias("text")))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    f = _tree(spark, d)
    return graph.resolve(graph.include_edges(f), f)


S_TREE = """n AS (SELECT path, coalesce(project, '') AS project, row_number() OVER (PARTITION BY coalesce(project, '') ORDER BY path) AS k FROM documents WHERE fmt = 'tex' AND path IS NOT NULL),
e AS (SELECT a.path AS src, b.path AS dst, b.k % 2 = 0 AS left_, regexp_replace(b.path, '\\.tex$', '') AS name, (SELECT max(k) FROM n x WHERE x.project = a.project) AS top, a.k FROM n a JOIN n b ON a.project = b.project AND b.k // 2 = a.k AND b.k > 1),
m AS (SELECT n.path AS src, count(dst) AS c, any_value(n.k) AS k FROM n LEFT JOIN e ON e.src = n.path GROUP BY n.path),
r AS (SELECT src, dst, name, CASE WHEN left_ THEN 0 ELSE 1 END AS ordinal FROM e UNION ALL SELECT src, NULL, 'missing-' || k, c FROM m UNION ALL SELECT src, src, string_split(src, '/')[-1], c + 1 FROM m)"""
S_CLOSURE = "c(root, path, depth) AS (SELECT path, path, 0 FROM n UNION SELECT c.root, r.dst, c.depth + 1 FROM c JOIN r ON r.src = c.path WHERE r.dst IS NOT NULL AND r.dst <> r.src AND c.depth < 32)"
add("include_edges", lambda s, d: graph.include_edges(_tree(s, d)), f"WITH {S_TREE} SELECT src, CAST(ordinal AS INT) AS ordinal, name FROM r")
add("resolved_includes", _edges, f"WITH {S_TREE} SELECT src, CAST(ordinal AS INT) AS ordinal, name, dst FROM r")


def _closed(spark: SparkSession, d: str, which: int) -> DataFrame:
    edges = cut(_edges(spark, d))
    return graph.closure(edges.select(F.col("src").alias("path")).distinct(), edges)[which]


add("include_closure", lambda s, d: _closed(s, d, 0), f"WITH RECURSIVE {S_TREE}, {S_CLOSURE} SELECT root, path, CAST(min(depth) AS INT) AS depth FROM c GROUP BY ALL")
add("include_warnings", lambda s, d: _closed(s, d, 1), f"WITH RECURSIVE {S_TREE}, {S_CLOSURE} SELECT DISTINCT root, path, 'missing include' AS problem, r.name AS detail FROM c JOIN r ON r.src = c.path WHERE r.dst IS NULL")
add("planned_files", lambda s, d: graph.planned(_tree(s, d))[0].select("path", "fragment", "root", "depth"),
    f"""WITH RECURSIVE {S_TREE}, {S_CLOSURE} SELECT path, depth > 0 AS fragment, root, depth FROM (SELECT path, root, CAST(min(depth) AS INT) AS depth FROM c WHERE root IN (SELECT path FROM n WHERE k = 1) GROUP BY ALL)""")

# ---- regions: texts with markers put in, alternately as the data has it
OFF = {"markdown": "<!-- tidewright: off -->", "latex": "%% Tidewright: OFF here"}
ON = {"markdown": "  <!-- tidewright: on -->", "latex": "% tidewright: on"}


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which a paragraph that begins with a letter up to M is preceded by a marker that switches off, any other by one that switches on."""
    fmt = base.format_of(F.col("path"))
    at = lambda of: F.when(fmt == "latex", of["latex"]).otherwise(of["markdown"])
    text = F.regexp_replace("text", F.lit(r"\n\n([A-M])"), F.concat(F.lit("\n"), at(OFF), F.lit("\n$1")))
    return table(spark, d, "documents").select("doc_id", "path", "fragment", F.replace(text, F.lit("\n\n"), F.concat(F.lit("\n"), at(ON), F.lit("\n"))).alias("text"))


S_FMT = "CASE WHEN regexp_matches(lower(path), '\\.(md|markdown|mdown)$') THEN 'markdown' WHEN regexp_matches(lower(path), '\\.(tex|latex)$') THEN 'latex' END"
_at = lambda of: f"CASE WHEN f = 'latex' THEN '{of['latex']}' ELSE '{of['markdown']}' END"
S_STATE = f"CASE WHEN f = 'latex' THEN regexp_extract(line, {q(base.marker_pattern('latex', 'tidewright'))}, 1) ELSE regexp_extract(line, {q(base.marker_pattern('markdown', 'tidewright'))}, 1) END"
add("disabled_spans", lambda s, d: spans.disabled_spans(_marked(s, d)).select("doc_id", "lo", "hi"), f"""WITH t AS (SELECT doc_id, f, replace(regexp_replace(text, '\\n\\n([A-M])', chr(10) || ({_at(OFF)}) || chr(10) || '\\1', 'g'), chr(10) || chr(10), chr(10) || ({_at(ON)}) || chr(10)) AS text
  FROM (SELECT doc_id, text, {S_FMT} AS f FROM documents) WHERE f IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, f, length(text) AS n, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM t),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM l),
m AS (SELECT doc_id, n, lo, lo + length(line) AS hi, lower({S_STATE}) AS state FROM o WHERE lower({S_STATE}) <> ''),
u AS (SELECT *, lag(state, 1, 'on') OVER (PARTITION BY doc_id ORDER BY lo) AS was FROM m), v AS (SELECT *, lead(hi) OVER (PARTITION BY doc_id ORDER BY lo) AS nxt FROM u WHERE state <> was)
SELECT doc_id, CAST(lo AS BIGINT) AS lo, CAST(coalesce(nxt, n) AS BIGINT) AS hi FROM v WHERE state = 'off'""")  # fmt: skip


def _outside(spark: SparkSession, d: str) -> DataFrame:
    """Whether the two ways to leave out what lies in a region agree: while a document is read, and by an anti join. One row a document."""
    m = _marked(spark, d)
    one = base.segments(m, drop_disabled="tidewright").select("doc_id", "start", "end", F.lit(1).alias("n"))
    two = spans.drop_inside(base.segments(m), spans.disabled_spans(m)).select("doc_id", "start", "end", F.lit(-1).alias("n"))
    none = m.select("doc_id", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(0).alias("n"))
    return one.unionByName(two).unionByName(none).groupBy("doc_id", "start", "end").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.max(F.abs("n")).alias("differ"))


add("segments_outside_regions", _outside, "SELECT doc_id, CAST(0 AS BIGINT) AS differ FROM documents")

# ---- what segments and round trips must keep


def _held(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every document with its segments' own texts put in their places: segments quote, and overlap nowhere."""
    docs = table(spark, d, "documents").where("text is not null")
    s = base.segments(docs)
    return spans.splice(docs, s.select("doc_id", "start", "end", F.col("text").alias("new"))).select("doc_id", F.md5("text").alias("digest"))


add("segments_quote", _held, "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")


def _protected(spark: SparkSession, d: str) -> DataFrame:
    """Digest of what a round trip must not touch: every document less its prose, before and after."""
    docs = table(spark, d, "documents").where("text is not null")
    r = cut(translate.round_trip(docs, ["fr"]).select("doc_id", "start", "end", "original", "final"))
    blank = lambda column: r.select("doc_id", "start", "end", F.lit("").alias("new"))
    # the same places emptied: what is left is what lies between, whatever the finals are
    left = spans.splice(docs, blank("original")).withColumnRenamed("text", "rest")
    n = r.groupBy("doc_id").agg(F.sum(F.length("original")).alias("prose"), F.sum(F.length("final")).alias("written"))
    done = translate.rendered(docs, r).join(left, "doc_id").join(n, "doc_id", "left").join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return done.select("doc_id", (F.length("rest") == F.col("n") - zero(F.col("prose"))).alias("rest_kept"), (F.length("text") == F.length("rest") + zero(F.col("written"))).alias("finals_placed"))


add("round_trip_keeps_rest", _protected, "SELECT doc_id, true AS rest_kept, true AS finals_placed FROM documents WHERE text IS NOT NULL")
add("span_coverage", lambda s, d: report.coverage(_span_rows(s, d).select("doc_id", "start", "end").distinct(), _lengths(s, d)).withColumn("percent", F.round("percent", 6)),
    f"""WITH d AS (SELECT doc_id, coalesce(n_chars, 0) AS chars, coalesce(p, 0) AS prose FROM documents LEFT JOIN (SELECT doc_id, sum(e - s) AS p FROM {S_SPANS} GROUP BY doc_id) USING (doc_id))
SELECT doc_id, CAST(sum(prose) AS BIGINT) AS prose, CAST(sum(chars) AS BIGINT) AS chars, round(100.0 * sum(prose) / CAST(greatest(sum(chars), 1) AS DOUBLE), 6) AS percent FROM d GROUP BY ROLLUP (doc_id)""")  # fmt: skip
add("head_sample", lambda s, d: spans.even_sample(_span_rows(s, d).select("doc_id", "start", "end").distinct(), "doc_id", ["start", "end"], limit=2),
    f'SELECT doc_id, s AS start, e AS "end" FROM {S_SPANS} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s, e) <= 2')
add("span_subset", lambda s, d: spans.subset(_span_rows(s, d).select("doc_id", "start", "end").distinct().withColumn("seg_id", F.row_number().over(report.Window.partitionBy("doc_id").orderBy("start", "end")) - 1), [0, 2, 3]),
    f'SELECT doc_id, s AS start, e AS "end", CAST(k AS INT) AS seg_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1 AS k FROM {S_SPANS}) WHERE k IN (0, 2, 3)')


# ---- prompts
S_NAME = lambda c: f"coalesce(CASE lower({c}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + f" END, {c})"
scalar("hop_prompts", "runs", "run_id", lambda p: F.transform(T.hop_chain(p), lambda x: translate.system_prompt(x["src"], x["dst"], "Be plain.")), ["pivot_chain"],
       f"(SELECT ['Translate this technical text from ' || {S_NAME('l[i]')} || ' into ' || {S_NAME('l[i + 1]')} || '. ' || {q(translate.MECHANICS)} || CASE WHEN l[i + 1] = 'en' THEN ' Style, below these rules: Be plain.' ELSE '' END for i in range(1, len(l))] FROM (SELECT list_concat(['en'], pivot_chain, ['en']) AS l))")


# ---- cache
def _pending(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document's originals the hops stored by a day spare, through one pivot and back."""
    r = raw(spark, d).where("original is not null").select("result_id", "doc_id", F.col("original").alias("masked"), "hops", "loaded_at")
    old = r.where(F.col("loaded_at") < F.lit(STORED).cast("timestamp")).select("masked", F.try_element_at("hops", F.lit(1)).alias("one"), F.try_element_at("hops", F.lit(-1)).alias("two"), F.size("hops").alias("n"))
    key = lambda src, dst, text: T.cache_key(F.lit("m"), F.lit(src), F.lit(dst), translate.system_prompt(F.lit(src), F.lit(dst)), F.lit("0.0"), text)
    cache = old.where("one is not null").select(key("en", "fr", F.col("masked")).alias("key"), F.col("one").alias("value")).unionByName(old.where("n > 1 and one is not null and two is not null").select(key("fr", "en", F.col("one")).alias("key"), F.col("two").alias("value")))
    return translate.pending(report.once(r.select("result_id", "doc_id", "masked"), "result_id"), ["fr"], cache, "m")


add("pending", _pending, f"""WITH r AS (SELECT DISTINCT result_id, doc_id, original FROM segment_results WHERE original IS NOT NULL AND {s_words('original')} >= {P.MIN_WORDS}),
o AS (SELECT original, hops[1] AS one, hops[-1] AS two, len(hops) AS n FROM segment_results WHERE original IS NOT NULL AND loaded_at < TIMESTAMPTZ '{STORED}+00'),
a AS (SELECT original, max(one) AS one FROM o WHERE one IS NOT NULL GROUP BY original), b AS (SELECT one, max(two) AS two FROM o WHERE n > 1 AND one IS NOT NULL AND two IS NOT NULL GROUP BY one)
SELECT doc_id, count(two) AS cached, count(*) AS total, CAST(coalesce(sum(CASE WHEN two IS NULL THEN length(original) END), 0) AS BIGINT) AS uncached_chars FROM r LEFT JOIN a USING (original) LEFT JOIN b USING (one) GROUP BY doc_id""")  # fmt: skip

# ---- files
add("glossary_terms", lambda s, d: table(s, d, "documents").where("source = 'glossary'").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select("doc_id", "line_no", files.glossary_terms(F.col("line")).alias("term")).where("term <> ''"),
    "SELECT doc_id, CAST(i - 1 AS INT) AS line_no, trim(string_split(l[i], '#')[1], ' ') AS term FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(l) + 1)) AS i FROM documents WHERE source = 'glossary' AND text IS NOT NULL) WHERE trim(string_split(l[i], '#')[1], ' ') <> ''")


def _personas(spark: SparkSession, d: str) -> DataFrame:
    """Name, number of replacements and guidance of every persona among the documents."""

    @F.pandas_udf("name string, forbid int, guidance string")
    def parsed(raw_: pd.Series) -> pd.DataFrame:
        made = [files.parsed_persona("", t) for t in raw_]
        return pd.DataFrame({"name": [p.name for p in made], "forbid": [len(p.forbid) for p in made], "guidance": [p.guidance for p in made]})

    t = table(spark, d, "documents").where("source = 'persona' and text is not null")
    return t.select("doc_id", parsed("text").alias("p")).select("doc_id", "p.*")


_HEAD = "^---\\n(?s:(.*?))\\n---\\n"
add("persona_settings", _personas, f"""SELECT doc_id, trim(regexp_extract(h, '(?m)^name:(.*)$', 1)) AS name, CAST(len(regexp_extract_all(regexp_extract(h, '(?m)^forbid:\\n((?:[ \\t]+.*(?:\\n|$))*)', 1), '(?m)^[ \\t]+[^:\\n]+:.+$')) AS INT) AS forbid, nullif(body, '') AS guidance
  FROM (SELECT doc_id, regexp_extract(text, '{_HEAD}', 1) AS h, {s_strip(f"regexp_replace(text, '{_HEAD}', '')")} AS body FROM documents WHERE source = 'persona' AND text IS NOT NULL)""")  # fmt: skip
add("assets", lambda s, d: files.assets(table(s, d, "documents").where("path is not null").select(F.col("path").alias("relative")).unionByName(table(s, d, "documents").select(F.concat("path", F.lit(".AUX")).alias("relative")).where("relative is not null")), table(s, d, "runs").select(F.col("path").alias("relative"))),
    "SELECT path AS relative FROM documents WHERE path IS NOT NULL AND NOT regexp_matches(lower(path), '\\.(tex|latex|md|markdown|mdown)$') AND path NOT IN (SELECT path FROM runs WHERE path IS NOT NULL)")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Documents against what stands for their translations: those that were run, less their formulas."""
    docs = table(spark, d, "documents").where("path is not null").select(F.col("path").alias("relative"), "text")
    other = docs.join(table(spark, d, "runs").select(F.col("path").alias("relative")).distinct(), "relative", "left_semi").withColumn("text", F.regexp_replace("text", r"\$[^$]*\$", ""))
    return report.compared_files(docs, other)


S_OTHER = "(SELECT path AS relative, text, regexp_replace(text, '\\$[^$]*\\$', '', 'g') AS other FROM documents WHERE path IN (SELECT path FROM runs) AND text IS NOT NULL)"
add("compared_files", _compared, s_structure("text", "other", "relative", S_OTHER) + """ UNION ALL SELECT path AS relative, 'missing' AS "check", true AS fatal, CAST(1 AS INT) AS lost, CAST(0 AS INT) AS gained FROM documents WHERE path IS NOT NULL AND text IS NOT NULL AND path NOT IN (SELECT path FROM runs WHERE path IS NOT NULL)""")


def _written(spark: SparkSession, d: str) -> DataFrame:
    """Reports of all documents' results, written as JSON and read again."""
    docs = table(spark, d, "documents").select("doc_id", "fmt")
    r = report.once(raw(spark, d).where("doc_id is not null").select("result_id", "doc_id", F.col("span_lo").alias("start"), F.col("span_hi").alias("end"), "original", "final", "hops", "attempts", "translated", "reason", "rules_applied", "issues"), "result_id")
    j = project.reports(docs, r, ["fr"], "m", "", False).select(F.from_json("text", files.REPORT).alias("r"), "relative")
    return j.select("relative", "r.format", "r.segments_total", "r.segments_translated", "r.segments_fallback", "r.segments_with_issues", F.size("r.segments").alias("listed"))


add("reports_written", _written, f"""SELECT doc_id || '.report.json' AS relative, fmt AS format, CAST(coalesce(n, 0) AS INT) AS segments_total, CAST(coalesce(t, 0) AS INT) AS segments_translated, CAST(coalesce(n - t, 0) AS INT) AS segments_fallback, CAST(coalesce(i, 0) AS INT) AS segments_with_issues, CAST(coalesce(n, 0) AS INT) AS listed
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(translated) AS t, count_if(translated AND len(issues) > 0) AS i FROM {ONCE} GROUP BY doc_id) USING (doc_id)""")  # fmt: skip


def _judge(spark: SparkSession, d: str, which: int) -> DataFrame:
    """A judge that goes by the finals' lengths, over the 200 longest originals that changed."""
    pairs = report.once(raw(spark, d).where("translated and original is not null and final is not null").select("result_id", "original", "final"), "result_id")
    reply = F.when(F.length("final") > F.length("original"), "the SAME").when(F.length("final") * 10 > F.length("original") * 9, "Weaker!").otherwise("?")
    return report.judged(pairs, lambda p: p.withColumn("reply", reply), 200)[which]


S_JUDGED = f"(SELECT result_id, CASE WHEN length(final) > length(original) THEN 'SAME' WHEN length(final) * 10 > length(original) * 9 THEN 'WEAKER' ELSE 'UNCLEAR' END AS verdict FROM {ONCE} WHERE translated AND {BOTH} AND final <> original ORDER BY length(original) DESC, result_id LIMIT 200)"
add("judged", lambda s, d: _judge(s, d, 0), f"SELECT * FROM {S_JUDGED}")
add("judge_tally", lambda s, d: _judge(s, d, 1), f"SELECT v AS verdict, count(verdict) AS n FROM (VALUES ('SAME'), ('WEAKER'), ('CHANGED'), ('UNCLEAR')) w(v) LEFT JOIN {S_JUDGED} ON v = verdict GROUP BY v")
