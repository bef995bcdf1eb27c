"""All core queries by name, with the SQL that gives the same result in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import graph, masking, mining, report, spans
from ..operators.cache import through_cache
from ..session import spread, table
from ..sources import base, files
from . import translate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def scalar(name: str, tab: str, key: str, value: Callable[..., Column], cols: list[str], sql: str, where: str = "true") -> None:
    """A query (key, v) of one value per row, each distinct pair once: a redelivered row counts once."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        t = table(spark, d, tab).where(where)
        return t.select(key, value(*map(F.col, cols)).alias("v")).dropDuplicates([key])

    add(name, query, f"SELECT DISTINCT {key}, {sql} AS v FROM {tab} WHERE {where}")


# ---- SQL fragments
W, SP = P.W, P.SPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qs(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def s_strip(t: str) -> str:
    return f"regexp_replace({t}, {q(rf'^[{SP}]+|[{SP}]+$')}, '', 'g')"


def s_bare(t: str) -> str:
    return f"regexp_replace({t}, {q(P.SENTINEL)}, ' ', 'g')"


def s_all(t: str, p: str, g: int = 0) -> str:
    return f"regexp_extract_all({t}, {q(p)}, {g})"


def s_numbers(t: str) -> str:
    return f"list_sort([regexp_replace(x, '[^\\p{{Nd}}]', '', 'g') for x in {s_all(s_bare(t), P.NUMBER)}])"


def s_identifiers(t: str) -> str:
    p = rf"(?:^|[^{W}])([A-Za-z][{W}.-]*\p{{Nd}}[{W}.-]*)"
    return f"list_sort([regexp_replace(x, '[.-]+$', '') for x in {s_all(s_bare(t), p, 1)}])"


def s_escapes(t: str) -> str:
    return f"list_sort({s_all(t, P.ESCAPE)})"


def s_cues(t: str, words: list[str]) -> str:
    return f"len([x for x in {s_all(s_bare(t), P.LETTERS)} if lower(x) IN {qs(words)} OR ends_with(lower(x), 'n''t')])"


def s_sentences(t: str) -> str:
    return f"greatest(1, len({s_all(s_strip(s_bare(t)), P.SENTENCE_END)}))"


def s_sentinels(t: str) -> str:
    p = r"\[\[(\p{Nd}+)\]\]"
    return s_all(t, p, 1)


def s_words(t: str) -> str:
    return f"len({s_all(s_bare(t), rf'[^{SP}]+')})"


def s_content(t: str) -> str:
    return f"list_distinct([lower(x) for x in {s_all(t, P.CONTENT_WORD)} if length(x) > 2 AND lower(x) NOT IN {qs(P.STOP_WORDS)}])"


def s_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END"


def s_candidates(t: str) -> str:
    hy = s_all(t, rf"(?:^|[^{W}])([A-Za-z][{W}]*(?:-[{W}]+)+)", 1)
    # every separator twice, so that one match's end is not the next one's start
    twice = f"regexp_replace({t}, {q(rf'([^{W}])')}, '\\1\\1', 'g')"
    cap = f"[replace(x, '  ', ' ') for x in {s_all(twice, rf'(?:^|[^{W}])([A-Z][a-z]+(?:  [A-Z][a-z]+)+)(?:[^{W}]|$)', 1)}]"
    co = s_all(t, rf"(?:^|[^{W}])([A-Za-z]+[A-Z0-9][{W}]*)", 1)
    c = f"list_distinct(list_concat({hy}, {cap}, {co}))"
    return f"(SELECT [t for t in c if len([o for o in c if o <> t AND contains(o, t)]) = 0] FROM (SELECT {c} AS c))"


def s_minus(a: str, b: str) -> str:
    """Elements of list a beyond their count in b, sorted."""
    return f"(SELECT flatten([[x for j in range(greatest(0, len([y for y in p if y = x]) - len([y for y in q if y = x])))] for x in list_sort(list_distinct(p))]) FROM (SELECT {a} AS p, {b} AS q))"


def s_listed(a: str) -> str:
    return f"('[' || array_to_string([chr(39) || x || chr(39) for x in {a}], ', ') || ']')"


def s_differs(a: str, b: str, word: str) -> str:
    """What check and comparison say of two multisets: what was lost, and gained or invented."""
    return f"(SELECT array_to_string(list_concat(CASE WHEN len(l) > 0 THEN ['lost ' || {s_listed('l')}] ELSE [] END, CASE WHEN len(g) > 0 THEN ['{word} ' || {s_listed('g')}] ELSE [] END), ', ') FROM (SELECT {s_minus(a, b)} AS l, {s_minus(b, a)} AS g))"


def s_macros(t: str) -> str:
    return f"list_sort({s_all(t, P.MACRO)})"


def s_math(t: str) -> str:
    # an escaped dollar is read as a piece of its own, so that it opens nothing
    p = r"\\\$|\$[^$]*\$|\\\[(?s:.)*?\\\]"
    return f"list_sort([x for x in {s_all(t, p)} if x <> '\\$'])"


def s_keys(t: str) -> str:
    return f"list_sort([regexp_extract(x, {q(P.KEYED)}, 1) || '|' || regexp_extract(x, {q(P.KEYED)}, 2) for x in {s_all(t, P.KEYED)}])"


def s_structure(a: str, b: str, key: str, rows: str) -> str:
    """Rows (key, check, fatal, lost, gained) of all structural checks over a table's columns a and b."""
    checks = [
        ("macros", "true", s_macros), ("environments", "true", lambda t: f"list_sort({s_all(t, P.ENVIRONMENT, 1)})"), ("escapes", "true", s_escapes), ("math spans", "true", s_math),
        ("reference keys", "false", s_keys), ("numbers", "false", s_numbers), ("identifiers", "false", s_identifiers),
    ]
    one = lambda n, fatal, f: f'SELECT {key}, \'{n}\' AS "check", {fatal} AS fatal, CAST(len({s_minus(f(a), f(b))}) AS INT) AS lost, CAST(len({s_minus(f(b), f(a))}) AS INT) AS gained FROM {rows} WHERE {f(a)} <> {f(b)}'
    return " UNION ALL ".join(one(*c) for c in checks)


def s_high(i: str) -> str:
    return f"coalesce(len([x for x in {i} if x.severity = 'high']), 0)"


ONCE = "(SELECT * EXCLUDE (loaded_at) FROM segment_results GROUP BY ALL)"
RUNS_ONCE = "(SELECT * EXCLUDE (loaded_at) FROM runs GROUP BY ALL)"


def results(spark: SparkSession, d: str) -> DataFrame:
    """Results once each; only the columns that a query reads are shuffled."""
    return report.once(table(spark, d, "segment_results"), "result_id")


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_results")


def flags(spark: SparkSession, d: str) -> DataFrame:
    return report.flags(raw(spark, d))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return report.once(table(spark, d, "runs"), "run_id")


# ---- projections and predicates
OF = ["original", "final"]
BOTH = "original IS NOT NULL AND final IS NOT NULL"
scalar("words_per_segment", "segment_results", "result_id", T.word_count, ["original"], s_words("original"))
scalar("worth_translating", "segment_results", "result_id", T.long_enough, ["original"], f"{s_words('original')} >= {P.MIN_WORDS}")
scalar("has_words", "segment_results", "result_id", T.has_words, ["final"], f"regexp_matches(regexp_replace(final, {q(P.SENTINEL)}, '', 'g'), '\\p{{L}}')")
scalar("changed", "segment_results", "result_id", lambda o, f: f != o, OF, "final <> original")
scalar("standalone_latex", "documents", "doc_id", T.is_standalone, ["text"], "regexp_matches(regexp_replace(text, '(^|[^\\\\])%[^\\n]*', '\\1', 'g'), '\\\\begin\\s*\\{document\\}')")
scalar("strip_comments", "documents", "doc_id", T.strip_comments, ["text"], "regexp_replace(text, '(^|[^\\\\])%[^\\n]*', '\\1', 'g')")
scalar("format_of_path", "documents", "doc_id", base.format_of, ["path"], "CASE WHEN regexp_matches(lower(path), '\\.(md|markdown|mdown)$') THEN 'markdown' WHEN regexp_matches(lower(path), '\\.(tex|latex)$') THEN 'latex' END")
scalar("control_tokens", "segment_results", "result_id", T.strip_control_tokens, ["final"], f"regexp_replace(final, {q(P.CONTROL_TOKEN)}, '', 'g')")
scalar("sentinel_ids", "segment_results", "result_id", lambda h: F.transform(h, T.sentinels), ["hops"], f"[{s_sentinels('h')} for h in hops]")

# ---- multisets, counts, checks, comparison
scalar("number_multiset", "segment_results", "result_id", T.numbers, ["original"], s_numbers("original"))
scalar("identifier_multiset", "segment_results", "result_id", T.identifiers, ["original"], s_identifiers("original"))
scalar("escape_multiset", "documents", "doc_id", T.escapes, ["text"], s_escapes(s_bare("text")))
scalar("negation_cues", "segment_results", "result_id", T.negation_count, ["final"], s_cues("final", P.NEGATIONS))
scalar("hedge_cues", "segment_results", "result_id", T.hedge_count, ["final"], s_cues("final", P.HEDGES))
scalar("sentence_stops", "segment_results", "result_id", T.sentence_count, ["original"], f"CASE WHEN original IS NOT NULL THEN {s_sentences('original')} END")
scalar("lost_numbers", "segment_results", "result_id", lambda o, f: T.multiset_minus(T.numbers(o), T.numbers(f)), OF, s_minus(s_numbers("original"), s_numbers("final")), BOTH)
scalar("content_overlap", "segment_results", "result_id", lambda o, f: F.round(T.jaccard(T.content_words(o), T.content_words(f)), 9), OF, f"round({s_jaccard(s_content('original'), s_content('final'))}, 9)", BOTH)
scalar("candidate_terms", "segment_results", "result_id", lambda o: F.sort_array(T.candidate_terms(o)), ["original"], f"list_sort({s_candidates('original')})", "original IS NOT NULL")


def _verdict(same: bool) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        shown = T.let(T.verdict(F.col("original"), F.col("final"), same), lambda v: F.struct(F.transform(v, lambda c: F.concat(c["name"], F.lit("="), c["ok"].cast("string"))).alias("checks"), T.passed(v).alias("ok")))
        return raw(spark, d).where(BOTH).select("result_id", shown.alias("v")).dropDuplicates(["result_id"]).select("result_id", "v.*")

    return query


def s_verdict(same: bool) -> str:
    o, f = "original", "final"
    c = {
        "nonempty": f"{s_strip(f)} <> ''",
        "sentinels": f"list_sort({s_sentinels(o)}) = list_sort({s_sentinels(f)})",
        "control_tokens": f"NOT regexp_matches({f}, {q(P.CONTROL_LEAK)})",
        "chatter": f"NOT regexp_matches({f}, {q(P.CHATTER)}) OR regexp_matches({o}, {q(P.CHATTER)})",
        "length": f"length({o}) < 40 OR length({f}) / CAST(greatest(length({o}), 1) AS DOUBLE) BETWEEN 0.5 AND 2.0",
        "numbers": f"{s_numbers(o)} = {s_numbers(f)}",
        "escapes": f"{s_escapes(o)} = {s_escapes(f)}",
    } | ({"negation": f"{s_cues(o, P.NEGATIONS)} = {s_cues(f, P.NEGATIONS)}"} if same else {})
    checks = ", ".join(f"'{k}=' || CAST(({v}) AS VARCHAR)" for k, v in c.items())
    return f"SELECT result_id, checks, len([x for x in checks if ends_with(x, 'false')]) = 0 AS ok FROM (SELECT DISTINCT result_id, [{checks}] AS checks FROM segment_results WHERE {BOTH})"


add("verdict_same_language", _verdict(True), s_verdict(True))
add("verdict_other_language", _verdict(False), s_verdict(False))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).where(BOTH).select("result_id", T.summary(T.verdict(F.col("original"), F.col("final"))).alias("summary")).dropDuplicates(["result_id"])


def s_summary() -> str:
    o, f = "original", "final"
    n = lambda t: s_cues(t, P.NEGATIONS)
    leaked = f"list_sort(list_distinct({s_all(f, P.CONTROL_LEAK)}))"
    ratio = f"length({f}) / CAST(greatest(length({o}), 1) AS DOUBLE)"
    sent = lambda t: f"list_sort({s_sentinels(t)})"
    bad = [
        (f"{s_strip(f)} = ''", "'nonempty: model returned nothing'"), (f"{sent(o)} <> {sent(f)}", f"'sentinels: ' || {s_differs(sent(o), sent(f), 'invented')}"),
        (f"len({leaked}) > 0", f"'control_tokens: leaked ' || {s_listed(leaked)}"),
        (f"regexp_matches({f}, {q(P.CHATTER)}) AND NOT regexp_matches({o}, {q(P.CHATTER)})", f"'chatter: conversational opener ' || chr(39) || {s_strip(f'regexp_extract({f}, {q(P.CHATTER)})')} || chr(39)"),
        (f"length({o}) >= 40 AND NOT ({ratio} BETWEEN 0.5 AND 2.0)", f"'length: ratio ' || printf('%.2f', {ratio}) || ' outside [0.5, 2.0]'"),
        (f"{s_numbers(o)} <> {s_numbers(f)}", f"'numbers: ' || {s_differs(s_numbers(o), s_numbers(f), 'gained')}"),
        (f"{s_escapes(o)} <> {s_escapes(f)}", f"'escapes: ' || {s_differs(s_escapes(o), s_escapes(f), 'invented')}"),
        (f"{n(o)} <> {n(f)}", f"'negation: ' || {n(o)} || ' negation cue(s) became ' || {n(f)}"),
    ]
    said = ", ".join(f"CASE WHEN {c} THEN {d} END" for c, d in bad)
    return f"SELECT DISTINCT result_id, array_to_string([x for x in [{said}] if x IS NOT NULL], '; ') AS summary FROM segment_results WHERE {BOTH}"


add("verdict_summary", _summary, s_summary())


def _issues(spark: SparkSession, d: str) -> DataFrame:
    t = raw(spark, d).where(BOTH).select("result_id", T.compare(F.col("original"), F.col("final")).alias("i")).dropDuplicates(["result_id"])
    return t.select("result_id", F.inline("i"))


def s_issues() -> str:
    o, f = "original", "final"
    n, h, s = (lambda t: s_cues(t, P.NEGATIONS)), (lambda t: s_cues(t, P.HEDGES)), s_sentences
    parts = [
        ("numbers", "high", f"{s_numbers(o)} <> {s_numbers(f)}", s_differs(s_numbers(o), s_numbers(f), "gained")), ("identifiers", "high", f"{s_identifiers(o)} <> {s_identifiers(f)}", s_differs(s_identifiers(o), s_identifiers(f), "gained")),
        ("escapes", "high", f"{s_escapes(s_bare(o))} <> {s_escapes(s_bare(f))}", s_differs(s_escapes(s_bare(o)), s_escapes(s_bare(f)), "invented")), ("negation", "high", f"{n(o)} <> {n(f)}", f"{n(o)} || ' negation cue(s) became ' || {n(f)}"),
        ("hedging", "low", f"{h(o)} <> {h(f)}", f"{h(o)} || ' hedge(s) became ' || {h(f)} || CASE WHEN {h(f)} < {h(o)} THEN ', firmed up' ELSE ', softened' END"),
        ("structure", "low", f"abs({s(o)} - {s(f)}) > greatest(1, {s(o)} // 3)", f"{s(o)} || ' sentence(s) became ' || {s(f)}"),
    ]
    one = f"(SELECT DISTINCT result_id, original, final FROM segment_results WHERE {BOTH})"
    return " UNION ALL ".join(f"SELECT result_id, '{k}' AS kind, '{sev}' AS severity, {detail} AS detail FROM {one} WHERE {cond}" for k, sev, cond, detail in parts)


add("fidelity_issues", _issues, s_issues())


def _differences(spark: SparkSession, d: str) -> DataFrame:
    """Words that each final lost or gained, with multiplicity: two multisets compared inside the row, so no word is shuffled."""
    words = lambda c: F.sort_array(F.filter(F.split(F.lower(c), rf"[{SP}]+", -1), lambda w: w != ""))
    r = raw(spark, d).where(BOTH).select("result_id", T.multiset_delta(words("original"), words("final")).alias("w")).dropDuplicates(["result_id"]).select("result_id", F.inline("w"))
    return r.select("result_id", F.col("x").alias("word"), F.greatest("n", F.lit(0)).cast("bigint").alias("lost"), F.greatest(-F.col("n"), F.lit(0)).cast("bigint").alias("gained"))


def s_side(c: str) -> str:
    return f"SELECT result_id, word, count(*) AS n FROM (SELECT result_id, unnest(regexp_split_to_array(lower({c}), {q(f'[{SP}]+')})) AS word FROM (SELECT DISTINCT result_id, original, final FROM segment_results WHERE {BOTH})) WHERE word <> '' GROUP BY ALL"


add("multiset_difference", _differences, f"SELECT result_id, word, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS lost, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS gained FROM ({s_side('original')}) a FULL JOIN ({s_side('final')}) b USING (result_id, word) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")

# ---- repair and layout
IN = P.INLINE
scalar("pivot_artifacts", "segment_results", "result_id", lambda f: T.strip_pivot_artifacts(f)["text"], ["final"],
       f"regexp_replace(regexp_replace(regexp_replace(translate(final, '{''.join(P.PIVOT_SPACES)}', '    '), {q(rf'[{IN}]+([.,;:!?%)\]])')}, '\\1', 'g'), {q(rf'([(\[])[{IN}]+')}, '\\1', 'g'), {q(rf'[{IN}]{{2,}}')}, ' ', 'g')")


def _echo_sql() -> str:
    t = "final"
    for p, _ in P.ECHOED:
        p = p.replace(r"\A", "^")
        t = f"CASE WHEN regexp_matches({t}, {q(p)}) AND NOT regexp_matches(original, {q(p)}) THEN regexp_replace({t}, {q(p)}, '') ELSE {t} END"
    return t


scalar("echoed_markers", "segment_results", "result_id", lambda o, f: T.strip_echoed_markers(o, f)["text"], OF, _echo_sql(), BOTH)
S_WIDTHS = f"[length(x) for x in string_split(text, chr(10)) if {s_strip('x')} <> '']"
scalar("wrap_width", "documents", "doc_id", T.detect_width, ["text"], f"CASE WHEN len({S_WIDTHS}) >= 2 AND list_max({S_WIDTHS}) >= 20 AND list_min({S_WIDTHS}[:-2]) >= list_max({S_WIDTHS}) - 24 THEN list_max({S_WIDTHS}) END")
S_TOKENS = f"[x for x in regexp_split_to_array(final, {q(f'[{SP}]+')}) if x <> '']"
scalar("greedy_wrap", "segment_results", "result_id", lambda f: T.rewrap(f, F.lit(60)), ["final"],
       f"CASE WHEN len({S_TOKENS}) = 0 THEN final ELSE list_reduce({S_TOKENS}, lambda a, t: a || CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(t) > 60 THEN chr(10) ELSE ' ' END || t) END")
scalar("apply_continuation", "segment_results", "result_id", lambda o: T.apply_continuation(o, F.lit("> ")), ["original"], "replace(original, chr(10), chr(10) || '> ')")
scalar("strip_continuation", "segment_results", "result_id", lambda o: T.strip_continuation(F.regexp_replace(o, " the ", "\n  the > "), F.lit("  ")), ["original"],
       "(SELECT array_to_string([CASE WHEN i = 1 THEN l[i] WHEN starts_with(l[i], '  ') THEN l[i][3:] ELSE regexp_replace(l[i], '^[> \\t]+', '') END for i in range(1, len(l) + 1)], chr(10)) FROM (SELECT string_split(replace(original, ' the ', chr(10) || '  the > '), chr(10)) AS l))", "original IS NOT NULL")
scalar("human_duration", "segment_results", "result_id", lambda e: T.human_duration(e * 60), ["elapsed_s"],
       "(SELECT CASE WHEN s < 1 THEN 'instant' WHEN s < 90 THEN CAST(CAST(round_even(s, 0) AS BIGINT) AS VARCHAR) || 's' WHEN s / 60 < 90 THEN CAST(CAST(round_even(s / 60, 0) AS BIGINT) AS VARCHAR) || ' min' WHEN floor((s / 60) % 60) > 0 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || 'h ' || lpad(CAST(CAST(floor((s / 60) % 60) AS BIGINT) AS VARCHAR), 2, '0') || 'm' WHEN s IS NOT NULL THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || 'h' END FROM (SELECT greatest(elapsed_s * 60, 0.0) AS s))", "elapsed_s IS NOT NULL")
scalar("cost_model", "segment_results", "result_id", lambda o: F.round(T.predict(F.length(o), F.lit(1)), 6), ["original"], f"round(CAST({P.OVERHEAD_SECONDS} AS DOUBLE) + length(original) * CAST({P.SECONDS_PER_CHAR} AS DOUBLE), 6)")
scalar("survival_ratio", "term_stats", "stat_id", lambda a, b: F.round(T.survival(a, b), 9), ["seen", "survived"], "round(coalesce(CASE WHEN seen <> 0 THEN survived / CAST(seen AS DOUBLE) END, 1.0), 9)")


def _variants(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "segment_results").select(F.explode(F.transform(F.regexp_extract_all("final", F.lit(P.WORD), F.lit(0)), F.lower)).alias("word")).distinct()
    return t.select("word", F.explode(T.spelling_variants(F.col("word"))).alias("variant"))


def s_variants() -> str:
    rules = ", ".join(f"({q(x)}, {q(y)})" for a, b in P.ENDINGS for x, y in ((a, b), (b, a)))
    tail = "(ed|ing|er|ers|est)$"
    return f"""WITH w AS (SELECT DISTINCT lower(unnest({s_all('final', P.WORD)})) AS word FROM segment_results), r(x, y) AS (VALUES {rules})
SELECT word, left(word, length(word) - length(x)) || y AS variant FROM w JOIN r ON ends_with(word, x)
UNION SELECT word, regexp_replace(word, 'll{tail}', 'l\\1') FROM w WHERE regexp_matches(word, 'll{tail}')
UNION SELECT word, regexp_replace(word, 'l{tail}', 'll\\1') FROM w WHERE regexp_matches(word, '(^|[^l])l{tail}')"""


add("spelling_variants", _variants, s_variants())

# ---- model boundary
S_MARK = f"regexp_matches(x, {q('^' + P.SENTINEL + '$')})"
scalar("rotated_words", "segment_results", "result_id", lambda o, h: T.rotate_words(F.concat_ws("\n", o, F.try_element_at(h, F.lit(1)))), ["original", "hops"], "NULL")
SQL["rotated_words"] = f"""WITH l AS (SELECT result_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS n FROM (SELECT DISTINCT result_id, concat_ws(chr(10), original, hops[1]) AS t FROM segment_results)),
w AS (SELECT *, {s_all("line", P.SENTINEL + "|[^" + SP + "]+")} AS w FROM l), p AS (SELECT *, [x for x in w if NOT {S_MARK}] AS p FROM w), r AS (SELECT *, list_concat(p[2:], p[1:1]) AS r FROM p),
o AS (SELECT result_id, n, array_to_string([CASE WHEN regexp_matches(w[i], {q('^' + P.SENTINEL + '$')}) THEN w[i] ELSE r[len([x for x in w[1:i] if NOT {S_MARK}])] END for i in range(1, len(w) + 1)], ' ') AS line FROM r)
SELECT result_id, string_agg(line, chr(10) ORDER BY n) AS v FROM o GROUP BY result_id"""
scalar("cache_keys", "segment_results", "result_id", lambda o: T.cache_key(F.lit("model"), F.lit("en"), F.lit("fr"), o), ["original"], "left(sha256('model' || chr(0) || 'en' || chr(0) || 'fr' || chr(0) || original || chr(0)), 32)")
scalar("hop_chain", "runs", "run_id", lambda p: F.transform(T.hop_chain(p), lambda x: F.concat(x["src"], F.lit(">"), x["dst"])), ["pivot_chain"],
       "(SELECT [l[i] || '>' || l[i + 1] for i in range(1, len(l))] FROM (SELECT list_concat(['en'], pivot_chain, ['en']) AS l))")
scalar("language_names", "runs", "run_id", lambda p: F.transform(p, T.language_name), ["pivot_chain"], "[coalesce(CASE lower(p) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END, p) for p in pivot_chain]")
scalar("rendered_prompts", "segment_results", "result_id", lambda o: T.render_prompt(F.lit("Translate."), o), ["original"],
       f"'<|begin_of_text|><|start|>system<|message|>Translate.' || chr(10) || chr(10) || 'Reasoning strength: low.' || chr(10) || chr(10) || '# Valid recipients: \"self\", \"user\".<|eot|><|start|>user<|message|>' || regexp_replace(original, {q(P.CONTROL_TOKEN)}, '', 'g') || '<|eot|><|start|>assistant'")
scalar("parsed_responses", "segment_results", "result_id", lambda f: T.parse_response(F.concat(F.lit(" to=self<|message|>thinking<|eom|><|start|>assistant<|message|>"), f, F.lit("<|eot|>"))), ["final"], s_strip("final"))
scalar("persona_names", "runs", "run_id", lambda p: p.rlike(P.SAFE_NAME), ["persona"], f"regexp_matches(persona, {q(P.SAFE_NAME)})")
scalar("settings_precedence", "runs", "run_id", lambda m, p: files.setting(m, F.lit("tern-3b"), F.nullif(p, F.lit(""))), ["model", "persona"], "CASE WHEN model IS DISTINCT FROM 'tern-3b' THEN model ELSE coalesce(nullif(persona, ''), 'tern-3b') END")


def _cached(spark: SparkSession, d: str) -> DataFrame:
    """Every original's first hop, from what had been stored by a given day or else by a call."""
    r = raw(spark, d).where("original is not null").select("result_id", "original", F.try_element_at("hops", F.lit(1)).alias("hop"), "loaded_at")
    keyed = r.withColumn("key", T.cache_key(F.lit("en"), F.col("original")))
    old = keyed.where(F.col("loaded_at") < F.lit(STORED).cast("timestamp")).where("hop is not null").groupBy("key").agg(F.max("hop").alias("value"))
    out, _ = through_cache(report.once(r.select("result_id", "original"), "result_id"), T.cache_key(F.lit("en"), F.col("original")), old, lambda x: x.withColumn("out", F.upper("original")))
    return out.select("result_id", "out")


STORED = "2025-05-01 00:00:00"
add("hop_cache", _cached, f"""WITH r AS (SELECT DISTINCT result_id, original FROM segment_results WHERE original IS NOT NULL),
c AS (SELECT original, max(hops[1]) AS value FROM segment_results WHERE original IS NOT NULL AND hops[1] IS NOT NULL AND loaded_at < TIMESTAMPTZ '{STORED}+00' GROUP BY original)
SELECT result_id, coalesce(value, upper(original)) AS out FROM r LEFT JOIN c USING (original)""")

# ---- spans
add("line_offsets", lambda s, d: spans.line_offsets(table(s, d, "documents")).select("doc_id", "line_no", "start", "line"),
    "SELECT doc_id, i - 1 AS line_no, CAST(coalesce(list_sum([length(x) + 1 for x in l[:i - 1]]), 0) AS BIGINT) AS start, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(l) + 1)) AS i FROM documents WHERE text IS NOT NULL)")
add("paragraphs", lambda s, d: spans.paragraphs(table(s, d, "documents")),
    "SELECT doc_id, i - 1 AS para_no, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, [y for y in [regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in regexp_split_to_array(text, '\\n[ \\t]*\\n')] if y <> ''] AS p FROM documents WHERE text IS NOT NULL))")


def _span_rows(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).where("span_lo is not null and span_hi is not null").select("doc_id", F.col("span_lo").alias("start"), F.col("span_hi").alias("end"), "translated").distinct()


S_SPANS = "(SELECT DISTINCT doc_id, span_lo AS s, span_hi AS e FROM segment_results WHERE span_lo IS NOT NULL AND span_hi IS NOT NULL)"


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


add("protected_spans", lambda s, d: spans.complement(_span_rows(s, d).join(_lengths(s, d), "doc_id", "left_semi"), _lengths(s, d)),
    f"""SELECT doc_id, f AS start, s AS "end" FROM (SELECT doc_id, s, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f
FROM (SELECT x.* FROM {S_SPANS} x SEMI JOIN documents USING (doc_id) UNION ALL SELECT doc_id, coalesce(n_chars, 0), coalesce(n_chars, 0) FROM documents)) WHERE s > f""")  # fmt: skip
add("merged_islands", lambda s, d: spans.merge_islands(_span_rows(s, d), F.col("start") <= F.col("reach") + 2, keep={"n": F.count("*")}),
    f"""SELECT doc_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM
(SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS b FROM {"(SELECT DISTINCT doc_id, span_lo AS s, span_hi AS e, translated FROM segment_results WHERE span_lo IS NOT NULL AND span_hi IS NOT NULL)"})) GROUP BY doc_id, island""")  # fmt: skip
def _shifted(spark: SparkSession, d: str) -> DataFrame:
    """The spans, and each of them once more from the middle on and the other way round, so that there is something to find."""
    r = _span_rows(spark, d).select("doc_id", "start", "end").distinct()
    half = F.floor((F.col("start") + F.col("end")) / 2)
    return r.unionByName(r.select("doc_id", half.alias("start"), (F.col("end") + 3).alias("end"))).unionByName(r.select("doc_id", F.col("end").alias("start"), F.col("start").alias("end"))).distinct()


add("span_violations", lambda s, d: spans.violations(_shifted(s, d)),
    f"""WITH x AS (SELECT doc_id, s, e FROM {S_SPANS} UNION SELECT doc_id, CAST(floor((s + e) / 2) AS BIGINT), e + 3 FROM {S_SPANS} UNION SELECT doc_id, e, s FROM {S_SPANS})
SELECT doc_id, s AS start, e AS "end", p AS problem FROM (SELECT *, CASE WHEN s > e THEN 'inverted' WHEN s < lag(e) OVER (PARTITION BY doc_id ORDER BY s, e) THEN 'overlapping' END AS p FROM x) WHERE p IS NOT NULL""")  # fmt: skip
add("unquoted_spans", lambda s, d: spans.unquoted(raw(s, d).select("doc_id", (F.col("span_lo") + F.when(F.col("translated"), 0).otherwise(1)).alias("start"), F.col("span_hi").alias("end"), "original").distinct(), table(s, d, "documents")),
    """SELECT doc_id, s AS start, e AS "end" FROM (SELECT DISTINCT doc_id, span_lo + CASE WHEN translated THEN 0 ELSE 1 END AS s, span_hi AS e, original FROM segment_results WHERE original IS NOT NULL) LEFT JOIN documents USING (doc_id) WHERE text IS NULL OR substring(text, s + 1, e - s) <> original""")  # fmt: skip
add("frozen_regions", lambda s, d: spans.drop_inside(_span_rows(s, d).select("doc_id", "start", "end").distinct(), results(s, d).where("not translated").select("doc_id", F.col("span_lo").alias("lo"), F.col("span_hi").alias("hi")).distinct()),
    f"""SELECT doc_id, s AS start, e AS "end" FROM {S_SPANS} x WHERE NOT EXISTS (SELECT 1 FROM segment_results r WHERE NOT r.translated AND r.doc_id = x.doc_id AND r.span_lo <= x.s AND x.e <= r.span_hi)""")
add("contained_spans", lambda s, d: spans.contained(_span_rows(s, d).select("doc_id", "start", "end").distinct(), _span_rows(s, d).where("not translated")),
    f"""SELECT doc_id, s AS start, e AS "end" FROM {S_SPANS} x WHERE EXISTS (SELECT 1 FROM segment_results r WHERE NOT r.translated AND r.doc_id = x.doc_id AND r.span_lo >= x.s AND r.span_hi <= x.e)""")
add("even_sample", lambda s, d: spans.even_sample(_span_rows(s, d).select("doc_id", "start", "end").distinct(), "doc_id", ["start", "end"], sample=3),
    f"""SELECT doc_id, s AS start, e AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {S_SPANS}) WHERE n <= 3 OR k IN (CAST(floor(0 * (n / 3.0)) AS BIGINT), CAST(floor(1 * (n / 3.0)) AS BIGINT), CAST(floor(2 * (n / 3.0)) AS BIGINT))""")


def _splice(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its latest result's prose in upper case; everything else as it was."""
    docs = table(spark, d, "documents")
    r = results(spark, d).where("original is not null").select("doc_id", F.col("span_lo").alias("start"), F.col("span_hi").alias("end"), F.upper("original").alias("new"))
    return spans.splice(docs.where("text is not null"), r.join(docs.select("doc_id"), "doc_id", "left_semi")).select("doc_id", F.md5("text").alias("digest"))


add("splice", _splice, """WITH r AS (SELECT doc_id, span_lo AS s, span_hi AS e, max(upper(original)) AS new FROM segment_results WHERE original IS NOT NULL GROUP BY ALL),
p AS (SELECT doc_id, s, substring(text, p0 + 1, s - p0) || new AS piece, e FROM (SELECT r.*, text, coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY s), 0) AS p0 FROM r JOIN documents USING (doc_id) WHERE text IS NOT NULL)),
g AS (SELECT doc_id, string_agg(piece, '' ORDER BY s) AS head, max(e) AS last FROM p GROUP BY doc_id)
SELECT doc_id, md5(coalesce(head, '') || substring(text, coalesce(last, 0) + 1)) AS digest FROM documents LEFT JOIN g USING (doc_id) WHERE text IS NOT NULL""")
add("prose_segments", lambda s, d: base.segments(table(s, d, "documents"), drop_disabled="tidewright"))
add("prose_coverage", lambda s, d: report.coverage(base.segments(table(s, d, "documents")), _lengths(s, d)))


def _mask(spark: SparkSession, d: str) -> DataFrame:
    """Every document masked by its own format's rules, and restored."""
    docs = table(spark, d, "documents").where("text is not null")
    m = docs.select("doc_id", masking.masker()("text", F.coalesce(base.format_of(F.col("path")), F.lit("markdown"))).alias("m"))
    return m.select("doc_id", F.md5(masking.unmask(F.col("m.text"), F.col("m.mapping"))).alias("digest"), F.forall("m.mapping", lambda x: F.contains(F.col("m.text"), x["key"])).alias("placed"))


add("mask_and_restore", _mask, "SELECT doc_id, md5(text) AS digest, true AS placed FROM documents WHERE text IS NOT NULL")
add("round_trip", lambda s, d: translate.round_trip(table(s, d, "documents"), ["fr"]).select("doc_id", "seg_id", "translated", "final", "reason"))


# ---- aggregates
add("run_totals", lambda s, d: report.totals(flags(s, d), ["project"]),
    f"SELECT project, count(*) AS segments, count_if(translated) AS translated, count_if(NOT translated) AS fallback, count_if(translated AND coalesce(len(issues), 0) > 0) AS flagged, count_if(final <> original) AS changed FROM {ONCE} GROUP BY project")
add("reports_by_model", lambda s, d: runs(s, d).groupBy("model").agg(F.count("*").alias("runs"), F.sum("segments_total").alias("segments"), F.sum("segments_translated").alias("translated"), F.sum("segments_fallback").alias("fallback"), F.sum("segments_with_issues").alias("flagged"), F.count_if("interrupted").alias("interrupted")),
    f"SELECT model, count(*) AS runs, CAST(sum(segments_total) AS BIGINT) AS segments, CAST(sum(segments_translated) AS BIGINT) AS translated, CAST(sum(segments_fallback) AS BIGINT) AS fallback, CAST(sum(segments_with_issues) AS BIGINT) AS flagged, count_if(interrupted) AS interrupted FROM {RUNS_ONCE} GROUP BY model")
add("worst_flagged", lambda s, d: report.worst_first(flags(s, d), 10), f"SELECT result_id, doc_id, span_lo, {s_high('issues')} AS high, len(issues) AS total FROM {ONCE} WHERE len(issues) > 0 ORDER BY high DESC, total DESC, doc_id, span_lo, result_id LIMIT 10")
add("worst_first_all", lambda s, d: report.worst_first(flags(s, d), None), f"SELECT result_id, doc_id, span_lo, {s_high('issues')} AS high, len(issues) AS total FROM {ONCE} WHERE len(issues) > 0")
add("mined_terms", lambda s, d: mining.mine(raw(s, d).where("translated and final <> original"), key="result_id").withColumn("survival", F.round("survival", 9)),
    f"""SELECT term, count(*) AS seen, count_if(contains(lower(final), lower(term))) AS survived, round(count_if(contains(lower(final), lower(term))) / CAST(count(*) AS DOUBLE), 9) AS survival
FROM (SELECT final, unnest({s_candidates('original')}) AS term FROM {ONCE} WHERE translated AND final <> original) GROUP BY term HAVING count(*) >= {P.MIN_OCCURRENCES} AND count_if(contains(lower(final), lower(term))) / CAST(count(*) AS DOUBLE) <= {P.MAX_SURVIVAL}""")  # fmt: skip
add("glossary_lines", lambda s, d: mining.mine(raw(s, d).where("translated and final <> original"), key="result_id").select(mining.glossary_line(F.col("term"), F.col("seen"), F.col("survived")).alias("line")),
    f"""SELECT term || '    # survived ' || count_if(contains(lower(final), lower(term))) || '/' || count(*) AS line
FROM (SELECT final, unnest({s_candidates('original')}) AS term FROM {ONCE} WHERE translated AND final <> original) GROUP BY term HAVING count(*) >= {P.MIN_OCCURRENCES} AND count_if(contains(lower(final), lower(term))) / CAST(count(*) AS DOUBLE) <= {P.MAX_SURVIVAL}""")  # fmt: skip
S_SIMS = f"(SELECT result_id, {s_jaccard(s_content('original'), s_content('final'))} AS similarity FROM {ONCE} WHERE translated AND final <> original)"
add("overlap_statistics", lambda s, d: report.overlap_statistics(report.overlaps(raw(s, d))).select("changed", *[F.round(c, 9).alias(c) for c in ("mean", "median", "least")]),
    f"SELECT count(*) AS changed, round(avg(similarity), 9) AS mean, round(list_sort(list(similarity))[count(*) // 2 + 1], 9) AS median, round(min(similarity), 9) AS least FROM {S_SIMS}")
add("overlap_histogram", lambda s, d: report.histogram(report.overlaps(raw(s, d))), f"SELECT b.bucket, count(similarity) AS n FROM (VALUES " + ", ".join(f"({lo}, {hi}, '{n}')" for lo, hi, n in report.BUCKETS) + f") b(lo, hi, bucket) LEFT JOIN {S_SIMS} x ON similarity >= lo AND similarity < hi GROUP BY b.bucket")
add("lowest_overlap", lambda s, d: report.overlaps(raw(s, d)).select("result_id", F.round("similarity", 9).alias("similarity")).orderBy("similarity", "result_id").limit(8), f"SELECT result_id, round(similarity, 9) AS similarity FROM {S_SIMS} ORDER BY 2, 1 LIMIT 8")
add("fallback_reasons", lambda s, d: report.reasons(flags(s, d)), f"SELECT left({s_strip('string_split(coalesce(reason, ' + chr(39) * 2 + '), ' + chr(39) + ':' + chr(39) + ')[-1]')}, 60) AS reason, count(*) AS n FROM {ONCE} WHERE NOT translated GROUP BY 1 ORDER BY n DESC, reason LIMIT 8")
add("scores", lambda s, d: report.scores(flags(s, d)).select("segments", "fallback", "changed", "severe", F.round("meaning", 6).alias("meaning"), F.round("completion", 6).alias("completion")),
    f"SELECT count(*) AS segments, count_if(NOT translated) AS fallback, count_if(translated AND final <> original) AS changed, CAST(coalesce(sum({s_high('issues')}), 0) AS BIGINT) AS severe, round(100.0 * (1 - coalesce(sum({s_high('issues')}), 0) / CAST(greatest(count_if(translated AND final <> original), 1) AS DOUBLE)), 6) AS meaning, round(100.0 * (count(*) - count_if(NOT translated)) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS completion FROM {ONCE}")
add("longest_changed", lambda s, d: report.longest_changed(flags(s, d)), f"SELECT result_id, length(original) AS chars FROM {ONCE} WHERE translated AND final <> original ORDER BY chars DESC, result_id LIMIT 25")
add("structure_differences", lambda s, d: report.structure(raw(s, d), "result_id", "original", "final"), s_structure("original", "final", "result_id", f"(SELECT DISTINCT result_id, original, final FROM segment_results WHERE {BOTH})"))
add("structure_of_files", lambda s, d: report.structure(spread(table(s, d, "documents").select("doc_id", "text")).withColumn("other", F.regexp_replace(F.regexp_replace("text", r"\$[^$]*\$", ""), "e", "e1")), "doc_id", "text", "other"),
    s_structure("text", "other", "doc_id", "(SELECT doc_id, text, replace(regexp_replace(text, '\\$[^$]*\\$', '', 'g'), 'e', 'e1') AS other FROM documents WHERE text IS NOT NULL)"))


def _eta(spark: SparkSession, d: str) -> DataFrame:
    r = flags(spark, d).where("run_id is not null").select("result_id", "run_id", "span_lo", "elapsed_s", F.coalesce("chars", F.lit(0)).alias("chars"))
    return report.running_eta(r, "run_id", ["span_lo", "result_id"]).select("result_id", F.round("remaining_s", 4).alias("remaining_s"))


add("running_eta", _eta, f"""WITH r AS (SELECT result_id, run_id, span_lo, elapsed_s, coalesce(length(original), 0) AS c, CASE WHEN elapsed_s >= 1 THEN 1 ELSE 0 END AS w FROM {ONCE} WHERE run_id IS NOT NULL),
a AS (SELECT *, sum(w) OVER o AS done, sum(CASE WHEN w = 1 THEN elapsed_s ELSE 0 END) OVER o AS spent, sum(w * c) OVER o AS dc, sum(w) OVER p - sum(w) OVER o AS ln, sum(c) OVER p - sum(c) OVER o AS lc FROM r
  WINDOW o AS (PARTITION BY run_id ORDER BY span_lo, result_id ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY run_id))
SELECT result_id, round(CASE WHEN ln = 0 THEN 0.0 ELSE CASE WHEN done > 0 THEN spent / (done * {P.OVERHEAD_SECONDS} + dc * {P.SECONDS_PER_CHAR}) ELSE 1.0 END * (ln * {P.OVERHEAD_SECONDS} + lc * {P.SECONDS_PER_CHAR}) END, 4) AS remaining_s FROM a""")



def s_duration(s: str) -> str:
    n = lambda x: f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"
    h, m = f"CAST(CAST(floor({s} / 3600) AS BIGINT) AS VARCHAR)", f"CAST(floor(({s} / 60) % 60) AS BIGINT)"
    return f"CASE WHEN {s} < 1 THEN 'instant' WHEN {s} < 90 THEN {n(s)} || 's' WHEN {s} / 60 < 90 THEN {n(f'{s} / 60')} || ' min' WHEN {m} > 0 THEN {h} || 'h ' || lpad(CAST({m} AS VARCHAR), 2, '0') || 'm' ELSE {h} || 'h' END"


S_ETA = f"(CAST({P.OVERHEAD_SECONDS} AS DOUBLE) * (t - c) + CAST({P.SECONDS_PER_CHAR} AS DOUBLE) * (t * 100))"
add("run_summaries", lambda s, d: runs(s, d).select("run_id", T.run_summary(F.col("segments_total"), F.col("segments_translated"), F.lit(1), F.col("segments_total") * 100).alias("line")),
    f"SELECT run_id, CASE WHEN t = 0 THEN 'nothing to translate' WHEN t = c THEN t || ' segments, all cached, this will be instant' WHEN c > 0 THEN t || ' segments, ' || c || ' already cached, ' || (t - c) || ' to translate, ~' || {s_duration(S_ETA)} ELSE t || ' segments, ~' || {s_duration(S_ETA)} END AS line FROM (SELECT run_id, segments_total AS t, segments_translated AS c FROM {RUNS_ONCE})")
add("unmatched_results", lambda s, d: flags(s, d).join(table(s, d, "runs").select("run_id").distinct(), "run_id", "left_anti").select("result_id"), f"SELECT result_id FROM {ONCE} WHERE run_id IS NULL OR run_id NOT IN (SELECT run_id FROM runs WHERE run_id IS NOT NULL)")
add("roots_first", lambda s, d: graph.roots_first(table(s, d, "documents").where("fmt = 'tex'").select("doc_id", "project", "path", "text"), "project").select("doc_id", "ordinal"),
    "SELECT doc_id, row_number() OVER (PARTITION BY project ORDER BY coalesce(regexp_matches(regexp_replace(text, '(^|[^\\\\])%[^\\n]*', '\\1', 'g'), '\\\\begin\\s*\\{document\\}'), false) DESC, path) AS ordinal FROM documents WHERE fmt = 'tex'")

FLAGSHIP: Query = QUERIES["mined_terms"]
