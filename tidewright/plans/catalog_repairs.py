"""Queries of the repairs, with the SQL that gives the same result in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import masking, repair
from .catalog import BOTH, OF, SP, add, q, raw, s_all, s_strip, scalar

# ---- words
S_RULES = "[" + ", ".join(f"{{'x': {q(x)}, 'y': {q(y)}}}" for a, b in P.ENDINGS for x, y in ((a, b), (b, a))) + "]"
_TAIL = "(ed|ing|er|ers|est)$"
S_VARIANTS = f"""[v for v in list_concat([left(k, length(k) - length(r.x)) || r.y for r in {S_RULES} if ends_with(k, r.x)],
  CASE WHEN regexp_matches(k, 'll{_TAIL}') THEN [regexp_replace(k, 'll{_TAIL}', 'l\\1')] ELSE [] END, CASE WHEN regexp_matches(k, '(^|[^l])l{_TAIL}') THEN [regexp_replace(k, 'l{_TAIL}', 'll\\1')] ELSE [] END) if v <> k AND list_contains(sk, v)]"""


def s_cased(form: str, like: str) -> str:
    return f"CASE WHEN regexp_matches({like}, '\\p{{Lu}}') AND upper({like}) = {like} AND length({like}) > 1 THEN upper({form}) WHEN regexp_matches(left({like}, 1), '\\p{{Lu}}') THEN upper(left({form}, 1)) || substring({form}, 2) ELSE {form} END"


def s_reworded(text: str, new: str) -> str:
    """A text with each of its words w (k in lower case) as ``new`` says, from the source's words sw and their lower case sk."""
    return f"""(SELECT array_to_string([g[i] || coalesce(n[i], '') for i in range(1, len(g) + 1)], '') FROM (SELECT g, [{new} for w in ws] AS n FROM
  (SELECT regexp_split_to_array({text}, {q(P.WORD)}) AS g, {s_all(text, P.WORD)} AS ws, {s_all("original", P.WORD)} AS sw, [lower(x) for x in {s_all("original", P.WORD)}] AS sk)))"""


_FIRST = "sw[list_position(sk, {0})]"
_LOW = "lower(w)"
_VARIANT = f"({S_VARIANTS.replace('(k,', f'({_LOW},').replace('length(k)', f'length({_LOW})').replace('v <> k', f'v <> {_LOW}')})[1]"
S_SPELLED = f"CASE WHEN list_contains(sk, {_LOW}) OR {_VARIANT} IS NULL THEN w ELSE {s_cased(_FIRST.format(_VARIANT), 'w')} END"
S_AMERICAN = "replace(replace(replace(final, 'our', 'or'), 'ise', 'ize'), 'lled', 'led')"


def _american(f: Column) -> Column:
    """The finals with other spellings, so that there is something to restore."""
    for a, b in (("our", "or"), ("ise", "ize"), ("lled", "led")):
        f = F.replace(f, F.lit(a), F.lit(b))
    return f


scalar("restored_spelling", "segment_results", "result_id", lambda o, f: repair.restored_spelling(o, _american(f))["text"], OF, s_reworded(S_AMERICAN, S_SPELLED), BOTH)
scalar("restored_capitals", "segment_results", "result_id", lambda o, f: repair.restored_capitals(o, F.lower(f))["text"], OF, s_reworded("lower(final)", f"coalesce({_FIRST.format(_LOW)}, w)"), BOTH)
scalar("matched_case", "segment_results", "result_id", lambda f: T.match_case(F.lit("colour"), F.regexp_extract(f, P.WORD, 0)), ["final"], s_cased("'colour'", f"regexp_extract(final, {q(P.WORD)})"))
scalar("vocabularies", "segment_results", "result_id", lambda o: F.sort_array(F.transform(F.map_entries(T.vocabulary(o)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ["original"],
       f"(SELECT list_sort([k || '=' || sw[list_position(sk, k)] for k in list_distinct(sk)]) FROM (SELECT {s_all('original', P.WORD)} AS sw, [lower(x) for x in {s_all('original', P.WORD)}] AS sk))", "original IS NOT NULL")

# ---- personas
FORBID, OPENERS = [("not", "hardly"), ("—", ","), ("The margin", "the edge")], ["The ", "At the same time,"]


def _persona_sql() -> str:
    t = "final"
    for bad, good in FORBID:
        t = f"replace({t}, {q(bad)}, {q(good)})"
    for o in OPENERS:
        p = rf"(^|[.!?]\s+){o}\s*"
        new = f"regexp_replace({t}, {q(p)}, '\\1', 'gi')"
        for c in "abcdefghijklmnopqrstuvwxyz":
            new = f"regexp_replace({new}, {q(rf'(^|[.!?]\s+){c}')}, '\\1{c.upper()}', 'g')"
        t = f"(SELECT CASE WHEN regexp_matches(t, {q('(?i)' + p)}) THEN {new.replace(t, 't')} ELSE t END FROM (SELECT {t} AS t))"
    i = P.INLINE
    return f"regexp_replace(regexp_replace({t}, {q(rf'[{i}]{{2,}}')}, ' ', 'g'), {q(rf'[{i}]+([.,;:!?])')}, '\\1', 'g')"


scalar("persona_rules", "segment_results", "result_id", lambda f: repair.persona_rules(f, FORBID, OPENERS)["text"], ["final"], _persona_sql(), "final IS NOT NULL")

# ---- layout around placeholders: hops hold them where the originals hold fragments
FRAGMENT = r"`[^`\n]+`|\$[^$\n]+\$|\[@[^\]\s]+\]"
HOP = "original IS NOT NULL AND hops[1] IS NOT NULL"


def _mapping(o: Column) -> Column:
    return F.transform(F.regexp_extract_all(o, F.lit(FRAGMENT), F.lit(0)), lambda f, i: F.struct(F.concat(F.lit("[["), i.cast("string"), F.lit("]]")).alias("key"), f.alias("frag")))


def _hops(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("result_id", "original", F.try_element_at("hops", F.lit(1)).alias("hop")).where("original is not null and hop is not null")


def _tight(spark: SparkSession, d: str) -> DataFrame:
    """First hops with blanks before all placeholders, put right by the originals."""
    spaced = F.replace(F.replace(F.col("hop"), F.lit("[["), F.lit("  [[")), F.lit("]]"), F.lit("]] "))
    return _hops(spark, d).select("result_id", repair.tightened(F.col("original"), spaced, _mapping(F.col("original"))).alias("v")).dropDuplicates(["result_id"])


S_MARKS = r"\[\[\d+\]\]"
S_FRAGS = f"{s_all('original', FRAGMENT)}"
_BEFORE = f"['[[' || (i - 1) || ']]' for i in range(1, len(f) + 1) if instr(original, f[i]) > 1 AND NOT regexp_matches(substring(original, instr(original, f[i]) - 1, 1), {q(f'[{SP}]')})]"
_BEHIND = "['[[' || (i - 1) || ']]' for i in range(1, len(f) + 1) if regexp_matches(f[i], '[ \\t]$')]"
_LEFT = "CASE WHEN i > 1 AND list_contains(a, m[i - 1]) THEN regexp_replace(g[i], '^[ \\t]+', '') ELSE g[i] END"
add("tightened_spacing", _tight, f"""SELECT DISTINCT result_id, array_to_string([CASE WHEN i <= len(m) AND list_contains(b, m[i]) THEN regexp_replace({_LEFT}, '[ \\t]+$', '') ELSE {_LEFT} END || coalesce(m[i], '') for i in range(1, len(g) + 1)], '') AS v
  FROM (SELECT result_id, g, m, {_BEFORE} AS b, {_BEHIND} AS a FROM (SELECT result_id, original, {S_FRAGS} AS f, regexp_split_to_array(t, '{S_MARKS}') AS g, regexp_extract_all(t, '{S_MARKS}') AS m
    FROM (SELECT result_id, original, replace(replace(hops[1], '[[', '  [['), ']]', ']] ') AS t FROM segment_results WHERE {HOP})))""")  # fmt: skip


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """First hops wrapped as they will look with their fragments back, what lies between the first two placeholders held together."""
    marks = F.regexp_extract_all("hop", F.lit(S_MARKS), F.lit(0))
    first = F.struct(F.try_element_at(marks, F.lit(1)).alias("open"), F.try_element_at(marks, F.lit(2)).alias("close"))
    groups = F.when(F.size(marks) > 1, F.array(first)).otherwise(F.array().cast("array<struct<open:string,close:string>>"))
    m = _mapping(F.col("original"))
    return _hops(spark, d).select("result_id", masking.unmask(repair.wrapped(F.col("hop"), F.lit(40), m, groups), m).alias("v")).dropDuplicates(["result_id"])


_RESTORED = "array_to_string([g[i] || CASE WHEN i <= len(m) THEN coalesce(f[CAST(m[i][3:-3] AS INT) + 1], m[i]) ELSE '' END for i in range(1, len(g) + 1)], '')"
_GLUED = f"""CASE WHEN len(m) > 1 AND instr(substring(t, instr(t, m[1]) + length(m[1])), m[2]) > 0 THEN left(t, instr(t, m[1]) - 1) || regexp_replace(substring(t, instr(t, m[1]), length(m[1]) + instr(substring(t, instr(t, m[1]) + length(m[1])), m[2]) - 1), {q(f'[{SP}]+')}, chr(1), 'g')
  || substring(t, instr(t, m[1]) + length(m[1]) + instr(substring(t, instr(t, m[1]) + length(m[1])), m[2]) - 1) ELSE t END"""
add("fused_wrap", _fused, f"""WITH h AS (SELECT DISTINCT result_id, hops[1] AS t, {S_FRAGS} AS f, regexp_extract_all(hops[1], '{S_MARKS}') AS m FROM segment_results WHERE {HOP}),
k AS (SELECT result_id, f, [replace(x, chr(1), ' ') for x in regexp_split_to_array({_GLUED}, {q(f'[{SP}]+')}) if x <> ''] AS k FROM h),
u AS (SELECT result_id, f, unnest(k) AS tok, unnest(range(len(k))) AS n FROM k), v AS (SELECT result_id, n, f, regexp_split_to_array(tok, '{S_MARKS}') AS g, regexp_extract_all(tok, '{S_MARKS}') AS m FROM u),
r AS (SELECT result_id, list({_RESTORED} ORDER BY n) AS r FROM v GROUP BY result_id)
SELECT result_id, CASE WHEN r IS NULL THEN t ELSE list_reduce(r, lambda a, x: a || CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(x) > 40 THEN chr(10) ELSE ' ' END || x) END AS v FROM h LEFT JOIN r USING (result_id)""")  # fmt: skip
_W = f"[length(x) for x in string_split(original, chr(10)) if {s_strip('x')} <> '']"
_WIDTH = f"CASE WHEN len({_W}) >= 2 AND list_max({_W}) >= 20 AND list_min({_W}[:-2]) >= list_max({_W}) - 24 THEN list_max({_W}) END"
_TOKENS = f"[x for x in regexp_split_to_array(final, {q(f'[{SP}]+')}) if x <> '']"
scalar("matched_wrapping", "segment_results", "result_id", T.match_wrapping, OF,
       f"(SELECT CASE WHEN w IS NULL OR len(k) = 0 THEN final ELSE list_reduce(k, lambda a, t: a || CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(t) > w THEN chr(10) ELSE ' ' END || t) END FROM (SELECT {_WIDTH} AS w, {_TOKENS} AS k))", BOTH)


# ---- one rule of the masks
def _math(spark: SparkSession, d: str) -> DataFrame:
    """Originals with their formulas hidden by the one rule for them."""
    rule = dict(masking.RULES["markdown"])["math"]
    made = masking.masker_of([rule])(F.col("original"))
    return raw(spark, d).where("original is not null").select("result_id", made["text"].alias("v")).dropDuplicates(["result_id"])


_RULE = dict(masking.RULES["markdown"])["math"]
add("masked_formulas", _math, f"""SELECT DISTINCT result_id, array_to_string([g[i] || CASE WHEN i < len(g) THEN '[[' || (i - 1 + b) || ']]' ELSE '' END for i in range(1, len(g) + 1)], '') AS v
  FROM (SELECT result_id, regexp_split_to_array(original, {q(_RULE)}) AS g, coalesce(list_max([CAST(x AS INT) for x in regexp_extract_all(original, '\\[\\[(\\d+)\\]\\]', 1)]) + 1, 0) AS b FROM segment_results WHERE original IS NOT NULL)""")  # fmt: skip
