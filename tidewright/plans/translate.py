"""The round trip as one plan: documents, segments, masks, hops, checks, repairs, splice, report.

The transformation of a hop is a parameter: a column function that stays in the JVM, or a
function of a DataFrame (a model's client in ``mapInPandas``) that goes through the cache.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import repair
from ..operators.cache import through_cache
from ..operators.masking import mask, rules_for, unmask
from ..operators.spans import splice
from ..session import cut
from ..sources.base import segments
from ..sources.markdown import Span, unprefixed

MECHANICS = "Give only the translation. Copy every placeholder of the form [[n]] as it stands. Keep numbers, names, formatting and capitals. Leave nothing out, add nothing."


def system_prompt(src: Column, dst: Column, guidance: str | None = None) -> Column:
    """Prompt of a hop; a persona's guidance only on the way back to English."""
    base = F.concat(F.lit("Translate this technical text from "), T.language_name(src), F.lit(" into "), T.language_name(dst), F.lit(". " + MECHANICS))
    return F.when(dst == "en", F.concat(base, F.lit(f" Style, below these rules: {guidance}"))).otherwise(base) if guidance else base


MASKED = "array<struct<key: string, frag: string>>", "array<struct<open: string, close: string>>"


def masked_segments(docs: DataFrame, terms: list[str] | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Segments of the documents (id_col, text, path, fragment) with body (no container prefix), masked text, mapping and label groups.

    ``terms``: a glossary to hide as well. Documents are parsed and their segments masked in one Arrow pass."""
    glossary = list(terms or [])

    def hidden(fmt: str, segment: Span, text: str, rules: dict) -> tuple:
        if fmt not in rules:
            rules[fmt] = rules_for(fmt, glossary)
        body = unprefixed(text, segment.indent)
        masked, mapping, groups = mask(body, rules[fmt])
        return body, masked, [{"key": k, "frag": v} for k, v in mapping], [{"open": x, "close": y} for x, y in groups]

    more = [("body", "string"), ("masked", "string"), ("mapping", MASKED[0]), ("groups", MASKED[1])]
    return segments(docs, id_col=id_col, with_format=True, extra=(more, hidden), **options)


def _hop(call: Callable[[Column], Column], src: str, dst: str):
    def step(a: Column) -> Column:
        def judged(out: Column) -> Column:
            checks = T.verdict(F.col("masked"), out, same_language=dst == "en")
            why = lambda v: F.when(T.passed(v), "").otherwise(F.concat(F.lit(f"{src}->{dst}: "), T.summary(v)))
            return F.struct(out.alias("cur"), F.array_append(a["hops"], out).alias("hops"), T.let(checks, why).alias("reason"))

        return F.when(a["reason"] == "", T.let(call(a["cur"]), judged)).otherwise(a)

    return step


def hops_in_jvm(masked: DataFrame, pivots: list[str], call: Callable[[Column], Column]) -> DataFrame:
    """``masked`` with hops, reason, attempts: the chain of hops as one expression; a failing check ends a chain, and one of
    too few words never begins.

    Each hop's text is bound once, so neither it nor its checks are computed again by what follows."""
    langs = ["en", *pivots, "en"]
    why = F.when(T.long_enough(F.col("masked")), "").otherwise(TOO_SHORT)
    acc = F.struct(F.col("masked").alias("cur"), F.array().cast("array<string>").alias("hops"), why.alias("reason"))
    for src, dst in zip(langs, langs[1:]):
        acc = T.let(acc, _hop(call, src, dst))
    return masked.withColumn("_h", acc).select("*", F.col("_h.cur").alias("_cur"), F.col("_h.hops").alias("hops"), F.col("_h.reason").alias("reason"), F.lit(1).alias("attempts")).drop("_h")


def hops_through_cache(masked: DataFrame, pivots: list[str], call: Callable[[DataFrame], DataFrame], cache: DataFrame, model: str, attempts: int = 2, guidance: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``hops_in_jvm`` with an external call, which gets (text, system, src, dst, temperature) and gives ``out``.

    The first attempt is greedy and goes through the cache; what fails a check is called again at 0.3, uncached. Every
    hop's results are cut from their lineage, so a call is made once. Returns the results and the new cache entries."""
    if attempts < 1:
        raise ValueError("at least one attempt is needed")
    langs = ["en", *pivots, "en"]
    short = masked.where(~T.long_enough(F.col("masked"))).select("*", F.array().cast("array<string>").alias("hops"), F.lit(TOO_SHORT).alias("reason"), F.col("masked").alias("_cur"), F.lit(1).alias("attempts"))
    todo, done, entries = masked.where(T.long_enough(F.col("masked"))), None, cache.limit(0).select("key", "value")
    for attempt in range(1, attempts + 1):
        temperature = 0.0 if attempt == 1 else 0.3
        d = todo.withColumn("hops", F.array().cast("array<string>")).withColumn("reason", F.lit("")).withColumn("_cur", F.col("masked"))
        for src, dst in zip(langs, langs[1:]):
            live = F.col("reason") == ""
            prompt = system_prompt(F.lit(src), F.lit(dst), guidance)
            key = F.when(live, T.cache_key(F.lit(model), F.lit(src), F.lit(dst), prompt, F.lit(str(temperature)), F.col("_cur")))
            store = cache.unionByName(entries) if attempt == 1 else cache.limit(0)
            ask = lambda r, src=src, dst=dst, prompt=prompt: call(r.withColumn("text", F.col("_cur")).withColumn("system", prompt).withColumn("src", F.lit(src)).withColumn("dst", F.lit(dst)).withColumn("temperature", F.lit(temperature))).withColumnRenamed("out", "_out")
            d, fresh = through_cache(d, key, store, ask, "_out")
            if attempt == 1:
                entries = entries.unionByName(fresh)
            checks = T.verdict(F.col("masked"), F.col("_out"), same_language=dst == "en")
            why = F.when(live & ~T.passed(checks), F.concat(F.lit(f"{src}->{dst}: "), T.summary(checks)))
            d = d.withColumn("_why", why).withColumn("hops", F.when(live, F.array_append("hops", F.col("_out"))).otherwise(F.col("hops")))
            d = cut(d.withColumn("_cur", F.when(live, F.col("_out")).otherwise(F.col("_cur"))).withColumn("reason", F.coalesce("_why", "reason")).drop("_out", "_why"))
        d = d.withColumn("attempts", F.lit(attempt))
        ok = d.where("reason = ''") if attempt < attempts else d
        done = ok if done is None else done.unionByName(ok)
        todo = d.where("reason <> ''").select(*masked.columns)
    return done.unionByName(short.select(*done.columns)), entries


def finish(hopped: DataFrame, forbid: list[tuple[str, str]] | None = None, openers: list[str] | None = None, wrap: bool = True, id_col: str = "doc_id") -> DataFrame:
    """Results of hopped segments: repairs in their order, fragments back in place, issues; a row with a reason keeps its text."""
    done = F.col("reason") == ""
    fixed = repair.repaired(*map(F.col, ("body", "masked", "_cur", "mapping", "groups", "heading", "indent")), forbid, openers, wrap)
    r = hopped.withColumn("_r", F.when(done, fixed))
    none = F.array().cast("array<struct<kind:string,detail:string,severity:string>>")
    return r.select(
        id_col, "seg_id", "start", "end", F.col("text").alias("original"), F.when(done, unmask(F.col("_r.text"), F.col("mapping"))).otherwise(F.col("text")).alias("final"), "hops", "attempts",
        done.alias("translated"), "reason", F.coalesce("_r.fixed", F.array().cast("array<string>")).alias("rules_applied"),
        F.when(done, T.compare(F.col("masked"), F.col("_r.text"))).otherwise(none).alias("issues"),
    )


TOO_SHORT = f"under {T.P.MIN_WORDS} words, nothing to round-trip"


#: Word of the comments that switch regions off and on.
REGIONS = "tidewright"


def round_trip(docs: DataFrame, pivots: list[str], call: Callable[[Column], Column] = T.rotate_words, terms: list[str] | None = None, id_col: str = "doc_id", regions: str | None = REGIONS, **rules) -> DataFrame:
    """Results of all segments outside the regions switched off; one too short to translate keeps its text and says why.

    One branch: every document is parsed once."""
    return finish(hops_in_jvm(masked_segments(docs, terms, id_col, drop_disabled=regions), pivots, call), id_col=id_col, **rules)


def rendered(docs: DataFrame, results: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) of every document with its results in place."""
    return splice(docs, results.select(id_col, "start", "end", F.col("final").alias("new")), id_col)


def pending(masked: DataFrame, pivots: list[str], cache: DataFrame, model: str) -> DataFrame:
    """(doc_id, cached, total, uncached_chars): how much of the work the cache already holds, walking each chain to its first miss."""
    langs = ["en", *pivots, "en"]
    c = cache.groupBy("key").agg(F.max("value").alias("_hit"))
    d = masked.where(T.long_enough(F.col("masked"))).withColumn("_cur", F.col("masked"))
    for src, dst in zip(langs, langs[1:]):
        key = T.cache_key(F.lit(model), F.lit(src), F.lit(dst), system_prompt(F.lit(src), F.lit(dst)), F.lit("0.0"), F.col("_cur"))
        d = d.withColumn("key", key).join(c, "key", "left").drop("key", "_cur").withColumnRenamed("_hit", "_cur")
    return d.groupBy("doc_id").agg(F.count("_cur").alias("cached"), F.count("*").alias("total"), F.coalesce(F.sum(F.when(F.col("_cur").isNull(), F.length("masked"))), F.lit(0)).alias("uncached_chars"))
