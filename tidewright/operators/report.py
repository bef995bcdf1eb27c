"""Reports over finished runs: totals, ranking, overlap, structure, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..session import cut


def latest(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, the one loaded last; a null time is the earliest. Rows with a null key stay."""
    cols = [c for c in rows.columns if c != key]
    g = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.coalesce("loaded_at", F.lit("1900-01-01").cast("timestamp"))).alias("_r"))
    return g.select(key, "_r.*").select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, of redelivered rows that are equal but for the time of loading. Rows with a null key stay.

    Project to what is needed first: only those columns are shuffled."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull()))


def flags(results: DataFrame) -> DataFrame:
    """What the reports need of each result, once a result and without its texts: they are read and compared where they lie."""
    narrow = results.select(
        "result_id", "run_id", "doc_id", "project", "span_lo", "span_hi", "elapsed_s", "translated", "reason",
        (F.col("final") != F.col("original")).alias("changed"), high(F.col("issues")).alias("high"), n_issues(F.col("issues")).alias("total"), F.length("original").alias("chars"),
    )
    return once(narrow, "result_id")


def high(issues: Column) -> Column:
    return F.size(F.filter(F.coalesce(issues, F.array().cast("array<struct<kind:string,detail:string,severity:string>>")), lambda i: i.severity == "high"))


def n_issues(issues: Column) -> Column:
    return F.greatest(F.size(issues), F.lit(0))


def totals(flagged: DataFrame, by: list[str]) -> DataFrame:
    """Segments, translated ones, fallbacks, flagged ones and changed ones of each group of ``flags``."""
    return flagged.groupBy(*by).agg(
        F.count("*").alias("segments"), F.count_if("translated").alias("translated"), F.count_if(~F.col("translated")).alias("fallback"),
        F.count_if(F.col("translated") & (F.col("total") > 0)).alias("flagged"), F.count_if("changed").alias("changed"),
    )


def worst_first(flagged: DataFrame, limit: int | None = 10) -> DataFrame:
    """Flagged results, those with most grave issues first, then most issues, then by document and place; the first ``limit`` or all.

    With a limit the plan keeps only the top rows of each partition."""
    f = flagged.where("total > 0").select("result_id", "doc_id", "span_lo", "high", "total")
    o = f.orderBy(F.desc("high"), F.desc("total"), "doc_id", "span_lo", "result_id")
    return o if limit is None else o.limit(limit)


def overlaps(results: DataFrame) -> DataFrame:
    """(result_id, similarity): content-word overlap of originals and finals of changed translations, once a result."""
    r = results.where("translated and final <> original")
    return once(r.select("result_id", T.jaccard(T.content_words(F.col("original")), T.content_words(F.col("final"))).alias("similarity")), "result_id")


def overlap_statistics(sims: DataFrame) -> DataFrame:
    """One row: number, mean, upper median and least of the similarities; null without any.

    Similarities are first counted by value. The median is the value at place n div 2 of the order: the counts of values in
    BINS equal stretches say in which it lies, and only the values of that stretch are put in order."""
    c = sims.groupBy("similarity").agg(F.count("*").alias("n")).withColumn("_bin", F.floor(F.col("similarity") * BINS))
    bins = c.groupBy("_bin").agg(F.sum("n").alias("_m"), F.sum(F.col("similarity") * F.col("n")).alias("_s"), F.min("similarity").alias("_least"))
    all_ = Window.partitionBy()  # of at most BINS + 1 rows
    half = F.floor(F.sum("_m").over(all_) / 2)
    run = bins.withColumn("_to", F.sum("_m").over(all_.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_skip", half - F.col("_to") + F.col("_m"))
    # the stretch in which the median lies, and how many similarities of it come before the median
    at = run.where((F.col("_skip") >= 0) & (F.col("_skip") < F.col("_m"))).select("_bin", "_skip")
    inside = c.join(F.broadcast(at), "_bin").withColumn("_upto", F.sum("n").over(Window.partitionBy("_bin").orderBy("similarity").rowsBetween(Window.unboundedPreceding, 0)))
    median = inside.where("_upto > _skip").agg(F.min("similarity"))
    return bins.agg(F.sum("_m").alias("changed"), (F.sum("_s") / F.sum("_m")).alias("mean"), F.min("_least").alias("least")).select("changed", "mean", median.scalar().alias("median"), "least")


#: Stretches of the similarities from 0 to 1 in which the median is looked for.
BINS = 10_000
BUCKETS = [(0.9, 1.01, "0.90+"), (0.8, 0.9, "0.80-0.90"), (0.7, 0.8, "0.70-0.80"), (0.6, 0.7, "0.60-0.70"), (0.0, 0.6, "below 0.60")]


def histogram(sims: DataFrame) -> DataFrame:
    """(bucket, n) of the five ranges of overlap, empty ones too: one pass of conditional counts."""
    one = sims.agg(*[F.count_if((F.col("similarity") >= lo) & (F.col("similarity") < hi)).alias(f"_{i}") for i, (lo, hi, _) in enumerate(BUCKETS)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("bucket"), F.col(f"_{i}").alias("n")) for i, (*_, name) in enumerate(BUCKETS)])))


def reasons(flagged: DataFrame, k: int = 8) -> DataFrame:
    """(reason, n) of the most frequent causes of fallbacks: what follows the last colon, 60 characters; ties by reason."""
    r = flagged.where("not translated").select(F.substring(T.strip_space(F.element_at(F.split(F.coalesce("reason", F.lit("")), ":", -1), -1)), 1, 60).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


STRUCTURE = {
    "macros": (lambda t: F.regexp_extract_all(t, F.lit(P.MACRO), F.lit(0)), True),
    "environments": (lambda t: F.regexp_extract_all(t, F.lit(P.ENVIRONMENT), F.lit(1)), True),
    "escapes": (lambda t: F.regexp_extract_all(t, F.lit(P.ESCAPE), F.lit(0)), True),
    "math spans": (lambda t: F.regexp_extract_all(t, F.lit(P.MATH), F.lit(0)), True),
    "reference keys": (lambda t: F.transform(F.regexp_extract_all(t, F.lit(P.KEYED), F.lit(0)), lambda x: F.concat_ws("|", F.regexp_extract(x, P.KEYED, 1), F.regexp_extract(x, P.KEYED, 2))), False),
    "numbers": (T.numbers, False),
    "identifiers": (T.identifiers, False),
}


def compared_files(originals: DataFrame, others: DataFrame, key: str = "relative", text: str = "text") -> DataFrame:
    """(key, check, fatal, lost, gained) of every difference in structure between files of the same key; a file that has no
    counterpart is a fatal difference of the check "missing", lost or gained by 1. A null text counts as missing."""
    a = originals.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_a"))
    b = others.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_b"))
    both = a.join(b, key, "full")
    alone = both.where("_a is null or _b is null").select(key, F.lit("missing").alias("check"), F.lit(True).alias("fatal"), F.col("_b").isNull().cast("int").alias("lost"), F.col("_a").isNull().cast("int").alias("gained"))
    return structure(both, key, "_a", "_b").unionByName(alone)


def structure(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, check, fatal, lost, gained) of every structural check in which two texts differ.

    Each check compares two multisets inside the row: no token is shuffled. Rows with a null side are left out."""
    count = lambda d, sign: F.aggregate(d, F.lit(0), lambda acc, r: acc + F.greatest(sign * r["n"], F.lit(0)))
    row = lambda n, fatal: lambda d: F.struct(F.lit(n).alias("check"), F.lit(fatal).alias("fatal"), count(d, 1).alias("lost"), count(d, -1).alias("gained"))
    made = [T.let(T.multiset_delta(F.sort_array(f(F.col(a))), F.sort_array(f(F.col(b)))), row(n, fatal)) for n, (f, fatal) in STRUCTURE.items()]
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, F.filter(F.array(*made), lambda x: (x["lost"] > 0) | (x["gained"] > 0)).alias("_d"))
    # rows without differences go along as empty lists: a filter on the list would compute it twice
    return once(rows, key).select(key, F.inline("_d"))


def scores(flagged: DataFrame) -> DataFrame:
    """One row: grave issues over changed segments as a score (it may be negative), and the share not kept in the original language.

    Grave issues count in every flagged segment; both denominators are at least 1."""
    r = flagged.agg(
        F.count("*").alias("segments"), F.count_if(~F.col("translated")).alias("fallback"), F.count_if(F.col("translated") & F.col("changed")).alias("changed"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("severe"),
    )
    meaning = 100.0 * (1 - F.col("severe") / F.greatest(F.col("changed"), F.lit(1)))
    completion = 100.0 * (F.col("segments") - F.col("fallback")) / F.greatest(F.col("segments"), F.lit(1))
    return r.select("segments", "fallback", "changed", "severe", meaning.alias("meaning"), completion.alias("completion"))


def coverage(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, prose, chars, percent) of every document, and of all as the row with a null id. Overlapping spans count each."""
    s = spans.groupBy(id_col).agg(F.sum(F.col("end") - F.col("start")).alias("prose"))
    d = docs.select(id_col, "n_chars").join(s, id_col, "left").na.fill(0, ["prose"])
    g = d.where(F.col(id_col).isNotNull()).rollup(id_col).agg(F.sum("prose").alias("prose"), F.sum("n_chars").alias("chars"))
    return g.withColumn("percent", 100.0 * F.col("prose") / F.greatest("chars", F.lit(1)))


def longest_changed(flagged: DataFrame, limit: int = 25) -> DataFrame:
    """The changed results with the longest originals, for a judge to read; ties by id."""
    return flagged.where("translated and changed").select("result_id", "chars").orderBy(F.desc("chars"), "result_id").limit(limit)


def verdict_word(reply: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(reply, r"(?i)\b(SAME|WEAKER|CHANGED)\b", 1)), F.lit("")), F.lit("UNCLEAR"))


def judged(pairs: DataFrame, ask, limit: int = 25, key: str = "result_id") -> tuple[DataFrame, DataFrame]:
    """((key, verdict), (verdict, n)): what a judge says of the changed pairs (key, original, final) with the longest originals, and
    how often each verdict was given, those of no known word as UNCLEAR; a verdict never given has 0.

    ``ask`` gets the chosen pairs and gives them with a column ``reply``; it is asked once and its replies are kept. Ties by key."""
    chosen = pairs.where("final <> original").orderBy(F.desc(F.length("original")), key).limit(limit)
    said = cut(ask(chosen).select(key, verdict_word(F.col("reply")).alias("verdict")))
    counts = said.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return said, counts.select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in VERDICTS])))


# What a judge may say.
VERDICTS = ("SAME", "WEAKER", "CHANGED", "UNCLEAR")


def running_eta(results: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Each result with the seconds that its group's rest will take at the pace so far.

    A result of under a second came from a cache and tells nothing of the pace. ``results`` has ``elapsed_s`` and ``chars``."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(group)
    work = F.coalesce(F.col("elapsed_s") >= P.CACHED_BELOW_SECONDS, F.lit(False))
    r = results.withColumn("_w", work.cast("int"))
    done, spent, chars = F.sum("_w").over(w), F.sum(F.when(F.col("_w") == 1, F.col("elapsed_s")).otherwise(0.0)).over(w), F.sum(F.when(F.col("_w") == 1, F.col("chars")).otherwise(0)).over(w)
    left_n = F.sum("_w").over(all_) - done
    left_c = F.sum("chars").over(all_) - F.sum("chars").over(w)
    factor = F.when(done > 0, spent / T.predict(chars, done)).otherwise(1.0)
    return r.withColumn("remaining_s", F.when(left_n == 0, 0.0).otherwise(factor * T.predict(left_c, left_n))).drop("_w")
