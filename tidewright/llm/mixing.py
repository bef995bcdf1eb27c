"""Mixing of sources to target shares of tokens.

Weighted sampling without replacement by exponential keys (Efraimidis and Spirakis):
key = -ln(u) / quality, smallest first. Every source gets whole epochs first; the
rest of its budget is filled in the order of the keys up to a prefix sum of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import TOKENIZER_DIR, count_corpus

#: Documents of a source that one task orders; a source of any size is spread over as many buckets as that takes.
BUCKET_ROWS = 50_000
#: The greatest density of the logarithm of an exponential variable, 1/e.
DENSEST = 0.368
#: The least weight of a document.
LEAST_QUALITY = 0.01
#: Rows of targets up to which they are broadcast; a longer table is joined by shuffling.
FEW_TARGETS = 10_000


def few(wanted: DataFrame):
    """What marks a table with a row for each of the targets for a broadcast, if those are few: they are counted first."""
    return F.broadcast if wanted.limit(FEW_TARGETS + 1).count() <= FEW_TARGETS else lambda df: df


def targets(mix: DataFrame) -> DataFrame:
    """Recipes as they are used: rows with a null recipe, source or share, a share that is not
    positive or no repeat left out, repeated (recipe, source) rows once (the largest share)."""
    ok = mix.where("recipe is not null and source is not null and target_share > 0")
    return ok.groupBy("recipe", "source", "tokenizer").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))


def plan(sizes: DataFrame, mix: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per recipe and source: tokens at hand, budget, whole epochs, rest.

    The set of a recipe is the largest in which every source that has tokens keeps its
    share: size = min(max_repeats * tokens / share), or ``total_tokens`` if that is less. A source
    without tokens supplies 0, the other shares keep their proportions.
    """
    w = Window.partitionBy("recipe")
    have = mix.join(sizes, ["source", "tokenizer"], "left").na.fill(0, ["have_tokens", "have_docs"])
    live = F.col("have_tokens") > 0
    size = F.min(F.when(live, F.col("max_repeats") * F.col("have_tokens") / F.col("target_share"))).over(w)
    if total_tokens is not None:
        # shares of sources without tokens fall to the others
        size = F.least(size, F.lit(float(total_tokens)) / F.sum(F.when(live, F.col("target_share"))).over(w))
    return (
        have.withColumn("budget", F.when(live, F.least(F.col("target_share") * size, (F.col("max_repeats") * F.col("have_tokens")).cast("double"))).otherwise(0.0))
        .withColumn("epochs", F.when(live, F.floor(F.col("budget") / F.col("have_tokens") + 1e-9)).otherwise(0).cast("bigint"))
        .withColumn("rest", F.when(live, F.greatest(F.col("budget") - F.col("epochs") * F.col("have_tokens"), F.lit(0.0))).otherwise(0.0))
        .withColumn("buckets", F.greatest(F.ceil(F.col("have_docs") * DENSEST / BUCKET_ROWS), F.lit(1)))
    )


def sizes(docs: DataFrame) -> DataFrame:
    return docs.where("n_tokens > 0").groupBy("source", "tokenizer").agg(F.sum("n_tokens").alias("have_tokens"), F.count("*").alias("have_docs"))


def _keyed(docs: DataFrame, p: DataFrame, seed: int) -> DataFrame:
    """Documents of every recipe with their exponential keys and the buckets of those.

    A bucket is a stretch of the key's logarithm: quality only shifts that, so no stretch of a given length holds more than
    DENSEST of a source's documents per unit, whatever their qualities are, and a bucket has about BUCKET_ROWS at most."""
    rows = docs.where("n_tokens > 0").select("doc_id", "source", "tokenizer", "n_tokens", "quality", F.monotonically_increasing_id().alias("_i"))
    picked = rows.join(p, ["source", "tokenizer"])
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "recipe", "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = picked.withColumn("_key", -F.log(u) / F.col("quality"))
    return keyed.withColumn("_bucket", F.floor(F.log("_key") * F.col("buckets")))


def mix(docs: DataFrame, mix_targets: DataFrame, seed: int = 0, total_tokens: float | None = None) -> DataFrame:
    """(recipe, source, doc_id, repeats, n_tokens): the documents of every recipe and how often each is used.

    ``docs``: doc_id, source, tokenizer, n_tokens, quality (above 0), already computed. Documents of a null
    source, a source of no recipe, or no token supply nothing. Repeated rows are documents of
    their own. Ties of keys are broken by doc_id. The document in which a budget ends is used
    if that comes closer to the budget. An empty table gives an empty result. ``total_tokens``: size of
    every recipe, if less than the largest possible.

    Only the bucket in which a budget ends is put in order: those before it are taken whole where they lie.
    """
    g = ["recipe", "source", "tokenizer"]
    wanted = targets(mix_targets)
    small = few(wanted)
    p = cut(plan(sizes(docs), wanted, total_tokens).where("budget > 0").select(*g, "epochs", "rest", "buckets"))
    totals = _keyed(docs, small(p.where("rest > 0")), seed).groupBy(*g, "rest", "_bucket").agg(F.sum("n_tokens").alias("_t"))
    w = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    # the first bucket whose end is beyond the budget; one row for each row of the targets
    ends = totals.withColumn("_to", F.sum("_t").over(w)).where("_to > rest").groupBy(*g).agg(F.min("_bucket").alias("_last"), F.min_by(F.col("_to") - F.col("_t"), "_bucket").alias("_before"))
    # where all of a source is used up, no bucket is the last
    keyed = _keyed(docs, small(p.join(small(ends), g, "left")), seed)
    inside = keyed.where("_bucket = _last").withColumn("_sum", F.col("_before") + F.sum("n_tokens").over(Window.partitionBy(*g, "_bucket").orderBy("_key", "doc_id", "_i").rowsBetween(Window.unboundedPreceding, 0)))
    more = (F.col("_sum") - F.col("n_tokens") / 2 <= F.col("rest")).cast("bigint")
    rest = keyed.where("_last is null or _bucket <> _last").withColumn("_more", F.coalesce(F.col("_bucket") < F.col("_last"), F.col("rest") > 0).cast("bigint"))
    every = rest.unionByName(inside.withColumn("_more", more).drop("_sum"))
    return every.withColumn("repeats", F.col("epochs") + F.col("_more")).where("repeats > 0").select("recipe", "source", "doc_id", "repeats", "n_tokens")


def shares(mixed: DataFrame, docs: DataFrame, mix_targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per row of the targets: the share reached, its tokens, documents, budget and most repeats.
    A source without documents has 0. A recipe that reached nothing has null shares."""
    wanted = targets(mix_targets)
    got = mixed.groupBy("recipe", "source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("docs"), F.max("repeats").alias("most_repeats"))
    all_ = plan(sizes(docs), wanted, total_tokens).join(few(wanted)(got), ["recipe", "source"], "left").na.fill(0, ["tokens", "docs", "most_repeats"])
    w = Window.partitionBy("recipe")
    return all_.select("recipe", "source", "target_share", F.try_divide(F.col("tokens"), F.sum("tokens").over(w)).alias("reached_share"), "tokens", F.round("budget", 3).alias("budget"), "docs", "max_repeats", "most_repeats", "have_tokens", "have_docs")


def counted(documents: DataFrame, mix_targets: DataFrame, folder: str = TOKENIZER_DIR, quality: str | None = None) -> DataFrame:
    """doc_id, source, tokenizer, n_tokens, quality of every document of a source that a recipe names,
    once for each tokenizer named (at most the few that the folder holds), computed once.

    ``quality``: a column of weights; null and what is not above 0 weigh least. Without one it is the share of letters."""
    names = sorted(r[0] for r in mix_targets.where("tokenizer is not null").select("tokenizer").distinct().collect())
    wanted = mix_targets.where("source is not null").select("source", "tokenizer").distinct()
    small = few(wanted)
    out = None
    for n in names:
        d = documents.join(small(wanted.where(F.col("tokenizer") == n).select("source")), "source", "left_semi")
        one = count_corpus(d, "doc_id", "text", n, folder, ["source", *([quality] if quality else [])], with_quality=not quality)
        if quality:
            one = one.withColumn("quality", F.greatest(F.coalesce(F.col(quality).cast("double"), F.lit(LEAST_QUALITY)), F.lit(LEAST_QUALITY))).select("doc_id", "source", "n_tokens", "quality")
        one = one.withColumn("tokenizer", F.lit(n))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = documents.limit(0).selectExpr("doc_id", "source", "0L as n_tokens", "0d as quality", "'' as tokenizer")
    return cut(out)
