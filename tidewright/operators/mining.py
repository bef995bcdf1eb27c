"""Which coined terms a round trip loses, from (original, final) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .report import once


def measure(pairs: DataFrame, original: str = "original", final: str = "final", key: str | None = None) -> DataFrame:
    """(term, seen, survived, survival) of every candidate term: in how many pairs the original has it, and the final too.

    Pairs with a null side are left out. Terms are counted once a pair; both counters add up before the shuffle. ``key``: of
    pairs with the same key one counts; they meet as short lists of terms, not as texts."""
    p = pairs.where(F.col(original).isNotNull() & F.col(final).isNotNull())
    out = F.lower(final)
    found = T.let(F.struct(T.candidate_terms(F.col(original)).alias("t"), out.alias("o")), lambda z: F.transform(z["t"], lambda x: F.struct(x.alias("term"), F.contains(z["o"], F.lower(x)).alias("kept"))))
    t = p.select(*([key] if key else []), found.alias("_f"))
    t = (once(t, key) if key else t).select(F.inline("_f"))
    g = t.groupBy("term").agg(F.count("*").alias("seen"), F.count_if("kept").alias("survived"))
    return g.withColumn("survival", T.survival(F.col("seen"), F.col("survived")))


def mine(pairs: DataFrame, least: int = P.MIN_OCCURRENCES, most: float = P.MAX_SURVIVAL, **columns) -> DataFrame:
    """Terms seen often enough that mostly don't survive, worst first; ties by term."""
    return measure(pairs, **columns).where((F.col("seen") >= least) & (F.col("survival") <= most)).orderBy("survival", F.desc("seen"), "term")


def glossary_line(term: Column, seen: Column, survived: Column) -> Column:
    return F.format_string("%s    # survived %d/%d", term, survived, seen)


def glossary_header(source: str, least: int = P.MIN_OCCURRENCES, most: float = P.MAX_SURVIVAL) -> str:
    return f"# Terms this round trip could not carry, mined from {source}.\n#\n# Each was seen at least {least} times and survived at most {100 * most:.0f}% of them.\n"


def glossary(mined: DataFrame, source: str, least: int = P.MIN_OCCURRENCES, most: float = P.MAX_SURVIVAL) -> DataFrame:
    """(ordinal, line) of a glossary of mined terms: what it is, then a line for each term, worst first."""
    order = Window.orderBy("survival", F.desc("seen"), "term")  # mined terms are few: they have passed both thresholds
    lines = mined.select(F.row_number().over(order).alias("ordinal"), glossary_line(F.col("term"), F.col("seen"), F.col("survived")).alias("line"))
    head = mined.sparkSession.createDataFrame([(0, glossary_header(source, least, most))], "ordinal int, line string")
    return head.unionByName(lines)


def write_glossary(mined: DataFrame, source: str, path: str, **thresholds) -> None:
    """The glossary as one text file in the folder ``path``; what was there is replaced."""
    glossary(mined, source, **thresholds).coalesce(1).sortWithinPartitions("ordinal").select("line").write.mode("overwrite").text(path)
