"""A project's files from folder to folder: read, plan, round trip, documents, reports, assets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import planned
from ..operators.spans import even_sample, subset
from ..session import cut
from ..sources import files
from .translate import REGIONS, finish, hops_in_jvm, masked_segments, rendered


@dataclass
class Outcome:
    """What a run of a project left: results of all segments, warnings of the plan, relative paths of the assets copied."""

    results: DataFrame
    warnings: DataFrame
    assets: list[str] = field(default_factory=list)
    interrupted: bool = False


def reports(docs: DataFrame, results: DataFrame, pivots: list[str], model: str, persona: str, interrupted: bool) -> DataFrame:
    """(relative, text) of a report for each document: its counts and its segments in order, as JSON. Documents without segments have one too."""
    segment = F.struct(F.array("start", "end").alias("span"), "original", "final", "hops", "attempts", "translated", "reason", "rules_applied", "issues")
    by = results.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if("translated").alias("t"), F.count_if(F.col("translated") & (F.size("issues") > 0)).alias("i"), F.sort_array(F.collect_list(segment)).alias("s")
    )
    j = docs.select("doc_id", "fmt").join(by, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    report = F.struct(
        F.col("doc_id").alias("path"), F.col("fmt").alias("format"), F.array(*map(F.lit, pivots)).alias("pivot"), F.lit(persona).alias("persona"), F.lit(model).alias("model"),
        zero(F.col("n")).alias("segments_total"), zero(F.col("t")).alias("segments_translated"), zero(F.col("n") - F.col("t")).alias("segments_fallback"), zero(F.col("i")).alias("segments_with_issues"),
        F.lit(interrupted).alias("interrupted"), F.coalesce("s", F.array().cast(by.schema["s"].dataType)).alias("segments"),
    )
    return j.select(F.concat("doc_id", F.lit(".report.json")).alias("relative"), files.report_json(report).alias("text"))


def translate_folder(
    spark: SparkSession, folder: str, out: str, pivots: list[str], call: Callable[[Column], Column] = T.rotate_words, persona: files.Persona | None = None, terms: list[str] | None = None, model: str = "mock",
    follow: bool = True, whole_fragments: bool = False, copy_assets: bool = True, wrap: bool = True, limit: int = 0, sample: int = 0, ordinals: list[int] | None = None, regions: str | None = REGIONS,
    rounds: int = 1, should_stop: Callable[[], bool] = lambda: False, on_round: Callable[[DataFrame], None] = lambda results: None,
) -> Outcome:
    """Documents, reports and assets of a project below ``out``, a folder that driver and executors share; never in place.

    ``limit``, ``sample``, ``ordinals`` narrow each document to some of its segments; the others stay as they are. Files are worked on in
    ``rounds`` of about equal numbers; before each ``should_stop`` is asked, after it ``on_round`` gets its results. A run that was
    stopped writes what it has, says so in the reports, and copies no assets."""
    persona = persona or files.Persona()
    read = cut(files.read_documents(spark, folder))
    plan, warnings = planned(read.select(F.col("relative").alias("path"), "text"), follow, whole_fragments)
    docs = cut(plan.join(read.select(F.col("relative").alias("path"), "fmt"), "path").select(F.col("path").alias("doc_id"), "text", "path", "fragment", "fmt"))
    done: DataFrame | None = None
    stopped = False
    for k in range(rounds):
        stopped = should_stop()
        if stopped:
            break
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)
        segments = masked_segments(part, terms, drop_disabled=regions)
        if ordinals is not None:
            segments = subset(segments, ordinals)
        elif limit or sample:
            segments = even_sample(segments, "doc_id", ["seg_id"], sample, limit)
        results = cut(finish(hops_in_jvm(segments, pivots, call), wrap=wrap, **persona.rules()))
        files.write_documents(rendered(part, results).select(F.col("doc_id").alias("relative"), "text"), out)
        files.write_documents(reports(part, results, pivots, model, persona.name, False), out)
        on_round(results)
        done = results if done is None else done.unionByName(results)
    if done is None:
        done = finish(hops_in_jvm(masked_segments(docs.limit(0)), pivots, call))
    if stopped:
        seen = done.select("doc_id").distinct()
        files.write_documents(reports(docs.join(seen, "doc_id", "left_semi"), done, pivots, model, persona.name, True), out)
    several = docs.count() > 1
    copied = files.copied_assets(spark, folder, out, docs.select(F.col("doc_id").alias("relative"))) if copy_assets and several and not stopped else []
    return Outcome(done, warnings, copied, stopped)
