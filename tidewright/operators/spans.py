"""Interval operators over (document, start, end) rows: complement, islands, containment, splice, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.base import format_of, marker_pattern


def running_starts(sizes: Column) -> Column:
    """For each of an array's sizes the sum of those before it. Sums run over blocks of about the root of their number, so that no
    array is copied once for each element of a long one."""
    zero = F.lit(0).cast("bigint")
    sums = lambda values, first: F.aggregate(values, F.array(first), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    total = lambda values: F.aggregate(values, zero, lambda acc, x: acc + x)

    def blocks(z: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(z))).cast("int")

        def parts(w: Column) -> Column:
            cut = F.transform(F.sequence(F.lit(1), F.size(z), w), lambda i: F.slice(z, i, w))
            return T.let(cut, lambda p: T.let(sums(F.transform(p, total), zero), lambda at: F.flatten(F.transform(p, lambda x, i: F.slice(sums(x, F.element_at(at, i + 1)), F.lit(1), F.size(x))))))

        return F.when(F.size(z) > 0, T.let(F.greatest(width, F.lit(1)), parts)).otherwise(F.array().cast("array<bigint>"))

    return T.let(F.transform(sizes, lambda x: x.cast("bigint")), blocks)


def line_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, line_no, start, line) of every line; lines end at line feeds only. A null text has no line, an empty one a
    single empty line.

    Offsets come from the text's own lines, so there is no shuffle and no window."""
    keep = keep or []
    made = T.let(F.split(text_col, "\n", -1), lambda lines: F.arrays_zip(running_starts(F.transform(lines, lambda x: F.length(x) + 1)).alias("start"), lines.alias("line")))
    return docs.where(F.col(text_col).isNotNull()).select(id_col, *keep, F.posexplode(made).alias("line_no", "x")).select(id_col, *keep, "line_no", "x.start", "x.line")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, para_no, text) of a text's parts between blank lines, trimmed, without blank ones."""
    parts = F.filter(F.transform(F.split(text_col, r"\n[ \t]*\n", -1), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: x != "")
    return docs.select(id_col, F.posexplode(parts).alias("para_no", "text"))


def disabled_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", word: str = "tidewright") -> DataFrame:
    """(id, lo, hi) of regions switched off: the first ``off`` opens, the next ``on`` closes, an open one runs to the end.

    Lines are walked by a fold per document; only documents with a marker are walked."""
    fmt = format_of(F.col(path_col))
    d = docs.select(id_col, F.col(text_col).alias("_t"), fmt.alias("_f")).where(F.col("_f").isNotNull() & F.lower("_t").contains(f"{word.lower()}:"))
    state = F.lower(F.when(F.col("_f") == "latex", F.regexp_extract("line", marker_pattern("latex", word), 1)).otherwise(F.regexp_extract("line", marker_pattern("markdown", word), 1)))
    marks = line_offsets(d.withColumn("_n", F.length("_t")), id_col, "_t", ["_f", "_n"]).withColumn("state", state).where("state <> ''")
    w = Window.partitionBy(id_col).orderBy("start")
    turns = marks.withColumn("_was", F.lag("state", 1, "on").over(w)).where("state <> _was")
    pairs = turns.withColumn("_next", F.lead(F.col("start") + F.length("line")).over(w))
    return pairs.where("state = 'off'").select(id_col, F.col("start").alias("lo"), F.coalesce("_next", "_n").alias("hi"))


def drop_inside(segments: DataFrame, regions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Segments that lie wholly inside no region: an anti join on the document with a range condition."""
    s, r = segments.alias("s"), regions.alias("r")
    return s.join(r, (F.col(f"s.{id_col}") == F.col(f"r.{id_col}")) & (F.col("r.lo") <= F.col("s.start")) & (F.col("s.end") <= F.col("r.hi")), "left_anti")


def merge_islands(spans: DataFrame, joinable: Column, id_col: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, start, end) of islands of spans: one begins where a span neither overlaps what was before nor is joinable with it.

    ``joinable`` may use columns start, end and reach (the end of what was before). ``keep``: further aggregates."""
    w = Window.partitionBy(id_col).orderBy("start", "end")
    reach = spans.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("reach").isNull() | ~((F.col("start") <= F.col("reach")) | joinable), 1).otherwise(0)
    marked = reach.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    more = [c.alias(n) for n, c in (keep or {}).items()]
    return marked.groupBy(id_col, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *more).drop("_island")


def complement(spans: DataFrame, lengths: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end) of what no span covers. ``lengths``: (id, n_chars). A document without spans is one gap, an empty one none."""
    w = Window.partitionBy(id_col).orderBy("start", "end")
    ends = lengths.select(id_col, F.col("n_chars").alias("start"), F.col("n_chars").alias("end"))
    every = spans.select(id_col, F.col("start").cast("bigint"), F.col("end").cast("bigint")).unionByName(ends.select(id_col, F.col("start").cast("bigint"), F.col("end").cast("bigint")))
    gaps = every.withColumn("_from", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return gaps.where("start > _from").select(id_col, F.col("_from").alias("start"), F.col("start").alias("end"))


def unquoted(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", quoted: str = "original") -> DataFrame:
    """Spans (id, start, end, quoted) that do not quote their document; a null quotation is none, an unknown document is quoted by nothing."""
    j = spans.where(F.col(quoted).isNotNull()).join(docs.select(id_col, F.col(text_col).alias("_t")), id_col, "left")
    own = F.substring(F.col("_t"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return j.where(F.col("_t").isNull() | (own != F.col(quoted))).select(id_col, "start", "end")


def violations(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, problem) of spans that overlap the one before or are inverted."""
    w = Window.partitionBy(id_col).orderBy("start", "end")
    problem = F.when(F.col("start") > F.col("end"), "inverted").when(F.col("start") < F.lag("end").over(w), "overlapping")
    return spans.withColumn("problem", problem).where("problem is not null").select(id_col, "start", "end", "problem")


def contained(spans: DataFrame, outer: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans that hold at least one of ``outer``'s spans: a semi join on the document with a range condition."""
    s, o = spans.alias("s"), outer.alias("o")
    return s.join(o, (F.col(f"s.{id_col}") == F.col(f"o.{id_col}")) & (F.col("o.start") >= F.col("s.start")) & (F.col("o.end") <= F.col("s.end")), "left_semi")


def subset(segments: DataFrame, ordinals: list[int] | DataFrame, ordinal_col: str = "seg_id") -> DataFrame:
    """Segments of the given ordinals: a list, or rows (ordinal_col and any keys they share with the segments)."""
    if isinstance(ordinals, DataFrame):
        return segments.join(ordinals, [c for c in ordinals.columns if c in segments.columns], "left_semi")
    return segments.where(F.col(ordinal_col).isin(sorted(set(ordinals))))


def splice(docs: DataFrame, replacements: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of the documents with their spans replaced: (id, start, end, new). A null replacement keeps the original.

    A document's replacements meet its text in one row, as an array sorted by start; each takes what lies before it along. Repeated
    spans count once. Documents without replacements stay; the text crosses the network once, in a join on the document."""
    per = replacements.groupBy(id_col, "start", "end").agg(F.max("new").alias("new")).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "new"))).alias("_r"))
    d = docs.select(id_col, F.col(text_col).alias("_t")).join(per, id_col, "left")
    at = lambda k: F.coalesce(F.try_element_at(F.col("_r"), k)["end"], F.lit(0))

    def piece(r, i):
        # what stands between the span before and this one, then what takes this one's place
        from_ = F.when(i == 0, F.lit(0)).otherwise(at(F.greatest(i, F.lit(1))))
        gap = F.substring(F.col("_t"), (from_ + 1).cast("int"), (r["start"] - from_).cast("int"))
        own = F.substring(F.col("_t"), (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int"))
        return F.concat(gap, F.coalesce(r["new"], own))

    tail = F.substring(F.col("_t"), (at(F.size("_r")) + 1).cast("int"), F.length("_t"))
    return d.select(id_col, F.when(F.col("_r").isNull(), F.col("_t")).otherwise(F.concat(F.array_join(F.transform("_r", piece), ""), tail)).alias("text"))


def even_sample(rows: DataFrame, group: str, order: list[str], sample: int = 0, limit: int = 0) -> DataFrame:
    """Rows of each group at evenly spread places, int(i * n / sample) for i below ``sample``, or else the first ``limit``.

    A group with no more rows than asked for stays whole."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    if sample:
        i = F.ceil(F.col("_k") * sample / F.col("_n"))
        chosen = (F.col("_n") <= sample) | ((i < sample) & (F.floor(i * (F.col("_n") / sample)) == F.col("_k")))
    else:
        chosen = (F.col("_n") <= limit) | (F.col("_k") < limit) if limit else F.lit(True)
    return r.where(chosen).drop("_k", "_n")
