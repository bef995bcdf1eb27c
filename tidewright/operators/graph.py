"""Include graph of a project's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..session import cut


def include_edges(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(src, ordinal, name) of every include of every file; comments are ignored."""
    return files.select(F.col(path).alias("src"), F.posexplode(T.includes(F.col(text))).alias("ordinal", "name"))


def roots_first(files: DataFrame, group: str) -> DataFrame:
    """Files (group, path, text, ...) without their texts, with the ordinal of each in its group: standalone ones first, then by path.

    A group of any size is ordered over all tasks: rows are range-partitioned by group and order, numbered inside their partition, and
    begin where the partitions before them end. Only counts by partition and group come together in one place."""
    order = files.select(*[c for c in files.columns if c != "text"], F.when(F.coalesce(T.is_standalone(F.col("text")), F.lit(False)), 0).otherwise(1).alias("_o"))
    placed = cut(order.repartitionByRange(F.col(group).asc_nulls_first(), "_o", "path").withColumn("_p", F.spark_partition_id()))
    inside = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_p", group).orderBy("_o", "path")))
    sizes = placed.groupBy("_p", group).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_p").alias("_q"), F.col(group).alias("_g"), "_before")
    j = inside.join(before, (F.col("_p") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g")))
    return j.withColumn("ordinal", (F.col("_before") + F.col("_k")).cast("int")).drop("_p", "_k", "_o", "_q", "_g", "_before")


def _folder(path):
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def _normal(path):
    """A path without . and .. parts; null if it leads above its root or is absolute."""
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(acc, x):
        up = x == ".."
        size = F.size(acc["p"])
        kept = F.when((x == "") | (x == "."), acc["p"]).when(up, F.slice(acc["p"], F.lit(1), F.greatest(size - 1, F.lit(0)))).otherwise(F.array_append(acc["p"], x))
        return F.struct(kept.alias("p"), (acc["ok"] & ~(up & (size == 0))).alias("ok"))

    r = F.aggregate(F.split(path, "/", -1), start, step)
    return F.when(r["ok"] & ~path.startswith("/"), F.array_join(r["p"], "/"))


def resolve(edges: DataFrame, files: DataFrame, root_folder: str = "") -> DataFrame:
    """(src, ordinal, name, dst): the file an include names, in the root's folder first, then in its own; null if none.

    Without .tex at its end a name is tried with it first. What leads out of the project is no file."""
    n = F.trim("name")
    names = F.when(n == "", F.array().cast("array<string>")).when(n.endswith(".tex"), F.array(n)).otherwise(F.array(F.concat(n, F.lit(".tex")), n))
    places = F.array(F.lit(root_folder), _folder(F.col("src")))
    tries = F.flatten(F.transform(places, lambda d: F.transform(names, lambda x: F.when(x.startswith("/"), x).otherwise(F.concat(d, x)))))
    c = edges.select("src", "ordinal", "name", F.posexplode_outer(tries).alias("rank", "_c")).withColumn("_c", _normal(F.col("_c")))
    hit = c.join(files.select(F.col("path").alias("_c"), F.lit(True).alias("_hit")).distinct(), "_c", "left")
    return hit.groupBy("src", "ordinal", "name").agg(F.min_by(F.when(F.col("_hit"), F.col("_c")), F.when(F.col("_hit"), F.col("rank"))).alias("dst"))


REACHED = "root string, path string, depth int"
WARNING = "root string, path string, problem string, detail string"


def closure(roots: DataFrame, edges: DataFrame, max_depth: int = P.MAX_INCLUDE_DEPTH, max_files: int = P.MAX_INCLUDE_FILES) -> tuple[DataFrame, DataFrame]:
    """((root, path, depth), warnings): all files that each root reaches, with the least depth; cycles end.

    One round per level over the frontier of all roots at once: new files are what the edges lead to less what is known. Frontier
    and known files are cut from their lineage in the shared folder. A root keeps its first ``max_files`` files by depth and path.
    Warnings (root, path, problem, detail), one a row: an include that no file answers, files deeper than ``max_depth`` (the path is
    the file whose includes were not followed), a root with more files than it keeps."""
    known = cut(roots.where("path is not null").select(F.col("path").alias("root"), "path", F.lit(0).alias("depth")).distinct())
    e = edges.where("dst is not null").select("src", "dst").distinct()
    frontier, depth = known, 0
    deeper = None
    while True:
        step = frontier.join(e, frontier["path"] == e["src"]).select("root", F.col("src"), F.col("dst").alias("path"))
        new = step.join(known.select("root", "path"), ["root", "path"], "left_anti")
        depth += 1
        if depth > max_depth:
            deeper = new.select("root", F.col("src").alias("path"), F.lit("too deep").alias("problem"), F.col("path").alias("detail")).distinct()
            break
        frontier = cut(new.select("root", "path", F.lit(depth).alias("depth")).distinct())
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier))
    w = Window.partitionBy("root").orderBy("depth", "path")
    ranked = known.withColumn("_k", F.row_number().over(w))
    kept = ranked.where(F.col("_k") <= max_files).drop("_k")
    many = ranked.groupBy("root").agg(F.max("_k").alias("_n")).where(F.col("_n") > max_files)
    warnings = kept.join(edges.where("dst is null").select(F.col("src").alias("path"), "name"), "path").select("root", "path", F.lit("missing include").alias("problem"), F.col("name").alias("detail")).distinct()
    warnings = warnings.unionByName(many.select("root", F.col("root").alias("path"), F.lit("too many files").alias("problem"), F.col("_n").cast("string").alias("detail")))
    return kept, warnings.unionByName(deeper) if deeper is not None else warnings


def planned(files: DataFrame, follow: bool = True, whole_fragments: bool = False, max_depth: int = P.MAX_INCLUDE_DEPTH, max_files: int = P.MAX_INCLUDE_FILES) -> tuple[DataFrame, DataFrame]:
    """((path, text, fragment, root, depth), warnings) of the files (path, text) to work on, each once.

    Standalone LaTeX files and files of other formats are roots. Files that a root includes are fragments of the first root, by path,
    that reaches them. A LaTeX file without a document that no root includes is warned of ("bare fragment") and, unless
    ``whole_fragments``, has no prose. Without ``follow`` every file is a root of its own."""
    once = files.where("path is not null").groupBy("path").agg(F.max("text").alias("text"))
    tex = F.lower("path").rlike(r"\.(tex|latex)$")
    alone = ~tex | F.coalesce(T.is_standalone(F.col("text")), F.lit(False))
    marked = once.withColumn("_root", alone)
    reached, warnings = None, None
    if follow:
        edges = cut(resolve(include_edges(once), once))
        reached, warnings = closure(marked.where("_root").select("path"), edges, max_depth, max_files)
        owner = reached.where("depth > 0").groupBy("path").agg(F.min(F.struct("root", "depth")).alias("_o"))
    else:
        owner = marked.limit(0).select("path", F.lit(None).cast("struct<root:string,depth:int>").alias("_o"))
    plan = marked.join(owner, "path", "left")
    bare = ~F.col("_root") & F.col("_o").isNull()
    fragment = ~F.col("_root") & (F.col("_o").isNotNull() | F.lit(whole_fragments))
    out = plan.select("path", "text", fragment.alias("fragment"), F.when(F.col("_root"), F.col("path")).otherwise(F.coalesce("_o.root", "path")).alias("root"), F.when(F.col("_root"), 0).otherwise(F.coalesce("_o.depth", F.lit(0))).alias("depth"))
    alone_ = plan.where(bare & ~F.lit(whole_fragments)).select(F.col("path").alias("root"), "path", F.lit("bare fragment").alias("problem"), F.lit(None).cast("string").alias("detail"))
    return out, alone_ if warnings is None else warnings.unionByName(alone_)
