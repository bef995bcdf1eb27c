"""Scans of files and sinks to files."""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
import tomllib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import is_standalone, strip_control_tokens
from .base import extensions, format_of


def tolerant(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def read_documents(spark: SparkSession, *folders: str) -> DataFrame:
    """(doc_id, path, relative, fmt, text, fragment) of every file of a known extension below the folders, one row a file, line ends untouched.

    doc_id is the path relative to the last folder common to all, so that files of the same name stay apart. Bytes that are no UTF-8
    are replaced. Files of other kinds are left out. fragment: a LaTeX file without a document. The order is that of the paths."""
    roots = [re.sub(r"(?<=.)/+$", "", f) for f in folders]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
    top = roots[0] if len(roots) == 1 else os.path.commonpath(roots)
    path = F.regexp_replace("path", r"^file:/+", "/")
    d = raw.select(path.alias("path"), F.substring(path, F.lit(len(top.rstrip("/")) + 2), F.length(path)).alias("relative"), tolerant(F.col("content")).alias("text"))
    d = d.where(format_of(F.col("path")).isNotNull()).withColumn("fmt", format_of(F.col("path")))
    fragment = (F.col("fmt") == "latex") & ~is_standalone(F.col("text"))
    return d.select(F.col("relative").alias("doc_id"), "path", "relative", "fmt", "text", fragment.alias("fragment")).orderBy("path")


REPORT = (
    "path string, format string, pivot array<string>, persona string, model string, seconds double, segments_total int, segments_translated int, segments_fallback int, "
    "segments_with_issues int, interrupted boolean, segments array<struct<span: array<bigint>, original: string, final: string, hops: array<string>, attempts: int, "
    "translated: boolean, reason: string, rules_applied: array<string>, issues: array<struct<kind: string, detail: string, severity: string>>, seconds: double>>"
)


def read_reports(spark: SparkSession, place: str) -> DataFrame:
    """Rows of all *.report.json below a folder, or of one file; what a report lacks is null."""
    return spark.read.schema(REPORT).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.report.json").json(place)


def report_totals(reports: DataFrame) -> DataFrame:
    """One row: reports, segments, translated, fallbacks, flagged and interrupted ones; a missing count is 0."""
    names = {"segments_total": "segments", "segments_translated": "translated", "segments_fallback": "fallbacks", "segments_with_issues": "flagged"}
    return reports.agg(F.count("*").alias("reports"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in names.items()], F.count_if("interrupted").alias("interrupted"))


def changed_pairs(reports: DataFrame) -> DataFrame:
    """(original, final) of the translated segments that changed."""
    s = reports.select(F.inline("segments"))
    return s.where("translated and final <> original").select("original", "final")


def glossary_terms(line: Column) -> Column:
    """The term of a glossary's line: what stands before its first #, trimmed."""
    return F.trim(F.split(line, "#")[0])


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term) of each line before its first #, trimmed, without empty ones."""
    return spark.read.text(path).select(glossary_terms(F.col("value")).alias("term")).where("term <> ''")


def find_glossary(explicit: str | None = None, folder: str = ".", name: str = "glossary.txt") -> str | None:
    """The glossary named, which must be there, or the one of the folder, or none."""
    if explicit:
        if not os.path.isfile(explicit):
            raise FileNotFoundError(explicit)
        return explicit
    place = os.path.join(folder, name)
    return place if os.path.isfile(place) else None


def safe_name(name: Column) -> Column:
    """Whether a name may be a file's name in a folder of personas."""
    return name.rlike(P.SAFE_NAME)


def frontmatter(raw: str) -> tuple[dict, str]:
    """(settings, body) of a text with a block of settings at its start: scalars, one level of named values, lists.

    A comment after a value is dropped, after a quoted one too."""
    m = re.match(r"---\n(.*?)\n---\n(.*)\Z", raw, re.DOTALL)
    if not m:
        return {}, raw.strip()

    def scalar(s: str) -> str:
        s = s.strip()
        q = re.match(r"([\"'])(.*?)\1\s*(?:#.*)?$", s)
        return q.group(2) if q else s.split("#", 1)[0].strip()

    out: dict = {}
    key = None
    for line in m.group(1).split("\n"):
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        if s.startswith("- ") and key:
            out[key] = out.get(key) if isinstance(out.get(key), list) else []
            out[key].append(scalar(s[2:]))
            continue
        pair = re.match(r"(\"[^\"]*\"|'[^']*'|[^:]*):(.*)$", s)
        if not pair:
            continue
        k, v = scalar(pair.group(1)), pair.group(2).strip()
        if line[0] in " \t" and key:
            if not isinstance(out.get(key), str):  # what has a value of its own holds no others
                out[key] = out.get(key) if isinstance(out.get(key), dict) else {}
                out[key][k] = scalar(v)
        else:
            key, out[k] = k, scalar(v) if v else None
    return out, m.group(2).strip()


def read_personas(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, too_long, raw) of each persona file, control tokens stripped. READMEs are left out."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return b.select(name.alias("name"), "length", (F.col("length") > P.PERSONA_MAX_BYTES).alias("too_long"), strip_control_tokens(tolerant(F.col("content"))).alias("raw")).where("lower(name) <> 'readme'")


@dataclass(frozen=True)
class Persona:
    """How results are to sound: guidance for the way back, words to replace, sentence openers to drop."""

    name: str = ""
    guidance: str | None = None
    description: str = ""
    forbid: tuple[tuple[str, str], ...] = ()
    openers: tuple[str, ...] = ()

    def rules(self) -> dict:
        """Its hard rules, as arguments of a round trip."""
        return {"forbid": list(self.forbid), "openers": list(self.openers)}


def parsed_persona(name: str, raw: str) -> Persona:
    """A persona from a file's text: settings before the guidance, or guidance alone."""
    meta, body = frontmatter(raw)
    forbid, openers = meta.get("forbid"), meta.get("banned_openers")
    said = lambda key: v if isinstance(v := meta.get(key), str) else ""
    return Persona(
        said("name") or name, body or None, said("description"),
        tuple(forbid.items()) if isinstance(forbid, dict) else (), tuple(openers) if isinstance(openers, list) else (),
    )


#: Names that stand for no persona.
NO_PERSONA = ("", "none", "neutral", "off")


def find_persona(spark: SparkSession, name: str | None, folder: str, default: str = "neutral", required: bool | None = None) -> Persona:
    """The persona of a name: a file of the folder and of no other place.

    A name that stands for none gives the empty persona; so does the default if it has no file. Any other that has no file, a
    name that is no plain file name, and a file beyond the size limit are errors. ``required`` overrides who must have a file."""
    wanted = default if name is None else name
    if wanted.strip().lower() in NO_PERSONA:
        return Persona()
    if not re.fullmatch(P.SAFE_NAME.replace(r"\A", "").replace(r"\z", ""), wanted):
        raise ValueError(f"{wanted!r} is no name of a persona")
    place = os.path.realpath(os.path.join(folder, f"{wanted}.md"))
    if os.path.dirname(place) != os.path.realpath(folder):
        raise ValueError(f"{wanted!r} lies outside of {folder}")
    if not os.path.isfile(place):
        if required if required is not None else wanted != default:
            raise FileNotFoundError(place)
        return Persona()
    row = read_personas(spark, folder).where(F.col("name") == wanted).first()
    if row is None or row.too_long:
        raise ValueError(f"{place} is longer than {P.PERSONA_MAX_BYTES} bytes")
    return parsed_persona(wanted, row.raw)


def setting(value: Column, default: Column, from_file: Column) -> Column:
    """A value that differs from its default wins, then the file's, then the default."""
    return F.when(~value.eqNullSafe(default), value).otherwise(F.coalesce(from_file, default))


SETTINGS = ("pivot", "persona", "glossary", "effort", "attempts", "backend", "model", "preserve_wrapping", "cache", "report", "follow_inputs", "copy_assets", "out", "n_ctx")


def find_settings(start: str, name: str = "tidewright.toml") -> str | None:
    """The settings file of a folder or the nearest folder above it."""
    here = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(here, name)):
            return os.path.join(here, name)
        if os.path.dirname(here) == here:
            return None
        here = os.path.dirname(here)


def load_settings(path: str, table: str = "tidewright") -> dict:
    """Settings of a TOML file, in its own table or bare; an unknown one is an error."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    data = data.get(table, data)
    unknown = sorted(set(data) - set(SETTINGS))
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    return data


def assets(files: DataFrame, translated: DataFrame) -> DataFrame:
    """Files to carry over: not translated, no source, no build product, nothing hidden or in a skipped folder. ``files``: relative."""
    parts = F.split("relative", "/")
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"(?<=.)\.[^.]+$", 0))
    keep = files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, P.ASSET_SKIP_DIRS))) & ~name.startswith(".") & ~suffix.isin(P.ASSET_SKIP_SUFFIXES + P.ASSET_SKIP_SOURCES))
    return keep.join(translated.select("relative"), "relative", "left_anti")


def write_documents(rendered: DataFrame, out: str) -> None:
    """One file per row (relative, text) below ``out``, by the executors; ``out`` must be a folder they share.

    A relative path that leads out of the folder is an error, nothing is written for a null text."""

    def write(rows):
        for r in rows:
            if r.text is None:
                continue
            target = os.path.abspath(os.path.join(out, r.relative))
            if os.path.commonpath([target, os.path.abspath(out)]) != os.path.abspath(out):
                raise ValueError(f"{r.relative} leads out of the folder")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            tmp = f"{target}.part"
            with open(tmp, "w", encoding="utf-8", newline="") as f:
                f.write(r.text)
            os.replace(tmp, target)

    rendered.select("relative", "text").foreachPartition(write)


def copied_assets(spark: SparkSession, source: str, out: str, translated: DataFrame) -> list[str]:
    """Relative paths of the assets copied from one folder to another, where they replace nothing that was written as a document."""
    names = sorted(os.path.relpath(os.path.join(d, f), source) for d, _, fs in os.walk(source) for f in fs)
    listed = spark.createDataFrame([(n,) for n in names], "relative string")
    chosen = [r.relative for r in assets(listed, translated).orderBy("relative").collect()]  # names of one project's files
    for n in chosen:
        target = os.path.join(out, n)
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        shutil.copyfile(os.path.join(source, n), target)
    return chosen


def report_json(report: Column) -> Column:
    """A run's report as JSON text, characters beyond ASCII kept, nulls kept."""
    return F.to_json(report, {"ignoreNullFields": "false"})


def matches_extension(path: str) -> bool:
    return any(fnmatch.fnmatch(path.lower(), f"*{e}") for e in extensions())
