"""Registry of text formats and the scan of documents into prose segments."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import patterns as P
from ..session import spread
from . import latex, markdown

Parser = Callable[[str, bool], list[markdown.Span]]
_FORMATS: dict[str, tuple[Parser, tuple[str, ...]]] = {}


def register(name: str, parser: Parser, extensions: tuple[str, ...]) -> None:
    """Adds a format: parser(source, fragment) gives the spans of prose."""
    _FORMATS[name] = (parser, extensions)


register("markdown", lambda s, fragment: markdown.prose(s), P.FORMATS["markdown"])
register("latex", latex.prose, P.FORMATS["latex"])


def extensions() -> list[str]:
    return sorted(x for _, e in _FORMATS.values() for x in e)


def format_of(path: Column, strict: bool = False) -> Column:
    """Name of the format of a path by its extension; null where none handles it, or an error if strict."""
    ext = F.lower(F.regexp_extract(path, r"(?<=[^/])\.[^./]+$", 0))
    out = None
    for name, (_, exts) in _FORMATS.items():
        out = (F.when if out is None else out.when)(ext.isin(list(exts)), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("no format handles "), ext))) if strict else out


def marker_pattern(fmt: str, word: str) -> str:
    """Pattern of the comment lines that switch regions off and on: ``word: off`` or ``word: on``."""
    return rf"(?im)^[ \t]*%+[ \t]*{word}:[ \t]*(off|on)\b.*$" if fmt == "latex" else rf"(?im)^[ \t]*<!--[ \t]*{word}:[ \t]*(off|on)[ \t]*-->[ \t]*$"


def switched_off(text: str, fmt: str, word: str) -> list[tuple[int, int]]:
    """Regions of a text that are switched off: the first ``off`` opens one, the next ``on`` closes it, an open one runs to the end."""
    if f"{word.lower()}:" not in text.lower():
        return []
    marks = [(m.start(), m.end(), m.group(1).lower()) for m in re.finditer(marker_pattern(fmt, word), text)]
    turns = [m for m, before in zip(marks, ["on", *(x[2] for x in marks)]) if m[2] != before]
    return [(lo, end) for (lo, _, state), end in zip(turns, [*(x[1] for x in turns[1:]), len(text)]) if state == "off"]


SEGMENT = "seg_id int, start int, end int, text string, block string, heading boolean, indent string"


def segments(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", fragment_col: str = "fragment", drop_disabled: str | None = None, with_format: bool = False,
    extra: tuple[list[tuple[str, str]], Callable[..., tuple]] | None = None,
) -> DataFrame:
    """(id_col, seg_id, start, end, text, block, heading, indent) of every prose segment.

    Documents of an unknown format, and null or empty ones, have none. Each document is scanned
    whole where it is read, without a shuffle. Repeated rows are scanned each. ``drop_disabled``:
    word of the comments that switch regions off and on; segments wholly inside one are left out.
    ``with_format``: the format's name as a further column fmt. ``extra``: names and types of more columns,
    and a function of format, span, text and a dictionary kept for the task that gives their values.
    """
    names = [id_col, "seg_id", "start", "end", "text", "block", "heading", "indent"] + ["fmt"] * with_format
    more, make = extra or ([], None)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {SEGMENT}" + ", fmt string" * with_format + "".join(f", {n} {t}" for n, t in more)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()] + [pa.string()] * with_format
    kinds += [to_arrow_type(StructType.fromDDL(f"v {t}")[0].dataType) for _, t in more]
    fmts = {n: p for n, (p, _) in _FORMATS.items()}

    def run(batches):
        memo: dict = {}
        for b in batches:
            rows: list[tuple] = []
            for i, (text, fmt, fragment) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                if text and fmt in fmts:
                    found = fmts[fmt](text, bool(fragment))
                    off = switched_off(text, fmt, drop_disabled) if drop_disabled else []
                    for n, s in enumerate(x for x in found if not any(lo <= x.start and x.end <= hi for lo, hi in off)):
                        part = text[s.start : s.end]
                        rows.append((i, n, s.start, s.end, part, s.block, s.heading, s.indent, *([fmt] * with_format), *(make(fmt, s, part, memo) if make else ())))
            if rows:
                c = list(zip(*rows))
                arrays = [b.column(0).take(pa.array(c[0], pa.int64())), *(pa.array(x, k) for x, k in zip(c[1:], kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(n for n, _ in more)])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), format_of(F.col(path_col)).alias("_fmt"), F.col(fragment_col).cast("boolean").alias("_fragment"))
    return spread(rows).mapInArrow(run, schema)
