"""Inline protection: fragments of a text become numbered placeholders and come back unchanged."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import let

# What is hidden in a text of each format, in order of priority. A pattern's named group stays visible.
RULES = {
    "markdown": [
        ("task_marker", r"\A\[[ xX]\][ \t]+"),
        ("code", r"`+[^`]*`+"),
        ("math", r"\$\$?(?:\\.|[^$\\])+\$\$?"),
        ("autolink", r"<https?://[^>\s]+>"),
        ("image", r"!\[[^\]]*\]\([^)]*\)"),
        ("link", r"\[(?P<label>[^\]]*)\]\([^)]*\)"),
        ("refstyle_link", r"\[(?P<label>[^\]]*)\]\[[^\]]*\]"),
        ("citation", r"\[[-@][^\]]*\]"),
        ("footnote_ref", r"\[\^[^\]]*\]"),
        ("bare_url", r"https?://\S+"),
        ("html", r"</?[A-Za-z][^>]*>"),
        ("entity", r"&[A-Za-z]+;|&#\d+;"),
    ],
    "latex": [
        ("comment", r"(?m)(?<!\\)%.*$"),
        ("display_math", r"\\\[(?:.|\n)*?\\\]|\$\$(?:.|\n)*?\$\$"),
        ("inline_math", r"(?<!\\)\$(?:\\.|[^$\\])+\$|\\\((?:.|\n)*?\\\)"),
        (
            "opaque_macro",
            r"\\(?:cite|citep|citet|citeauthor|citeyear|ref|eqref|autoref|cref|Cref|pageref|label|includegraphics|input|include|bibliography"
            r"|bibliographystyle|url|nocite|hyperref|texttt|lstinline|path|verb|code|mintinline)\s*(?:\[[^\]]*\])?(?:\{[^{}]*\})+",
        ),
        ("href", r"\\href\s*\{[^{}]*\}\s*\{(?P<label>[^{}]*)\}"),
        ("text_macro", r"\\(?:emph|textit|textbf|textsc|textrm|textsf|underline|text|mbox)\s*\{(?P<label>[^{}]*)\}"),
        ("escape", r"\\[&%$#_{}~^\\]"),
        ("bare_macro", r"\\[A-Za-z@]+\*?"),
        ("brace", r"[{}]"),
    ],
}
MARK_PATTERN = r"\[\[\d+\]\]"
MARK = re.compile(r"\[\[(\d+)\]\]")
MASKED = StructType([
    StructField("text", StringType()),
    StructField("mapping", ArrayType(StructType([StructField("key", StringType()), StructField("frag", StringType())]))),
    StructField("groups", ArrayType(StructType([StructField("open", StringType()), StructField("close", StringType())]))),
])


def glossary_pattern(terms: list[str]) -> str | None:
    """One alternation over all terms, the longest first, in any case, never inside a word. Null and empty terms are none."""
    terms = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    return r"(?i)(?<!\w)(?:" + "|".join(map(re.escape, terms)) + r")(?!\w)" if terms else None


def rules_for(fmt: str, terms: list[str] | None = None) -> list[re.Pattern]:
    rules = [re.compile(p) for _, p in RULES[fmt]]
    g = glossary_pattern(terms or [])
    return [re.compile(g), *rules] if g else rules


def mask(text: str, rules: list[re.Pattern]) -> tuple[str, list[tuple[str, str]], list[tuple[str, str]]]:
    """(masked text, [(placeholder, fragment)], [(opening, closing placeholder) of visible labels]).

    An earlier rule owns what it matches. A label with a backslash is hidden with its construct.
    Placeholders are numbered from one beyond the largest that the text itself holds."""
    lows: list[int] = []
    taken: list[tuple[int, int, tuple[int, int] | None]] = []
    for rule in rules:
        found = []
        for m in rule.finditer(text):
            lo, hi = m.span()
            k = bisect.bisect_right(lows, lo)
            if lo == hi or (k and taken[k - 1][1] > lo) or (k < len(taken) and taken[k][0] < hi):
                continue
            label = m.span("label") if "label" in rule.groupindex else None
            found.append((lo, hi, label if label and "\\" not in text[slice(*label)] else None))
        taken = sorted([*taken, *found])
        lows = [x[0] for x in taken]
    n = max((int(m.group(1)) + 1 for m in MARK.finditer(text)), default=0)
    out: list[str] = []
    mapping: list[tuple[str, str]] = []
    groups: list[tuple[str, str]] = []

    def hide(fragment: str) -> str:
        mapping.append((f"[[{n + len(mapping)}]]", fragment))
        return mapping[-1][0]

    at = 0
    for lo, hi, label in taken:
        out.append(text[at:lo])
        if label is None:
            out.append(hide(text[lo:hi]))
        else:
            a = hide(text[lo : label[0]])
            out += [a, text[slice(*label)]]
            if label[1] < hi:
                out.append(hide(text[label[1] : hi]))
                groups.append((a, out[-1]))
        at = hi
    out.append(text[at:])
    return "".join(out), mapping, groups


def _masker(rules_of):
    """Column function of a text and its format: a struct of MASKED; null for null or a format without rules. One Arrow pass."""
    kind = to_arrow_type(MASKED)

    @F.arrow_udf(MASKED)
    def run(texts: pa.Array, fmts: pa.Array) -> pa.Array:
        known: dict = {}
        rows: list[dict | None] = []
        for t, f in zip(texts.to_pylist(), fmts.to_pylist()):
            if f not in known:
                known[f] = rules_of(f)
            if t is None or known[f] is None:
                rows.append(None)
                continue
            m, mapping, groups = mask(t, known[f])
            rows.append({"text": m, "mapping": [{"key": k, "frag": x} for k, x in mapping], "groups": [{"open": a, "close": b} for a, b in groups]})
        return pa.array(rows, kind)

    return run


def masker(terms: list[str] | None = None):
    """Column function of a text and its format: the text's masked form, placeholders and label groups; null for null or an unknown format."""
    return _masker(lambda f: rules_for(f, terms) if f in RULES else None)


def masker_of(patterns: list[str]):
    """Column function: a text masked by the given patterns alone, in their order."""
    run = _masker(lambda _: [re.compile(p) for p in patterns])
    return lambda text: run(text, F.lit(""))


def unmask(text: Column, mapping: Column) -> Column:
    """The text with its placeholders replaced in one pass: a restored fragment is never searched again.

    The text is split at its placeholders and each part is looked up, so the order of the mapping doesn't matter."""
    marks, gaps = F.regexp_extract_all(text, F.lit(MARK_PATTERN), F.lit(0)), F.split(text, MARK_PATTERN, -1)

    def filled(z: Column) -> Column:
        back = lambda mark: F.coalesce(F.try_element_at(z["back"], mark), mark, F.lit(""))
        return F.array_join(F.transform(z["gaps"], lambda g, i: F.concat(g, back(F.try_element_at(z["marks"], i + 1)))), "")

    return let(F.struct(marks.alias("marks"), gaps.alias("gaps"), F.map_from_entries(mapping).alias("back")), filled)
