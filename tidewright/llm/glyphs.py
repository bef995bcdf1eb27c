"""One form for text that looks the same.

DuckDB runs inside the Arrow partitions: a batch is a table there, and embedded SQL
(nfc_normalize, translate, regexp_replace) maps compatibility forms, invisible
characters, kinds of blank and look-alike letters. The look-alikes are applied before
and after composing, so that a look-alike base with a combining accent composes too.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Letters of other scripts that look like a Latin letter, in pairs (look-alike, Latin).
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï", "Ѐ": "È", "ѐ": "è", "Ӓ": "Ä", "ӓ": "ä", "Ӧ": "Ö", "ӧ": "ö", "Ӑ": "Ă", "ӑ": "ă", "Ӗ": "Ĕ", "ӗ": "ĕ", "Ӱ": "Ÿ", "ӱ": "ÿ", "Ӯ": "Ȳ", "ӯ": "ȳ", "Ӕ": "Æ", "ӕ": "æ", "Ә": "Ə", "ә": "ə",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "ı", "ϳ": "j", "ϲ": "c", "Ϲ": "C", "Ϳ": "J", "ό": "ó", "ὸ": "ò", "ί": "í", "ϊ": "ï", "Ά": "Á", "Έ": "É", "Ί": "Í", "Ό": "Ó", "Ύ": "Ý", "Ϊ": "Ï", "Ϋ": "Ÿ",
    # Latin, phonetic, Armenian and others
    "ɡ": "g", "ɑ": "a", "ⅼ": "l", "ո": "n", "օ": "o", "հ": "h", "ս": "u", "զ": "q", "ց": "g", "Տ": "S", "Օ": "O", "Լ": "L", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ꞵ": "β",
    # marks
    "‐": "-", "‑": "-", "։": ":", "∶": ":", "∕": "/", "⁄": "/", "∙": "·", "‧": "·", "ꓸ": ".", "․": ".", "ǃ": "!", "Ꭺ": "A", "Ꭼ": "E", "Ꮃ": "W", "Ꮪ": "S", "Ꮲ": "P",
}
# Invisible characters (soft hyphen, joiners, direction marks, variation selectors, byte-order mark, tags).
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{0084}\x{0086}-\x{009F}]"
# Blanks of any kind.
BLANKS = [0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]


def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility forms that look as their base: wide and narrow forms, ligatures, radicals, and
    whatever else the Unicode tables decompose as a plain compatibility form into one letter or into
    letters. Raised, lowered, circled, squared, fraction and font forms look different and stay."""
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    for i in [*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x2F800, 0x2FA20)]:
        c = chr(i)
        d = unicodedata.decomposition(c)
        tag = d.split(" ")[0] if d.startswith("<") else ""
        if tag not in ("<wide>", "<narrow>", "<compat>") or c in "…ſ‥‗․":
            continue
        to = unicodedata.normalize("NFKC", c)
        if i == 0xFF9E or i == 0xFF9F:  # half-width voicing marks compose with the letter before
            to = "゙" if i == 0xFF9E else "゚"
        if " " in to or "/" in to or "(" in to and len(to) > 1:
            continue
        (one if len(to) == 1 else more)[c] = to
    return one, {k: v for k, v in more.items() if 0xFB00 <= ord(k) <= 0xFB06 or 0x2100 <= ord(k) <= 0x217F}


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@functools.cache
def _mapping() -> tuple[dict[str, str], dict[str, str]]:
    """(characters that one character stands for, characters that several stand for)."""
    one, more = _compatible()
    for c in BLANKS:
        one[chr(c)] = " "
    one |= {k: v for k, v in LOOK_ALIKES.items() if k != v and len(v) == 1}
    # a compatibility form of a look-alike, or a look-alike with an accent, ends at the Latin letter as well
    return {k: one.get(v, v) for k, v in one.items()}, more


#: Canonical composing turns a few characters into others that have a form of their own.
_LATE = "".join(sorted({unicodedata.normalize("NFC", chr(i)) for i in [*range(0x340, 0x380), *range(0x1F00, 0x2130)]} - {""}, key=lambda c: (len(c), c)))


def canonical_sql(column: str, chars: set[str] | None = None) -> str:
    """DuckDB expression of the canonical form of ``column``; null stays null.

    ``chars``: all characters that occur in the column. translate builds its table anew for every row, so only what
    occurs, or can come out of composing, is put into it."""
    one, more = _mapping()
    late = set(_LATE)
    if chars is not None:
        one = {k: v for k, v in one.items() if k in chars}
        more = {k: v for k, v in more.items() if k in chars}
    after = {k: v for k, v in _mapping()[0].items() if chars is None or k in late or k in chars}
    accents = chars is None or any(unicodedata.normalize("NFC", c) != c or unicodedata.combining(c) for c in chars)
    e = column
    for k, v in sorted(more.items()):
        e = f"replace({e}, {_quote(k)}, {_quote(v)})"
    # a line break is one, whatever code points make it up
    e = f"regexp_replace({e}, '\\r\\n|[\\r\\x{{0085}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    e = f"regexp_replace({e}, {_quote(INVISIBLE)}, '', 'g')"
    for table in (one, after if accents else {}):
        if table:
            e = f"translate({e}, {_quote(''.join(table))}, {_quote(''.join(table.values()))})"
        e = f"nfc_normalize({e})"
    return e


#: A character that may need mapping: all but printable ASCII and the line feed.
ODD = "[^\\n -~]"


def _forms(con, texts: pa.Array) -> pa.Array:
    """Canonical forms of the distinct texts of a batch, by SQL over the batch as a table."""
    chars = set().union(*map(set, texts.to_pylist()))
    con.register("batch", pa.table({"k": pa.array(range(len(texts)), pa.int64()), "v": texts}))
    return con.sql(f"SELECT {canonical_sql('v', chars)} AS form FROM batch ORDER BY k").to_arrow_table().column("form").combine_chunks().cast(pa.string())


def _run(batches):
    import duckdb
    import pyarrow.compute as pc

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    for b in batches:
        v = b.column(b.num_columns - 1)
        # plain ASCII without control characters is its own form; of equal texts one is mapped
        odd = pc.if_else(pc.match_substring_regex(v, ODD), v, None).dictionary_encode()
        form = v
        if len(odd.dictionary):
            form = pc.coalesce(_forms(con, odd.dictionary.cast(pa.string())).take(odd.indices), v)
        yield pa.RecordBatch.from_arrays([*b.columns, form], names=[*b.schema.names, "_form"])


def canonical(df: DataFrame, keep: list[str], value: Column) -> DataFrame:
    """(kept columns, _value, _form) of every row: the value and its canonical form.

    Null gives null, empty gives empty. Two values have equal forms exactly when they show
    the same text: letter case, accents, raised digits, quotation marks, dashes of another
    length and the number of blanks and line breaks still tell values apart. Texts of any
    length are mapped whole. No shuffle. Other columns are dropped.
    """
    rows = df.select(*keep, value.alias("_value"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_run, fields + ", _form string")


def _digests(batches):
    for b in _run(batches):
        yield pa.RecordBatch.from_arrays(b.columns[:-2] + [pa.array([None if t is None else hashlib.md5(t.encode()).digest() for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())], names=[*b.schema.names[:-2], "_form"])


def digests(df: DataFrame, keep: list[str], value: Column) -> DataFrame:
    """(kept columns, raw, form): 128-bit digests of every value and of its canonical form; null gives null.

    Texts that are their own form never leave the JVM, and no text comes back from Python."""
    raw = F.unhex(F.md5(value))
    rows = df.select(*keep, raw.alias("raw"), F.when(value.rlike(ODD), value).alias("_value"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(_digests, fields + ", _form binary").select(*keep, "raw", F.coalesce("_form", "raw").alias("form"))


def values(results: DataFrame, keep: list[str], fields: tuple[str, ...] = ("final", "hops")) -> DataFrame:
    """One row per value that is not null: kept columns, field, hop_no (-1 outside hops), value."""
    parts = [F.array(F.struct(F.lit(f).alias("field"), F.lit(-1).alias("hop_no"), F.col(f).alias("value"))) for f in fields if f != "hops"]
    if "hops" in fields:
        parts.append(F.transform(F.coalesce("hops", F.array().cast("array<string>")), lambda v, i: F.struct(F.lit("hops").alias("field"), i.alias("hop_no"), v.alias("value"))))
    return results.select(*keep, F.inline(F.concat(*parts))).where("value is not null")


PLACE = ["doc_id", "span_lo", "hop_no"]


def spellings(results: DataFrame) -> DataFrame:
    """(result_id, doc_id, span_lo, hop_no, form, raw) of every value of final (hop_no -1) and hops, computed once and cut from
    its lineage: digests, no texts. Rows with a null key or value are left out; a redelivered row is there more than once."""
    v = values(results.where("result_id is not null and doc_id is not null and span_lo is not null"), ["result_id", "doc_id", "span_lo"])
    return cut(digests(v, ["result_id", *PLACE], F.col("value")))


def _several(h: DataFrame) -> DataFrame:
    """Rows of ``h`` in groups of one place and form with more than one spelling, each once. Groups are first reduced to the
    least and the greatest of their spellings, so that one of any size is added up before it is shuffled."""
    spelled = h.groupBy(*PLACE, "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*PLACE, "form")
    return h.join(spelled, [*PLACE, "form"], "left_semi").distinct()


def _field() -> Column:
    return F.when(F.col("hop_no") < 0, "final").otherwise("hops").alias("field")


def same_text_pairs(results: DataFrame) -> DataFrame:
    """(field, hop_no, result_a, result_b): pairs of results of the same doc_id, span_lo, field and
    hop_no whose values have equal forms but are stored differently; result_a < result_b.

    Rows with a null key or value pair with nothing; a redelivered row counts once. The join is on place *and* form, so
    that it meets only pairs that are in the result or are exact copies; groups with one spelling are left out before it.
    The result itself grows with the square of a place's results; ``same_text_classes`` says the same in one row a value.
    """
    several = _several(spellings(results))
    a, b = several.alias("a"), several.alias("b")
    on = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in [*PLACE, "form"]]
    j = a.join(b, [*on, F.col("a.result_id") < F.col("b.result_id"), F.col("a.raw") != F.col("b.raw")])
    return j.select(F.col("a.hop_no"), F.col("a.result_id").alias("result_a"), F.col("b.result_id").alias("result_b")).select(_field(), "hop_no", "result_a", "result_b")


def same_text_classes(results: DataFrame) -> DataFrame:
    """(result_id, field, hop_no, class_id, spelling_id, links) of every value that shows the same text as another one of its
    place stored differently: class_id is the least result_id of those that show it, spelling_id the least of those stored
    alike, links the number of results in the class that are stored differently. No pair is formed."""
    several = _several(spellings(results))
    key = [*PLACE, "form"]
    alike = several.groupBy(*key, "raw").agg(F.count("*").alias("_n"), F.min("result_id").alias("spelling_id"))
    every = alike.groupBy(*key).agg(F.sum("_n").alias("_all"), F.min("spelling_id").alias("class_id"))
    j = several.join(alike.join(every, key), [*key, "raw"])
    return j.select("result_id", _field(), "hop_no", "class_id", "spelling_id", (F.col("_all") - F.col("_n")).alias("links"))
