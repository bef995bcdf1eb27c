"""Queries and SQL of the training-data operators; ``__spark_entry__`` adds them if this module can be imported."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import align, glyphs, learning, mixing, models, sentences, splitting, termfreq, tokens, truncation


def _splitter(spark: SparkSession, d: str, folder: str | None = None) -> sentences.Model:
    return models.kept(spark, folder and f"{folder}/splitter", "sentences", lambda: sentences.train(sentences.sample_values(table(spark, d, "segment_results"))))


def _tables(spark: SparkSession, d: str, folder: str | None = None) -> align.Tables:
    return models.kept(spark, folder and f"{folder}/tables", "align", lambda: learning.train_whole(table(spark, d, "segment_results"), table(spark, d, "runs")))


def _scored(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    """Every result with its cut values. ``folder``: where fitted models are, or are left; limits are counted afresh in any case."""
    t, runs = table(spark, d, "segment_results"), table(spark, d, "runs")
    limits = truncation.limits_of(t, runs)
    fit = lambda: truncation.train(truncation.sample_rows(t, runs=runs), _splitter(spark, d, folder), _tables(spark, d, folder), limits=limits)
    model = models.kept(spark, folder and f"{folder}/truncation", "truncation", fit)
    model.limits = limits
    return truncation.scored(t, model, runs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("result_id", F.inline("cut"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_scored(spark, d), table(spark, d, "runs"))


def p2_stats(spark: SparkSession, d: str) -> DataFrame:
    t = termfreq.dedupe(table(spark, d, "term_stats"), "stat_id").where("seen is not null")
    freq = termfreq.term_frequency(t, termfreq.term_key(F.col("term")), F.col("run_id"), F.col("seen"), F.col("survived"))
    runs = table(spark, d, "runs").agg(F.count_distinct("run_id").alias("n"))
    return termfreq.mark(freq, runs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_stats(spark, d).where("mark is not null").select("term_key", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return align.aligned(table(spark, d, "segment_results"), _splitter(spark, d), _tables(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "segment_results"), _splitter(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.same_text_pairs(table(spark, d, "segment_results"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same as p5_found with a row for each value instead of each pair."""
    return glyphs.same_text_classes(table(spark, d, "segment_results"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every value of final and hops in its canonical form."""
    v = glyphs.values(table(spark, d, "segment_results").where("result_id is not null"), ["result_id"])
    return glyphs.canonical(v, ["result_id", "field", "hop_no"], F.col("value")).select("result_id", "field", "hop_no", F.col("_form").alias("form")).distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every document's text after encoding and decoding."""
    return tokens.round_tripped(table(spark, d, "documents")).select("doc_id", F.md5("text").alias("digest"))


def _mixed(spark: SparkSession, d: str):
    m = table(spark, d, "mix_targets")
    docs = mixing.counted(table(spark, d, "documents"), m)
    return docs, m, mixing.mix(docs, m)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[2]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, m, mixed = _mixed(spark, d)
    return mixing.shares(mixed, docs, m)


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """For each row of the targets: whether its source has documents, its share is met to one document's size, no document is used
    more often than allowed, and all documents used are the source's own."""
    docs, m, mixed = _mixed(spark, d)
    s = mixing.shares(mixed, docs, m)
    own = mixed.join(table(spark, d, "documents").select("doc_id", F.col("source").alias("own")), "doc_id").groupBy("recipe", "source").agg(F.min(F.col("own") == F.col("source")).alias("own_documents"))
    longest = docs.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    near = F.abs(F.col("tokens") - F.col("budget")) <= F.col("longest") / 2 + 1
    j = s.join(own, ["recipe", "source"], "left").join(longest, "source", "left")
    return j.select("recipe", "source", (F.col("have_docs") > 0).alias("has_documents"), F.coalesce(near, F.col("tokens") == 0).alias("share_kept"), (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"), F.coalesce("own_documents", F.lit(True)).alias("own_documents"))


def _limits(spark: SparkSession, d: str) -> list[tuple]:
    # the table of limits is kept by hand and holds a few rows
    return [tuple(r) for r in table(spark, d, "split_limits").select("limit_id", "tokenizer", "max_tokens", "overlap_tokens").collect()]


def p8_joined(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every document's pieces joined without their overlaps, for each limit, and whether all of them are within it;
    a document within the limit is one piece."""
    docs, limits = table(spark, d, "documents").where("text is not null"), _limits(spark, d)
    pieces = splitting.split_corpus(docs, limits)
    by = pieces.groupBy("doc_id", "limit_id").agg(F.sort_array(F.collect_list(F.struct("core_lo", "piece_hi"))).alias("p"), F.max("n_tokens").alias("n"))
    # all limits of a document meet its text in one row, so that texts are shuffled once
    lists = by.groupBy("doc_id").agg(F.collect_list(F.struct("limit_id", "p", "n")).alias("_l"))
    each = docs.select("doc_id", "text").join(lists, "doc_id", "left")
    of = lambda i: F.try_element_at(F.filter("_l", lambda x: x["limit_id"] == i), F.lit(1))
    joined = lambda x: F.array_join(F.transform(x["p"], lambda y: F.substring("text", y["core_lo"] + 1, y["piece_hi"] - y["core_lo"])), "")
    rows = [F.struct(F.lit(i).alias("limit_id"), F.md5(F.coalesce(joined(of(i)), "text")).alias("digest"), F.coalesce(of(i)["n"] <= m, F.lit(True)).alias("fits")) for i, _, m, _ in limits]
    return each.select("doc_id", F.inline(F.array(*rows)))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_corpus(table(spark, d, "documents"), _limits(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_rates, p2_found, p2_stats, p3_found, p4_found, p5_found, p5_classes, p5_forms, p6_ids, p6_roundtrip, p7_mix, p7_shares, p7_kept, p8_pieces, p8_joined)
}

_TERMS = """
  (SELECT lower(regexp_replace(term, '^[\\s\\x{00A0}\\x{200B}\\x{3000}\\x{FEFF}]+|[\\s\\x{00A0}\\x{200B}\\x{3000}\\x{FEFF}]+$', '', 'g')) AS term_key, run_id, seen, coalesce(survived, 0) AS survived
   FROM (SELECT DISTINCT stat_id, run_id, term, seen, survived FROM term_stats) WHERE term IS NOT NULL AND seen IS NOT NULL)"""

_STATS = f"""SELECT term_key, CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(survived) AS BIGINT) AS survived, count(DISTINCT run_id) AS records,
  CASE WHEN sum(seen) <= 2 THEN 'rare' WHEN count(DISTINCT run_id) > 0.05 * (SELECT count(DISTINCT run_id) FROM runs) THEN 'common' END AS mark
  FROM {_TERMS} GROUP BY term_key"""

_VALUES = """(SELECT result_id, doc_id, span_lo, 'final' AS field, -1 AS hop_no, final AS value FROM segment_results WHERE final IS NOT NULL
  UNION SELECT result_id, doc_id, span_lo, 'hops', CAST(i - 1 AS INT), hops[i] FROM (SELECT *, unnest(range(1, len(hops) + 1)) AS i FROM segment_results) WHERE hops[i] IS NOT NULL)"""


def _looks() -> str:
    """What each character looks like, as rows of SQL: written from the Unicode categories and character by character, so that
    it shares nothing with the operator but the list of look-alike letters."""
    looks = dict(glyphs.LOOK_ALIKES)
    for i in [9, *range(0x7F, 0x2000), *range(0x2000, 0x3400), *range(0xF900, 0xFB10), *range(0xFE00, 0x10000), *range(0xE0000, 0xE1000), *range(0x2F800, 0x2FA20)]:
        c = chr(i)
        kind, parts = unicodedata.category(c), unicodedata.decomposition(c).split()
        if kind == "Cf" and i not in (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2) or i in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= i <= 0x180F or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or kind == "Cc" and i not in (9, 0x85):
            looks[c] = ""
        elif kind == "Zs" or i == 9:
            looks[c] = " "
        elif parts[:1] in (["<wide>"], ["<narrow>"]) or parts[:1] == ["<compat>"] and len(parts) == 2 and c not in "ſ․":
            to = unicodedata.normalize("NFKC", c)
            looks.setdefault(c, glyphs.LOOK_ALIKES.get(to, to if to.strip() else c))
        elif 0xFB00 <= i <= 0xFB06 or 0x2150 <= i <= 0x217F and parts[:1] == ["<compat>"]:
            looks.setdefault(c, unicodedata.normalize("NFKC", c))
    return ", ".join(f"({ord(c)}, {glyphs._quote(t)})" for c, t in looks.items() if c != t)


def _looked(table_: str) -> str:
    """The values of a table with each character as it looks, put together again and composed."""
    return f"""SELECT value, nfc_normalize(coalesce(string_agg(coalesce(t, c), '' ORDER BY i), '')) AS form FROM
  (SELECT value, unnest(l) AS c, unnest(range(len(l))) AS i FROM (SELECT value, regexp_extract_all(form, '(?s).') AS l FROM {table_})) LEFT JOIN looks ON ascii(c) = code GROUP BY value"""


_FORMS = f"""looks(code, t) AS (VALUES {_looks()}), texts AS (SELECT DISTINCT value, replace(regexp_replace(value, '\\r\\n?', chr(10), 'g'), chr(8232), chr(10)) AS form FROM {_VALUES}),
  once AS ({_looked("texts")}), twice AS ({_looked("once")}),
  f AS (SELECT v.*, coalesce(form, '') AS form FROM {_VALUES} v LEFT JOIN twice USING (value))"""

SQL: dict[str, str] = {
    "p5_forms": f"WITH {_FORMS} SELECT DISTINCT result_id, field, hop_no, form FROM f",
    "p5_found": f"""WITH {_FORMS} SELECT a.field, a.hop_no, a.result_id AS result_a, b.result_id AS result_b FROM f a JOIN f b
  ON a.doc_id = b.doc_id AND a.span_lo = b.span_lo AND a.field = b.field AND a.hop_no = b.hop_no AND a.form = b.form AND a.result_id < b.result_id AND a.value <> b.value""",
    "p5_classes": f"""WITH {_FORMS}, k AS (SELECT *, count(*) OVER w AS n, min(result_id) OVER w AS class_id, count(*) OVER s AS same, min(result_id) OVER s AS spelling_id FROM f
  WINDOW w AS (PARTITION BY doc_id, span_lo, field, hop_no, form), s AS (PARTITION BY doc_id, span_lo, field, hop_no, form, value))
  SELECT result_id, field, hop_no, class_id, spelling_id, n - same AS links FROM k WHERE n > same AND doc_id IS NOT NULL AND span_lo IS NOT NULL AND result_id IS NOT NULL""",
    "p2_stats": _STATS,
    "p2_found": f"SELECT term_key, mark FROM ({_STATS}) WHERE mark IS NOT NULL",
    "p6_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_kept": """SELECT recipe, source, target_share > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(trim(text)) > 0) AS has_documents, true AS share_kept, true AS repeats_kept, true AS own_documents
  FROM (SELECT DISTINCT recipe, source, target_share FROM mix_targets) t""",
    "p8_joined": "SELECT limit_id, doc_id, md5(text) AS digest, true AS fits FROM documents CROSS JOIN (SELECT DISTINCT limit_id FROM split_limits) WHERE text IS NOT NULL",
}
