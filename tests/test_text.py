"""Column functions on literals."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as T


def one(spark, col, *values):
    df = spark.createDataFrame([values], " , ".join(f"c{i} string" for i in range(len(values))))
    return df.select(col(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.numbers, "1,000.5", ["10005"]),
        (T.numbers, "1 000,5", ["10005"]),
        (T.numbers, "[[12]] and 3", ["3"]),
        (T.identifiers, "ResNet50. Q5_K_M", ["Q5_K_M", "ResNet50"]),
        (T.negation_count, "It does not, doesn't, cannot.", 3),
        (T.hedge_count, "It may, perhaps, doesn't.", 3),
        (T.sentence_count, "One. Two! Three?", 3),
        (T.sentence_count, "", 1),
        (T.long_enough, "[[0]] [[1]] [[2]] [[3]] [[4]] [[5]] [[6]] [[7]]", False),
        (T.long_enough, "one two three four five six seven", True),
        (T.sentinels, "[[3]] x [[1]]", ["3", "1"]),
        (T.candidate_terms, "A Responsible Release uses low-rank Net5 things", ["low-rank", "Responsible Release", "Net5"]),
        (T.is_standalone, "% \\begin{document}\n", False),
        (T.is_standalone, "\\% \\begin {document}", True),
        (T.detect_width, "a" * 61 + "\n" + "b" * 58 + "\nshort", 61),
        (T.detect_width, "a" * 74 + "\n" + "b" * 77, 77),
        (T.detect_width, "short\n" + "a" * 77, None),
        (T.rotate_words, "[[0]]. one two\n[[1]] three word[[2]]", "[[0]] one two .\n[[1]] word[[2]] three"),
        (T.parse_response, " to=self<|message|>think<|eom|><|start|>assistant<|message|>answer<|eot|>", "answer"),
        (T.parse_response, "plain <|eot|>", "plain"),
        (T.strip_control_tokens, "a<|eot|>b", "ab"),
        (T.has_words, "[[0]] 12", False),
    ],
)
def test_scalars(spark, f, text, want):
    assert one(spark, f, text) == want


def test_null_gives_null(spark):
    for f in (T.numbers, T.word_count, T.rotate_words, T.candidate_terms, T.sentence_count, T.detect_width):
        assert one(spark, f, None) is None


def test_durations(spark):
    got = [one(spark, lambda c: T.human_duration(c.cast("double")), str(x)) for x in (0.2, 45, 600, 7200, 5400)]
    assert got == ["instant", "45s", "10 min", "2h", "1h 30m"]


def verdict(spark, a, b, same=True):
    return one(spark, lambda x, y: T.summary(T.verdict(x, y, same)), a, b)


def test_verdicts(spark):
    assert verdict(spark, "It has [[0]] and [[1]].", "[[1]] it has, and [[0]].") == ""
    assert verdict(spark, "a [[0]]", "a") == "sentinels: lost ['0']"
    assert verdict(spark, "value 256", "value 512") == "numbers: lost ['256'], gained ['512']"
    assert "negation: 1 negation cue(s) became 0" == verdict(spark, "it is not so", "it is so")
    assert verdict(spark, "it is not so", "ce n'est pas", same=False) == ""
    assert verdict(spark, "text", "Sure, here it is").startswith("chatter: conversational opener 'Sure,'")
    assert verdict(spark, "x" * 40, "y" * 10) == "length: ratio 0.25 outside [0.5, 2.0]"
    assert verdict(spark, "a \\_ b", "a _ b") == "escapes: lost ['\\_']"
    assert verdict(spark, "a", " ") == "nonempty: model returned nothing"


def test_compare(spark):
    i = one(spark, T.compare, "It may not use Q5_K_M with 3.", "It uses Q5_K_S with 4.")
    assert {x["kind"] for x in i} == {"numbers", "identifiers", "negation", "hedging"}
    assert {x["severity"] for x in i if x["kind"] == "hedging"} == {"low"}
    assert one(spark, T.compare, "same", "same") == []


def test_repairs(spark):
    r = one(spark, T.strip_pivot_artifacts, "bold\u202f! ( a )  b")
    assert r["text"] == "bold! (a) b" and r["fixed"][0] == "unicode space U+202F"
    assert one(spark, T.strip_echoed_markers, "bullet", "- bullet")["text"] == "bullet"
    assert one(spark, T.strip_echoed_markers, "- bullet", "- bullet")["text"] == "- bullet"
    assert one(spark, lambda a: T.match_case(a, F.lit("WORD")), "emphasise") == "EMPHASISE"
    assert "emphasize" in one(spark, T.spelling_variants, "emphasise")
    assert one(spark, lambda a: T.rewrap(a, F.lit(11)), "aaa bbb ccc ddd") == "aaa bbb ccc\nddd"
    assert one(spark, lambda a: T.strip_continuation(a, F.lit("> ")), "a\n> b\n>c") == "a\nb\nc"


def test_vocabulary_keeps_first_form(spark):
    assert one(spark, T.vocabulary, "Colour colour Work") == {"colour": "Colour", "work": "Work"}
