"""Column functions over texts: extraction, counting, checks, comparison, repair, layout, costs.

All take and return Columns and treat null as SQL does: a null text gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_space(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"\A[{P.SPACE}]+|[{P.SPACE}]+\z", "")


def without_sentinels(text: Column) -> Column:
    return F.regexp_replace(text, P.SENTINEL, " ")


def sentinels(text: Column) -> Column:
    """Numbers of the placeholders of a text, in order."""
    return _all(text, r"\[\[(\p{Nd}+)\]\]", 1)


def word_count(text: Column) -> Column:
    return F.size(_all(without_sentinels(text), rf"[^{P.SPACE}]+"))


def long_enough(text: Column) -> Column:
    return word_count(text) >= P.MIN_WORDS


def has_words(text: Column) -> Column:
    """Any letter besides placeholders."""
    return F.regexp_replace(text, P.SENTINEL, "").rlike(r"\p{L}")


def strip_comments(source: Column) -> Column:
    return F.regexp_replace(source, P.COMMENT, "")


def is_standalone(source: Column) -> Column:
    return strip_comments(source).rlike(P.DOCUMENT)


def includes(source: Column) -> Column:
    """Names that a source includes, in order."""
    return _all(strip_comments(source), P.INCLUDE, 1)


def strip_control_tokens(text: Column) -> Column:
    return F.regexp_replace(text, P.CONTROL_TOKEN, "")


# ---- multisets and counts


def numbers(text: Column) -> Column:
    """Sorted multiset of digit sequences; separators inside a number don't count."""
    return F.sort_array(F.transform(_all(without_sentinels(text), P.NUMBER), lambda x: F.regexp_replace(x, r"[^\p{Nd}]", "")))


def identifiers(text: Column) -> Column:
    """Sorted multiset of tokens that begin with a letter and hold a digit."""
    return F.sort_array(F.transform(_all(without_sentinels(text), P.IDENTIFIER), lambda x: F.regexp_replace(x, r"[.-]+\z", "")))


def escapes(text: Column) -> Column:
    return F.sort_array(_all(without_sentinels(text), P.ESCAPE))


def _cues(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.transform(_all(without_sentinels(text), P.LETTERS), F.lower), lambda w: w.isin(words) | w.endswith("n't")))


def negation_count(text: Column) -> Column:
    return _cues(text, P.NEGATIONS)


def hedge_count(text: Column) -> Column:
    """Hedging cues; a word that ends in n't counts here as well."""
    return _cues(text, P.HEDGES)


def sentence_count(text: Column) -> Column:
    """Ends of sentences by full stops alone, at least 1."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.size(_all(strip_space(without_sentinels(text)), P.SENTENCE_END))))


def _runs(values: Column, sign: int) -> Column:
    """(value, signed length) of the runs of equal values of a sorted array."""

    def lengths(z: Column) -> Column:
        at = lambda k: F.element_at(z["starts"], k)
        end = lambda i: F.when(i + 1 < F.size(z["starts"]), F.try_element_at(z["starts"], i + 2)).otherwise(F.size(z["v"]) + 1)
        return F.transform(z["starts"], lambda s, i: F.struct(F.element_at(z["v"], s).alias("x"), (sign * (end(i) - at(i + 1))).cast("int").alias("n")))

    def runs(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 1) | (F.element_at(v, i) != F.element_at(v, F.greatest(i - 1, F.lit(1)))))
        return let(F.struct(v.alias("v"), starts.alias("starts")), lengths)

    return let(values, runs)


def multiset_delta(a: Column, b: Column) -> Column:
    """(x, n) of the elements whose counts differ in two sorted arrays, n being the count in ``a`` less that in ``b``; sorted by x.

    The runs of both are sorted together and neighbours are added, so that the work grows as a sort does."""

    def summed(c: Column) -> Column:
        def one(i: Column) -> Column:
            here, before, after = F.element_at(c, i), F.try_element_at(c, F.greatest(i - 1, F.lit(1))), F.try_element_at(c, i + 1)
            n = here["n"] + F.when(after["x"] == here["x"], after["n"]).otherwise(0)
            return F.struct(here["x"].alias("x"), F.when((i > 1) & (before["x"] == here["x"]), 0).otherwise(n).alias("n"))

        every = F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), one))
        return F.filter(F.coalesce(every, F.array().cast("array<struct<x:string,n:int>>")), lambda r: r["n"] != 0)

    merged = lambda z: F.sort_array(F.concat(_runs(z["a"], 1), _runs(z["b"], -1)))
    none = F.array().cast("array<struct<x:string,n:int>>")
    both = lambda z: F.when(z["a"] == z["b"], none).when(z["a"].isNotNull() & z["b"].isNotNull(), let(merged(z), summed))
    return let(F.struct(a.alias("a"), b.alias("b")), both)


def surplus(delta: Column, sign: int = 1) -> Column:
    """Elements of one side of a ``multiset_delta`` beyond their count in the other, with multiplicity."""
    return F.flatten(F.transform(F.filter(delta, lambda r: sign * r["n"] > 0), lambda r: F.array_repeat(r["x"], sign * r["n"])))


def multiset_minus(a: Column, b: Column) -> Column:
    """Elements of the sorted array ``a`` beyond their count in ``b``, with multiplicity."""
    return surplus(multiset_delta(a, b))


def content_words(text: Column) -> Column:
    """Set of lower-case words of more than two letters that are no stop words."""
    w = F.transform(_all(text, P.CONTENT_WORD), F.lower)
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(P.STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 1 if both are empty."""
    share = lambda z: F.when((F.size(z["a"]) == 0) & (F.size(z["b"]) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(z["a"], z["b"])) / F.size(F.array_union(z["a"], z["b"])))
    return let(F.struct(a.alias("a"), b.alias("b")), share)


def candidate_terms(text: Column) -> Column:
    """Set of hyphenated, capitalised and coined terms, without those inside another."""
    found = F.array_distinct(F.concat(_all(text, P.HYPHENATED), _all(text, P.CAP_PHRASE), _all(text, P.COINED)))
    return let(found, lambda f: F.filter(f, lambda t: ~F.exists(f, lambda o: (o != t) & F.contains(o, t))))


# ---- checks


def _check(ok: Column, name: str, detail: Column) -> Column:
    return F.struct(ok.alias("ok"), F.lit(name).alias("name"), F.when(ok, F.lit("")).otherwise(detail).alias("detail"))


def _listed(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def _differs(a: Column, b: Column, word: str) -> Column:
    return let(multiset_delta(a, b), lambda d: _shown(surplus(d), surplus(d, -1), word))


def _shown(lost: Column, gained: Column, word: str) -> Column:
    part = lambda a, w: F.transform(F.filter(F.array(a), lambda x: F.size(x) > 0), lambda x: F.concat(F.lit(f"{w} "), _listed(x)))
    return F.array_join(F.concat(part(lost, "lost"), part(gained, word)), ", ")


def check_nonempty(src: Column, out: Column) -> Column:
    return _check(strip_space(out) != "", "nonempty", F.lit("model returned nothing"))


def _equal(a: Column, b: Column, name: str, word: str) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda z: _check(z["a"] == z["b"], name, _differs(z["a"], z["b"], word)))


def check_sentinels(src: Column, out: Column) -> Column:
    return _equal(F.sort_array(sentinels(src)), F.sort_array(sentinels(out)), "sentinels", "invented")


def check_control_tokens(src: Column, out: Column) -> Column:
    return let(F.sort_array(F.array_distinct(_all(out, P.CONTROL_LEAK))), lambda x: _check(F.size(x) == 0, "control_tokens", F.concat(F.lit("leaked "), _listed(x))))


def check_chatter(src: Column, out: Column) -> Column:
    opener = strip_space(F.regexp_extract(out, P.CHATTER, 0))
    return _check(~out.rlike(P.CHATTER) | src.rlike(P.CHATTER), "chatter", F.concat(F.lit("conversational opener '"), opener, F.lit("'")))


def check_length(src: Column, out: Column, lo: float = 0.5, hi: float = 2.0) -> Column:
    ratio = F.length(out) / F.greatest(F.length(src), F.lit(1))
    return _check((F.length(src) < 40) | ratio.between(lo, hi), "length", F.format_string(f"ratio %.2f outside [{lo}, {hi}]", ratio))


def check_numbers(src: Column, out: Column) -> Column:
    return _equal(numbers(src), numbers(out), "numbers", "gained")


def check_escapes(src: Column, out: Column) -> Column:
    return _equal(F.sort_array(_all(src, P.ESCAPE)), F.sort_array(_all(out, P.ESCAPE)), "escapes", "invented")


def check_negation(src: Column, out: Column) -> Column:
    text = lambda z: F.concat(z["a"].cast("string"), F.lit(" negation cue(s) became "), z["b"].cast("string"))
    return let(F.struct(negation_count(src).alias("a"), negation_count(out).alias("b")), lambda z: _check(z["a"] == z["b"], "negation", text(z)))


CHECKS = (check_nonempty, check_sentinels, check_control_tokens, check_chatter, check_length, check_numbers, check_escapes, check_negation)
SAME_LANGUAGE_ONLY = (check_negation,)


def verdict(src: Column, out: Column, same_language: bool = True, checks=CHECKS) -> Column:
    """Array of the checks' results; checks that compare words only run where both sides are one language."""
    return F.array(*[c(src, out) for c in checks if same_language or c not in SAME_LANGUAGE_ONLY])


def passed(checks: Column) -> Column:
    return F.forall(checks, lambda c: c.ok)


def summary(checks: Column) -> Column:
    return F.array_join(F.transform(F.filter(checks, lambda c: ~c.ok), lambda c: F.concat(c["name"], F.lit(": "), c["detail"])), "; ")


# ---- comparison


def _issue(kind: str, severity: str, differs: Column, detail: Column) -> Column:
    return F.when(differs, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), F.lit(severity).alias("severity")))


def _multiset_issue(kind: str, word: str):
    return lambda z: _issue(kind, "high", z["a"] != z["b"], _differs(z["a"], z["b"], word))


def compare(src: Column, out: Column) -> Column:
    """Every way in which a text's checkable claims differ from its source's, as an array of (kind, detail, severity)."""
    return let(F.struct(src.alias("a"), out.alias("b")), lambda z: _compare(z["a"], z["b"]))


def _compare(src: Column, out: Column) -> Column:
    two = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    found = []
    for kind, f, word in (("numbers", numbers, "gained"), ("identifiers", identifiers, "gained"), ("escapes", escapes, "invented")):
        found.append(let(two(f(src), f(out)), _multiset_issue(kind, word)))
    found.append(let(two(negation_count(src), negation_count(out)), lambda z: _issue("negation", "high", z["a"] != z["b"], F.format_string("%d negation cue(s) became %d", z["a"], z["b"]))))
    turn = lambda z: F.when(z["b"] < z["a"], "firmed up").otherwise("softened")
    found.append(let(two(hedge_count(src), hedge_count(out)), lambda z: _issue("hedging", "low", z["a"] != z["b"], F.format_string("%d hedge(s) became %d, %s", z["a"], z["b"], turn(z)))))
    far = lambda z: F.abs(z["a"] - z["b"]) > F.greatest(F.lit(1).cast("bigint"), F.floor(z["a"] / 3))
    found.append(let(two(sentence_count(src), sentence_count(out)), lambda z: _issue("structure", "low", far(z), F.format_string("%d sentence(s) became %d", z["a"], z["b"]))))
    return F.array_compact(F.array(*found))


# ---- repair


def _steps(text: Column, steps) -> Column:
    """Struct (text, fixed) after steps (condition, new text, label) taken one after another; each sees the text before it once."""
    acc = F.struct(text.alias("text"), F.array().cast("array<string>").alias("fixed"))
    for hit, new, label in steps:
        acc = let(acc, _step(hit, new, label))
    return acc


def _step(hit, new, label: str):
    def run(a):
        h = hit(a["text"])
        return F.struct(F.when(h, new(a["text"])).otherwise(a["text"]).alias("text"), F.when(h, F.array_append(a["fixed"], F.lit(label))).otherwise(a["fixed"]).alias("fixed"))

    return run


def _pattern(p: str, to: str):
    return (lambda t: t.rlike(p)), (lambda t: F.regexp_replace(t, p, to))


def _space(c: str):
    return (lambda t: F.contains(t, F.lit(c))), (lambda t: F.translate(t, c, " "))


def strip_pivot_artifacts(text: Column) -> Column:
    """Struct (text, fixed): spaces of the pivot language's typography put right, and what was."""
    steps = [(*_space(c), f"unicode space U+{ord(c):04X}") for c in P.PIVOT_SPACES]
    steps.append((*_pattern(rf"[{P.INLINE}]+([.,;:!?%)\]])", "$1"), "space before punctuation"))
    steps.append((*_pattern(rf"([(\[])[{P.INLINE}]+", "$1"), "space after opening bracket"))
    steps.append((*_pattern(rf"[{P.INLINE}]{{2,}}", " "), "repeated space"))
    return _steps(text, steps)


def _echo(p: str, original: Column):
    return (lambda t: t.rlike(p) & ~original.rlike(p)), (lambda t: F.regexp_replace(t, p, ""))


def strip_echoed_markers(original: Column, translated: Column) -> Column:
    """Struct (text, fixed): structural markers at the start that the original doesn't have."""
    return _steps(translated, [(*_echo(p, original), f"echoed {label}") for p, label in P.ECHOED])


def vocabulary(text: Column) -> Column:
    """Map from each lower-case word to the form in which it occurs first."""
    words = lambda w: F.struct(w.alias("w"), F.transform(w, F.lower).alias("k"))
    first = lambda z: let(F.array_distinct(z["k"]), lambda d: F.map_from_arrays(d, F.transform(d, lambda k: F.element_at(z["w"], F.array_position(z["k"], k).cast("int")))))
    return let(let(_all(text, P.WORD), words), first)


def spelling_variants(word: Column) -> Column:
    """Plausible other spellings of a lower-case word, in the order of the rules."""
    out = []
    for a, b in P.ENDINGS:
        for x, y in ((a, b), (b, a)):
            out.append(F.when(word.endswith(x), F.concat(F.substring(word, F.lit(1), F.length(word) - len(x)), F.lit(y))))
    tail = "(ed|ing|er|ers|est)"
    out.append(F.when(word.rlike(f"ll{tail}$"), F.regexp_replace(word, f"ll{tail}$", "l$1")))
    out.append(F.when(word.rlike(f"(?<!l)l{tail}$"), F.regexp_replace(word, f"(?<!l)l{tail}$", "ll$1")))
    return F.array_distinct(F.filter(F.array_compact(F.array(*out)), lambda v: v != word))


def match_case(form: Column, like: Column) -> Column:
    """``form`` in the capitalisation of ``like``."""
    upper = like.rlike(r"\p{Lu}") & (F.upper(like) == like) & (F.length(like) > 1)
    lead = F.substring(like, 1, 1).rlike(r"\p{Lu}")
    return F.when(upper, F.upper(form)).when(lead, F.concat(F.upper(F.substring(form, 1, 1)), F.substring(form, F.lit(2), F.length(form)))).otherwise(form)


# ---- layout


def strip_continuation(text: Column, prefix: Column) -> Column:
    """Without the container's prefix on every line but the first; a line without it is left-stripped."""
    lines = F.split(text, "\n", -1)
    out = F.transform(lines, lambda x, i: F.when(i == 0, x).when(x.startswith(prefix), F.substring(x, F.length(prefix) + 1, F.length(x))).otherwise(F.regexp_replace(x, r"\A[> \t]+", "")))
    return F.when((prefix == "") | prefix.isNull(), text).otherwise(F.array_join(out, "\n"))


def apply_continuation(text: Column, prefix: Column) -> Column:
    out = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(prefix, x)))
    return F.when((prefix == "") | prefix.isNull(), text).otherwise(F.array_join(out, "\n"))


def detect_width(text: Column) -> Column:
    """Column at which a text is wrapped by hand, or null."""
    sizes = F.transform(F.filter(F.split(text, "\n", -1), lambda x: strip_space(x) != ""), lambda x: F.length(x))

    def width(z):
        least = F.array_min(F.slice(z, F.lit(1), F.greatest(F.size(z) - 1, F.lit(1))))
        return F.when((F.size(z) >= 2) & (F.array_max(z) >= 20) & (least >= F.array_max(z) - 24), F.array_max(z))

    return let(sizes, width)


def rewrap(text: Column, width: Column, size=F.length) -> Column:
    """Greedy wrap of the tokens to ``width``; a token is never split. A blank text stays. ``size``: how wide a token is."""
    tokens = F.filter(F.split(text, rf"[{P.SPACE}]+", -1), lambda t: t != "")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    tokens = F.transform(tokens, lambda t: F.struct(t.alias("t"), size(t).alias("n")))

    def step(acc, token):
        t, n = token["t"], token["n"]
        fresh = acc.text == ""
        over = ~fresh & (acc.used + 1 + n > width)
        sep = F.when(fresh, F.lit("")).when(over, F.lit("\n")).otherwise(F.lit(" "))
        return F.struct(F.concat(acc.text, sep, t).alias("text"), F.when(fresh | over, n).otherwise(acc.used + 1 + n).alias("used"))

    return let(tokens, lambda z: F.when(F.size(z) == 0, text).otherwise(F.aggregate(z, start, step)["text"]))


def match_wrapping(original: Column, translated: Column) -> Column:
    """``translated`` wrapped as ``original`` is, if it is."""
    return let(detect_width(original), lambda w: F.when(w.isNull(), translated).otherwise(rewrap(translated, w)))


# ---- costs


def human_duration(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    m = s / 60
    whole = lambda x: F.bround(x, 0).cast("bigint").cast("string")
    hours, rest = F.floor(m / 60), F.floor(F.pmod(m, F.lit(60.0)))
    return (
        F.when(s < 1, "instant").when(s < 90, F.concat(whole(s), F.lit("s"))).when(m < 90, F.concat(whole(m), F.lit(" min")))
        .when(rest > 0, F.format_string("%dh %02dm", hours, rest)).when(s.isNotNull(), F.format_string("%dh", hours))
    )


def predict(chars: Column, segments: Column) -> Column:
    return segments * P.OVERHEAD_SECONDS + chars * P.SECONDS_PER_CHAR


def run_summary(total: Column, cached: Column, files: Column, chars: Column) -> Column:
    """The line that says how much work a run is."""
    rest = total - cached
    where = F.when(files > 1, F.format_string(" across %d files", files)).otherwise("")
    eta = human_duration(predict(chars, rest))
    return (
        F.when(total == 0, "nothing to translate").when(rest == 0, F.format_string("%d segments%s, all cached, this will be instant", total, where))
        .when(cached > 0, F.format_string("%d segments%s, %d already cached, %d to translate, ~%s", total, where, cached, rest, eta)).otherwise(F.format_string("%d segments%s, ~%s", total, where, eta))
    )


# ---- model boundary


def hop_chain(pivots: Column) -> Column:
    """Consecutive pairs of en, the pivots, en."""
    langs = F.concat(F.array(F.lit("en")), pivots, F.array(F.lit("en")))
    return F.transform(F.sequence(F.lit(1), F.size(langs) - 1), lambda i: F.struct(F.element_at(langs, i).alias("src"), F.element_at(langs, i + 1).alias("dst")))


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in P.LANGUAGES.items() for x in kv])
    return F.coalesce(names[F.lower(code)], code)


def cache_key(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts, each followed by a zero byte."""
    return F.substring(F.sha2(F.concat(*[F.concat(p, F.lit("\0")) for p in parts]), 256), 1, 32)


def rotate_words(text: Column) -> Column:
    """Stand-in for a translation: on every line the words move one place to the left, placeholders keep theirs."""

    mark = lambda w: w.rlike(rf"\A{P.SENTINEL}\z")

    def line(words):
        # a word takes the next one's place; its number among the words is the count of words before it
        before = lambda i: F.size(F.filter(F.slice(words, F.lit(1), i), lambda w: ~mark(w)))
        turned = lambda plain: F.transform(words, lambda w, i: F.when(mark(w), w).otherwise(F.try_element_at(plain, F.pmod(before(i) + 1, F.greatest(F.size(plain), F.lit(1))) + 1)))
        simple = F.concat(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), F.slice(words, F.lit(1), F.lit(1)))
        return F.array_join(F.when(F.exists(words, mark), let(F.filter(words, lambda w: ~mark(w)), turned)).otherwise(simple), " ")

    # a placeholder at a word's start stands alone, one glued behind a word is part of it
    words = lambda x: _all(x, rf"{P.SENTINEL}|[^{P.SPACE}]+")
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: let(words(x), line)), "\n")


def render_prompt(system: Column, user: Column, effort: str = "low", bos: bool = True) -> Column:
    if effort not in ("low", "medium", "high", "xhigh"):
        raise ValueError(f"unknown effort {effort!r}")
    s, u = strip_control_tokens(system), strip_control_tokens(user)
    head = ("<|begin_of_text|>" if bos else "") + "<|start|>system<|message|>"
    tail = f'\n\nReasoning strength: {effort}.\n\n# Valid recipients: "self", "user".<|eot|><|start|>user<|message|>'
    return F.concat(F.lit(head), s, F.lit(tail), u, F.lit("<|eot|><|start|>assistant"))


def parse_response(raw: Column) -> Column:
    """Text of the blocks addressed to the user; without any, the raw text less its control tokens."""
    head = r"(?s)\A(?:\s*to=([^<\s]+))?\s*<\|message\|>(.*?)(?:<\|eom\|>|<\|eot\|>|\z)"
    blocks = F.filter(F.split(raw, r"<\|start\|>assistant", -1), lambda b: (b != "") & b.rlike(head))
    mine = F.filter(blocks, lambda b: F.regexp_extract(b, head, 1).isin("", "user"))
    text = strip_space(F.array_join(F.transform(mine, lambda b: F.regexp_extract(b, head, 2)), ""))
    return let(text, lambda t: F.when(t == "", strip_space(F.regexp_replace(raw, P.CONTROL_LEAK, ""))).otherwise(t))


def survival(seen: Column, survived: Column) -> Column:
    """Share that survived; 1 where nothing was seen."""
    return F.coalesce(F.try_divide(survived, seen), F.lit(1.0))
