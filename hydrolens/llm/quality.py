"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression of the whole text (no user function, no
shuffle), every rule compares a ratio of two measures with a limit. Rules are
compared as products of whole numbers, so no verdict hangs on a rounded ratio.

Defined results: a NULL or empty text has no words and fails the base rules;
rows are judged one by one, so ties, repeated rows and NULLs in other columns
play no part; extra columns pass through, and a column of the input that bears
the name of a measure is replaced by the measure; an empty table gives an empty
result. Rules that hold for some languages only (``Rule.languages``) pass texts
that name another language in ``lang``, and texts whose letters are mostly of
another script than the Latin one; a NULL ``lang``, or none, leaves it to the script.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is it that for on as are be this with or an was at by have from not but "
    "der die das und in zu den von ist des mit sich dem ein eine nicht auf für es im als auch "
    "de la le et les des en un une du que est pour qui dans par sur pas au avec "
    "el los las y que se del un una por con su para es al lo como no"
)

#: Languages of the stop words, as ``lang`` names them, and languages whose words stand apart in Latin letters.
LANGUAGES = ("en", "de", "fr", "es")

#: The characters counted as symbols, and the white space between words.
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``low * per <= scale * measure <= high * per`` (a missing limit is no limit).

    Texts of fewer than ``from_words`` words are too short for the ratio to say anything.
    A rule with ``languages`` passes texts of other languages or scripts.
    """

    name: str
    measure: str
    per: str | None = None
    low: int | None = None
    high: int | None = None
    scale: int = 100
    from_words: int = 0
    languages: tuple[str, ...] = ()


#: The contract's base rules: texts of at least ten words, at most a fifth of them in repeated windows.
BASE = (
    Rule("words", "n_words", low=10, scale=1),
    Rule("repeated words", "n_repeat_words", per="n_words", high=20),
)

#: The method's own rules; limits in hundredths of the second measure.
RULES = (
    Rule("mean word length", "word_chars", per="n_words", low=200, high=1500, languages=LANGUAGES),
    Rule("symbols per word", "n_symbols", per="n_words", high=30),
    Rule("stop words", "n_stop_words", per="n_words", low=2, from_words=40, languages=LANGUAGES),
    Rule("repeated lines", "n_dup_lines", per="n_lines", high=50),
    Rule("words in capitals", "n_upper_words", per="n_words", high=50),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where lambdas below refer to it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _repeated(ws: Column) -> Column:
    """Words that lie in a window of five words found twice or more, the first one included.

    Windows are told apart by a 64-bit hash of their words' hashes. Most texts
    repeat no window, so only the others pay for the sort that finds the places.
    """
    n, none = F.size(ws), F.lit(0).cast("bigint")

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        return F.aggregate(
            F.transform(starts, lambda p, k: F.when(k < last, F.least(F.lit(WINDOW), F.get(starts, k + 1) - p))
                        .otherwise(F.lit(WINDOW))),
            none, lambda a, x: a + x)

    def twice(s: Column) -> Column:
        at = lambda k: F.get(s, k)["h"]  # noqa: E731 - NULL past either end
        both = F.filter(s, lambda x, k: F.coalesce(at(k - 1) == x["h"], F.lit(False))
                        | F.coalesce(at(k + 1) == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(both, lambda x: x["i"])), covered)

    def places(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), none).otherwise(let(by_hash, twice))

    def windows(hs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hs) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(hs, i + j) for j in range(WINDOW)]))

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(n >= WINDOW, let(let(hashed, windows), places)).otherwise(none)


def measures(text: Column, stop_words: str = STOP_WORDS) -> dict[str, Column]:
    """Name to expression of every measure of a text; words and lines are split once."""
    t = F.coalesce(text, F.lit(""))
    stop = sorted({v + end for w in stop_words.split() for v in (w, w.capitalize()) for end in ("", ".", ",")})
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            _repeated(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: w.isin(stop))).cast("bigint").alias("n_stop_words"),
            F.size(F.filter(ws, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))
                   ).cast("bigint").alias("n_upper_words"))

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("bigint").alias("n_lines"),
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"))

    return {
        "words": let(words_of(text), of_words), "lines": let(lines, of_lines),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("bigint"),
        "n_other_letters": F.length(F.regexp_replace(t, r"[\P{L}\p{IsLatin}]+", "")).cast("bigint"),
    }


def holds(rule: Rule, measure: dict[str, Column], lang: Column | None = None) -> Column:
    value = measure[rule.measure] * rule.scale
    per = measure[rule.per] if rule.per else F.lit(1)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= per * rule.low)
    if rule.high is not None:
        ok = ok & (value <= per * rule.high)
    if rule.languages:
        ok = ok | (2 * measure["n_other_letters"] > measure["word_chars"])
        if lang is not None:
            ok = ok | F.coalesce(~lang.isin(*rule.languages), F.lit(False))
    return ok | (measure["n_words"] < rule.from_words) if rule.from_words else ok


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
            "n_upper_words", "n_other_letters")


def _judged(docs: DataFrame, text: str, base: tuple[Rule, ...], rules: tuple[Rule, ...], stop_words: str, lang: str) -> Column:
    """The measures and the verdict of a text, in one struct."""
    named = F.col(lang).cast("string") if lang in docs.columns else None

    def verdicts(m: Column) -> Column:
        of = {"words": ("n_words", "n_repeat_words", "n_stop_words", "n_upper_words"), "lines": ("n_lines", "n_dup_lines")}
        known = {c: m[part][c] for part, cs in of.items() for c in cs} | {c: m[c] for c in ("word_chars", "n_symbols", "n_other_letters")}
        broken = F.filter(F.array(*[F.when(~holds(r, known, named), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
        failed = F.lit(False)
        for r in base:
            failed = failed | ~holds(r, known, named)
        return F.struct(*[known[c].alias(c) for c in MEASURES], failed.alias("base_failed"), broken.alias("failed"),
                        (F.size(broken) == 0).alias("kept"))

    # one expression: a filter on ``kept`` that Spark moves below the projection still measures a text once
    return let(F.struct(*[c.alias(n) for n, c in measures(F.col(text), stop_words).items()]), verdicts)


def judge(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES,
          stop_words: str = STOP_WORDS, lang: str = "lang") -> DataFrame:
    """Input columns with the measures, ``base_failed``, ``kept`` and ``failed`` (names of the rules broken)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c == text or c not in (*MEASURES, "base_failed", "kept", "failed")]
    return docs.select(*rest, _judged(docs, text, base, rules, stop_words, lang).alias("__judged")).select(*rest, "__judged.*")


def passing(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES,
            stop_words: str = STOP_WORDS, lang: str = "lang") -> DataFrame:
    """The rows that break no rule, with all columns as they came, whatever their names."""
    return docs.where(_judged(docs, text, base, rules, stop_words, lang)["kept"])
