"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Frequent words of English, Spanish, French and German, in lower case.
STOP_WORDS = (
    *("the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "on", "as", "was", "are", "by", "this", "a"),
    *("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "una", "con", "para", "es", "al"),
    *("le", "et", "les", "des", "est", "dans", "qui", "pour", "pas", "sur", "par", "avec", "du", "au"),
    *("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "auf", "nicht", "ein", "eine", "dem", "im", "ich", "des", "er"),
)


@dataclass(frozen=True)
class Rule:
    """A row passes where ``low <= value <= high`` (None: no bound). A null value passes."""

    name: str
    value: Callable[[dict[str, Column]], Column]
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_chars", lambda m: F.try_divide(m["word_chars"], m["n_words"]), 2.0, 14.0),
    Rule("symbols_per_word", lambda m: F.try_divide(m["n_symbols"], m["n_words"]), high=0.2),
    Rule("exclamations_per_word", lambda m: F.try_divide(m["n_exclamations"], m["n_words"]), high=0.5),
    Rule("stop_word_kinds", lambda m: m["n_stop_kinds"], low=1),
    Rule("repeated_line_share", lambda m: F.try_divide(m["n_dup_lines"], m["n_lines"]), high=0.6),
)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words covered by windows whose word sequence occurs twice or more in the array.

    Windows are compared by 64-bit hashes within one text. Only texts with a
    repeated window are sorted.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            twin = F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)) | F.coalesce((i > 0) & (F.get(s, i - 1)["h"] == e["h"]), F.lit(False)))
            return let(F.array_sort(F.transform(twin, lambda e: e["i"])), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(by_hash, again)).otherwise(0)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) > window, let(hashes, covered)).otherwise(0)


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row each: doc_id, the counts, base_failed, kept and a column per rule.

    Counts cover the whole text; null text has no words. ``base_failed``:
    under 20 words, or over 30 % of words in repeated 8-word windows. ``kept``
    needs the base rules and every rule of the table. Rows are judged one by
    one, so null or repeated doc_ids and other columns make no difference.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    split = docs.select("doc_id", text.alias("t"), words.alias("w"), lines.alias("l"))
    count = lambda c: c.cast("long")
    counts = split.select(
        "doc_id",
        count(F.size("w")).alias("n_words"),
        count(F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).alias("word_chars"),
        count(F.regexp_count("t", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        count(F.regexp_count("t", F.lit("!"))).alias("n_exclamations"),
        count(F.size("l")).alias("n_lines"),
        count(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        count(F.size(F.array_intersect("w", F.array(*map(F.lit, dict.fromkeys(STOP_WORDS)))))).alias("n_stop_kinds"),
        count(repeated_words(F.col("w"))).alias("n_repeat_words"),
    )
    m = {c: F.col(c) for c in counts.columns}
    base_failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])

    def passes(r: Rule) -> Column:
        v, ok = r.value(m), F.lit(True)
        if r.low is not None:
            ok = ok & (v >= r.low)
        if r.high is not None:
            ok = ok & (v <= r.high)
        return F.coalesce(ok, F.lit(True))

    named = {f"rule_{r.name}": passes(r) for r in rules}
    verdict = ~base_failed
    for ok in named.values():
        verdict = verdict & ok
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), verdict.alias("kept"), *[v.alias(k) for k, v in named.items()])
