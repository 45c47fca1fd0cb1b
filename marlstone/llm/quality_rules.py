"""Quality rules: a threshold table compiled into one projection of native expressions.

Each rule names a measure, a lower and an upper limit; a document is kept if it passes all.
Measures come from the words of the text (maximal runs of anything but ASCII white space),
its lines (between line feeds) and its characters. No user function runs.

Null and empty texts have no words: they fail the base rules. Repeated rows are judged row by
row. The result has the key and the measures only, so other columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, split_words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "on", "as", "are", "this", "it",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "ein", "nicht",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "dans",
    "el", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "y",
]

#: measure, least, most (None: open). Ratios are of words unless they say lines.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_chars", 2, 16),
    ("symbol_ratio", None, 0.1),
    ("alphabetic_ratio", 0.7, None),
    ("stop_word_ratio", 0.05, None),
    ("dup_line_ratio", None, 0.5),
    ("ellipsis_line_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""
    n = F.size(words)
    keyed = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )

    def covered(s: Column) -> Column:
        h = lambda i: F.get(s, i)["h"]
        twice = F.filter(s, lambda x, i: F.coalesce(x["h"] == h(i - 1), F.lit(False)) | F.coalesce(x["h"] == h(i + 1), F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["p"])), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x))

    return let(F.sort_array(keyed), covered)


def measures(text: Column) -> Column:
    """One struct of all measures of a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    without = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))

    def of(words: Column, lines: Column) -> Column:
        n, chars = F.size(words), without(SPACES)
        symbols = F.char_length(text) - without("[#*$%&|<>]")
        full = F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        n_full = F.size(full)
        dup = n_full - F.size(F.array_distinct(full))
        return let(_repeat_words(words), lambda repeat: F.struct(
            n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"), repeat.cast("long").alias("n_repeat_words"),
            share(repeat, n).alias("repeat_word_ratio"), share(chars, n).alias("mean_word_chars"), share(symbols, n).alias("symbol_ratio"), share(dup, n_full).alias("dup_line_ratio"),
            share(F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))), n).alias("alphabetic_ratio"),
            share(F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))), n).alias("stop_word_ratio"),
            share(F.size(F.filter(full, lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))), n_full).alias("ellipsis_line_ratio"),
            share(F.size(F.filter(full, lambda x: x.rlike("^\\s*[-*•]"))), n_full).alias("bullet_line_ratio"),
        ))

    return let(split_words(text, SPACES), lambda w: let(F.split(text, "\n"), lambda x: of(w, x)))


def verdict(m: Column, rules=None) -> Column:
    """True if the measures in struct m pass every rule."""
    tests = []
    for name, least, most in RULES if rules is None else rules:
        v = m[name]
        tests += [v >= least] if least is not None else []
        tests += [v <= most] if most is not None else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", rules=None) -> DataFrame:
    """key, every measure, base_failed and kept."""
    base = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    scored = df.select(F.col(key), measures(F.col(text)).alias("m"))
    return scored.select(key, "m.*", base.alias("base_failed"), (~base & verdict(F.col("m"), rules)).alias("kept"))
