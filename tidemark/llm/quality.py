"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

``measures`` gives the base counts of a text, ``judge`` adds the ratios and one
verdict from ``RULES``. Everything is evaluated row by row in the JVM: no
shuffle, no user function, and each text is cut into words once.

Defined results: a null text has no words, so that it fails the base rule; a
text without words has ratios 0. Repeated rows get equal results. An empty table gives an empty one. Other columns pass
through; ``judge`` replaces a column that has the name of its one result, ``keep_good`` adds none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "was", "are",
    "der", "die", "das", "und", "ist", "von", "mit", "den", "des", "ein", "eine", "nicht",
    "le", "la", "les", "et", "est", "une", "un", "que", "dans", "pour", "du",
    "el", "los", "las", "de", "y", "en", "por", "con", "se", "su",
]

#: measure, least, most (None: open). A text that breaks one is not kept.
RULES = [
    ("n_words", MIN_WORDS, None),
    ("n_words", None, 1_000_000),
    ("mean_word", 2.0, 14.0),
    ("symbols_per_word", None, 0.10),
    ("marks_per_word", None, 0.20),
    ("upper_share", None, 0.50),
    ("stop_share", 0.02, None),
    ("dup_line_share", None, 0.50),
    ("repeat_share", None, 0.30),
    ("same_share", None, 0.30),
]

#: The same without an upper limit of words: a long clean text is a good text.
CORPUS_RULES = [r for r in RULES if r[0] != "n_words" or r[2] is None]

#: The languages of STOP_WORDS. A corpus has others, whose texts can't be held to these words.
LISTED = ["en", "de", "fr", "es"]

_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def _repeats(words: Column) -> Column:
    """Words covered by windows of 8 words that occur twice or more in the text."""
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.array(hashes), _covered)[0]


def _covered(h: Column) -> Column:
    """From window hashes by place: the number of words in windows that are not alone."""
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def found(s: Column) -> Column:
        size = F.size(s)
        same = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < size - 1) & (F.get(s, k + 1)["h"] == x["h"])))
        at = F.array_sort(F.transform(same, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    repeated = F.size(F.array_distinct(h)) < F.size(h)
    return F.when(repeated, F.transform(F.array(placed), found)[0]).otherwise(0)


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def measures(text: Column) -> Column:
    """A struct of the base counts and of the ratios that RULES name."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")

    def of(words: Column) -> Column:
        solid = F.length(F.translate(whole, " \t\n\x0b\x0c\r", ""))
        letters = F.length(F.regexp_replace(whole, r"\P{L}+", ""))
        upper = F.length(F.regexp_replace(whole, r"\P{Lu}+", ""))
        base = F.struct(
            F.size(words).cast("long").alias("n_words"),
            solid.cast("long").alias("word_chars"),
            _count(whole, "#*$%&|<>").cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeats(words).cast("long").alias("n_repeat_words"),
            F.size(lines).alias("n_lines"),
            _count(whole, "!?").alias("n_marks"),
            letters.alias("letters"),
            upper.alias("upper"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop"),
            F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))).alias("n_same"),
        )
        return base

    b = F.transform(F.array(_words(text)), of)[0]

    def ratios(x: Column) -> Column:
        words = F.greatest(x["n_words"], F.lit(1))
        return F.struct(
            *(x[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            (x["word_chars"] / words).alias("mean_word"),
            (x["n_symbols"] / words).alias("symbols_per_word"),
            (x["n_marks"] / words).alias("marks_per_word"),
            (x["upper"] / F.greatest(x["letters"], F.lit(1))).alias("upper_share"),
            (x["n_stop"] / words).alias("stop_share"),
            (x["n_dup_lines"] / F.greatest(x["n_lines"], F.lit(1))).alias("dup_line_share"),
            (x["n_repeat_words"] / words).alias("repeat_share"),
            (x["n_same"] / words).alias("same_share"),
        )

    return F.transform(F.array(b), ratios)[0]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def passes(m: Column, rules: list = RULES) -> Column:
    """All rules of the table as one condition."""
    tests = [m[name] >= least for name, least, _ in rules if least is not None] + [m[name] <= most for name, _, most in rules if most is not None]
    return reduce(lambda a, b: a & b, tests)


def judge(docs: DataFrame, text_col: str = "text", rules: list = RULES, into: str = "quality") -> DataFrame:
    """``docs`` with a struct column: the measures, ``base_failed`` and ``kept``."""
    m = F.col(into)
    made = docs.withColumn(into, measures(F.col(text_col)))
    return made.withColumn(into, F.struct(F.col(f"{into}.*"), base_failed(m).alias("base_failed"), (~base_failed(m) & passes(m, rules)).alias("kept")))


def keep_good(docs: DataFrame, text_col: str = "text", rules: list = CORPUS_RULES, lang_col: str = "lang") -> DataFrame:
    """The rows that are kept, with their own columns only.

    The share of stop words counts where ``lang_col`` names a language that has a list (``LISTED``); where it is null, another one or missing, all other rules decide.
    """
    listed = F.coalesce(F.col(lang_col).isin(LISTED), F.lit(False)) if lang_col in docs.columns else F.lit(False)
    words, rest = ([r for r in rules if (r[0] == "stop_share") == own] for own in (True, False))

    def good(x: Column) -> Column:
        ok = ~base_failed(x) & passes(x, rest)
        return ok & (~listed | passes(x, words)) if words else ok

    return docs.where(F.transform(F.array(measures(F.col(text_col))), good)[0])
