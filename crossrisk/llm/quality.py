"""Quality rules: a table of thresholds compiled into one projection.

Every measure is an expression on the whole text, evaluated by Spark itself; no user function, no shuffle.  Words are runs
of characters other than space and 0x09-0x0D.  Repeated three-word windows are found by sorting packed numbers (33 bits of
hash, 31 of position); windows whose bits agree are compared as strings, so hashes decide nothing.

Null and empty texts have no words and fail the length rule; ratios with a zero denominator are 0.  Each row stands for
itself, so repeated rows repeat.  Columns other than the text pass through, and none of them clashes: the measures live in
one struct column whose name the caller gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the characters counted as symbols
SYMBOLS = "[#*$%&|<>]"
GAP = "[\\x20\\x09-\\x0D]+"
# frequent function words of English, French, German and Spanish
STOP_WORDS = ["a", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "in", "is", "it",
              "its", "not", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "were", "which", "with", "you",
              "au", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "ils", "je", "la", "le", "les", "mais",
              "ne", "nous", "ou", "par", "pas", "plus", "pour", "qu", "que", "qui", "sur", "un", "une", "vous",
              "aber", "als", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "die", "ein", "eine", "einer", "er", "es",
              "für", "ich", "im", "ist", "mit", "nicht", "oder", "sich", "sie", "sind", "und", "von", "wie", "wir", "zu", "zum",
              "al", "como", "con", "del", "el", "esta", "las", "lo", "los", "mi", "más", "no", "o", "para", "pero", "por", "se", "su",
              "sus", "una", "y"]
#: rule, measure, least, most; None: no bound
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("words", "n_words", 50, None),
    ("repeated_windows", "repeat_ratio", None, 0.5),
    ("mean_word_length", "mean_word_length", 1.5, 30),
    ("symbols", "symbol_ratio", None, 0.25),
    ("stop_words", "stop_ratio", 0.005, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
]
BASE_RULES = ("words", "repeated_windows")
POSITION = (1 << 31) - 1


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _places(n: Column) -> Column:
    """0 .. n - 1, empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that stand in the text twice or more."""
    def window(p):
        return [F.get(words, p + i) for i in range(size)]

    def like_neighbour(array, key):
        return lambda v, j: F.coalesce(key(v) == key(F.get(array, j - 1)), F.lit(False)) | F.coalesce(
            key(v) == key(F.get(array, j + 1)), F.lit(False))

    packed = F.transform(_places(F.size(words) - (size - 1)), lambda p: F.xxhash64(*window(p)).bitwiseAND(~POSITION).bitwiseOR(
        p.cast("long")))
    alike = let(F.sort_array(packed), lambda s: F.filter(s, like_neighbour(s, lambda v: F.shiftright(v, 31))))
    written = F.transform(alike, lambda v: let(v.bitwiseAND(POSITION).cast("int"), lambda p: F.struct(
        F.concat_ws(" ", *window(p)).alias("g"), p.alias("p"))))
    twice = let(F.sort_array(written), lambda s: F.filter(s, like_neighbour(s, lambda v: v["g"])))
    covered = F.flatten(F.transform(twice, lambda v: F.array(*[v["p"] + i for i in range(size)])))
    return F.size(F.array_distinct(covered))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(text: Column) -> Column:
    """A struct with every measure that a rule can name."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.lit(" \t\n\x0b\x0c\r"), x)) > 0)

    def counted(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"))

    def finished(c):
        dup = c["lines"]["n"] - c["lines"]["d"]
        return F.struct(
            c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
            dup.alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"), c["n_stop_words"].alias("n_stop_words"),
            _ratio(c["n_repeat_words"], c["n_words"]).alias("repeat_ratio"),
            _ratio(c["word_chars"], c["n_words"]).alias("mean_word_length"),
            _ratio(c["n_symbols"], c["n_words"]).alias("symbol_ratio"),
            _ratio(c["n_stop_words"], c["n_words"]).alias("stop_ratio"),
            _ratio(dup, c["lines"]["n"]).alias("dup_line_ratio"))
    return let(let(words, counted), finished)


def failed(measured: Column, rules=RULES) -> Column:
    """The names of the broken rules, in the order of the table."""
    broken = []
    for name, measure, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (measured[measure] < least)
        if most is not None:
            bad = bad | (measured[measure] > most)
        broken.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*broken))


def measured(docs: DataFrame, rules=RULES, name: str = "quality") -> DataFrame:
    """``docs`` with a struct column of all measures, the broken rules and the verdict."""
    whole = let(measures(F.col("text")), lambda m: let(failed(m, rules), lambda bad: F.struct(
        m.alias("measures"), bad.alias("failed"), (F.size(bad) == 0).alias("kept"))))
    return docs.withColumn(name, whole)


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows that break no rule, with their own columns."""
    verdict = let(measures(F.col("text")), lambda m: F.size(failed(m, rules)) == 0)
    return docs.where(verdict)
