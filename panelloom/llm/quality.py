"""Quality rules: one table of thresholds, compiled into one projection.

No user functions: words, lines and windows are arrays, and all counts are
expressions on them, so a document is judged where it is read, without a shuffle.

Defined cases: a null or empty text has no words and fails the base rule; rows with a
null identifier and repeated rows are judged as they stand; an empty table gives an
empty result; further columns of the input are ignored by `measure`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Characters that separate words, and characters counted as symbols.
BLANKS = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "[#*$%&|<>]"

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = ("the of and to in is that it for on with as are this by be from or an at "
              "der die das und zu den von mit ist ein eine nicht des auf im "
              "le la les et un une que en dans pour par sur est du qui au "
              "el los las de y con se del no lo su como").split()


@dataclass(frozen=True)
class Rule:
    """A ratio of measured counts (numerator over denominator) and the range that passes."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float

    def passes(self) -> Column:
        over = F.col(self.denominator)
        ratio = F.col(self.numerator) / F.when(over > 0, over)
        return F.coalesce(ratio.between(self.low, self.high), F.lit(True))


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("repeated_line_share", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def _bound(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`."""
    return F.transform(F.array(value), body)[0]


def _paired(hashes: Column, gap: int) -> Column:
    """Hash of element i with element i + gap."""
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(ordered):
        same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        marks = F.transform(ordered, lambda x, j: F.when(
            same(x, F.get(ordered, j - 1)) | same(x, F.get(ordered, j + 1)), x["i"]))
        return F.sort_array(F.filter(marks, lambda i: i.isNotNull()))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(_bound(tagged, repeated), start, step, lambda a: a["n"])


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text.

    Window hashes are doubled from word hashes (1, 2, 4, 8 words), so the cost is linear.
    """
    def judged(windows):
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_covered(windows))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = _bound(hashed, lambda a: _bound(_paired(a, 1), lambda b: _bound(_paired(b, 2), lambda c: _paired(c, 4))))
    return F.when(F.size(words) < WINDOW, 0).otherwise(_bound(windows, judged))


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the counts of each text; `prefix` keeps them apart from the input's own columns."""
    whole, words, lines = (f"__{prefix}{n}" for n in ("whole", "words", "lines"))
    names = {n: f"{prefix}{n}" for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                                         "n_repeat_words", "n_stop_words")}
    body = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    trimmed = F.btrim(F.col(whole), F.lit(" \t\n\x0b\f\r"))
    split = body.withColumns({
        words: F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS)),
        lines: F.filter(F.split(F.col(whole), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""),
    })
    known = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
    as_long = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(F.col(words), "")),
        "n_symbols": F.char_length(F.col(whole)) - F.char_length(F.regexp_replace(F.col(whole), SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(F.col(lines))),
        "n_repeat_words": repeat_words(F.col(words)),
        "n_stop_words": F.size(F.filter(F.col(words), lambda w: w.isin(known))),
    }
    counted = split.withColumns({names[k]: v.cast("long") for k, v in as_long.items()})
    return counted.drop(whole, words, lines)


def verdict(rules=RULES, prefix: str = "") -> tuple[Column, Column]:
    """(base_failed, kept) on the measured counts: every rule in one boolean expression."""
    n = F.col(f"{prefix}n_words")
    failed = (n < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MAX_REPEAT_PERCENT * n)
    passed = F.lit(True)
    for r in rules:
        passed = passed & Rule(r.name, prefix + r.numerator, prefix + r.denominator, r.low, r.high).passes()
    return failed, ~failed & passed


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts and verdict of every document."""
    failed, kept = verdict(rules)
    measured = measure(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return measured.drop("text").withColumns({"base_failed": failed, "kept": kept})


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that pass, with the input's columns and no others."""
    prefix = "__quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return measure(docs, prefix=prefix).filter(verdict(rules, prefix)[1]).select(docs.columns)
