"""Documents with nulls, empty and very long texts, repeated rows and clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

CLASHING = ("row", "name", "size", "bucket", "set_key", "score", "n_words", "word", "cell", "shard", "kept", "rest", "offset", "start")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "of", "and", "to", "in", "re", "tion", "blé", "ou", "st", "ing", "ä"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + rng.choice(["", "", "", ".", ",", "\n", " the"]) for w in out)


def rows() -> list[tuple]:
    long = prose(1, 30_000)
    base = prose(2, 400)
    near = base.replace(base.split()[200], "changed", 1)
    found = [(1, prose(3, 120)), (2, base), (3, base), (4, near), (5, ""), (6, None), (7, " \n\t "), (8, long),
             (9, "word"), (10, "two words"), (11, base[:700]), (12, prose(4, 300) + " " + base[300:900]), (None, prose(5, 80)),
             (None, prose(6, 60)), (13, "x" * 200_000), (14, "#$% " * 50), (15, "same line here\n" * 60), (15, "same line here\n" * 60),
             (16, prose(7, 90).upper()), (17, "ÀÉÎ é ẖ " * 30 + "  end"), (18, "it's we'll 12 345 ... !? <b>&amp;</b>\x00\x0b"),
             (19, "\U0001f600\U0001f680 " * 40), (-5, prose(8, 200))]
    return [(i, t, ("en", "de", None)[k % 3], "s", len(t or "")) for k, (i, t) in enumerate(found)]


def documents(spark, clashing: bool = True):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else df


def empty(spark):
    return documents(spark).limit(0)


def texts() -> list[tuple]:
    return [(i, t or "") for i, t, *_ in rows()]
