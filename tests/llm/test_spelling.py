import random
import re
import zlib
from collections import Counter

import cases
import pytest
from panelloom.llm import spelling
import panelloom.llm.queries  # noqa: F401  (registers the queries)
from panelloom.llm.registry import ORACLES, QUERIES


def counted(rows, letters, least, noise):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if noise and h % noise == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= letters and n >= least}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(words, ratio=spelling.RATIO):
    out, form = {}, {}
    for w, n in words.items():
        near = sorted(((-words[v], v) for v in words if v != w and one_apart(w, v)))
        best = (near[0][1], -near[0][0]) if near and -near[0][0] >= ratio * n else (None, None)
        form[w] = best[0]
        out[w] = (n, len(near), *best)
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out[w] += (end,)
    return out


def invented(seed, count):
    """Words over few letters, so that many are near each other, some repeated letters and some very long."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(count)}
    words |= {"a" * k for k in range(6, 14)} | {"x" * 500, "x" * 501, "x" * 250 + "y" + "x" * 249, "ab" * 40, "ba" * 40, "\U0001f600words", "wordsñ日"}
    return {w: rng.choice([5, 6, 30, 31, 200, 1000, 25, 5000]) for w in sorted(words)}


@pytest.mark.parametrize("page, spread", [(1024, 8192), (32, 16), (1, 3)])
def test_groups_equal_brute_force(spark, page, spread):
    words = invented(page, 300)
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.groups(table, page=page, spread=spread).collect()}
    assert got == grouped(words)


@pytest.mark.parametrize("letters, least, noise", [(6, 5, 199), (6, 2, 7), (1, 1, 0), (3, 1, 2)])
def test_vocabulary_equals_brute_force(spark, letters, least, noise):
    got = spelling.vocabulary(cases.documents(spark), letters, least, noise).collect()
    assert {r.word: r.n for r in got} == counted([(r[0], r[1]) for r in cases.rows()], letters, least, noise)


def test_counts_that_leave_a_task_early(spark):
    got = spelling.vocabulary(cases.documents(spark), held=3).collect()
    assert {r.word: r.n for r in got} == counted([(r[0], r[1]) for r in cases.rows()], 6, 5, 199)


def test_empty_tables(spark):
    assert spelling.groups(spelling.vocabulary(cases.empty(spark))).count() == 0


def test_query_equals_sql(spark, sf):
    from compare import compare, database

    assert compare(QUERIES["op13_spelling_variants"](spark, sf), database(sf), ORACLES["op13_spelling_variants"]) == []
