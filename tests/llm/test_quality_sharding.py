import re
from collections import Counter

import cases
import pytest
from panelloom.llm import quality, sharding
import panelloom.llm.queries  # noqa: F401  (registers the queries)
from panelloom.llm.registry import ORACLES, QUERIES


def measured(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark):
    got = quality.judge(cases.documents(spark)).collect()
    want = sorted(measured(t) for _, t in cases.texts())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_reject_symbols_and_keep_prose(spark):
    kept = {r.doc_id for r in quality.judge(cases.documents(spark)).collect() if r.kept}
    assert {1, 2, 8} <= kept and not kept & {5, 6, 7, 9, 14, 15}


def test_keep_has_the_columns_of_its_input(spark):
    docs = cases.documents(spark)
    out = quality.keep(docs)
    assert out.schema == docs.schema and 0 < out.count() < docs.count()
    assert quality.keep(cases.empty(spark)).count() == 0 and quality.judge(cases.empty(spark)).count() == 0


def test_query_equals_sql(spark, sf):
    from compare import compare, database

    assert compare(QUERIES["op6_quality_rules"](spark, sf), database(sf), ORACLES["op6_quality_rules"]) == []


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_gapless(spark, shards):
    rows = sharding.assign(spark, cases.documents(spark), shards).collect()
    texts = cases.texts()
    assert len(rows) == len(texts)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert sorted(r["size"] for r in rows) == sorted(len(t.encode()) + 1 for _, t in texts)
    assert sharding.assign(spark, cases.empty(spark), shards).count() == 0


def test_shards_equal_the_serial_ring(spark, sf):
    """The same rule, one document after another: the arcs in turn, ranks in ring order."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keyed = docs.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    places = {r.doc_id: (r.place % sharding.CELLS, r.place) for r in keyed.select("doc_id", F.xxhash64("doc_id", "size", "crc").alias("place")).collect()}
    room = [len(places) // 8 + (s < len(places) % 8) for s in range(8)]
    want = {}
    for _, low, high, clockwise in sharding.ring(8):
        for doc in sorted((d for d, (c, _) in places.items() if low <= c <= high), key=lambda d: places[d]):
            shard = next(s for s in clockwise if room[s])
            room[shard] -= 1
            want[doc] = shard
    assert {r.doc_id: r.shard for r in sharding.assign(spark, docs).collect()} == want


def test_most_documents_stay_at_their_node(spark, sf):
    """Adding a shard moves few documents beyond the new shard's share."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, after = ({r.doc_id: r.shard for r in sharding.assign(spark, docs, n).collect()} for n in (8, 9))
    assert sum(before[d] != after[d] for d in before) < 0.5 * len(before)
