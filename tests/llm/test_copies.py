import hashlib
import random
import time
from collections import defaultdict

import cases
import numpy as np
import pytest
from panelloom.llm import graph, jaccard, suffixes
from panelloom.llm.words import word_hashes
from panelloom.sources.storage import stage


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_join(docs, width, percent):
    sets = [(i, shingle_set(t, width)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[root(k)].append(i)
    return sorted((str(i), len(s), str(min((x for x in groups[root(k)] if x is not None), default=None))) for k, (i, s) in enumerate(sets))


def family(seed, n, words, edits):
    """Near copies of one text: some linked, some not, all with frequent shingles."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("common", [1, 3, 32])
@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, common, width, percent):
    texts = family(1, 60, 120, 8) + family(2, 40, 30, 3) + family(3, 30, 11, 2)
    docs = [(i, t) for i, t in cases.texts()] + [(100 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as name", "2 as class", "3 as root").repartition(4)
    got = jaccard.join(df, width, percent, common).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_join(docs, width, percent)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_more_frequent_tokens_than_are_sent(spark, monkeypatch, width, percent):
    """Lists grow past `common` when few frequent tokens go along; no link is lost, and no list is paired as a whole."""
    monkeypatch.setattr(jaccard, "FREQUENT_TOKENS", 4)
    texts = family(1, 60, 120, 8) + family(2, 40, 30, 3) + family(3, 30, 11, 2)
    docs = [(i, t) for i, t in cases.texts()] + [(100 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = jaccard.join(df, width, percent, 8).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_join(docs, width, percent)


def test_long_lists_give_star_edges(spark):
    """One list of n sets gives n - 1 rows if it is longer than the limit, else all its pairs."""
    def rows(n, common):
        data = [np.full(n, 7 << 40, np.uint64), np.arange(1, n + 1, dtype=np.int64), np.full(n, 50, np.int32), np.zeros(n, np.uint8)]
        table = spark.createDataFrame([(0, *[bytes(x.tobytes()) for x in data])], "bucket long, token binary, keys binary, sizes binary, heavy binary")
        return jaccard._pairs(table, 90, common).collect()

    assert len(rows(16, 16)) == 120 and len(rows(17, 16)) == 16 and len(rows(5000, 16)) == 4999
    assert all(r.a == 1 and r.ma == r.mb == 1 for r in rows(5000, 16))


def test_shared_lines_do_not_join_candidates(spark, monkeypatch):
    """More frequent tokens than cells go along: lists of texts rich in rare tokens keep to the limit, and hardly any text is verified."""
    monkeypatch.setattr(jaccard, "FREQUENT_TOKENS", 256)
    lines = [" ".join(f"l{k}w{i}" for i in range(12)) for k in range(80)]
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(60)) + "\n" + lines[i % 80] + "\n" + lines[(7 * i + i // 80) % 80]) for i in range(240)]
    pairs, verified, seen = jaccard._pairs, jaccard._verified, {}
    monkeypatch.setattr(jaccard, "_pairs", lambda postings, *a: pairs(seen.setdefault("postings", postings), *a))
    monkeypatch.setattr(jaccard, "_verified", lambda docs, members, *a: verified(docs, seen.setdefault("members", members), *a))
    got = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), common=4).collect()
    lists = defaultdict(set)
    for r in seen["postings"].collect():
        for token, key, heavy in zip(np.frombuffer(r.token, np.uint64), np.frombuffer(r["keys"], np.int64), np.frombuffer(r.heavy, np.uint8)):
            lists[int(token)].add((int(key), bool(heavy)))
    assert max(len(x) for x in lists.values() if not all(heavy for _, heavy in x)) <= 4
    assert seen["members"].count() < 60 and all(r.component_id == r.doc_id for r in got)


def test_levels_put_frequent_tokens_last(spark):
    texts = [(i, f"a b c d{i} e{i} f{i} " + ("g h i" if i < 6 else f"x{i} y{i} z{i}")) for i in range(40)]
    found = jaccard._frequent(spark.createDataFrame(texts, "doc_id long, text string"), 3, 16, 4)
    every, some, once = (jaccard.levels(jaccard.token_sets([x], 3)[0], found)[0] for x in (b"a b c", b"g h i", b"no such words"))
    assert found.dtype == np.uint8 and every == 4 and some == 1 and once == 0
    tokens = jaccard.token_sets([texts[0][1].encode()], 3)[0]
    made, single, combined = jaccard.prefixes(tokens, found, 80)
    assert not made and not set(jaccard.token_sets([b"a b c", b"g h i"], 3)[0].tolist()) & set(single.tolist()) and not len(combined)


def shuffled_bytes(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(blocks.apply(i).length() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_"))


def test_texts_that_stay_are_not_exchanged(spark):
    """What the join leaves on disk as it ends is far below the texts, of which few have copies."""
    large = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(large)
    spark.conf.set(large, "-1")  # as for tables too large to be sent
    try:
        exchanged_texts(spark)
    finally:
        spark.conf.set(large, before)


def exchanged_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.randbytes(4).hex() for _ in range(200)) for _ in range(1500)]
    docs = stage(spark.createDataFrame(list(enumerate(texts + texts[:20])) + [(1, texts[1])], "doc_id long, text string").repartition(4))
    before = shuffled_bytes(spark)
    kept = jaccard.keep(docs)
    assert shuffled_bytes(spark) - before < 200_000 or not time.sleep(3) and shuffled_bytes(spark) - before < 200_000
    out = stage(kept)
    assert shuffled_bytes(spark) - before < sum(map(len, texts)) // 4
    assert sorted(tuple(r) for r in out.collect()) == sorted(enumerate(texts))


def test_blocks_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 500)
    docs = list(enumerate(family(4, 50, 100, 8)))
    got = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), common=3).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_join(docs, 3, 90)


def test_one_document_of_each_group_stays(spark):
    docs = cases.documents(spark)
    kept = jaccard.keep(docs)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert kept.schema == docs.schema and 2 in ids and 3 not in ids and 4 not in ids and ids.count(15) == 1 and {5, 6, 7} <= set(ids)
    assert jaccard.join(cases.empty(spark)).count() == 0 and jaccard.keep(cases.empty(spark)).count() == 0


def test_word_hashes_follow_lower_case_words():
    texts = [(t or "").encode() for _, t in cases.texts()] + [b"", b"A a", b"ab c", b"a bc"]
    hashes, counts = word_hashes(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist())))


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(50)] + [(2000, 2000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(51)}


def brute_cut(docs, length):
    seen, out = set(), []
    for i, t in sorted({(LAST if i is None else i, t) for i, t in docs}):
        covered = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if t[p:p + length] in seen:
                covered[p:p + length] = True
            seen.add(t[p:p + length])
        kept = bytes(b for b, c in zip(t, covered) if not c)
        runs = int((covered[1:] & ~covered[:-1]).sum() + covered[0])
        out.append((i, t, (len(t), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())))
    known = {(i, t): v for i, t, v in out}
    return sorted((i, *known[i, t]) for i, t in ((LAST if i is None else i, t) for i, t in docs))


LAST = suffixes.LAST_ID


def repeats():
    """Copies, shared passages and lines, repeats within a text, and runs of one character; names order equal ids."""
    rng = random.Random(9)
    line = cases.prose(70, 40)
    docs = [(i, (t or "").replace("x" * 200_000, "x" * 3000)[:20_000]) for i, t in cases.texts() if i is not None]
    for i in range(60):
        docs.append((200 + i, cases.prose(100 + i, 40) + line + cases.prose(300 + i, rng.randrange(5, 40))))
    docs += [(300 + i, cases.prose(100, 40)) for i in range(20)] + [(400, "ab" * 500 + "cd" * 200), (401, "b" + "ab" * 80)]
    return [(i, t.encode()) for i, t in docs]


@pytest.mark.parametrize("bits, bucket, piece", [(27, 12 << 20, 1 << 20), (27, 2000, 1 << 20), (4, 3000, 700)])
def test_cut_equals_brute_force(spark, monkeypatch, bits, bucket, piece):
    """Also with a full map, divided buckets and texts in pieces."""
    docs = repeats()
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string").selectExpr("*", "1 as name").repartition(6)
    for name, value in (("MAP_BITS", bits), ("BUCKET_BYTES", bucket), ("SLICE", piece)):
        monkeypatch.setattr(suffixes, name, value)
    got = suffixes.dedup(df).collect()
    assert sorted(tuple(r) for r in got) == brute_cut(docs, suffixes.LENGTH)


def test_cut_of_odd_documents(spark):
    docs = cases.documents(spark)
    got = suffixes.dedup(docs).collect()
    assert len(got) == docs.count() and {r.n_bytes for r in got} == {len(t.encode()) for _, t in cases.texts()}
    assert suffixes.dedup(cases.empty(spark)).count() == 0
    trimmed = suffixes.trim(docs)
    rows = trimmed.collect()
    assert trimmed.schema == docs.schema and len(rows) == docs.count()
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert [r.text for r in rows if r.doc_id == 2][0].strip() and [r.text for r in rows if r.doc_id == 3] == [""]


def python_steps(plan) -> tuple[int, int]:
    """Python steps that run together in one task: at the top of the plan, and the most below any shuffle."""
    children = plan.children()
    below = [python_steps(children.apply(i)) for i in range(children.size())]
    tops, most = [t for t, _ in below], max((m for _, m in below), default=0)
    here = (max if plan.nodeName() == "Union" else sum)(tops or [0])
    if "Exchange" in plan.nodeName():
        return 0, max(most, here)
    return here + any(x in plan.nodeName() for x in ("Python", "MapInArrow", "InPandas")), most


def test_a_task_of_the_cut_needs_one_python_worker(spark):
    """Idle workers stay, and in the next step each builds its tables."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan's shuffles are hidden
    try:
        docs = stage(cases.documents(spark, clashing=False))  # a shuffle of its own would part the steps
        for out in (suffixes.trim(docs), suffixes.dedup(docs)):
            assert max(python_steps(out._jdf.queryExecution().executedPlan())) == 1
            assert out.count() == docs.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_multikey_orders_rows():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (500, 24), dtype=np.uint8)
    rows[:, 2:20] = 0
    order, tied = suffixes.multikey(rows)
    ordered = [bytes(rows[i]) for i in order]
    assert ordered == sorted(ordered)
    assert tied.tolist() == [False] + [a == b for a, b in zip(ordered, ordered[1:])]


def test_anchors_of_equal_strings_agree():
    rng = np.random.default_rng(4)
    shared = bytes(rng.integers(97, 123, 400, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) + shared + bytes(rng.integers(97, 123, 77, dtype=np.uint8)) for n in (10, 333)]
    anchors = suffixes.Anchors(texts)
    places = []
    for k, before in enumerate((10, 333)):
        some = anchors.number == k
        at, first, last = (x[some] - anchors.begins[k] - before for x in (anchors.at, anchors.first, anchors.last))
        places.append({int(p): int(a) for a, f, z in zip(at, first, last) for p in range(f, z + 1) if 0 <= p <= 300})
        assert sum(z - f + 1 for f, z in zip(first, last)) == len(texts[k]) - suffixes.LENGTH + 1
    assert places[0] == places[1] and len(places[0]) == 301


def test_equal_rows_of_one_task_are_one_document(spark):
    docs = [(k, cases.prose(k, 60) + cases.prose(90, 60)) for k in (1, 2, 3)]
    docs = docs[:1] * 3 + docs[1:] + docs[2:] + [(4, cases.prose(90, 60)[100:400] + cases.prose(4, 30))]
    got = suffixes.dedup(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(tuple(r) for r in got) == brute_cut([(i, t.encode()) for i, t in docs], suffixes.LENGTH)


def test_anchors_spread_evenly_over_buckets():
    """The least hash of many is small: it must not lead all grams to the first ranges of the map."""
    text = bytes(np.random.default_rng(5).integers(97, 123, 200_000, dtype=np.uint8))
    gram = np.unique(suffixes.Anchors([text]).gram)
    packed = suffixes._by_bucket(gram, 16).to_pydict()
    sizes = [len(x) // 8 for x in packed["data"]]
    assert packed["bucket"] == list(range(16)) and sum(sizes) == len(gram) and max(sizes) < 2 * len(gram) / 16


@pytest.mark.parametrize("percent", [20, 50, 60, 66, 67, 80, 90])
def test_linked_sets_share_an_indexed_token_at_any_percent(percent):
    """All pairs of sets of seven tokens, of which two are rare or none is."""
    tokens = np.arange(1, 8, dtype=np.uint64) << np.uint64(32)
    for frequent in (np.arange(1, 8, dtype=np.uint32), np.arange(1, 6, dtype=np.uint32)):
        chosen = [tokens[[m >> i & 1 > 0 for i in range(7)]] for m in range(1, 128)]
        found = [jaccard.prefixes(t, frequent, percent) for t in chosen]
        sets, single, combined = [set(t.tolist()) for t in chosen], [set(f[1].tolist()) for f in found], [set(f[2].tolist()) for f in found]
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    assert single[i] & single[j] or combined[i] & combined[j], (sets[i], sets[j])
