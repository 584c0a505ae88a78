import base64
import hashlib
import zlib

import cases
import numpy as np
import public_tokenizers as P
import pytest
from panelloom.llm import bpe, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (200, 40), (64, 64)])
def test_digests_equal_the_library(spark, library, chunk, overlap):
    got = bpe.digests(cases.documents(spark), RANKS, P.PATTERN, chunk, overlap).collect()
    want = []
    for i, t in cases.texts():
        ids = library.encode_ordinary(t)
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_ids_round_trip(spark, library):
    ids = bpe.encode(cases.documents(spark), RANKS, P.PATTERN, 500, 50)
    texts = sorted(t.encode() for _, t in cases.texts())
    assert sorted(bytes(r.data) for r in bpe.decode(ids, RANKS, P.PATTERN).collect()) == texts
    assert sorted(r.ids for r in ids.collect()) == sorted(library.encode_ordinary(t.decode()) for t in texts)
    assert bpe.digests(cases.empty(spark), RANKS, P.PATTERN).count() == 0


def test_overlap_must_fit(spark):
    with pytest.raises(ValueError):
        bpe.encode(cases.documents(spark), RANKS, P.PATTERN, 100, 200)


def whole_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [(i, x.ids + [1]) for (i, _), x in zip(cases.texts(), t.encode_batch([t for _, t in cases.texts()], add_special_tokens=False))]


@pytest.mark.parametrize("window, spare", [(2048, 16), (64, 0), (50, 3)])
def test_pieces_cover_every_id_once(spark, window, spare):
    rows = packing.pack(cases.documents(spark), P.path("word_bpe_49k.json"), window, spare).collect()
    known = {}
    for i, ids in whole_ids():
        known.setdefault((i, len(ids)), []).append(np.array(ids, "<u4"))
    found = {}
    for r in rows:
        texts = known[r.doc_id, r.doc_tokens]
        assert any(zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in texts)
        found.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for key, texts in known.items():
        place = np.zeros(key[1] + 1, int)
        for start, length in found[key]:
            place[start] += 1
            place[start + length] -= 1
        assert (np.cumsum(place)[:-1] == len(texts)).all()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padded += at < window - spare and at & (at - 1) != 0
    assert padded <= 1
    assert packing.pack(cases.empty(spark), P.path("word_bpe_49k.json"), window).count() == 0


def serial(sizes, window):
    """Best fit decreasing, one piece after another."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(window - s)
    return sorted(rooms)


def test_grouped_plan_equals_serial_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(1, 60, rng.integers(1, 200))
        counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
        groups = packing.best_fit(counts, 64)
        assert sorted(c for n, c, _ in groups for _ in range(n)) == serial(sizes.tolist(), 64)
        ranks = {}
        for n, _, content in groups:
            for size, fit, rank, _ in content:
                ranks.setdefault(size, []).extend(range(rank, rank + n * fit))
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}


HARD = ["a <|endoftext|> b", "<|ENDOFTEXT|>", "<|startoftext|><|endoftext|>.", "It's 10,000.00 (ok). «a». b.", "x., y,. z.. .", "é. ×. ÷, ß. Ǆ. ñ",
        "e\u0301. E\u0301", "İstanbul, STRASSE.", "a\tb\x0bc\x85d\u2028e\u00a0f. g", "0 00 0.0 a0b", "don't we'LL 'S", "\U0001f600. \U0001f600,", "abc" * 50 + ".",
        "日本語、テスト。 ok.", "Ａ.", "\x00.", "....", ",", "a,b", "a.\nb,\n", "ﬁne. ﬃ,", "A\u030a.", "Å. Å.", "σς Σ. ΑΣ."]


@pytest.mark.parametrize("held", [3, 100, 800_000])
def test_words_apart_equal_words_in_text(held, monkeypatch):
    """Ids are the library's, with a table that forgets after every run and one that never does."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = np.random.default_rng(held)
    mixed = ["".join(rng.choice(list("aàÀbB.,'’0 \n\t!é́ßσ<|>"), 40)) for _ in range(2000)]
    texts = [t for _, t in cases.texts()] + HARD + mixed
    monkeypatch.setattr(packing, "RUN_BYTES", 5_000)
    words = packing.Words(P.path("word_bpe_49k.json"), held)
    assert words.apart and words.folds
    want = [x.ids + [1] for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in words.ids([t.encode() for t in texts])] == want
    assert [x.tolist() for x in words.ids([t.encode() for t in texts])] == want


@pytest.mark.parametrize("change", ["byte level", "cased", "blanks in tokens"])
def test_other_vocabularies_are_read_as_their_file_says(tmp_path, change):
    import json

    from tokenizers import Tokenizer

    rules = json.loads(open(P.path("word_bpe_49k.json")).read())
    if change == "cased":
        rules["normalizer"]["normalizers"].pop()
    if change == "blanks in tokens":
        rules["pre_tokenizer"] = rules["pre_tokenizer"]["pretokenizers"][1]
    path = tmp_path / "words.json"
    path.write_text(json.dumps(rules))
    path = P.path("byte_bpe_50k.json") if change == "byte level" else str(path)
    words = packing.Words(path)
    assert words.apart == (change == "cased") and words.folds == (change == "blanks in tokens")
    texts = [t for _, t in cases.texts()] + HARD
    want = [x.ids + [1] for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in words.ids([t.encode() for t in texts])] == want


def test_long_texts_are_cut_at_blanks():
    text = ("word " * 3000 + "x" * 5000 + "\n" + "é " * 300).encode()
    pieces = list(packing.pieces_of(text, 1000))
    assert b"".join(pieces) == text and all(p[:1] in b" \n" for p in pieces[1:])
    assert sum(len(p) > 1000 for p in pieces) == 1


def test_ranks_follow_the_tasks(spark):
    """Ranks of equal lengths have no gap, whatever the partitions."""
    docs = spark.createDataFrame([(i, "a " * (i % 3) + "b " * 10 * (i % 2)) for i in range(300)], "doc_id long, text string").repartition(7)
    ranked, counts = packing._ranked(packing.stage(packing.tokenise(docs, P.path("word_bpe_49k.json"), 8)), 8)
    found = {}
    for r in ranked.collect():
        found.setdefault(r.length, []).append(r["rank"])
    assert {n: sorted(x) for n, x in found.items()} == {n: list(range(len(x))) for n, x in found.items()}
    assert sum(r.n for r in counts.collect()) == sum(map(len, found.values()))
