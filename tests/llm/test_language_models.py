import math
import zlib
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
from panelloom.llm import markov, toxicity
from pyspark.sql import functions as F


def held(i, folds=7, fold=2):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == fold


def test_base_score_equals_brute_force(spark):
    got = markov.score(cases.documents(spark), toxicity.remainder("doc_id", 7) == 2, states=3, iterations=1).collect()
    counts = Counter()
    for i, t in cases.texts():
        if not held(i):
            counts.update(t.encode().lower().split())
            counts["end"] += 1
    total, distinct, want = sum(counts.values()), len(counts), []
    for i, t in cases.texts():
        words = [*t.encode().lower().split(), "end"]
        want.append((str(i), held(i), len(words), sum(w in counts for w in words), total,
                     round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), 5)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_words_beyond_the_frequent_ones_meet_their_counts(spark, monkeypatch):
    docs = cases.documents(spark)
    fold = toxicity.remainder("doc_id", 7) == 2
    want = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in markov.score(docs, fold, 2, 1).collect())
    monkeypatch.setattr(markov, "FREQUENT", 20)
    monkeypatch.setattr(markov, "OWN", 10)
    monkeypatch.setattr(markov, "END", 10 + markov.CLASSES)
    monkeypatch.setattr(markov, "SYMBOLS", 11 + markov.CLASSES)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in markov.score(docs, fold, 2, 1).collect()) == want


def test_no_training_texts(spark):
    assert markov.score(cases.empty(spark), F.lit(False)).count() == 0
    rows = markov.score(cases.documents(spark), F.lit(True), 2, 1).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_words_and_classes_equal_plain_python():
    texts = ["", None, " ", "A b  C", "\t\v\f lead and trail \r\n", "x\x1cy\u00a0z\u2003w ÄÖ İ", "\x00 a\x00b", "é", "日本 語", "one"]
    for some in (texts, texts[3:6], [], [None], [" "]):
        words, counts = markov.tokens(pa.array(some, pa.string()))
        want = [(t or "").encode().lower().split() for t in some]
        assert words.to_pylist() == [w for t in want for w in t] and counts.tolist() == [len(t) for t in want]
        assert markov.all_spelled(words).tolist() == [markov.spelled(w) for t in want for w in t]


def test_words_are_counted_in_pieces(spark, monkeypatch):
    docs = cases.documents(spark).repartition(3)
    want = Counter(w for _, t in cases.texts() for w in t.encode().lower().split())
    for size in (markov.COUNTED_BYTES, 50):
        monkeypatch.setattr(markov, "COUNTED_BYTES", size)
        assert {bytes(r.word): r.n for r in markov.count_words(docs).collect()} == want


def paths(model, seq):
    """Likelihood and posterior by summing over every path of states."""
    k = len(model.start)
    total, emitted = 0.0, np.zeros((k, len(seq)))
    for code in range(k ** len(seq)):
        states = [code // k ** t % k for t in range(len(seq))]
        p = model.start[states[0]] * model.emit[states[0], seq[0]]
        for t in range(1, len(seq)):
            p *= model.step[states[t - 1], states[t]] * model.emit[states[t], seq[t]]
        total += p
        for t, s in enumerate(states):
            emitted[s, t] += p
    return total, emitted / total


def test_forward_backward_equals_sum_over_paths():
    rng = np.random.default_rng(1)
    ratio = lambda x: x / x.sum(-1, keepdims=True)
    model = markov.Model(ratio(rng.random(2)), ratio(rng.random((2, 2))), ratio(rng.random((2, markov.SYMBOLS))))
    sequences = [rng.integers(0, 6, n) for n in (4, 1, 7, 4)]
    group = markov.Abreast(sequences)
    got, sums = group.log10(model), group.expected(model)
    emitted = np.zeros((2, markov.SYMBOLS))
    for seq, value in zip(sequences, got):
        total, share = paths(model, seq)
        assert abs(value - math.log10(total)) < 1e-9
        for t, s in enumerate(seq):
            emitted[:, s] += share[:, t]
    assert np.allclose(sums[6:].reshape(2, -1), emitted) and abs(sums[:2].sum() - 4) < 1e-9
    assert abs(sums[2:6].sum() - sum(len(s) - 1 for s in sequences)) < 1e-9


def test_long_sequences_are_scaled_now_and_then():
    """Equal to a recursion that scales at every step, with very unlikely symbols; most steps go without scaling."""
    rng = np.random.default_rng(8)
    ratio = lambda x: x / x.sum(-1, keepdims=True)
    emit = ratio(rng.random((3, markov.SYMBOLS)))
    emit[:, :40] *= 1e-15
    model = markov.Model(ratio(rng.random(3)), ratio(rng.random((3, 3))), emit)
    sequences = [rng.integers(0, 60, n) for n in (800, 3, 800, 1, 797, 800, 17, 8, 9)]
    group = markov.Abreast(sequences)
    got, sums = group.log10(model), group.expected(model)
    start, step, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((3, markov.SYMBOLS))
    for seq, value in zip(sequences, got):
        alpha, scale = [], []
        for t, x in enumerate(seq):
            now = (alpha[-1] @ model.step if t else model.start) * emit[:, x]
            scale.append(now.sum())
            alpha.append(now / now.sum())
        assert math.isclose(value, np.log10(scale).sum(), rel_tol=1e-12)
        beta = np.ones(3)
        for t in range(len(seq) - 1, -1, -1):
            emitted[:, seq[t]] += alpha[t] * beta
            if t:
                after = emit[:, seq[t]] * beta / scale[t]
                step += np.outer(alpha[t - 1], after) * model.step
                beta = model.step @ after
        start += alpha[0] * beta
    assert np.allclose(sums, np.concatenate([start, step.ravel(), emitted.ravel()]), rtol=1e-9)
    alike = markov.Abreast([rng.integers(0, 60, 800) for _ in range(5)])
    assert (alike.forward(model)[2] != 1).sum() == 5 * 800 // markov.SCALED_EVERY


def test_scores_equal_a_plain_model(spark):
    """The whole score: forward recursion over the symbols, one token after another, times the words' shares."""
    docs, fold = cases.documents(spark), toxicity.remainder("doc_id", 7) == 2
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", fold)
    learned = body.filter(~F.col("held_out"))
    known = markov.vocabulary(markov.count_words(learned), learned.count())
    model = markov.train(markov.observe(body, known), 3, 2)
    counts = Counter(w for i, t in cases.texts() if not held(i) for w in t.encode().lower().split())
    of_class = Counter()
    for w, n in counts.items():
        if w not in known.own:
            of_class[markov.spelled(w)] += n + 1
    want = []
    for i, t in cases.texts():
        words, now, total = t.encode().lower().split(), model.start, 0.0
        for k, w in enumerate([*words, None]):
            symbol = markov.END if w is None else known.own.get(w, markov.OWN + markov.spelled(w))
            now = (now @ model.step if k else now) * model.emit[:, symbol]
            total += math.log10(now.sum())
            now = now / now.sum()
            if w is not None and w not in known.own:
                total += math.log10((counts[w] + 1) / (of_class[markov.spelled(w)] + 1))
        want.append((str(i), len(words) + 1, total))
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in markov.score(docs, fold, 3, 2).collect())
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], rtol=1e-9)


def test_start_sees_every_training_text(spark):
    """Counts of followers equal a plain loop, however the texts are dealt; a text does not follow another."""
    rng = np.random.default_rng(4)
    sequences = [np.append(rng.integers(0, markov.END, n), markov.END).astype("<u2") for n in (0, 1, 5, 300, 0, 40)]
    rows = [(bytes(x.tobytes()),) for x in sequences]
    want = Counter((int(a), int(b) % markov.GROUPS) for x in sequences for a, b in zip(x, x[1:]))
    for parts in (1, 4):
        got = markov.followers(spark.createDataFrame(rows, "symbols binary").repartition(parts))
        assert {(a, g): int(got[a, g]) for a, g in zip(*np.nonzero(got))} == want


def test_start_parts_languages():
    """Two languages with their own words: states of the start lean to one of them, and training keeps them apart."""
    rng = np.random.default_rng(6)
    sequences = [np.append(rng.integers(0, 30, 80) + 100 * (i % 2), markov.END) for i in range(60)]
    seen = np.zeros((markov.SYMBOLS, markov.GROUPS))
    for x in sequences:
        np.add.at(seen, (x[:-1], x[1:] % markov.GROUPS), 1)
    own = markov.clusters(seen, 2, 11)
    assert len(set(own[:30])) == 1 and len(set(own[100:130])) == 1 and own[0] != own[100] and own[300] == -1
    model = markov.Model.started(seen, 2, 11)
    assert np.allclose(model.emit.sum(1), 1) and np.allclose(model.step.sum(1), 1)
    group = markov.Abreast(sequences)
    apart = model.updated(group.expected(model))
    mixed = markov.Model.random(2, 3)
    mixed = mixed.updated(group.expected(mixed))
    assert group.log10(apart).sum() > group.log10(mixed).sum()


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    sequences = [np.where(rng.random(60) < 0.9, rng.integers(0, 50, 60) + 50 * (i % 2), markov.END) for i in range(40)]
    model, group, before = markov.Model.random(2, 3), markov.Abreast(sequences), -np.inf
    for _ in range(8):
        now = group.log10(model).sum()
        assert now > before - 1
        before, model = now, model.updated(group.expected(model))


def test_words_of_a_class_and_one_unseen_share_all_probability(spark):
    counts = spark.createDataFrame([(bytes(f"w{i}", "ascii"), 1 + i % 4) for i in range(200)], "word binary, n long")
    known = markov.vocabulary(counts, 3)
    assert known.distinct == 201 and known.train_tokens == 3 + sum(1 + i % 4 for i in range(200))
    assert set(known.own) == set(known.counts) and np.allclose(10 ** known.sizes, 1)


TOXIC = ("awfulist", "nastier", "vilest")


def labelled(spark, n=400):
    rows, marks = [], []
    for i in range(n):
        words = cases.prose(1000 + i, 40 + i % 60).split()
        bad = i % 4 == 0
        if bad:
            for k in range(4):
                words[(7 * k + i) % len(words)] = TOXIC[(i + k) % 3]
        rows.append((i, " ".join(words), "en" if i % 3 else "de"))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([*marks, (None, 1), (5000, None), (5001, 7)], "doc_id long, toxic int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    truth = {i: i % 4 == 0 for i in range(400)}
    found = toxicity.score(docs, model).collect()
    away = [r for r in found if held(r.doc_id, 5, 0)]
    assert len(away) > 50 and sum((r.score >= 0.5) == truth[r.doc_id] for r in away) >= 0.95 * len(away)
    odd = toxicity.score(cases.documents(spark), model).collect()
    assert len(odd) == len(cases.texts()) and all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.clean(cases.documents(spark), model)
    assert kept.schema == cases.documents(spark).schema and kept.count() >= 0.8 * len(odd)
    assert toxicity.score(cases.empty(spark), model).count() == 0


def test_long_texts_are_scored_whole(spark, monkeypatch):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    long = spark.createDataFrame([(1, cases.prose(1, 3000) + " " + " ".join(TOXIC)), (2, cases.prose(1, 3000))], "doc_id long, text string").selectExpr("*", "'en' as lang")
    want = {r.doc_id: r.score for r in toxicity.score(long, model).collect()}
    monkeypatch.setattr(toxicity, "STEP_WORDS", 50)
    got = {r.doc_id: r.score for r in toxicity.score(long, model).collect()}
    assert want[1] > 0.5 > want[2] and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_labels_of_one_class_give_the_prior(spark):
    docs, labels = labelled(spark, 40)
    for value in (0, 1):
        model = toxicity.train(docs, labels.filter(F.col("toxic") == value))
        scores = [r.score for r in toxicity.score(docs, model).collect()]
        assert all(abs(s - value) < 1e-3 for s in scores)
    assert all(r.score < 1e-3 for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect())


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("fr").alias("lang"))
    a = sorted(r.score for r in toxicity.score(docs, model).collect())
    assert np.allclose(a, sorted(r.score for r in toxicity.score(other, model).collect()))


def test_thresholds_cover_all_labels_at_their_natural_share(spark):
    rows, marks = [], []
    for i in range(3000):  # a tenth toxic, half of it mildly; as mild are three tenths of the clean texts
        words = cases.prose(5000 + i, 25).split()
        bad = i % 10 == 0
        hard = 4 if bad and i % 20 else int(bad or i % 10 < 4)
        for k in range(hard):
            words[5 * k] = TOXIC[(i + k) % 3]
        rows.append((i, " ".join(words), "en"))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample=150)
    aside = [(r.score, r.doc_id % 10 == 0) for r in toxicity.score(docs, model).collect() if held(r.doc_id, 5, 1)]
    f1 = lambda c: 2 * sum(y for s, y in aside if s >= c) / (sum(s >= c for s, _ in aside) + sum(y for _, y in aside))
    assert f1(toxicity.cutoff(model)("en")) >= max(f1(s) for s, _ in aside) - 0.01


def small_network(seed=3):
    """A network over 40 word hashes with every parameter away from zero, and the embedding rows of 12 words."""
    rng = np.random.default_rng(seed)
    net = toxicity.Network(np.arange(1, 41, dtype=np.int64) * 7, seed)
    for p in net.parameters():
        p += rng.normal(0, 0.2, p.shape)
    net.embed[0] = 0
    parts = np.vstack([np.zeros((1, 1 + len(toxicity.STEMS)), np.int64), rng.integers(0, 41, (11, 1 + len(toxicity.STEMS)))])
    return net, parts, rng


def plain_score(net, parts, words):
    """Filters, maxima and the logistic layer of one text, one window after another; windows may reach past the text's end."""
    gap = max(toxicity.WIDTHS) - 1
    vectors = [net.embed[parts[w]].sum(0) for w in (list(words) or [0])] + [np.zeros(net.embed.shape[1])] * gap
    total, k = net.shift[0], 0
    for width, bank in zip(toxicity.WIDTHS, net.filters):
        for f in range(toxicity.FILTERS):
            found = [sum(vectors[i + o] @ bank[o, :, f] for o in range(width)) for i in range(len(vectors) - width + 1 - (max(toxicity.WIDTHS) - width))]
            total += max(max(found) + net.bias[k], 0.0) * net.out[k]
            k += 1
    return 1 / (1 + math.exp(-total))


def test_gradients_equal_finite_differences():
    net, parts, rng = small_network()
    texts = [rng.integers(0, 12, n).astype(np.int32) for n in (1, 4, 9, 2, 0)]
    labels = np.array([1.0, 0.0, 1.0, 1.0, 0.0])

    def loss():
        scores = np.array([plain_score(net, parts, t) for t in texts])
        return -(labels * np.log(scores) + (1 - labels) * np.log(1 - scores)).mean()

    found = toxicity._gradients(net, parts, texts, labels)
    step, checked = 1e-6, 0
    for p, g in zip(net.parameters(), found):
        flat, grad = p.reshape(-1), g.reshape(-1)
        likely = np.argsort(-np.abs(grad))[:12]  # the largest, and some others
        for i in {*likely.tolist(), *rng.integers(0, len(flat), 8).tolist()}:
            if p is net.embed and i < net.embed.shape[1]:
                continue  # row 0 stays the zero vector
            before = flat[i]
            flat[i] = before + step
            up = loss()
            flat[i] = before - step
            down = loss()
            flat[i] = before
            assert abs((up - down) / (2 * step) - grad[i]) < 1e-6
            checked += abs(grad[i]) > 1e-5
    assert checked > 30


def test_scores_do_not_depend_on_neighbours():
    """Scores of texts in one batch are those of the texts alone, short and empty ones, and one cut into stretches."""
    net, _, rng = small_network()
    words = [f"w{i}" for i in range(30)]
    net = toxicity.Network(np.unique(toxicity.all_hashes([w.encode() for w in words])), 3)
    for p in net.parameters():
        p += rng.normal(0, 0.3, p.shape)
    net.embed[0] = 0
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 0, 3, 1, 50, 2, toxicity.STEP_WORDS * 2 + 5, 4)]
    batch = lambda some: pa.RecordBatch.from_pydict({"text": pa.array(some, pa.string())})
    together = np.concatenate([s for _, s in toxicity.scored(iter([batch(texts)]), net.to_bytes(), "text")])
    alone = [next(toxicity.scored(iter([batch([t])]), net.to_bytes(), "text"))[1][0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6) and len(set(np.round(alone, 6))) > 5
    for text, score in zip(texts, alone):  # in one piece, however long
        parts = net.parts(toxicity.all_hashes([b"", *(w.encode() for w in text.split())]))
        rows, starts, ends = toxicity.padded([np.arange(1, len(parts), dtype=np.int32)])
        logit = net.logits(net.pooled(net.embed[parts[rows]].sum(1), starts, ends)[0])[0]
        assert abs(1 / (1 + math.exp(-logit)) - score) < 1e-5


def test_scores_equal_a_plain_network(spark):
    """The scores of whole texts against one window after another, words looked up one by one."""
    docs, labels = labelled(spark, 120)
    model = toxicity.train(docs, labels)
    data = model.value if hasattr(model, "value") else model
    net = toxicity.Network.from_bytes(data if isinstance(data, bytes) else bytes(data))
    for r in toxicity.score(docs, model).limit(40).collect():
        words = docs.where(F.col("doc_id") == r.doc_id).first().text.encode().lower().split()
        parts = net.parts(toxicity.all_hashes(words))
        assert abs(plain_score(net, parts, range(len(words))) - r.score) < 1e-4
