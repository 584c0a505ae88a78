"""Hidden Markov language model over whole texts.

A token's symbol is the word itself for the most frequent words and else a class by
spelling; P(text) is the likelihood of the symbols under the latent states, times the
share of each word in its class (add-one, with room for one unseen word a class). So the
model's tables are bounded, while every word's count comes from all training texts.

* Words are counted for each slice in its task, then summed by a shuffle.
* Counts of frequent words (at most `FREQUENT`) go along with the code; all other words
  of a text meet their counts in a join, and only sums for each text come back.
* The start comes from all training texts too: each task counts which group of symbols
  follows each symbol, Spark adds the counts up, and symbols with like followers (those of a
  language, or of a place in a sentence) are put in one state's main share.
* Baum-Welch: each task sums expected counts over its texts, Spark adds them up, and the
  new parameters (states x symbols) are set in the driver. Every iteration runs over all
  training texts.
* The scaled forward recursion runs over the whole text, many texts abreast.

Defined cases: null is the empty text, whose one token is the end; null identifiers hash
as the empty text; repeated rows count and are scored as often as they occur; without
training texts the base is 0 for each token and the model uniform over symbols.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelloom.llm.batches import slices, small_batches
from panelloom.sources.storage import stage

STATES = 8
ITERATIONS = 3
OWN = 4096
CLASSES = 1024
FREQUENT = 1 << 16
GROUPS = 64     # groups of following symbols, for the start
MAIN = 0.8      # share of its count that a symbol gives to its own state, for the start
COUNTED_BYTES = 16 << 20  # of words that a task counts at once
ABREAST = 200_000
SCALED_EVERY = 8  # steps; between them probabilities shrink, far from underflow
END = OWN + CLASSES
SYMBOLS = END + 1


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in lower case (A-Z only), cut at the six ASCII blanks, and how many each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, counts = cut.flatten().cast(pa.binary()), pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False)
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at either end leave an empty word
    text = np.repeat(np.arange(len(counts)), counts)[some]
    return words.filter(pa.array(some)), np.bincount(text, minlength=len(counts))


def spelled(word: bytes) -> int:
    """Class by first and last letters: those of one language tend to share states."""
    return zlib.crc32(word[:2] + b" " + word[-3:]) % CLASSES


def all_spelled(words: pa.Array) -> np.ndarray:
    """`spelled` of each word: once for each of the different first and last letters."""
    letters = pc.binary_join_element_wise(pc.binary_slice(words, 0, 2), pc.binary_slice(words, -3), b" ").dictionary_encode()
    classes = np.array([zlib.crc32(x) % CLASSES for x in letters.dictionary.to_pylist()], np.int64)
    return classes[letters.indices.to_numpy(zero_copy_only=False)]


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over whole texts; tasks sum up a bounded number of words before they send them."""
    def run(batches):
        held = []

        def emit():
            found = pa.chunked_array(held, pa.binary()).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

        for batch in slices(batches, "text"):
            held.append(tokens(batch["text"])[0])
            if sum(x.nbytes for x in held) > COUNTED_BYTES:
                yield emit()
        if held:
            yield emit()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What the tasks know of the counts; its size doesn't grow with the corpus."""

    train_tokens: int
    distinct: int
    texts: int
    counts: dict[bytes, int]  # of frequent words
    own: dict[bytes, int]  # symbols of the most frequent
    sizes: np.ndarray  # log10 of each class's count and words, plus one


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """Summaries of the counts: bounded numbers of rows reach the driver."""
    floors = [1 << k for k in range(48)]
    one = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words"),
                     *[F.sum((F.col("n") >= f).cast("long")).alias(f"at_{f}") for f in floors]).first()
    floor = next(f for f in floors if (one[f"at_{f}"] or 0) <= FREQUENT)
    frequent = {bytes(r.word): r.n for r in counts.filter(F.col("n") >= floor).collect()}
    own = {w: i for i, w in enumerate(sorted(frequent, key=lambda w: (-frequent[w], w))[:OWN])}
    most = pa.array(list(own), pa.binary())

    def classes(batches):
        n, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            found = batch["word"].cast(pa.binary())
            rest = pc.invert(pc.is_in(found, most))
            at = all_spelled(found.filter(rest))
            np.add.at(n, at, batch["n"].filter(rest).to_numpy())
            words += np.bincount(at, minlength=CLASSES)
        yield pa.RecordBatch.from_pydict({"class": np.arange(CLASSES), "n": n, "words": words})

    sums = counts.mapInArrow(classes, "class long, n long, words long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sizes = np.ones(CLASSES)
    for r in sums.collect():  # one row a class
        sizes[r["class"]] += r["n"] + r["words"]
    return Vocabulary((one["tokens"] or 0) + texts, one["words"] + (texts > 0), texts, frequent, own, np.log10(sizes))


def observe(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """Symbols of every whole text, sums over its frequent words, and its other words as often as they occur."""
    ordered = sorted(known.counts, key=lambda w: (-known.counts[w], w))  # the first OWN are symbols of their own
    place = pa.array(ordered, pa.binary())
    logs = np.log10(np.array([known.counts[w] for w in ordered], float) + 1)
    symbols = np.array([i if i < OWN else OWN + spelled(w) for i, w in enumerate(ordered)], np.uint16)
    end, some_texts, sizes = np.log10(known.texts + 1), known.texts > 0, known.sizes

    def run(batches):
        for batch in slices(batches, "text"):
            flat, counts = tokens(batch["text"])
            texts, ends = len(counts), np.cumsum(counts)
            at = pc.fill_null(pc.index_in(flat, place), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(texts), counts)
            rare = np.flatnonzero(at < 0)
            rest = flat.take(pa.array(rare))
            seen = np.empty(len(flat), np.uint16)
            seen[at >= 0] = symbols[at[at >= 0]]
            seen[rare] = OWN + all_spelled(rest)

            def sums(some, values):
                return np.bincount(doc[some], values, texts)

            frequent, own, shared = at >= 0, (at >= 0) & (at < OWN), seen >= OWN
            cuts = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=texts))])
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], batch["held_out"], pa.array(counts + 1, pa.int64()),
                pa.array(np.bincount(doc[frequent], minlength=texts) + some_texts, pa.int64()),
                pa.array(sums(frequent, logs[at[frequent]]) + end), pa.array(sums(own, logs[at[own]]) + end),
                pa.array(sums(shared, sizes[seen[shared] - OWN])),
                pa.array([np.append(x, END).astype("<u2").tobytes() for x in np.split(seen, ends[:-1])], pa.binary()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rest)],
                ["doc_id", "held_out", "n_tokens", "n_known", "all_log", "own_log", "class_log", "symbols", "words"])

    seen = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, all_log double, own_log double, "
                                "class_log double, symbols binary, words array<binary>")
    return seen.withColumn("row", F.monotonically_increasing_id())


def _staying(states: int) -> np.ndarray:
    """Transitions that mostly stay."""
    step = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * 0.9
    return step / step.sum(1, keepdims=True)


def clusters(followers: np.ndarray, states: int, seed: int, rounds: int = 25) -> np.ndarray:
    """The cluster of each symbol by the shares of its followers, weighted by its count; -1 without any."""
    weight = followers.sum(1)
    known = np.flatnonzero(weight > 0)
    own = np.full(len(followers), -1)
    if not len(known):
        return own
    x, weight = np.sqrt(followers[known] / weight[known, None]), weight[known]
    rng = np.random.default_rng(seed)
    centres = x[[weight.argmax()]]
    for _ in range(states - 1):  # a far and frequent symbol at a time
        far = ((x[:, None] - centres) ** 2).sum(2).min(1) * weight
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else 0]]])
    for _ in range(rounds):
        near = ((x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1)).argmin(1)
        for s in range(states):
            if (near == s).any():
                centres[s] = np.average(x[near == s], axis=0, weights=weight[near == s])
    own[known] = near
    return own


@dataclass
class Model:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def random(cls, states: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        emit = rng.gamma(2.0, 1.0, (states, SYMBOLS))
        return cls(np.full(states, 1 / states), _staying(states), emit / emit.sum(1, keepdims=True))

    @classmethod
    def started(cls, followers: np.ndarray, states: int, seed: int) -> Model:
        """From counts of (symbol, group of the next symbol): a state for each cluster of symbols."""
        counts = followers.sum(1)
        own = clusters(followers, states, seed)
        part = np.full((states, SYMBOLS), (1 - MAIN) / states) + MAIN * (own == np.arange(states)[:, None])
        noise = np.random.default_rng(seed).uniform(0.9, 1.1, part.shape)
        emit = part * noise * (counts + 1.0)
        emit[:, END] = emit[:, END].mean()  # nothing follows the end
        return cls(np.full(states, 1 / states), _staying(states), emit / emit.sum(1, keepdims=True))

    def updated(self, sums: np.ndarray) -> Model:
        """From expected counts, smoothed so that nothing is impossible."""
        k = len(self.start)
        start, step, emit = np.split(sums, [k, k + k * k])
        ratio = lambda x: x / x.sum(-1, keepdims=True)
        return Model(ratio(start + 0.1), ratio(step.reshape(k, k) + 0.1), ratio(emit.reshape(k, SYMBOLS) + 0.02))


class Abreast:
    """Sequences laid side by side, longest first; step t holds those that are longer than t."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in sequences], kind="stable")
        ordered = [sequences[i] for i in self.order]
        self.lengths = np.array([len(s) for s in ordered])
        self.active = np.searchsorted(-self.lengths, -np.arange(self.lengths[0]), side="left")
        self.starts = np.concatenate([[0], np.cumsum(self.active)])
        number = np.repeat(np.arange(len(ordered)), self.lengths)
        time = np.arange(len(number)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        place = self.starts[time] + number
        self.symbols, self.number = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        self.symbols[place], self.number[place] = np.concatenate(ordered), number

    def forward(self, model: Model):
        """Emissions, probabilities of the states before each symbol is seen, and scales; logs of the scales add up to the
        log likelihood. Scaled are every few steps and those at which a sequence ends; elsewhere the scale is 1."""
        emit = np.ascontiguousarray(model.emit.T)[self.symbols]
        before, scale = np.empty_like(emit), np.ones(len(emit))
        whole, a = np.ones(len(model.start)), 0
        steps = self.active.tolist()
        for t, (n, following) in enumerate(zip(steps, [*steps[1:], 0])):
            b = a + n
            if t:
                np.dot(now[:n], model.step, before[a:b])
            else:
                before[:n] = model.start
            now = before[a:b] * emit[a:b]
            if following < n or t % SCALED_EVERY == SCALED_EVERY - 1:
                np.dot(now, whole, scale[a:b])
                now /= scale[a:b, None]
            a = b
        return emit, before, scale

    def log10(self, model: Model) -> np.ndarray:
        """log10 likelihood of each sequence, in the order given."""
        _, _, scale = self.forward(model)
        out = np.empty(len(self.lengths))
        out[self.order] = np.bincount(self.number, np.log10(scale), len(self.lengths))
        return out

    def expected(self, model: Model) -> np.ndarray:
        """Expected starts, transitions and emissions, by the backward recursion."""
        emit, before, scale = self.forward(model)
        emit /= scale[:, None]
        alpha = before * emit
        back = np.ascontiguousarray(model.step.T)
        b, going = len(emit), 0
        for n in reversed(self.active.tolist()):  # emissions times what comes after them
            a = b - n
            if going:
                emit[a:a + going] *= np.dot(emit[b:b + going], back)
            b, going = a, n
        first = self.active[0]
        previous = np.arange(first, len(emit)) - np.repeat(self.active[:-1], self.active[1:])
        moves = alpha[previous].T @ emit[first:]
        before *= emit
        emitted = np.array([np.bincount(self.symbols, x, SYMBOLS) for x in before.T])
        return np.concatenate([before[:first].sum(0), (moves * model.step).ravel(), emitted.ravel()])


def laid(sequences: list[np.ndarray]):
    """Groups of sequences of like length, about `ABREAST` symbols each, with their positions."""
    held, size = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: len(sequences[i])):
        if held and size + len(sequences[i]) > ABREAST:
            yield held, Abreast([sequences[j] for j in held])
            held, size = [], 0
        held.append(i)
        size += len(sequences[i])
    if held:
        yield held, Abreast([sequences[j] for j in held])


def _read(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch["symbols"].to_pylist()]


def _summed(training: DataFrame, size: int, sums) -> np.ndarray:
    """`sums(batches)` of each task, an array of `size` numbers, added up over the tasks."""
    def run(batches):
        total = sums(batches)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total[at].astype("float64")})

    found = training.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most `size` rows
    out = np.zeros(size)
    out[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out


def followers(training: DataFrame) -> np.ndarray:
    """How often a symbol of each group follows each symbol, over all training texts."""
    def sums(batches):
        total = np.zeros(SYMBOLS * GROUPS, np.int64)
        for batch in slices(batches, "symbols"):
            some = _read(batch)
            flat = np.concatenate(some).astype(np.int64)
            pairs = flat[:-1] * GROUPS + flat[1:] % GROUPS
            last = np.cumsum([len(x) for x in some])[:-1] - 1  # the next symbol is another text's
            total += np.bincount(np.delete(pairs, last), minlength=len(total))
        return total

    return _summed(training, SYMBOLS * GROUPS, sums).reshape(SYMBOLS, GROUPS)


def train(observed: DataFrame, states: int = STATES, iterations: int = ITERATIONS, seed: int = 11) -> Model:
    """Baum-Welch; the start and every iteration see all training texts."""
    training = observed.filter(~F.col("held_out")).select("symbols")
    seen = followers(training)
    size = states + states * states + states * SYMBOLS
    if not training.limit(1).count():
        return Model.random(states, seed).updated(np.zeros(size))
    model = Model.started(seen, states, seed)
    for _ in range(iterations):
        def sums(batches, model=model):
            total = np.zeros(size)
            for batch in slices(batches, "symbols"):
                for _, group in laid(_read(batch)):
                    total += group.expected(model)
            return total

        model = model.updated(_summed(training, size, sums))
    return model


def likelihood(observed: DataFrame, model: Model) -> DataFrame:
    """Adds `symbol_log`, the log10 likelihood of the symbols."""
    kept = [c for c in observed.columns if c not in ("symbols", "words")]

    def run(batches):
        for batch in slices(batches, "symbols"):
            out = np.zeros(batch.num_rows)
            for at, group in laid(_read(batch)):
                out[at] = group.log10(model)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(out)], [*kept, "symbol_log"])

    schema = ", ".join(f"{c} {t}" for c, t in observed.dtypes if c in kept)
    return observed.select(*kept, "symbols").mapInArrow(run, f"{schema}, symbol_log double")


def score(docs: DataFrame, held_out, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """Base and model scores of every whole text; `held_out` is a boolean column on doc_id."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    body = body.withColumn("held_out", held_out)
    learned = small_batches(body).filter(~F.col("held_out"))
    counts = stage(count_words(learned), "words")
    known = vocabulary(counts, learned.count())
    observed = stage(observe(body, known), "symbols")
    model = train(observed, states, iterations)

    rest = observed.select("row", F.explode("words").alias("word"))
    sums = rest.join(counts, "word").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1)).alias("rest_log"), F.count(F.lit(1)).alias("rest_known"))
    full = likelihood(observed, model).join(sums, "row", "left")
    rest_log = F.coalesce("rest_log", F.lit(0.0))
    unit = float(np.log10(known.train_tokens + known.distinct + 1))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(known.train_tokens).cast("long").alias("train_tokens"),
        (F.col("all_log") + rest_log - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("symbol_log") + F.col("all_log") - F.col("own_log") + rest_log - F.col("class_log")).alias("score"))
