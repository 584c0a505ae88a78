"""Convolutional text classifier, trained in numpy, scored over whole texts.

A word's embedding is the sum of the hashed embeddings of the word and of its first
letters (several lengths), so unseen forms of a known stem have a meaning; a hash seen
in too few training texts counts as zero. Filters of several widths slide over the text,
each keeps its maximum, and a logistic layer reads the maxima. As a filter is linear
before the pooling, its response is a sum of one table row for each word in the window,
so scoring costs a few lookups for each word and never holds more than a slice of text.

`train` draws at most `sample` texts of each class by hash (a stated bound; the prior
is counted over all labels). Thresholds are calibrated by language on all labelled texts
of a fold that the gradients never see: the texts are scored where they lie and counted by
score bin, so classes weigh as they occur. They decide `flagged`, never the score.

Defined cases: null and empty texts are scored as a text without words; labels that are
null, or for ids without a text, are not used; an id with several labels counts as toxic
if one says so; without both classes the score is the prior; repeated rows are scored alike.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelloom.llm.batches import forget, lean, raw, slices, small_batches

WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 16
STEMS = (3, 4, 5, 6)
SAMPLE = 2500
ROWS = 1 << 16
EPOCHS = 6
BATCH = 64
FOLDS = 5
TRIM = b".,;:!?\"'()[]"
STEP_WORDS = 100_000
CACHED_WORDS = 100_000
LEAST_MARKS = 20  # labels of each class that a language needs for a threshold of its own
CUTS = 1 / (1 + np.exp(-np.arange(-30 * 64, 30 * 64 + 1) / 64))  # borders of the score bins; one half is among them


def remainder(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def hashed(word: bytes) -> list[int]:
    """Hashes of the word and of its stems; a word no longer than a stem has none of that length (0)."""
    whole = word.strip(TRIM)
    letters = whole.decode("utf-8", "replace")
    return [zlib.crc32(whole)] + [zlib.crc32(f"{n}:{letters[:n]}".encode()) if len(letters) > n else 0 for n in STEMS]


def all_hashes(words) -> np.ndarray:
    """The hashes of many words, one line a word."""
    return np.fromiter((h for w in words for h in hashed(w)), np.int64).reshape(-1, 1 + len(STEMS))


class Network:
    """Embeddings by word hash, filters and a logistic layer; row 0 is the zero vector."""

    def __init__(self, hashes: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hashes = hashes
        self.embed = rng.normal(0, 0.1, (len(hashes) + 1, DIM))
        self.embed[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS)
        self.shift = np.zeros(1)
        self.thresholds = {}

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.shift]

    def parts(self, asked: np.ndarray) -> np.ndarray:
        """Embedding rows of the words' hashes, one line a word."""
        at = np.searchsorted(self.hashes, asked)
        known = len(self.hashes) > 0 and self.hashes[np.minimum(at, len(self.hashes) - 1)] == asked
        return np.where(known & (asked != 0), at + 1, 0)

    def pooled(self, vectors: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Maximum and argmax of each filter over the windows that begin in each padded text of word vectors."""
        tops, places = [], []
        n = len(vectors) - max(WIDTHS) + 1
        for width, bank in zip(WIDTHS, self.filters):
            sums = sum(vectors[o:o + n] @ bank[o] for o in range(width))
            tops.append(largest(sums, starts, ends))
            places.append(np.array([a + sums[a:b].argmax(0) for a, b in zip(starts, ends)]))
        return np.hstack(tops), places

    def logits(self, tops: np.ndarray) -> np.ndarray:
        return np.maximum(tops + self.bias, 0) @ self.out + self.shift[0]

    def to_bytes(self) -> bytes:
        sink = io.BytesIO()
        np.savez(sink, self.hashes, *self.parameters(), np.array(list(self.thresholds)), np.array([*self.thresholds.values()]))
        return sink.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as held:
            arrays = [held[k] for k in held.files]
        net = cls(arrays[0][:0])
        net.hashes, net.embed, *net.filters = arrays[:2 + len(WIDTHS)]
        net.bias, net.out, net.shift = arrays[2 + len(WIDTHS):5 + len(WIDTHS)]
        net.thresholds = dict(zip(arrays[-2].tolist(), arrays[-1].tolist()))
        return net


def largest(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximum of each stretch; what lies between them, windows that begin in the padding, doesn't count."""
    edges = np.column_stack([starts, ends]).ravel()
    return np.maximum.reduceat(sums, edges[:-1] if edges[-1] == len(sums) else edges, axis=0)[::2]


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of several texts end to end, with their starts and ends; each is followed by zero rows, so that no
    window that begins in a text reaches the next."""
    gap = np.zeros(max(WIDTHS) - 1, np.int32)
    pieces = [x for t in texts for x in (t if len(t) else np.zeros(1, np.int32), gap)]
    lengths = np.array([max(len(t), 1) + len(gap) for t in texts])
    ends = np.cumsum(lengths) - len(gap)
    return np.concatenate(pieces), ends + len(gap) - lengths, ends


def _gradients(net: Network, parts: np.ndarray, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    rows, starts, ends = padded(texts)
    words, inverse = np.unique(rows, return_inverse=True)
    vectors = net.embed[parts[words]].sum(1)[inverse]
    tops, places = net.pooled(vectors, starts, ends)
    hidden = np.maximum(tops + net.bias, 0)
    error = (1 / (1 + np.exp(-np.clip(net.logits(tops), -30, 30))) - labels) / len(labels)
    down = error[:, None] * net.out * (tops + net.bias > 0)
    embed, banks = np.zeros_like(net.embed), []
    for i, (width, bank) in enumerate(zip(WIDTHS, net.filters)):
        part, at, grad = down[:, i * FILTERS:(i + 1) * FILTERS], places[i], np.zeros_like(bank)
        for o in range(width):
            grad[o] = np.einsum("nfd,nf->df", vectors[at + o], part)
            pull = part[:, :, None] * bank[o].T
            for column in parts[rows[at + o]].transpose(2, 0, 1):
                np.add.at(embed, column, pull)
        banks.append(grad)
    embed[0] = 0
    return [embed, *banks, down.sum(0), error @ hidden, np.array([error.sum()])]


def _fit(net: Network, parts: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int) -> None:
    """Adam with weight decay; the order is drawn by the seed, so equal samples give equal models."""
    rng = np.random.default_rng(seed)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(max(epochs, 300 * BATCH // max(len(texts), 1))):  # a small sample is seen more often
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            step += 1
            for p, (m, v), g in zip(net.parameters(), state, _gradients(net, parts, [texts[i] for i in some], labels[some])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= 0.01 * (m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6) + 0.01 * p)


def _threshold(counts: np.ndarray, toxic: np.ndarray) -> float:
    """The border that gives the best F1 over texts counted by score bin: the middle one of a gap, one half where that is as good."""
    flagged, hits = counts[::-1].cumsum()[::-1][1:], toxic[::-1].cumsum()[::-1][1:]  # reaching border k: the bins above it
    f1 = 2 * hits / np.maximum(flagged + toxic.sum(), 1)
    best = np.flatnonzero(f1 == f1.max())
    half = len(CUTS) // 2
    if half in best:
        return float(CUTS[half])
    gap = best[flagged[best] == flagged[best[0]]]
    return float(CUTS[gap[len(gap) // 2]])


def _learn(texts: list[bytes], labels: np.ndarray, prior: float, seed: int) -> Network:
    number = {b"": 0}
    rows = [np.array([number.setdefault(w, len(number)) for w in t.lower().split()], np.int32) for t in texts]
    hashes = all_hashes(number)
    del number
    seen, times = np.unique(np.concatenate([np.unique(hashes[r]) for r in rows]), return_counts=True)
    often = (times >= max(3, len(rows) // 500)) & (seen != 0)
    seen, times = seen[often], times[often]
    net = Network(np.sort(seen[np.lexsort((seen, -times))[:ROWS]]).astype(np.int64), seed)
    parts = net.parts(hashes).astype(np.int32)
    parts[0] = 0
    del hashes
    _fit(net, parts, rows, labels, EPOCHS, seed)
    share = labels.mean()
    net.shift += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return net


def _constant(prior: float | None, seed: int) -> Network:
    """Gives every text the prior; 0 without labels."""
    net = Network(np.zeros(0, np.int64), seed)
    odds = min(max(prior or 0.0, 1e-13), 1 - 1e-13)
    net.out[:], net.shift[:] = 0, np.log(odds / (1 - odds))
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, seed: int = 7) -> bytes:
    """Fit on a sample of the labelled rows outside folds 0 and 1; all of fold 1 sets the thresholds.

    The model is bounded by its rows and widths.
    """
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max("toxic").cast("int").alias("toxic")).filter(remainder("doc_id", folds) != 0)
    prior = marks.agg(F.avg("toxic")).first()[0]
    if prior is None or prior in (0, 1):
        return _constant(prior, seed).to_bytes()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    drawn = [marks.filter(F.col("toxic") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1]).filter(remainder("doc_id", folds) != 1)
    drawn = F.broadcast(drawn.withColumnRenamed("doc_id", "marked_id"))  # at most 2 x sample rows
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = small_batches(body).join(drawn, F.col("doc_id") == F.col("marked_id")).select("doc_id", "text", "toxic")

    def run(batches):
        forget()
        found = [(d, t, y) for b in batches for d, t, y in zip(b["doc_id"].to_pylist(), raw(b, "text"), b["toxic"].to_pylist())]
        found.sort()
        if len({x[2] for x in found}) == 2:
            _, texts, marked = zip(*found)
            net = _learn(list(texts), np.array(marked, float), prior, seed)
        else:
            net = _constant(prior, seed)
        yield pa.RecordBatch.from_pydict({"model": [net.to_bytes()]})

    found = rows.repartition(1).mapInArrow(lean(run), "model binary").first()  # the sample alone is in one task
    net = Network.from_bytes(found[0]) if found else _constant(prior, seed)
    if len(net.hashes):  # without words all scores are the prior: no threshold parts them
        net.thresholds = _thresholds(docs, marks, net.to_bytes(), folds)
    return net.to_bytes()


def _thresholds(docs: DataFrame, marks: DataFrame, model: bytes, folds: int) -> dict[str, float]:
    """Thresholds from all labelled texts of fold 1, by language and ("") pooled.

    Texts are scored before the labels are joined, so none moves; what reaches the driver
    is at most one row for each language and score bin.
    """
    def run(batches):
        for batch, scores in scored(batches, model, "text"):
            bins = pa.array(np.searchsorted(CUTS, scores, "right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], bins], ["doc_id", "lang", "bin"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang"))
    body = small_batches(body.filter(F.col("doc_id").isNotNull() & (remainder("doc_id", folds) == 1)))
    binned = body.mapInArrow(lean(run), "doc_id long, lang string, bin int").join(marks, "doc_id")
    counted = binned.groupBy("lang", "bin").agg(F.count("toxic"), F.sum("toxic")).collect()
    held: dict[str, np.ndarray] = {"": np.zeros((2, len(CUTS) + 1), np.int64)}
    for lang, at, n, toxic in counted:
        for name in {"", lang}:
            held.setdefault(name, np.zeros((2, len(CUTS) + 1), np.int64))[:, at] += (n, toxic)
    return {name: _threshold(n, toxic) for name, (n, toxic) in sorted(held.items())
            if min(toxic.sum(), (n - toxic).sum()) >= LEAST_MARKS}


class Responses:
    """Filter responses of words, one table row each; starts anew when full."""

    def __init__(self, net: Network):
        self.net, self.banks = net, np.hstack([b[o] for b in net.filters for o in range(len(b))])
        self.forget()

    def forget(self) -> None:
        self.at, self.table = {b"": 0}, np.zeros((1024, self.banks.shape[1]), np.float32)

    def rows(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        new = {w for t in texts for w in t} - self.at.keys()
        if new and len(self.at) + len(new) > CACHED_WORDS:
            self.forget()
            new = {w for t in texts for w in t} - {b""}
        if new:
            first, total = len(self.at), len(self.at) + len(new)
            if total > len(self.table):
                grown = np.zeros((max(total, CACHED_WORDS), self.table.shape[1]), np.float32)  # takes memory as it fills
                grown[:first] = self.table[:first]
                self.table = grown
            self.table[first:total] = self.net.embed[self.net.parts(all_hashes(new))].sum(1) @ self.banks
            self.at.update(zip(new, range(first, total)))
        return [np.fromiter(map(self.at.__getitem__, t), np.int32, len(t)) for t in texts]


def scored(batches: Iterator[pa.RecordBatch], model: bytes, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with a score for each row."""
    forget()
    net = Network.from_bytes(model)
    words = Responses(net)
    gap = max(WIDTHS) - 1

    def pool(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n, tops, column = len(rows) - gap, [], 0
        for width in WIDTHS:
            sums = words.table[rows[:n], column:column + FILTERS]
            for o in range(1, width):
                sums += words.table[rows[o:o + n], column + o * FILTERS:column + (o + 1) * FILTERS]
            tops.append(largest(sums, starts, ends))
            column += width * FILTERS
        return np.hstack(tops)

    def grouped(texts):
        """Whole short texts together; a long one in stretches that overlap by a window."""
        held, size = [], 0
        for i, rows in enumerate(texts):
            for at in range(0, max(len(rows), 1), STEP_WORDS):
                part = rows[at:at + STEP_WORDS + gap]
                if held and size + len(part) > STEP_WORDS:
                    yield held
                    held, size = [], 0
                held.append((i, part))
                size += len(part)
        if held:
            yield held

    for batch in slices(batches, text, 1 << 20):
        tops = np.full((batch.num_rows, len(net.bias)), -np.inf, np.float32)
        for held in grouped(words.rows([t.lower().split() for t in raw(batch, text)])):
            owner = [i for i, _ in held]
            rows, starts, ends = padded([r for _, r in held])
            # Windows that begin in a stretch's overlap are the next stretch's, which has their other words.
            np.maximum.at(tops, owner, pool(rows, starts, np.minimum(ends, starts + STEP_WORDS)))
        yield batch, 1 / (1 + np.exp(-np.clip(net.logits(tops.astype(float)), -30, 30)))


def cutoff(model: bytes):
    """Threshold of a language: its own, else the pooled one, else one half."""
    thresholds = Network.from_bytes(model).thresholds
    return lambda lang: thresholds.get(lang or "?", thresholds.get("", 0.5))


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, score, and whether the score reaches the threshold of the document's language."""
    def run(batches):
        limit = cutoff(model)
        for batch, scores in scored(batches, model, "text"):
            flags = scores >= np.array([limit(x) for x in batch["lang"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores), pa.array(flags)], ["doc_id", "score", "flagged"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return small_batches(body).mapInArrow(lean(run), "doc_id long, score double, flagged boolean")


def clean(docs: DataFrame, model: bytes) -> DataFrame:
    """The documents that are not flagged, with the input's columns."""
    def run(batches):
        limit = cutoff(model)
        for batch, scores in scored(batches, model, "text"):
            kept = scores < np.array([limit(x) for x in batch["lang"].to_pylist()])
            yield batch.filter(pa.array(kept))

    return small_batches(docs).mapInArrow(lean(run), docs.schema)
