"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped by frequency.

`vocabulary` counts the words of all texts. `neighbours` finds, for every word, its near
words with a bit-sliced position index: a page of the vocabulary is kept as one bitset
for each (position, letter), a bit a word. A query is read letter by letter, and all words
of the page advance together. Four bitsets are tracked at once: words that agree so
far (no error), and words with one error, by how the places in query and word are shifted
against each other:

    replaced   place i of the query stands against place i of the word
    extra      the query has a letter more: place i stands against i - 1
    missing    the word has a letter more: place i stands against i + 1

One step is a few ANDs and ORs of machine words for a block of queries and the page.

Two near words of lengths c and c or c + 1 share the first c // 2 letters or the last
c - c // 2, as the difference lies in one part only. So a word meets only the words that
share one of these parts, and pages are filled from such groups. A group above
`spread` words is dealt to several pages, and its words are sent as queries to each; a
group's size is bounded by the words that the part left open can hold.

`groups` picks each word's form and follows forms to the last one.

Defined cases: null text has no words; null identifiers hash as the empty text; repeated
rows count again; equal numbers of occurrences are decided by code-point order; an empty
table gives no words; words of any length are handled; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelloom.llm.batches import slices, small_batches
from panelloom.llm.registry import texts
from panelloom.sources.storage import stage

MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
NOISE = 199          # one run in this many loses a letter
PAGE = 1024          # words of a page's index
SPREAD = 8192        # words of a group that go to one page
BLOCK = 512          # queries that advance together
HELD = 200_000       # distinct words that a task holds before it gives their counts on
FOUND = "word string, n_near long, near_n long, near string"


def _counts(docs: DataFrame, noise: int, letters: int, most: int) -> DataFrame:
    """(word, n) with partial counts: runs of letters, A-Z lower-cased, some with a letter deleted."""
    run = re.compile("[a-zÀ-ÿ]{%d,}" % letters)  # shorter maximal runs give no word

    def count(batches):
        held: Counter = Counter()

        def given():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for piece in slices([batch], "text"):
                for doc, text in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist()):
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in Counter(run.findall(text.encode().lower().decode())).items():
                        h = zlib.crc32(word.encode(), start)
                        if noise and h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < letters:
                                continue
                        held[word] += n
                if len(held) > most:
                    yield given()
                    held.clear()
        yield given()

    return small_batches(texts(docs)).mapInArrow(count, "word string, n long")


def vocabulary(docs: DataFrame, letters: int = MIN_LETTERS, least: int = MIN_COUNT, noise: int = NOISE,
               held: int = HELD) -> DataFrame:
    """(word, n): distinct words with at least `letters` code points and `least` occurrences in all texts.

    `noise` deletes a letter from one in so many (document, word) pairs, by checksum; 0 deletes none. `held` bounds
    the distinct words that a task counts before it gives them on.
    """
    total = _counts(docs, noise, letters, held).groupBy("word").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") >= least)


def _parts(words: DataFrame) -> DataFrame:
    """Every word with the parts that it may share with a near one: (c, side, part, word, n, length)."""
    def of(c: str, side: int) -> str:
        half = f"cast({c} div 2 as int)"
        part = f"substring(word, 1, {half})" if side == 0 else f"substring(word, length - {c} + {half} + 1)"
        return f"named_struct('c', cast({c} as int), 'side', {side}, 'part', {part})"

    ways = ", ".join(of(c, side) for c in ("length", "(length - 1)") for side in (0, 1))
    return words.withColumn("length", F.length("word")).select("word", "n", "length", F.expr(f"inline(array({ways}))"))


def _paged(parts: DataFrame, spread: int) -> DataFrame:
    """Rows for the pages: `held` rows are in the page's index, `asked` ones are its queries."""
    keys = ["c", "side", "part"]
    sizes = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("length").alias("least"))
    # Words that are alone, and groups of long words only, have no pair of this class.
    sizes = stage(sizes.where("size > 1 and least = c").select(*keys, F.ceil(F.col("size") / spread).cast("int").alias("pages")), "spelling-parts")
    rows = parts.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("word"), F.col("pages")).cast("int"))
    return rows.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).select(
        *keys, "page", "word", "n", (F.col("page") == F.col("own")).alias("held"))


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32) + 1  # 0 stands for no letter


class Index:
    """Bitsets over the words of a page: bit w of (position, letter) says that word w has the letter there."""

    def __init__(self, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.zeros((len(words), int(size.max()) + 2), np.uint32)
        for i, w in enumerate(words):
            self.codes[i, :len(w)] = _codes(w)
        self.width = -(-len(words) // 64)
        self.of_length = lambda n: self._bits((size == n)[None, :])[0]

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        packed = np.packbits(flags, axis=1, bitorder="little")
        out = np.zeros((len(flags), self.width * 8), np.uint8)
        out[:, :packed.shape[1]] = packed
        return out.view(np.uint64)

    def at(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitsets at a place, the first one empty, and the letters of the others."""
        column = self.codes[:, place] if 0 <= place < self.codes.shape[1] else np.zeros(len(self.codes), np.uint32)
        letters = np.unique(column[column > 0])
        return self._bits(np.vstack([np.zeros((1, len(column)), bool), letters[:, None] == column[None, :]])), letters

    def near(self, queries: np.ndarray) -> np.ndarray:
        """Words one difference away from each query (codes of equal length): a bitset for each query."""
        asked, n = queries.shape
        agree = np.full((asked, self.width), ~np.uint64(0))
        replaced, extra, missing = (np.zeros_like(agree) for _ in range(3))
        sets = {-1: self.at(-1), 0: self.at(0)}
        for i in range(n):
            sets[i + 1] = self.at(i + 1)
            behind, here, ahead = (_rows(*sets[at], queries[:, i]) for at in (i - 1, i, i + 1))
            missing = (missing | agree) & ahead   # the word's letter at i was passed over, now or before
            extra = (extra & behind) | agree      # the query's letter is passed over, now or before
            replaced = (replaced & here) | (agree & ~here)
            agree = agree & here
            del sets[i - 1]
        missing |= agree                          # the word's last letter
        return (replaced & self.of_length(n)) | (extra & self.of_length(n - 1)) | (missing & self.of_length(n + 1))


def _rows(bits: np.ndarray, letters: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The bitset of each asked letter."""
    if not len(letters):
        return np.broadcast_to(bits[0], (len(asked), bits.shape[1]))
    at = np.minimum(np.searchsorted(letters, asked), len(letters) - 1)
    return bits[np.where(letters[at] == asked, at + 1, 0)]


def _pairs(rows: pd.DataFrame, c: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers of the near pairs of class c within the groups of a page."""
    words = rows["word"].tolist()
    held = np.flatnonzero(rows["held"].to_numpy())
    queries, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    length = np.fromiter(map(len, words), np.int64, len(words))
    index = Index([words[i] for i in held]) if len(held) else None
    for n in (c, c + 1) if index else ():
        asked = np.flatnonzero(length == n)
        for start in range(0, len(asked), BLOCK):
            block = asked[start:start + BLOCK]
            bits = index.near(_codes("".join(words[i] for i in block)).reshape(len(block), n))
            if n > c:
                bits &= index.of_length(c)  # two long words are a pair of the next class
            q, w = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little", count=len(held)))
            queries.append(block[q])
            found.append(held[w])
    q, w = np.concatenate(queries), np.concatenate(found)
    group = rows["group"].to_numpy()
    mine = (group[q] == group[w]) & (q != w)
    q, w = q[mine], w[mine]
    if side:  # pairs that share the first part too have been found by it
        half = c // 2
        new = np.fromiter((words[a][:half] != words[b][:half] for a, b in zip(q, w)), bool, len(q))
        q, w = q[new], w[new]
    return q, w


def _best(rows: pd.DataFrame, c: int, side: int) -> pd.DataFrame:
    """Near words counted for each query, with the most frequent one."""
    q, w = _pairs(rows, c, side)
    n, word = rows["n"].to_numpy(), rows["word"].to_numpy()
    pairs = pd.DataFrame({"word": word[q], "near_n": n[w], "near": word[w]})
    pairs = pairs.sort_values(["word", "near_n", "near"], ascending=[True, False, True], kind="stable")
    pairs["n_near"] = pairs.groupby("word", sort=False)["near"].transform("size").astype("int64")
    return pairs.drop_duplicates("word")[["word", "n_near", "near_n", "near"]]


def neighbours(words: DataFrame, page: int = PAGE, spread: int = SPREAD) -> DataFrame:
    """(word, n_near, near_n, near): number of near words and the most frequent one; words without one have no row."""
    def run(batches):
        waiting, size, at = [], 0, None

        def flush():
            rows = pd.concat(waiting, ignore_index=True)
            best = _best(rows, *at)
            return pa.RecordBatch.from_pandas(best, pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())]), preserve_index=False)

        last = -1
        rest = None
        for batch in batches:
            frame = batch.to_pandas()
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            keys = frame[["c", "side", "part", "page"]]
            change = (keys != keys.shift()).any(axis=1)
            frame["group"] = change.cumsum() + last
            open_from = int(np.flatnonzero(change.to_numpy())[-1])  # the last group may go on in the next batch
            rest = frame.iloc[open_from:].drop(columns="group")
            for (c, side), part in frame.iloc[:open_from].groupby(["c", "side"], sort=False):
                for cut in _cuts(part["group"].to_numpy(), page):
                    if waiting and (at != (c, side) or size + cut.stop - cut.start > page):
                        yield flush()
                        waiting, size = [], 0
                    waiting.append(part.iloc[cut])
                    size, at = size + cut.stop - cut.start, (c, side)
            last += int(change.sum())
        if rest is not None and len(rest):
            if waiting and at != (rest["c"].iloc[0], rest["side"].iloc[0]):
                yield flush()
                waiting = []
            waiting.append(rest.assign(group=last + 1))
            at = (rest["c"].iloc[0], rest["side"].iloc[0])
        if waiting:
            yield flush()

    rows = _paged(_parts(words), spread)
    # The page spreads a large group over tasks; a page's rows stay together.
    rows = rows.repartition("c", "side", "part", "page").sortWithinPartitions("c", "side", "part", "page")
    partial = rows.mapInArrow(run, FOUND)
    return partial.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def _cuts(group: np.ndarray, page: int) -> list[slice]:
    """Stretches of whole groups with at most `page` rows, or one group."""
    edges = np.concatenate([np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    out, start, end = [], 0, 0
    for edge in edges:
        if end > start and edge - start > page:
            out.append(slice(start, end))
            start = end
        end = int(edge)
    if end > start:
        out.append(slice(start, end))
    return out


def groups(words: DataFrame, ratio: int = RATIO, page: int = PAGE, spread: int = SPREAD) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of `words` (word, n; words distinct).

    A word's form is its most frequent near word, if that is at least `ratio` times as
    frequent; forms are followed to the root by doubling the steps, so the rounds grow with
    the logarithm of a chain's length.
    """
    words = stage(words, "spelling-words")
    near = neighbours(words, page, spread)
    often = F.col("near_n") >= ratio * F.col("n")
    formed = stage(words.join(near.withColumnRenamed("word", "near_to"), F.col("word") == F.col("near_to"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("near")).alias("form"), F.when(often, F.col("near_n")).alias("form_n")), "spelling-forms")
    chains = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        above = chains.select(F.col("word").alias("step"), F.col("root").alias("beyond"))
        moved = stage(chains.join(above, F.col("root") == F.col("step"), "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-chains")
        chains = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    ends = chains.select(F.col("word").alias("variant"), "root")
    return formed.join(ends, F.col("word") == F.col("variant"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
