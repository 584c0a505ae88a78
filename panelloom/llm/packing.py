"""Best-fit decreasing packing of tokenised documents into windows of fixed length.

Each document is tokenised where it is read and cut into full windows and a remainder;
only lengths, checksums and starts go on. Best fit decreasing depends on the remainders'
lengths alone, so their histogram (fewer rows than a window has tokens) is all that the
plan needs: for each length, from long to short, a segment tree indexed by remaining
capacity finds the tightest open windows, which take pieces in groups of equal windows.
Pieces find their place by their rank among those of equal length, which is a task's
count so far and the counts of the tasks before it.

A window left with more than `spare` tokens of padding is dissolved: its pieces are cut
into powers of two, which fill windows without a gap.

A special token's text in a document is that token, as the library has it by default.

Defined cases: null is the empty text, which still has its end token; null identifiers
and repeated rows are packed like others; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelloom.llm.batches import kept, lean, raw, slices, small_batches
from panelloom.llm.words import stirred
from panelloom.sources.storage import stage

WINDOW = 2048
SPARE = 16
END = 1
PIECE = "struct<start:long,length:long,crc:long>"
CACHED_WORDS = 800_000   # some 30 bytes each
RUN_BYTES = 1 << 20      # bytes whose words are looked up together
# Fixed value: the pattern of vocabularies whose tokens lie within words.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Words:
    """Token ids of words, looked up by a 64-bit hash; unseen words are tokenised together.

    Used only where the vocabulary's file says that no token spans a blank, so that a text's ids
    are its words' ids in order; otherwise, and for texts with a special token, whole texts are
    tokenised. A vocabulary that ignores case reads texts without combining marks (which could meet a
    small letter but not a capital) in small ASCII letters: fewer words.

    The table holds arrays alone, some 30 bytes a word: hashes in order, where the ids start,
    their number, and uses; the least used half goes when it is full.
    """

    MARKED = re.compile(rb"[\xcc-\xff]")  # first bytes of U+0300 and above
    LETTERS = re.compile("[a-zß-öø-ÿ]+")  # one match of the pattern, which no normalisation changes
    SIGN = "0"  # a digit is a token of its own: it parts the words of one call
    # Byte-level vocabularies write each byte as a character: printable ones as they are, others from 256 on.
    BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

    def __init__(self, path: str, held: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.held = held
        rules = json.loads(self.tokenizer.to_str())
        steps = _steps(rules["normalizer"], "normalizers")
        cuts = _steps(rules["pre_tokenizer"], "pretokenizers")
        self.folds = {"type": "Lowercase"} in steps
        # Only what the pattern matches is kept, and it matches no blank; each match ends in a sign of its own.
        self.apart = (bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
                      and cuts[0]["pattern"].get("Regex") == WORD_PATTERN
                      and cuts[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
                      and {x["type"] for x in steps} <= {"NFC", "Replace", "Lowercase"} and rules["post_processor"] is None)
        self.special = re.compile(b"|".join(re.escape(t["content"].lower().encode()) for t in rules["added_tokens"]) or b"(?!)")
        if self.apart:
            self.sign, = self.tokenizer.encode(self.SIGN, add_special_tokens=False).ids
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.counts, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, end to end, and where each word's end."""
        counts = self.counts[at]
        till = np.cumsum(counts, dtype=np.int64)
        return self.flat[np.repeat(self.starts[at] - till + counts, counts) + np.arange(till[-1] if len(till) else 0)], till

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and their numbers."""
        found: list = [None] * len(words)
        some, rest = [], []
        tokens = self.tokenizer.model.tokenize
        for i, word in enumerate(words):
            if self.LETTERS.fullmatch(word):
                written = word if word.isascii() else word.encode().decode("latin-1").translate(self.BYTES)
                found[i] = [t.id for t in tokens(written)]
            else:
                (rest if self.SIGN in word else some).append(i)
        groups = [some[i:i + 500] for i in range(0, len(some), 500)]
        calls = [f" {self.SIGN} ".join(words[i] for i in g) for g in groups] + [words[i] for i in rest]
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(calls, add_special_tokens=False)]
        for group, ids in zip(groups, encoded):
            cuts = [-1, *(at for at, x in enumerate(ids) if x == self.sign), len(ids)]
            if len(cuts) != len(group) + 1:
                raise ValueError("the parting sign is not a token of its own in this vocabulary")
            for i, low, high in zip(group, cuts, cuts[1:]):
                found[i] = ids[low + 1:high]
        for i, ids in zip(rest, encoded[len(groups):]):
            found[i] = ids
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int32, len(found))

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add words with their hashes (in order)."""
        flat, counts = self._encode(words)
        starts = (len(self.flat) + np.cumsum(counts) - counts).astype(np.int32)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.counts = np.insert(self.keys, at, keys), np.insert(self.counts, at, counts)
        self.starts, self.uses = np.insert(self.starts, at, starts), np.insert(self.uses, at, 0)
        self.flat = np.concatenate([self.flat, flat])

    def _forget(self) -> None:
        """Keep the words that were used most."""
        best = np.sort(np.argsort(-self.uses, kind="stable")[:self.held // 2])
        self.flat, till = self._gather(best)
        self.keys, self.counts, self.uses = self.keys[best], self.counts[best], self.uses[best] // 2
        self.starts = (till - self.counts).astype(np.int32)

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes in the table, and which are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _by_words(self, texts: list[bytes], fold: bool) -> list[np.ndarray]:
        data = b" ".join([*texts, b""])
        if fold:
            data = data.lower()
        hashes, first, last, ends = word_spans(data, list(map(len, texts)))
        keys, example, of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.held:
            self._forget()
        _, known = self._found(keys)
        new = example[~known]
        self._learn(keys[~known], [data[a:b].decode() for a, b in zip(first[new].tolist(), last[new].tolist())])
        places, _ = self._found(keys)
        self.uses[places] += np.bincount(of, minlength=len(keys)).astype(np.int32)
        flat, till = self._gather(places[of])
        cuts = np.concatenate([[0], till])[ends]
        return [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, then the end token."""
        found: list[list] = [[] for _ in texts]
        runs: dict[bool, list] = {True: [], False: []}  # (text, piece) waiting, folded or not
        held = {True: 0, False: 0}
        for i, text in enumerate(texts):
            if not self.apart or self.special.search(text.lower()):
                found[i].append(np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32))
                continue
            fold = self.folds and not self.MARKED.search(text)
            for piece in pieces_of(text):
                if held[fold] + len(piece) > RUN_BYTES:
                    self._run(runs[fold], fold, found)
                    held[fold] = 0
                runs[fold].append((i, piece))
                held[fold] += len(piece)
        for fold, run in runs.items():
            self._run(run, fold, found)
        end = [np.array([END], np.uint32)]
        return [np.concatenate(x + end) for x in found]

    def _run(self, run: list[tuple[int, bytes]], fold: bool, found: list[list]) -> None:
        if run:
            for (i, _), part in zip(run, self._by_words([p for _, p in run], fold)):
                found[i].append(part)
            run.clear()


def _steps(rule: dict | None, name: str) -> list[dict]:
    return [] if rule is None else rule[name] if rule["type"] == "Sequence" else [rule]


def pieces_of(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces that end at blanks, of `most` bytes unless a word is longer."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(b" ", at, at + most), text.rfind(b"\n", at, at + most))
        if cut <= at:
            nexts = [x for x in (text.find(b" ", at + most), text.find(b"\n", at + most)) if x >= 0]
            cut = min(nexts, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_spans(data: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of joined texts, and the number of words up to the end of each text."""
    at = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], (at == 32) | (at == 10), [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edges[::2], edges[1::2]
    # A full stop or comma that ends a word after a letter is a token of its own; so there are fewer words.
    stop = last[(last - first > 1)] - 1
    before, lead = at[stop - 1], at[np.maximum(stop - 2, 0)]
    letter = _LETTER[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    stop = stop[((at[stop] == 46) | (at[stop] == 44)) & letter]
    first, last = np.sort(np.concatenate([first, stop])), np.sort(np.concatenate([last, stop]))
    ends = np.searchsorted(first, np.cumsum(np.array(lengths, np.int64) + 1))
    # Sums of byte values times powers of the base, modulo 2^64: a word's is a difference, brought to place 0.
    powers, back = _powers(len(at) + 1)
    sums = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(_BYTE[at] * powers[:len(at)], out=sums[1:])
    size = last - first
    hashes = stirred((sums[last] - sums[first]) * back[first] + size.astype(np.uint64))
    for i in np.flatnonzero(size > 64).tolist():  # sums of many powers can be made to collide
        hashes[i] = int.from_bytes(blake2b(data[first[i]:last[i]], digest_size=8).digest(), "little")
    return hashes, first, last, ends


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_KNOWN = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of the base and of its inverse."""
    if len(_KNOWN[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            up = np.full(n, base, np.uint64)
            up[0] = 1
            _KNOWN[k] = np.multiply.accumulate(up)
    return _KNOWN[0], _KNOWN[1]


def words_of(path: str, held: int) -> Words:
    return kept((Words, path, held), lambda: Words(path, held))


def cut(ids: np.ndarray, window: int) -> tuple[list, list, list]:
    """(full windows, the remainder if any, the remainder's powers of two), as start, length, checksum."""
    piece = lambda a, n: {"start": a, "length": n, "crc": zlib.crc32(ids[a:a + n].astype("<u4").tobytes())}
    full = [piece(a, window) for a in range(0, len(ids) - window + 1, window)]
    at, rest = len(full) * window, len(ids) % window
    parts, start = [], at
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            parts.append(piece(start, 1 << bit))
            start += 1 << bit
    return full, [piece(at, rest)] if rest else [], parts if len(parts) > 1 else []


def tokenise(docs: DataFrame, path: str, window: int = WINDOW, held: int = CACHED_WORDS) -> DataFrame:
    """Pieces of every whole text: doc_id, doc_tokens, full, rest, parts; and where they stand in their task:
    `part` is the task, `full_rank` and `rest_rank` count the full windows, and the remainders of equal length, before."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))

    def run(batches):
        from pyspark import TaskContext

        words, task = words_of(path, held), TaskContext.get().partitionId()
        windows, seen = 0, defaultdict(int)
        for batch in slices(batches, "text", 4 << 20):
            found = words.ids(raw(batch, "text"))
            full, rest, parts = zip(*(cut(x, window) for x in found))
            full_rank, rest_rank = [], []
            for x, y in zip(full, rest):
                full_rank.append(windows)
                windows += len(x)
                size = y[0]["length"] if y else 0
                rest_rank.append(seen[size])
                seen[size] += 1
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(x) for x in found], pa.int64()),
                 *(pa.array(x, kind) for x in (full, rest, parts)), pa.array([task] * len(found), pa.int32()),
                 pa.array(full_rank, pa.int64()), pa.array(rest_rank, pa.int64())],
                ["doc_id", "doc_tokens", "full", "rest", "parts", "part", "full_rank", "rest_rank"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lists = ", ".join(f"{n} array<{PIECE}>" for n in ("full", "rest", "parts"))
    return small_batches(body).mapInArrow(lean(run), f"doc_id long, doc_tokens long, {lists}, part int, full_rank long, rest_rank long")


class Capacities:
    """Segment tree over remaining capacities: the smallest one at or above a size that has open windows."""

    def __init__(self, top: int):
        self.leaves = 1 << (top + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, windows: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += windows
            at >>= 1

    def tightest(self, size: int) -> int | None:
        at = size + self.leaves
        if self.count[at]:
            return size
        while at > 1 and (at & 1 or not self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, list]]:
    """Groups of equal windows: (windows, remaining capacity, content).

    Content lists (size, pieces a window, first rank, offset): window j of the group takes the
    pieces of that size whose ranks begin at first rank + j * pieces.
    """
    tree, groups = Capacities(window), defaultdict(list)

    def shelve(windows, capacity, content):
        groups[capacity].append((windows, content))
        tree.add(capacity, windows)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            capacity = tree.tightest(size)
            if capacity is None:
                capacity, windows, content = window, -(-left // (window // size)), []
            else:
                windows, content = groups[capacity].pop()
                tree.add(capacity, -windows)
            fit = min(capacity // size, left)
            taken = min(windows, left // fit)
            if taken < windows and content:
                rest = [(s, n, first + taken * n, offset) for s, n, first, offset in content]
                shelve(windows - taken, capacity, rest)
            shelve(taken, capacity - fit * size, [*content, (size, fit, rank, window - capacity)])
            rank += taken * fit
            left -= taken * fit
    return [(n, capacity, content) for capacity, held in groups.items() for n, content in held]


def plan(histogram: dict[int, int], first: int, window: int = WINDOW, spare: int = SPARE):
    """(places of whole pieces, places of cut ones, ranks of cut ones): rows for the joins below.

    A place is (size, rank from, rank till, pieces a window, first sequence, offset).
    """
    whole, dissolved = [], []
    for windows, capacity, content in best_fit(histogram, window):
        fill = window - capacity
        if capacity <= spare or fill & (fill - 1) == 0:
            whole += [(s, a, a + windows * n, n, first, offset) for s, n, a, offset in content]
            first += windows
        else:
            dissolved += [(s, a, a + windows * n) for s, n, a, _ in content]
    bits, ranks = defaultdict(int), []
    for size, a, b in dissolved:
        for bit in range(size.bit_length()):
            if size >> bit & 1:
                ranks.append((size, a, b, 1 << bit, bits[1 << bit]))
                bits[1 << bit] += b - a
    parts = []
    for windows, _, content in best_fit(dict(bits), window):
        parts += [(s, a, a + windows * n, n, first, offset) for s, n, a, offset in content]
        first += windows
    return whole, parts, ranks


def _ranked(cut_docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Every piece with its rank among those of equal length; and (length, part, n), the pieces of each task.

    A rank is the number of such pieces in earlier tasks, and that of earlier ones in the same
    task, which is known since the text was read. So nothing is sorted, and no length is one task's.
    """
    sizes = F.array(F.struct(F.lit(window).cast("long").alias("length"), F.size("full").cast("long").alias("n")),
                    F.struct(F.coalesce(F.get("rest", F.lit(0))["length"], F.lit(0)).alias("length"), F.lit(1).cast("long").alias("n")))
    counts = stage(cut_docs.select("part", F.inline(sizes)).where("n > 0 and length > 0").groupBy("length", "part")
                   .agg(F.sum("n").alias("n")), "piece-counts")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    starts = counts.select("length", F.col("part").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def pieces(name, rank, parts):
        return F.transform(name, lambda p, i: F.struct(p["start"].alias("start"), p["length"].alias("length"), p["crc"].alias("crc"),
                                                       rank(i).alias("rank"), parts.alias("parts")))

    none = F.lit(None).cast(f"array<{PIECE}>")
    both = F.concat(pieces("full", lambda i: F.col("full_rank") + i, none), pieces("rest", lambda i: F.col("rest_rank") + i, F.col("parts")))
    rows = cut_docs.select("doc_id", "doc_tokens", "part", F.inline(both)).withColumnRenamed("length", "long")
    placed = rows.join(starts, (F.col("long") == F.col("length")) & (F.col("part") == F.col("of")))
    return placed.select("doc_id", "doc_tokens", "start", "length", "crc", "parts", (F.col("base") + F.col("rank")).alias("rank")), counts


def _placed(pieces: DataFrame, places: list, window: int) -> DataFrame:
    """Look up (length, rank) in the places; their number depends on the window, not on the rows."""
    schema = "size long, low long, high long, fit long, first long, base long"
    at = F.broadcast(pieces.sparkSession.createDataFrame(places, schema))
    inside = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    nth = F.col("rank") - F.col("low")
    return pieces.join(at, inside).select(
        "doc_id", "start", "length", "crc", "doc_tokens",
        F.expr("first + (rank - low) div fit").alias("sequence_id"),
        (F.col("base") + F.pmod(nth, F.col("fit")) * F.col("size")).alias("offset"))


def pack(docs: DataFrame, path: str, window: int = WINDOW, spare: int = SPARE, held: int = CACHED_WORDS) -> DataFrame:
    """Every piece with its sequence and its offset there; `held` words are kept in a worker's table."""
    spark = docs.sparkSession
    cut_docs = stage(tokenise(docs, path, window, held), "pieces")
    ranked, counts = _ranked(cut_docs, window)
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # no more rows than a window has tokens
    full_total = histogram.pop(window, 0)
    whole, parts, ranks = plan(histogram, full_total, window, spare)
    placed = _placed(ranked, [*whole, (window, 0, full_total, 1, 0, 0)], window)
    moved = F.broadcast(spark.createDataFrame(ranks, "size long, low long, high long, bit long, bit_base long"))
    opened = ranked.join(moved, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    opened = opened.withColumn("part", F.when(F.size("parts") > 0, F.filter("parts", lambda p: p["length"] == F.col("bit"))[0])
                               .otherwise(F.struct("start", "length", "crc")))
    opened = opened.select("doc_id", "doc_tokens", "part.start", "part.length", "part.crc",
                           (F.col("bit_base") + F.col("rank") - F.col("low")).alias("rank"))
    placed = placed.unionByName(_placed(opened, parts, window))
    return placed.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
