"""Exact removal of repeated byte strings, by sorting sampled suffixes.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier. Not all
suffixes need sorting: every string of that length has one anchor, the smallest hash
among its grams of `GRAM` bytes, and equal strings have it at the same place. So each
suffix that starts at an anchor stands for the strings whose anchor it is; its entry is
the text from the first of them to the end of the last.

1. The grams at anchors are counted; those found twice or more set a bit in a map of fixed
   size. A full map only lets more entries through: results don't depend on it. Entries
   whose bit is set are merged by a hash of their text: of equal ones, all but the first
   are repeats as a whole. Grams that two different entries share make the next map.
2. Entries of those grams go to buckets, by splitters sampled from the leading bytes of
   the suffixes. Bytes that are so common that several splitters are equal get a bucket of
   their own, dealt over as many parts. Equal entries of a task are merged before.
3. Buckets sort locally by multikey quicksort: eight bytes at a time, going on only
   with suffixes that still tie. Equal entries all repeat the first. Where entries share
   the gram but not the rest, their strings are compared one by one.
4. Parts of one bucket compare across their boundaries: the first of each of their strings
   meet by hash.

Strings are compared as two 64-bit hashes, entries in the merge as hashes of gram and
text (128 bits), in the buckets byte by byte.

Defined cases: null is the empty text; matches never cross documents; a null identifier
comes last; rows with equal identifier and text are one document and get one result each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from panelloom.llm.batches import forget, give_back, raw, slices, small_batches
from panelloom.llm.words import _BYTE, _MIX, stirred
from panelloom.sources.storage import stage

LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1  # grams in a string
MAP_BITS = 27
PLACE_BITS = 24
SLICE = 1 << 18
SENT_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
MAPPED_BYTES = 16 << 20
ROWS_AT_ONCE = 4096
MERGED_AT_ONCE = 100_000
SAMPLED_DOCUMENTS, SAMPLED_EACH = 8000, 64
LEAD = 16
LAST_ID = (1 << 63) - 1  # a null identifier within tasks

_CODE = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _MIX[2]


def rolled(values: np.ndarray, width: int, odd: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of `width` values, put together from runs of powers of two."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, done, size, factor = None, width, 1, odd
    while True:
        if width & size:  # the shortest runs stand last
            done -= size
            part = values[done:done + n]
            out = part if out is None else part * scale + out
            with np.errstate(over="ignore"):
                scale = factor if out is part else scale * factor
        if 2 * size > width:
            return out
        values = values[:-size] * factor + values[size:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        size *= 2


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys."""
    size, low = 1, keys
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(keys) - width + 1
    return np.minimum(low[:n], low[width - size:width - size + n])


class Anchors:
    """The anchors of several texts: text number, place, first and last string start, gram hash."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.cumsum(lengths) - lengths
        grams = stirred(rolled(_CODE[self.data], GRAM, _ODD))
        if len(self.data) < LENGTH:
            self.number = self.at = self.first = self.last = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        low = np.uint64((1 << PLACE_BITS) - 1)
        lowest = least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), GRAMS)
        ends = np.repeat(self.begins + lengths, lengths)[:len(lowest)]
        starts = np.flatnonzero(np.arange(len(lowest)) + LENGTH <= ends)
        place = (lowest[starts] & low).astype(np.int64)
        turn = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(place) else place
        self.at, self.first = place[turn], starts[turn]
        self.last = starts[np.concatenate([turn[1:] - 1, [len(starts) - 1]])] if len(turn) else turn
        self.number = np.searchsorted(self.begins, self.first, side="right") - 1
        self.gram = stirred(grams[self.at])  # spread anew: at anchors the hashes are small, and maps and buckets take leading bits


def pieces(batches: Iterator[pa.RecordBatch]):
    """(identifiers, names, offsets, texts) of bounded size; a text beyond that comes in overlapping pieces."""
    forget()
    for batch in slices(batches, "text", SLICE):
        ids = [LAST_ID if x is None else x for x in batch["doc_id"].to_pylist()]
        rows = zip(ids, batch["name"].to_pylist(), raw(batch, "text"))
        cut = [(i, name, at, text[at:at + SLICE + LENGTH - 1]) for i, name, text in rows for at in range(0, max(len(text), 1), SLICE)]
        if len(cut) == batch.num_rows:
            yield tuple(zip(*cut))
        else:
            yield from (((i,), (n,), (a,), (t,)) for i, n, a, t in cut)


def spans(data: np.ndarray, first: np.ndarray, till: np.ndarray) -> np.ndarray:
    """The bytes of several ranges, end to end."""
    size = till - first
    return data[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]


def fingerprints(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of the strings that lie end to end in the data."""
    starts = np.cumsum(size) - size
    place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), size)
    powers = np.multiply.accumulate(np.full(int(size.max(initial=1)), _MIX[3], np.uint64))
    return stirred(np.add.reduceat(_BYTE_CASED[data] * powers[place], starts) + size.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)


_BYTE_CASED = stirred(_BYTE + np.arange(256, dtype=np.uint64))  # tells capitals apart


def _bit_map(hashes: DataFrame, twice: bool) -> np.ndarray:
    """Bits of the hashes (all, or those found twice) in a map of 2^MAP_BITS bits, whatever the input.

    hashes: bucket, data (64-bit hashes packed); equal hashes must have equal buckets.
    """
    shift = 64 - MAP_BITS

    def marked(part: pd.DataFrame) -> tuple[int, bytes]:
        found, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in part["data"]]), return_counts=True)
        at = np.unique(found[n > twice] >> np.uint64(shift)).astype(np.int64)
        low = int(at[0] >> 3) if len(at) else 0
        bits = np.zeros(int(at[-1] >> 3) - low + 1 if len(at) else 0, np.uint8)
        np.bitwise_or.at(bits, (at >> 3) - low, np.uint8(1) << (at & 7).astype(np.uint8))
        return low, bits.tobytes()

    def count(part: pd.DataFrame) -> pd.DataFrame:
        low, bits = marked(part)
        give_back()
        return pd.DataFrame({"low": [low], "bits": [bits]})

    out = np.zeros((1 << MAP_BITS) >> 3, np.uint8)
    for low, bits in hashes.groupBy("bucket").applyInPandas(count, "low long, bits binary").collect():  # the map, in pieces
        out[low:low + len(bits)] |= np.frombuffer(bits, np.uint8)
    return out


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _by_bucket(hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted hashes in ranges of the map."""
    bucket = (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64) * buckets >> MAP_BITS
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return pa.RecordBatch.from_pydict({"bucket": bucket[np.concatenate([[0], cuts])], "data": [x.tobytes() for x in np.split(hashes, cuts)]})


def _repeated(docs: DataFrame, buckets: int) -> np.ndarray:
    """Bit map of the grams found at two anchors or more."""
    def send(batches):
        for *_, texts in pieces(batches):
            gram, n = np.unique(Anchors(list(texts)).gram, return_counts=True)
            if len(gram):
                yield _by_bucket(np.repeat(gram, np.minimum(n, 2)), buckets)
            gram = n = None
        give_back()

    return _bit_map(docs.mapInArrow(send, "bucket long, data binary"), True)


def _marked(anchors: Anchors, bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_in_map(bits, anchors.gram))


def _leads(anchors: Anchors, some: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(anchors.data, LEAD)[anchors.at[some]].copy().view(f"S{LEAD}").ravel()


def _splitters(docs: DataFrame, bits: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct splitters and how often each was drawn, from a bounded sample of documents."""
    documents = docs.count()
    share = max(1, documents // SAMPLED_DOCUMENTS)
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "name"), F.lit(share)) == 0)

    def lead(batches):
        for ids, *_, texts in pieces(batches):
            anchors = Anchors(list(texts))
            some = _marked(anchors, bits)
            if len(some):
                step = max(1, len(some) // (SAMPLED_EACH * len(ids)))
                yield pa.RecordBatch.from_pydict({"leads": [_leads(anchors, some[::step]).tobytes()], "n": [len(some)]})

    rows = drawn.mapInArrow(lead, "leads binary, n long").collect()  # at most some hundred thousand short strings
    if not rows:
        return np.zeros(0, f"S{LEAD}"), np.zeros(0, np.int64)
    leads = np.sort(np.concatenate([np.frombuffer(r.leads, f"S{LEAD}") for r in rows]))
    buckets = max(16, sum(r.n for r in rows) * share * 2 * LENGTH // BUCKET_BYTES)
    at = np.arange(1, buckets) * len(leads) // buckets
    return np.unique(leads[at], return_counts=True)


ENTRIES = "bucket long, part long, ids binary, names binary, at binary, left binary, right binary, data binary"
COVERED = "doc_id long, name long, first long, till long, bucket long, data binary"


def _merged(ids, names, first, till) -> pd.DataFrame:
    """Intervals of each document, joined where they touch."""
    order = np.lexsort((first, names, ids))
    ids, names, first, till = ids[order], names[order], first[order], till[order]
    if not len(ids):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc_id", "name", "first", "till")})
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (names[1:] != names[:-1])])
    group = np.cumsum(new) - 1
    wide = int(till.max()) + 1
    reach = np.maximum.accumulate(till + group * wide) - group * wide
    start = np.concatenate([[True], new[1:] | (first[1:] > reach[:-1])])
    end = np.concatenate([np.flatnonzero(start)[1:] - 1, [len(ids) - 1]])
    return pd.DataFrame({"doc_id": ids[start], "name": names[start], "first": first[start], "till": reach[end]})


def _entries(piece, bits: np.ndarray) -> dict[str, np.ndarray]:
    """Entries of one piece whose gram is in the map, with their bytes end to end."""
    ids, names, offsets, texts = piece
    anchors = Anchors(list(texts))
    some = _marked(anchors, bits)
    number, at, first, till = anchors.number[some], anchors.at[some], anchors.first[some], anchors.last[some] + LENGTH
    shift = np.array(offsets, np.int64)[number] - anchors.begins[number]
    data = spans(anchors.data, first, till)
    return {"doc": np.array(ids, np.int64)[number], "name": np.array(names, np.int64)[number], "at": at + shift,
            "left": at - first, "right": till - at, "lead": _leads(anchors, some) if len(some) else np.zeros(0, f"S{LEAD}"),
            "mark": fingerprints(data, till - first), "gram": anchors.gram[some], "data": data}


def _packed(held: list[dict], splitters: np.ndarray, drawn: np.ndarray) -> pa.RecordBatch:
    """Entries by bucket and part. Equal entries of one task are merged: the ranges of all but the first are settled
    already, and go along in buckets below zero."""
    doc, name, at, left, right, lead, mark, _, data = (np.concatenate([h[c] for h in held]) for c in held[0])
    size = left + right
    begin = np.cumsum(size) - size
    order = np.lexsort((at, name, doc, left, size, mark))
    alike = np.all([x[order][1:] == x[order][:-1] for x in (mark, size, left)], axis=0)
    new = np.concatenate([[True], ~alike])
    rest, own = order[~new], order[new][np.cumsum(new) - 1][~new]
    again = rest[(doc[rest] != doc[own]) | (name[rest] != name[own]) | (at[rest] != at[own])]  # not those of equal rows
    here = np.sort(order[new])
    done = _merged(doc[again], name[again], at[again] - left[again], at[again] + right[again])

    place = np.searchsorted(splitters, lead[here])
    inside = np.minimum(place, max(len(splitters) - 1, 0))
    hit = splitters[inside] == lead[here] if len(splitters) else np.zeros(len(here), bool)
    parts = np.where(hit, drawn[inside], 1) if len(splitters) else np.ones(len(here), np.int64)
    bucket = 2 * place + hit
    part = (stirred(doc[here].astype(np.uint64) + np.uint64(1)) % parts.astype(np.uint64)).astype(np.int64)
    by = np.lexsort((part, bucket))
    cuts = np.flatnonzero((np.diff(bucket[by]) != 0) | (np.diff(part[by]) != 0)) + 1
    shrink = zstandard.ZstdCompressor(level=1).compress
    rows = [(int(bucket[g[0]]), int(part[g[0]]), *(x[here[g]].tobytes() for x in (doc, name, at)),
             *(x[here[g]].astype(np.uint8).tobytes() for x in (left, right)),
             shrink(spans(data, begin[here[g]], begin[here[g]] + size[here[g]]).tobytes())) for g in np.split(by, cuts) if len(g)]
    if len(done):
        ids, names, first, till = (done[c].to_numpy(np.int64).tobytes() for c in ("doc_id", "name", "first", "till"))
        rows.append((-1 - int(mark[again[0]] % np.uint64(64)), int(mark[again[0]] >> np.uint64(40)) % 64, ids, names, first, b"", b"", till))
    kinds = (pa.int64(), pa.int64(), *(pa.binary(),) * 6)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)],
                                      ["bucket", "part", "ids", "names", "at", "left", "right", "data"])


EQUALS = ("gram", np.uint64), ("mark", np.uint64), ("doc", np.int64), ("name", np.int64), ("at", np.int64), ("left", np.uint8), ("right", np.uint8)


def _merge_equal(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the first entry of each run of equal ones, the others but for those of equal rows)."""
    gram, mark, doc, name, at, left, right = columns
    by = np.lexsort((at, name, doc, right, left, mark, gram))
    new = np.concatenate([[True], np.any([x[by][1:] != x[by][:-1] for x in (gram, mark, left, right)], axis=0)])[:len(by)]
    first = by[new][np.cumsum(new) - 1]
    again = by[~new]
    own = first[~new]
    return by[new], again[(doc[again] != doc[own]) | (name[again] != name[own]) | (at[again] != at[own])]


def _equal(docs: DataFrame, bits: np.ndarray, buckets: int, grams: int) -> DataFrame:
    """Rows of two kinds: ranges of entries that equal an earlier one, and the grams of the different ones, packed."""
    def flush(held):
        columns = [np.concatenate([h[c] for h in held]) for c, _ in EQUALS]
        first, again = _merge_equal(columns)
        gram, mark, doc, name, at, left, right = columns
        done = _merged(doc[again], name[again], (at - left)[again], (at + right)[again])
        kinds = [x[first] for x in columns]
        bucket = (stirred(kinds[0] + kinds[1]) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        groups = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1)
        rows = [(int(bucket[g[0]]), *(x[g].astype(t).tobytes() for x, (_, t) in zip(kinds, EQUALS))) for g in groups if len(g)]
        if len(done):
            ids, names, start, till = (done[c].to_numpy(np.int64).tobytes() for c in ("doc_id", "name", "first", "till"))
            rows.append((-1 - int(mark[again[0]] % np.uint64(buckets)), b"", till, ids, names, start, b"", b""))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), *(pa.binary(),) * len(EQUALS)))],
                                          ["bucket", *(c for c, _ in EQUALS)])

    def send(batches):
        held, size = [], 0
        for piece in pieces(batches):
            entries = _entries(piece, bits)
            if len(entries["doc"]):
                held.append({c: entries[c].astype(t) if c not in ("left", "right") else entries[c] for c, t in EQUALS})
                size += len(entries["doc"])
            if size > MERGED_AT_ONCE:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)
        entries = held = None
        give_back()

    def merged(key, part):
        column = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in part[c]])
        if key[0] < 0:
            return _merged(*(column(c, np.int64) for c in ("doc", "name", "at", "mark"))).assign(bucket=None, data=None)
        columns = [column(c, t) for c, t in EQUALS]
        columns[5:] = [x.astype(np.int64) for x in columns[5:]]
        first, again = _merge_equal(columns)
        gram, mark, doc, name, at, left, right = columns
        out = _merged(doc[again], name[again], (at - left)[again], (at + right)[again]).assign(bucket=None, data=None)
        found, n = np.unique(gram[first], return_counts=True)
        packed = _by_bucket(np.repeat(found, np.minimum(n, 2)), grams).to_pandas()
        return pd.concat([out, packed.assign(doc_id=None, name=None, first=None, till=None)[list(out.columns)]], ignore_index=True)

    def merge(key, part):
        out = merged(key, part)
        give_back()
        return out

    schema = "bucket long, " + ", ".join(f"{c} binary" for c, _ in EQUALS)
    return docs.mapInArrow(send, schema).groupBy("bucket").applyInPandas(merge, COVERED)


def _send(docs: DataFrame, bits: np.ndarray, splitters: np.ndarray, drawn: np.ndarray) -> DataFrame:
    def run(batches):
        held, size = [], 0
        for piece in pieces(batches):
            entries = _entries(piece, bits)
            if len(entries["doc"]):
                held.append(entries)
                size += len(entries["data"])
            if size > SENT_BYTES:
                yield _packed(held, splitters, drawn)
                held, size = [], 0
        if held:
            yield _packed(held, splitters, drawn)
        entries = held = None
        give_back()

    return docs.mapInArrow(run, ENTRIES)


def multikey(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each in that order equals the one before) of byte rows: eight bytes at a time, for ties only."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.concatenate([[False], words[order[1:], 0] == words[order[:-1], 0]])
    for column in range(1, words.shape[1]):
        open_ = tied | np.concatenate([tied[1:], [False]])
        at = np.flatnonzero(open_)
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        word = words[order[at], column]
        by = np.lexsort((word, group))
        order[at], word = order[at][by], word[by]
        tied[at] &= np.concatenate([[False], word[1:] == word[:-1]])
    return order, tied


def _settle(part: pd.DataFrame, divided: bool):
    """Covered intervals of one bucket part, and the first of each string if the bucket is divided."""
    column = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in part[c]])
    doc, name, at = (column(c, np.int64) for c in ("ids", "names", "at"))
    left, right = (column(c, np.uint8).astype(np.int64) for c in ("left", "right"))
    data, size = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, part["data"])), np.uint8), left + right
    begin = np.cumsum(size) - size
    # The suffix from the anchor on, then what stands before it, backwards; each padded, and the lengths.
    most = LENGTH + GRAMS
    rows = np.zeros((len(doc), -(-(most + GRAMS + 2) // 8) * 8), np.uint8)
    for at_row in range(0, len(doc), ROWS_AT_ONCE):
        some, flat = slice(at_row, at_row + ROWS_AT_ONCE), rows[at_row:at_row + ROWS_AT_ONCE].ravel()
        for column, start, length, step in ((0, begin + left, right, 1), (most, begin + left - 1, left, -1)):
            start, length = start[some], length[some]
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            flat[np.repeat(rows.shape[1] * np.arange(len(start)) + column, length) + place] = data[np.repeat(start, length) + step * place]
    rows[:, most + GRAMS], rows[:, most + GRAMS + 1] = left, right
    order, tied = multikey(rows)
    run = np.empty(len(doc), np.int64)
    run[order] = np.cumsum(~tied) - 1
    grams = np.ascontiguousarray(rows[order, :GRAM]).view(f"V{GRAM}").ravel()
    del rows
    # The first entry of each run of equal ones stands for it.
    by = np.lexsort((at, name, doc, run))
    new = np.concatenate([[True], run[by][1:] != run[by][:-1]])
    first, again = by[new], by[~new]
    fresh = (doc[by] != doc[np.repeat(first, np.diff([*np.flatnonzero(new), len(by)]))]) | (
        name[by] != name[np.repeat(first, np.diff([*np.flatnonzero(new), len(by)]))]) | (
        at[by] != at[np.repeat(first, np.diff([*np.flatnonzero(new), len(by)]))])
    again = by[~new & fresh]  # the same entry of an equal row isn't a repeat of itself
    covered = [(doc[again], name[again], at[again] - left[again], at[again] + right[again])]
    # Entries that share the gram but not all.
    kinds = grams[np.flatnonzero(~tied)]  # of each run, in sorted order
    alike = np.concatenate([[False], kinds[1:] == kinds[:-1]])
    shared = alike | np.concatenate([alike[1:], [False]])
    some = first if divided else first[shared[run[first]]]
    kept = None
    if len(some):
        strings = spans(data, begin[some], begin[some] + size[some])
        ends = np.cumsum(size[some])
        where = np.arange(len(strings))
        owner = np.repeat(np.arange(len(some)), size[some])
        valid = np.flatnonzero(where + LENGTH <= ends[owner])
        one, two = (stirred(rolled(c[strings], LENGTH, m))[valid] for c, m in ((_CODE, _MIX[4]), (_BYTE_CASED, _MIX[5])))
        owner = owner[valid]
        who = some[owner]
        start = at[who] - left[who] + valid - (ends - size[some])[owner]
        covered.append(_later(one, two, doc[who], name[who], start))
        if divided:
            lead = _firsts(one, two, doc[who], name[who], start)
            kept = tuple(x[lead] for x in (one, two, doc[who], name[who], start))
    return _merged(*(np.concatenate(x) for x in zip(*covered))), kept


def _ordered(one, two, doc, name, start):
    by = np.lexsort((start, name, doc, two, one))
    new = np.concatenate([[True], (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])])[:len(by)]
    return by, new


def _firsts(one, two, doc, name, start) -> np.ndarray:
    by, new = _ordered(one, two, doc, name, start)
    return by[new]


def _later(one, two, doc, name, start):
    """Ranges of the strings that have an equal one before them."""
    by, new = _ordered(one, two, doc, name, start)
    first = by[new][np.cumsum(new) - 1]
    again = by[(doc[by] != doc[first]) | (name[by] != name[first]) | (start[by] != start[first])]
    return doc[again], name[again], start[again], start[again] + LENGTH


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, name, first, till: the ranges of bytes to remove (doc_id is `LAST_ID` for null); docs: doc_id, text, name."""
    total = small_batches(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, total // MAPPED_BYTES)
    merged = stage(_equal(docs, _repeated(docs, buckets), buckets, buckets), "merged")
    equal = merged.filter("bucket is null").select("doc_id", "name", "first", "till")
    bits = _bit_map(merged.filter("bucket is not null").select("bucket", "data"), True)
    splitters, drawn = _splitters(docs, bits, total)
    divided = {2 * i + 1 for i, n in enumerate(drawn.tolist()) if n > 1}
    sent = _send(docs, bits, splitters, drawn)
    cross = max(16, len(divided))

    def settle(key, part):
        if key[0] < 0:
            column = lambda c: np.concatenate([np.frombuffer(x, np.int64) for x in part[c]])
            return _merged(*map(column, ("ids", "names", "at", "data"))).assign(bucket=None, data=None)
        found, kept = _settle(part, key[0] in divided)
        out = found.assign(bucket=None, data=None)
        if kept is not None:
            place = (kept[0] >> np.uint64(32)).astype(np.int64) * cross >> 32
            for b in np.unique(place).tolist():
                packed = np.column_stack([x[place == b].view(np.int64) for x in kept]).tobytes()
                out.loc[len(out)] = [None, None, None, None, b, packed]
        kept = None
        give_back()
        return out

    settled = stage(sent.groupBy("bucket", "part").applyInPandas(settle, COVERED), "settled")

    def across(part: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 5) for x in part["data"]])
        one, two = (np.ascontiguousarray(rows[:, i]).view(np.uint64) for i in (0, 1))
        return _merged(*_later(one, two, *(rows[:, i] for i in (2, 3, 4))))

    ranges = "doc_id long, name long, first long, till long"
    own = settled.filter("bucket is null").select("doc_id", "name", "first", "till")
    met = settled.filter("bucket is not null").select("bucket", "data").groupBy("bucket").applyInPandas(across, ranges)
    return own.unionByName(met).unionByName(equal)


def _with_ranges(docs: DataFrame, doc_id: str, text: str, taken: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents that may have ranges, with their sorted list in `taken[2]`; those that have none).

    With one Python step on the first, no task needs two Python workers at once: an executor keeps all workers it
    ever had, and each later holds tables of its own.
    """
    keyed = docs.withColumns({taken[0]: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)),
                              taken[1]: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    narrow = keyed.select(F.col(taken[0]).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(taken[1]).alias("name"))
    found = covered(narrow).groupBy("doc_id", "name").agg(F.sort_array(F.collect_list(F.struct("first", "till"))).alias(taken[2]))
    found = stage(found.withColumnsRenamed({"doc_id": taken[3], "name": taken[4]}), "ranges")

    # Documents whose name isn't in the map of those with ranges need no shuffle.
    def send(batches):
        for batch in batches:
            yield _by_bucket(np.sort(stirred(batch["name"].to_numpy().view(np.uint64))), 64)

    bits = _bit_map(found.select(F.col(taken[4]).alias("name")).mapInArrow(send, "bucket long, data binary"), False)

    @F.pandas_udf("boolean")
    def touched(name: pd.Series) -> pd.Series:
        return pd.Series(_in_map(bits, stirred(name.to_numpy(np.int64).view(np.uint64))))

    asked = touched(taken[1])
    # Merged, not broadcast: the shuffle parts the look-up in the map from the step on the texts.
    same = (F.col(taken[0]) == F.col(taken[3])) & (F.col(taken[1]) == F.col(taken[4]))
    return keyed.filter(asked).join(found.hint("merge"), same, "left"), keyed.filter(~asked)


def _taken(docs: DataFrame) -> list[str]:
    """Names for further columns that the input doesn't have."""
    mark = "__cut"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    return [mark + c for c in ("_id", "_name", "_ranges", "_found_id", "_found_name")]


def _union(ranges) -> list[tuple[int, int]]:
    out = []
    for r in ranges or ():
        first, till = r["first"], r["till"]
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], till))
        else:
            out.append((first, till))
    return out


def _left(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for first, till in cut:
        parts.append(text[at:first])
        at = till
    return b"".join([*parts, text[at:]])


def dedup(docs: DataFrame) -> DataFrame:
    """What is removed from every whole text: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = _taken(narrow)

    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for text, ranges in zip(raw(batch, "text"), batch[names[2]].to_pylist()):
                cut = _union(ranges)
                rows.append((len(text), sum(b - a for a, b in cut), len(cut), hashlib.sha256(_left(text, cut)).hexdigest()))
            size, gone, n, sha = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (size, gone, n)), pa.array(sha)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        batch = None
        give_back()

    touched, whole = _with_ranges(narrow, "doc_id", "text", names)
    cut = touched.select("doc_id", "text", names[2]).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    data, none = F.coalesce("text", F.lit("")).cast("binary"), F.lit(0).cast("long")
    return cut.unionByName(whole.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), none.alias("n_removed"),
                                        none.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256")))


def trim(docs: DataFrame) -> DataFrame:
    """The documents without their repeated strings; a character of which a byte stays, stays whole."""
    names, columns = _taken(docs), docs.columns

    def whole(text: bytes, cut):
        """Shrink ranges to character boundaries."""
        for first, till in cut:
            while first < till and text[first] & 0xC0 == 0x80:
                first += 1
            while till > first and till < len(text) and text[till] & 0xC0 == 0x80:
                till -= 1
            if first < till:
                yield first, till

    def run(batches):
        for batch in slices(batches, "text"):
            new = []
            for text, ranges in zip(batch["text"].cast(pa.binary()).to_pylist(), batch[names[2]].to_pylist()):
                new.append(text if text is None else _left(text, list(whole(text, _union(ranges)))))
            at = batch.schema.get_field_index("text")
            out = batch.set_column(at, batch.schema.field(at), pa.array(new, pa.binary()).cast(batch.schema.field(at).type))
            yield out.select(columns)
        batch = out = None
        give_back()

    touched, rest = _with_ranges(docs, "doc_id", "text", names)
    trimmed = touched.select(*columns, names[2]).mapInArrow(run, docs.schema).unionByName(rest.select(columns))
    if "n_chars" in docs.columns:
        trimmed = trimmed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return trimmed.select(columns)
