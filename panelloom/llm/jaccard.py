"""Exact Jaccard join of word n-gram sets, by token-combination prefixes.

The tokens of the join are hashed n-grams. All sets' tokens are counted; a token in more
than `common` sets is frequent. The global order puts rare tokens first, by hash, then
frequent ones by level (the logarithm of the count) and hash. Levels go along with the code
in a map of cells, of bounded size: a token has its cell's highest level. A full map calls
more tokens frequent, which costs time, not results, as any order will do.

* A set with enough rare tokens indexes the usual prefix of single tokens. Two such sets,
  or one with any other, can only be linked if they share an indexed token, and share so
  many of them that the rest can make up the overlap (the count bound).
* A set made of frequent tokens has an extended prefix: its rare tokens one by one and its
  frequent ones in combinations of two that follow each other in the order. A token that
  only one of two sets has breaks two combinations at most, so a prefix longer by the
  possible differences keeps one intact. Where a whole set is too short for that (at 66
  percent and below), its frequent tokens are indexed one by one too. The most frequent
  tokens come last, so that texts which share a template alone have no combination in common.

Pairs of like size are taken within lists of at most `common` sets, which all lists of rare
tokens are. Longer ones, of combinations, give only star edges between sets of neighbouring
sizes: their work grows with their length. The components of this candidate graph are small; each is verified
exactly, in blocks of bounded size, skipping pairs that are already connected. Every link
between different sets lies in a component, so none is lost. Equal sets are one node,
known by a 64-bit hash of the set.

Defined cases: null and empty texts have no set and are linked with nothing; texts with
fewer words than n have one token; repeated rows and null identifiers count as documents
with that identifier (a component's smallest identifier that isn't null).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelloom.llm.batches import forget, give_back, lean, raw, slices, small_batches
from panelloom.llm.graph import components
from panelloom.llm.words import shingles, stirred, word_hashes
from panelloom.sources.storage import stage

COMMON = 16
FREQUENT_TOKENS = 1 << 26  # cells of the map of levels, at most; two make a byte
TOP_LEVEL = 15
MARKS = 1 << 27  # bits of a map of documents, at most
BUCKET_BYTES = 8 << 20
BLOCK_TOKENS = 400_000
SLICE = 1 << 19


def token_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    forget()
    hashes, counts = word_hashes(texts)
    return [shingles(x, width) for x in np.split(hashes, np.cumsum(counts)[:-1])] if texts else []


def set_key(tokens: np.ndarray) -> int:
    """64-bit name of a set, as a signed long."""
    mixed = stirred(tokens + np.uint64(0x632BE59BD9B4E019))
    return int(stirred(np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def slack(n: int, percent: int) -> int:
    """Tokens that a set of n may have and a linked set lack."""
    return n - -(-percent * n // 100)


def levels(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Level of each token, 0 for rare ones. frequent: the map of levels, or the sorted upper halves of tokens that all have one level."""
    high = (tokens >> np.uint64(32)).astype(np.uint32)
    if frequent.dtype == np.uint8:
        cell = high >> np.uint32(32 - len(frequent).bit_length())
        return frequent[cell >> 1] >> ((cell & 1) << 2).astype(np.uint8) & 15
    if not len(frequent):
        return np.zeros(len(tokens), np.uint8)
    return (frequent[np.minimum(np.searchsorted(frequent, high), len(frequent) - 1)] == high).astype(np.uint8)


def prefixes(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[bool, np.ndarray, np.ndarray]:
    """(made of frequent tokens, single tokens to index, combinations to index); `frequent` as in `levels`."""
    level = levels(tokens, frequent)
    order = np.argsort(level, kind="stable")  # the tokens are sorted by hash
    first, n = int((level == 0).sum()), len(tokens)
    rare, many = tokens[order[:first]], tokens[order[first:]]
    missing = slack(n, percent)
    if len(rare) > missing:
        return False, rare[:missing + 1], rare[:0]
    # For a linked set of any size both sides' differences sum up to this at most.
    both = n * (100 - percent) * (100 + percent) // (percent * (100 + percent))
    length = (missing - len(rare)) + max(both - len(rare), 0) + 2
    whole, many = len(many) <= length, many[:length]
    combined = stirred(many[:-1] * np.uint64(3) + stirred(many[1:])) if len(many) > 1 else many[:0]
    # Two sets that share no more tokens than they differ in, and one, may have no intact combination: the least
    # number that a set can share with a different linked one tells whether it can be in such a pair.
    shared = max(-(-percent * n // 100), -(-percent // max(100 - percent, 1)))
    if whole and shared * (2 * percent - 100) <= percent:
        combined = np.concatenate([combined, stirred(many)])
    return True, rare, combined


def _packed(parts: list[np.ndarray], buckets: int, tokens: np.ndarray):
    """Columns of equal length, grouped by bucket of the token: (bucket, bytes of each column)."""
    bucket = (tokens >> np.uint64(32)).astype(np.int64) * buckets >> 32
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    columns = [np.split(p[order], cuts) for p in parts]
    firsts = bucket[order][np.concatenate([[0], cuts]).astype(np.int64)] if len(order) else []
    return firsts, columns


def _frequent(docs: DataFrame, width: int, buckets: int, common: int) -> np.ndarray:
    """Map of the levels of frequent tokens, by the upper bits of their hashes: two cells a byte.

    Tasks send the tokens of their distinct sets packed by bucket, four bytes each; a bucket
    is counted in one task and is a bounded share of all. The map has 16 cells for each frequent
    token, and at most `FREQUENT_TOKENS`, which bounds what goes along with the code.
    """
    def send(batches):
        for batch in slices(batches, "text", SLICE):
            sets = {set_key(t): t for t in token_sets(raw(batch, "text"), width)}
            tokens = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
            firsts, (high,) = _packed([(tokens >> np.uint64(32)).astype(np.uint32)], buckets, tokens)
            if len(tokens):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(firsts, pa.int64()), "data": [x.tobytes() for x in high]})

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        token, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in part["data"]]), return_counts=True)
        token, n = token[n > common], n[n > common]
        level = np.minimum(np.log2(n / common).astype(np.int32) + 1, TOP_LEVEL)
        return pd.DataFrame({"token": token.astype(np.int64), "level": level})

    def count(part: pd.DataFrame) -> pd.DataFrame:
        out = counted(part)
        give_back()
        return out

    sent = docs.select("text").mapInArrow(lean(send), "bucket long, data binary")
    counts = stage(sent.groupBy("bucket").applyInPandas(count, "token long, level int"), "frequent", True)
    cells = min(FREQUENT_TOKENS, max(1 << 10, 1 << (16 * counts.count()).bit_length()))
    shift, pieces = 33 - cells.bit_length(), min(64, cells // 2)
    each = cells // pieces

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        first = int(part["piece"].iloc[0]) * each
        level = np.zeros(each, np.uint8)
        np.maximum.at(level, (part["token"].to_numpy() >> shift) - first, part["level"].to_numpy().astype(np.uint8))
        return pd.DataFrame({"first": [first], "data": [(level[::2] | level[1::2] << 4).tobytes()]})

    out = np.zeros(cells // 2, np.uint8)
    placed = counts.withColumn("piece", F.shiftright("token", shift + each.bit_length() - 1))
    for first, data in placed.groupBy("piece").applyInPandas(fill, "first long, data binary").collect():
        out[first // 2:first // 2 + len(data)] = np.frombuffer(data, np.uint8)
    return out


INDEXED = "doc_id long, name long, set_key long, n long, bucket long, token binary, keys binary, sizes binary, heavy binary"


def _index(docs: DataFrame, width: int, percent: int, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Rows of two kinds: a document with its set's name, and packed postings of single tokens and combinations."""
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            sets = token_sets(raw(batch, "text"), width)
            keys = [set_key(t) if len(t) else None for t in sets]
            indexed, names, sizes, heavy, seen = [], [], [], [], set()
            for tokens, key in zip(sets, keys):
                if key is None or key in seen:  # an equal set of this slice has sent its postings
                    continue
                seen.add(key)
                made, single, combined = prefixes(tokens, frequent, percent)
                chosen = np.concatenate([single, combined])
                indexed.append(chosen)
                names.append(np.full(len(chosen), key, np.int64))
                sizes.append(np.full(len(chosen), len(tokens), np.int32))
                heavy.append(np.full(len(chosen), made, np.uint8))
            kinds = dict(zip(("doc_id", "name", "set_key", "n", "bucket", "token", "keys", "sizes", "heavy"), (pa.int64(),) * 5 + (pa.binary(),) * 4))

            def rows(count, **held):
                return pa.RecordBatch.from_pydict({k: pa.array(held.get(k, [None] * count), t) for k, t in kinds.items()})

            yield rows(batch.num_rows, doc_id=batch["doc_id"].to_pylist(), name=batch["name"].to_pylist(), set_key=keys, n=[len(t) for t in sets])
            if indexed and sum(map(len, indexed)):
                token = np.concatenate(indexed)
                # Stirred, as a prefix holds the least hashes; a posting is longer than a counted token, but few are sent.
                firsts, packed = _packed([token, *map(np.concatenate, (names, sizes, heavy))], max(16, buckets // 4), stirred(token))
                token, names, sizes, heavy = ([x.tobytes() for x in p] for p in packed)
                yield rows(len(firsts), bucket=firsts.tolist(), token=token, keys=names, sizes=sizes, heavy=heavy)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _name("text").alias("name"))
    return named.mapInArrow(lean(run), INDEXED)


def _name(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _pairs(postings: DataFrame, percent: int, common: int) -> DataFrame:
    """Candidate pairs from single tokens and combinations, with the number of tokens shared, a row a bucket and pair.

    The number says nothing of two sets made of frequent tokens, as their shared frequent tokens
    aren't counted here. Sets of a list longer than `common` give star edges, which count no tokens.
    """
    def paired(part: pd.DataFrame) -> pd.DataFrame:
        token, key, size, made = (np.concatenate([np.frombuffer(x, t) for x in part[c]]) for c, t in (
            ("token", np.uint64), ("keys", np.int64), ("sizes", np.int32), ("heavy", np.uint8)))
        order = np.lexsort((key, size, token))
        token, key, size, made = token[order], key[order], size[order], made[order]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
        token, key, size, made = token[fresh], key[fresh], size[fresh].astype(np.int64), made[fresh].astype(bool)
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff([*start, len(token)])
        group = np.repeat(np.arange(len(start)), length)
        long = np.repeat(length > common, length)
        found, stars = [], []
        # Star edges of a long list: each set with the smallest of its run of sizes; sets of different runs aren't linked.
        apart = np.concatenate([[True], (group[1:] != group[:-1]) | (size[:-1] * 100 < size[1:] * percent)])
        hub = key[np.flatnonzero(apart)[np.cumsum(apart) - 1]]
        edge = long & (hub != key)
        if edge.any():
            stars = np.column_stack([hub[edge], key[edge]])
        for gap in range(1, min(common, int(length.max(initial=1)))):
            i = np.flatnonzero((group[gap:] == group[:-gap]) & ~long[gap:])
            j = i + gap
            close = size[i] * 100 >= size[j] * percent  # a list is sorted by size
            i, j = i[close], j[close]
            if len(i):
                found.append(np.column_stack([key[i], key[j], size[i], size[j], made[i], made[j]]))
        out = pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 6), np.int64), columns=["a", "b", "na", "nb", "ma", "mb"])
        out = out.groupby(["a", "b", "na", "nb", "ma", "mb"], as_index=False).size().rename(columns={"size": "shared"})
        if len(stars):
            star = pd.DataFrame(np.unique(stars, axis=0), columns=["a", "b"]).assign(na=0, nb=0, ma=1, mb=1, shared=0)
            out = pd.concat([out, star], ignore_index=True)
        return out.astype(np.int64)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = paired(part)
        give_back()
        return out

    schema = "a long, b long, na long, nb long, ma long, mb long, shared long"
    return postings.groupBy("bucket").applyInPandas(run, schema)


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose shared tokens allow the overlap: outside the prefixes at most n - prefix tokens can be shared.

    The prefix that ends first in the order is one of a set rich in rare tokens, all of
    whose indexed tokens are single; what either set has beyond it bounds the rest.
    """
    total = pairs.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("na", "nb", "ma", "mb")], F.sum("shared").alias("shared"))
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent) - 1e-9)
    beyond = lambda n: F.floor(F.col(n) * percent / 100 + 1 - 1e-9) - 1  # n less its prefix: ceil(percent n / 100) - 1
    rest = F.greatest(F.when(F.col("ma") == 0, beyond("na")).otherwise(0), F.when(F.col("mb") == 0, beyond("nb")).otherwise(0))
    return total.filter((F.col("ma") + F.col("mb") == 2) | (F.col("shared") + rest >= need)).select("a", "b")


def _marks(found: DataFrame) -> np.ndarray:
    """Map of bits of the documents (doc_id, name) found, eight for each and at most `MARKS`.

    Other documents may share a bit: it tells which texts needn't be exchanged, not which are meant.
    """
    marks = found.select(_mark().alias("mark"))
    bits = min(MARKS, max(1 << 10, 1 << (8 * marks.count()).bit_length()))
    pieces = min(64, bits // 8)
    each, shift = bits // pieces, 65 - bits.bit_length()

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        piece = int(part["piece"].iloc[0])
        held = np.zeros(each, bool)
        held[(part["mark"].to_numpy().view(np.uint64) >> np.uint64(shift)).astype(np.int64) - piece * each] = True
        return pd.DataFrame({"piece": [piece], "data": [np.packbits(held, bitorder="little").tobytes()]})

    out = np.zeros((pieces, each // 8), np.uint8)
    placed = marks.withColumn("piece", F.shiftrightunsigned("mark", 65 - pieces.bit_length()))
    for piece, data in placed.groupBy("piece").applyInPandas(fill, "piece long, data binary").collect():
        out[piece] = np.frombuffer(data, np.uint8)
    return out.reshape(-1)


def _mark(doc_id: str = "doc_id", name: str = "name"):
    return F.xxhash64(name, doc_id)


def _holds(bits: np.ndarray):
    """Function of a column of marks: whether the map has them."""
    shift = np.uint64(62 - len(bits).bit_length())

    @F.pandas_udf("boolean")
    def held(mark: pd.Series) -> pd.Series:
        at = (mark.to_numpy().view(np.uint64) >> shift).astype(np.int64)
        return pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return held


def _overlaps(sets: list[np.ndarray], one: int, others: list[int]) -> np.ndarray:
    """Sizes of the intersections of one set with others."""
    lengths = np.array([len(sets[j]) for j in others])
    flat = np.concatenate([sets[j] for j in others])
    at = np.minimum(np.searchsorted(sets[one], flat), len(sets[one]) - 1)
    return np.add.reduceat(sets[one][at] == flat, np.cumsum(lengths) - lengths).astype(np.int64)


def linked(keys: list[int], sets: list[np.ndarray], percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links that join the sets into their components; pairs already joined are skipped.

    With `split`, only pairs of one set before that position and one from it on are asked.
    """
    parent, out = list(range(len(keys))), []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted(range(len(keys)), key=lambda i: len(sets[i]))
    for at, i in enumerate(order):
        others, own = [], root(i)
        for j in order[at + 1:]:
            if len(sets[i]) * 100 < percent * len(sets[j]):
                break
            if root(j) != own and (split is None or (i < split) != (j < split)):
                others.append(j)
        if others:
            both = _overlaps(sets, i, others)
            union = np.array([len(sets[j]) for j in others]) + len(sets[i]) - both
            for j in np.array(others)[100 * both >= percent * union].tolist():
                if root(i) != root(j):
                    parent[root(j)] = root(i)
                    out.append((keys[i], keys[j]))
    return out


def _verified(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Exact links within the candidate components.

    members: doc_id and name of one document for each set, set_key, n, root. A component's sets are dealt to
    blocks by hash, and each pair of blocks is one group: bounded, however large the component.
    """
    weight = members.groupBy("root").agg(F.sum("n").alias("weight"))
    cut = members.join(weight, "root").withColumn("blocks", F.ceil(F.col("weight") / F.lit(BLOCK_TOKENS)).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("with", F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) as lo, greatest(x, block) as hi))"))
    asked = cut.select(F.col("doc_id").alias("member_id"), F.col("name").alias("member_name"), "set_key", "root", "block", "with")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _name("text").alias("name"))
    texts = texts.filter(_holds(_marks(members))(_mark()))

    def make(batches):
        for batch in slices(batches, "text"):
            sets = token_sets(raw(batch, "text"), width)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("set_key", "root", "block", "with")), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["set_key", "root", "block", "with", "tokens"])

    schema = "set_key long, root long, block int, with array<struct<lo:int,hi:int>>, tokens binary"
    same = (F.col("name") == F.col("member_name")) & F.col("doc_id").eqNullSafe(F.col("member_id"))
    made = texts.join(asked, same).select("text", "set_key", "root", "block", "with").mapInArrow(lean(make), schema)

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("set_key").sort_values(["block", "set_key"])
        sets = [np.frombuffer(x, np.uint64) for x in part["tokens"]]
        first = int((part["block"] == part["block"].iloc[0]).sum())
        edges = linked(part["set_key"].tolist(), sets, percent, first if first < len(part) else None)
        return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    dealt = made.withColumn("pair", F.explode("with")).select("root", "pair.lo", "pair.hi", "block", "set_key", "tokens")
    return dealt.groupBy("root", "lo", "hi").applyInPandas(verify, "a long, b long")


def _classes(docs: DataFrame, width: int, percent: int, common: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, set_key, n of every document), (set_key, doc_id, class of every set)."""
    bytes_all = small_batches(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, bytes_all // BUCKET_BYTES)
    frequent = _frequent(docs, width, buckets, common)
    indexed = stage(_index(docs, width, percent, frequent, buckets), "indexed", True)

    own = indexed.filter("bucket is null").select("doc_id", "name", "set_key", "n")
    postings = indexed.filter("bucket is not null").select("bucket", "token", "keys", "sizes", "heavy")
    coarse = components(stage(_possible(_pairs(postings, percent, common), percent), "candidates", True))
    first = own.filter("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "name")).alias("at"), F.first("n").alias("n"))
    first = stage(first.select("set_key", "at", "n"), "sets", True)
    members = first.join(coarse, first["set_key"] == coarse["node"]).select("at.doc_id", "at.name", "set_key", "n", "root")
    exact = components(stage(_verified(docs, members, width, percent), "links", True))
    return own, first.join(exact, first["set_key"] == exact["node"], "left").select(
        "set_key", "at", F.coalesce("root", "set_key").alias("class"))


def join(docs: DataFrame, width: int = 3, percent: int = 90, common: int = COMMON) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    own, classes = _classes(docs, width, percent, common)
    smallest = classes.groupBy("class").agg(F.min("at.doc_id").alias("component_id"))
    named = classes.join(smallest, "class").select(F.col("set_key").alias("named_key"), "component_id")
    return own.join(named, own["set_key"] == named["named_key"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep(docs: DataFrame, width: int = 5, percent: int = 80, common: int = COMMON) -> DataFrame:
    """One document of each component, that of the smallest identifier, and all without words; the input's columns."""
    own, classes = _classes(docs, width, percent, common)
    stay = classes.groupBy("class").agg(F.min("at").alias("at")).select("at.doc_id", "at.name")
    stay = stage(stay.unionByName(own.filter("set_key is null").select("doc_id", "name")).distinct(), "stay", True)
    mark = "__stay"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    named = stay.withColumnsRenamed({"doc_id": mark + "_id", "name": mark + "_name"})

    def matched(left, doc_id, name, kind):
        return left.join(named, doc_id.eqNullSafe(F.col(mark + "_id")) & (name == F.col(mark + "_name")), kind)

    # Only documents that go or have equal rows, and the few that share their bits, are exchanged with their texts.
    times = own.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("times"))
    asked = matched(times, F.col("doc_id"), F.col("name"), "left").filter(F.col(mark + "_name").isNull() | (F.col("times") > 1))
    held = _holds(_marks(asked))(_mark(mark + "_doc", mark + "_own"))
    rows = docs.withColumns({mark + "_own": _name("text"), mark + "_doc": F.col("doc_id").cast("long")}).withColumn(mark + "_held", held)
    found = matched(rows.filter(mark + "_held"), F.col(mark + "_doc"), F.col(mark + "_own"), "inner")
    # Equal rows have one name: the first of them stays.
    order = Window.partitionBy(mark + "_id", mark + "_name").orderBy(F.lit(0))
    empty = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
    kept = found.withColumn(mark, F.row_number().over(order)).filter((F.col(mark) == 1) | empty)
    return kept.select(docs.columns).unionAll(rows.filter(~F.col(mark + "_held")).select(docs.columns))
