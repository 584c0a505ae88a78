"""Byte-level BPE over whole texts, by overlapping chunks.

A text longer than `chunk` characters becomes chunk rows that overlap. Each chunk is
pre-tokenised on its own; a match depends only on the text from its start on, so two
chunks agree from the first boundary that both have (where they resynchronise). The
stretches between these stitches are then encoded apart from each other, and a text's
ids are put together in order. A text whose chunks share no boundary within the
overlap (one pre-token longer than it) is encoded in one piece: same ids, less spread.
Shorter texts are one chunk and need no shuffle. Decoding joins the raw bytes of ids.

Defined cases: null is the empty text, with no ids; null identifiers and repeated rows
give one result for each row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelloom.llm.batches import Bounded, kept, slices, small_batches

CHUNK = 1 << 15
OVERLAP = 1 << 10
# A match that starts this close to a chunk's end may change with the text beyond it.
MARGIN = 16
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Ranks and split pattern, with bounded caches from pre-token to ids."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.ids_of = Bounded(lambda piece: core.encode_single_piece(piece.encode()))
        self.digits_of = Bounded(lambda piece: ",".join(map(str, self.ids_of[piece])))

    def encode(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.ids_of.__getitem__, pieces)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int], digits: str) -> tuple[int, str, str]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return len(ids), sha(digits.encode()), sha(self.decode(ids))


def codec(path: str, pattern: str) -> Codec:
    return kept((Codec, path, pattern), lambda: Codec(path, pattern))


def bounds(split, text: str, final: bool) -> list[int]:
    """Starts of the pre-tokens that the text beyond this chunk can't change, and the end of a final chunk."""
    last = len(text) if final else len(text) - MARGIN
    starts = [m.start() for m in split.finditer(text)]
    return [s for s in starts if s < last or final] + ([len(text)] if final else [])


def _short(docs: DataFrame, path: str, pattern: str, ids: bool) -> DataFrame:
    def run(batches):
        c = codec(path, pattern)
        for batch in slices(batches, "text"):
            found = [c.split.findall(x) for x in batch["text"].to_pylist()]
            encoded = map(c.encode, found)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(encoded, pa.list_(pa.int32()))], ["doc_id", "ids"])
                continue
            rows = [c.digest(x, ",".join(filter(None, map(c.digits_of.__getitem__, p)))) for x, p in zip(encoded, found)]
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>" if ids else DIGEST)


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row for each chunk of each text, with its overlap."""
    def run(batches):
        for batch in slices(batches, "text"):
            for row, doc, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text"))):
                starts = range(0, max(len(text), 1), chunk)
                yield pa.RecordBatch.from_pydict({
                    "row": [row] * len(starts), "doc_id": [doc] * len(starts), "k": list(range(len(starts))),
                    "final": [s + chunk >= len(text) for s in starts],
                    "text": [text[s:s + chunk + overlap] for s in starts],
                }, schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()),
                                     ("final", pa.bool_()), ("text", pa.string())]))

    return docs.mapInArrow(run, "row long, doc_id long, k long, final boolean, text string")


def _pretokens(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Boundaries in the overlaps of each chunk: its head in its own terms, its tail in the next chunk's."""
    def run(batches):
        split = codec(path, pattern).split
        for batch in slices(batches, "text"):
            heads, tails = [], []
            for text, final in zip(batch["text"].to_pylist(), batch["final"].to_pylist()):
                at = bounds(split, text, final)
                heads.append([b for b in at if b < overlap])
                tails.append([b - chunk for b in at if b >= chunk])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, kind), pa.array(tails, kind)],
                                             [*batch.schema.names, "head", "tail"])

    return chunks.mapInArrow(run, "row long, doc_id long, k long, final boolean, text string, head array<int>, tail array<int>")


def _stretches(marked: DataFrame, path: str, pattern: str, chunk: int) -> DataFrame:
    """Encode each chunk from its stitch with the chunk before to its stitch with the next."""
    def run(batches):
        c = codec(path, pattern)
        for batch in slices(batches, "text"):
            out = []
            for text, lo, hi in zip(*(batch[x].to_pylist() for x in ("text", "lo", "hi"))):
                ids = c.encode(c.split.findall(text, lo, len(text) if hi is None else chunk + hi))
                out.append(np.array(ids, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["k"], pa.array(out, pa.binary())],
                                             ["row", "doc_id", "k", "ids"])

    return marked.mapInArrow(run, "row long, doc_id long, k long, ids binary")


def _long(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int, ids: bool) -> DataFrame:
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    parts = _chunks(rows, chunk, overlap).repartition("row", "k")
    marked = _pretokens(parts, path, pattern, chunk, overlap)
    order = Window.partitionBy("row").orderBy("k")
    common = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    stitched = marked.withColumn("lo", F.when(F.col("k") == 0, 0).otherwise(common)).drop("head", "tail")
    stitched = stitched.withColumn("hi", F.lead("lo").over(order))
    whole = F.max(F.col("lo").isNull()).over(Window.partitionBy("row"))
    stitched = stitched.withColumn("whole", whole)

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        c = codec(path, pattern)
        if part["whole"].iloc[0]:
            text = "".join(x[:chunk] for x in part["text"].iloc[:-1]) + part["text"].iloc[-1]
            all_ids = c.encode(c.split.findall(text))
        else:
            all_ids = np.frombuffer(b"".join(part["ids"]), "<i4").tolist()
        doc = part["doc_id"].iloc[:1].astype("Int64")
        if ids:
            return pd.DataFrame({"doc_id": doc, "ids": [all_ids]})
        n, a, b = c.digest(all_ids, ",".join(map(str, all_ids)))
        return pd.DataFrame({"doc_id": doc, "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]})

    pieces = _stretches(stitched.filter(~F.col("whole")), path, pattern, chunk)
    both = pieces.withColumns({"text": F.lit(None).cast("string"), "whole": F.lit(False)}).unionByName(
        stitched.filter("whole").select("row", "doc_id", "k", F.lit(None).cast("binary").alias("ids"), "text", "whole"))
    return both.groupBy("row").applyInPandas(joined, "doc_id long, ids array<int>" if ids else DIGEST)


def _encoded(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int, ids: bool) -> DataFrame:
    if not MARGIN < overlap <= chunk:
        raise ValueError("the overlap must exceed the margin and fit in a chunk")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > chunk
    small_batches(body)
    return _short(body.filter(~long), path, pattern, ids).unionByName(
        _long(body.filter(long), path, pattern, chunk, overlap, ids))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The ids of every whole text: doc_id, ids."""
    return _encoded(docs, path, pattern, chunk, overlap, True)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of every list of ids: doc_id, data."""
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            data = [c.decode(x or ()) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Count and checksums of the ids of every whole text, and of the bytes they decode to."""
    return _encoded(docs, path, pattern, chunk, overlap, False)
