import zlib
from hashlib import sha256

import cases
import pytest
from panelloom.llm import merkle
import panelloom.llm.queries  # noqa: F401  (registers the queries)
from panelloom.llm.registry import ORACLES, QUERIES
from pyspark.sql import functions as F


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def rise(level):
    """Levels of a tree, each a list of digests."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    found = []
    for level in levels[:-1]:
        other = i ^ 1
        found.append((None, "") if other >= len(level) else ("<" if i & 1 else ">", level[other]))
        i >>= 1
    return found


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: rise([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = rise([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            proof = path(trees[g], i) + path(top, at)
            out.append((x[3], x[2], trees[g][-1][0], top[-1][0], proof))
    return out


def fold(start, proof):
    for side, other in proof:
        start = H(other, start) if side == "<" else H(start, other) if side == ">" else H(start)
    return start


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_proofs_equal_brute_force(spark, bits):
    rows = [(i, "s", lang, n, t) for i, t, lang, _, n in cases.rows()] * 2 + [(k, None, "fr", None, None) for k in range(17)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns(
        {c: F.lit("x") for c in ("pos", "block", "tree", "digest", "total", "proof", "key", "owner")})
    built = merkle.manifest(docs, bits=bits)
    want = brute(rows)
    assert built.root.first()[0] == want[0][3]
    got = built.proofs().withColumn("folded", merkle.fold(F.col("digest"), F.col("proof"))).collect()
    assert {r.folded for r in got} == {want[0][3]}
    marks = {"<": "<", ">": ">", None: "="}
    assert sorted((r.digest, r.proof) for r in got) == sorted((x[1], [marks[s] + d for s, d in x[4]]) for x in want)
    assert sorted(r[1] for r in built.subroots.collect()) == sorted({x[2] for x in want})


def test_tables_of_one_row_and_none(spark):
    docs = cases.documents(spark)
    one = merkle.manifest(docs.limit(1))
    row = one.proofs().first()
    assert row.proof == [] and one.root.first()[0] == row.digest
    none = merkle.manifest(cases.empty(spark))
    assert none.proofs().count() == 0 and none.root.first()[0] is None


def test_query_equals_sql_and_finds_every_change(spark, sf):
    from compare import compare, database

    con = database(sf)
    assert compare(QUERIES["op12_merkle_manifest"](spark, sf), con, ORACLES["op12_merkle_manifest"]) == []
    rows = con.sql("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    got = {r.doc_id: r for r in QUERIES["op12_merkle_manifest"](spark, sf).collect()}
    for row, own, subroot, root, proof in brute(rows):
        r = got[row[0]]
        changed = zlib.crc32(str(row[0]).encode()) % 7 == 0
        start = leaf((*row[:3], row[3] + 1, row[4])) if changed else own
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (own, subroot, root, H(*[d for _, d in proof]))
        assert r.folded_root == fold(start, proof) and r.verified == (not changed)
