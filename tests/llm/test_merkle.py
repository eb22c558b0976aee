"""Merkle manifest against a plain tree, with fixtures of nulls, ties, repeats, long texts and other columns."""

import random
import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from refloom.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, pos int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root and, per leaf, the siblings with their side."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append(("L" if i % 2 else "R", nodes[i ^ 1]) if (i ^ 1) < len(nodes) else ("", ""))
        nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def folded(node, path):
    for side, other in path:
        node = h(other + node if side == "L" else node + other)
    return node


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of the untouched and touched contents, as the contract says."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {}
    for g in langs:
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        groups[g] = (own, *tree([leaf(*r) for r in own]))
    root, tops = tree([groups[g][1] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        own, subroot, paths = groups[g]
        for r, path in zip(own, paths, strict=True):
            path = path + top
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            claim = leaf(*r[:4], r[4] + 1) if touched else leaf(*r)
            got = folded(claim, path)
            out.append((r[0], leaf(*r), subroot, root, h("".join(x for _, x in path)), got, got == root))
    return sorted(out, key=repr)


def asked(spark, rows, tmp_path):
    full = [(*r, f"x{i}", "y", i) for i, r in enumerate(rows)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(full, SCHEMA).write.mode("overwrite").parquet(path)
    return queries.op11_merkle_manifest(spark, str(tmp_path))


def check(spark, rows, tmp_path):
    df = asked(spark, rows, tmp_path)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()]
    assert sorted(got, key=repr) == plain(rows)
    return got


def test_blocks_of_several_levels(spark, tmp_path):
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 900)
    rows = [(i, f"text {i}", rng.choice(["en", "en", "en", "de"]), rng.choice("ab"), i % 50) for i in ids]
    rows.append((5, "alone", "fr", None, None))
    got = check(spark, rows, tmp_path)
    assert {v for *_, v in got} == {True, False}


def test_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    rows = [
        (None, None, None, None, None), (None, "a", None, "s", 1), (7, None, "", None, 0), (7, "", "", "s", None),
        (7, "b", "", "s", 2**63 - 1), (3, "same", "en", "s", 4), (3, "same", "en", "s", 4), (3, "same", "en", "s", 4),
        (9, "ü" * 200_000, "é", "s", 3), (-4, "x\ny", "zz", "s", 3), (11, "x", "Z", "s", 3),
    ]
    check(spark, rows, tmp_path)


def test_one_row_and_none(spark, tmp_path):
    got = check(spark, [(1, "t", "en", "s", 1)], tmp_path)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")
    assert asked(spark, [], tmp_path).collect() == []


def test_only_every_eighth_level_is_written(spark):
    rows = spark.range(700).select(
        F.lit("1en").alias("tree"), F.col("id").alias("_id"), F.sha2(F.col("id").cast("string"), 256).alias("node")
    )
    levels = merkle.stored_levels(merkle.in_order(rows, ["_id"]))
    assert [x.count() for x in levels] == [700, 3, 1]
    assert levels[-1].first().node == tree([h(str(i)) for i in range(700)])[0]


def test_a_path_proves_its_leaf_only(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.manifest(docs, claimed={"text": F.concat("text", F.lit("!"))})
    got = found.select(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"), merkle.fold(F.col("claimed_leaf"), F.col("path")) == F.col("root"))
    assert {tuple(r) for r in got.collect()} == {(True, False)}
