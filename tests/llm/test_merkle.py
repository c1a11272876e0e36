import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tripmill.llm import merkle

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest(*fields)


def climb(hashes):
    """(root, per leaf the list of (before, after) level by level)"""
    proofs, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for leaf, place in enumerate(at):
            first = place // 8 * 8
            proofs[leaf].append((hashes[first:place], hashes[place + 1 : first + 8]))
        hashes = [digest(*hashes[i : i + 8]) for i in range(0, len(hashes), 8)]
        at = [place // 8 for place in at]
    return hashes[0], proofs


def expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    subroots, inner = [], {}
    for name in names:
        trees[name].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf_of(*row)))
        subroot, inner[name] = climb([leaf_of(*row) for row in trees[name]])
        subroots.append(subroot)
    root, upper = climb(subroots) if subroots else (None, [])
    out = []
    for number, name in enumerate(names):
        for row, steps in zip(trees[name], inner[name]):
            i, text, *others = row
            steps = steps + upper[number]
            leaf = now = leaf_of(*row)
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None:
                now = leaf_of(i, text.translate(LOWER), *others)
            for before, after in steps:
                now = digest(*before, now, *after)
            proof = digest(*(h for before, after in steps for h in before + after))
            out.append((i, leaf, subroots[number], root, proof, now, now == root))
    return sorted(out, key=repr)


def checked(frame, rows):
    got = sorted(map(tuple, merkle.audit(frame).collect()), key=repr)
    assert got == expected([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows])
    return got


@pytest.mark.parametrize("levels", range(1, 6))
def test_the_layout_has_every_node_once_and_halves_its_levels(levels):
    places = [merkle.address(d, n, levels) for d in range(levels) for n in range(8**d)]
    assert sorted(places) == list(range(merkle.slots(levels)))
    upper = levels // 2
    for depth in range(upper):
        for number in range(8**depth):
            assert merkle.address(depth, number, levels) == merkle.address(depth, number, upper)
    if upper:
        # A subtree of the lower half is a layout of its own, in one piece.
        lower, width = levels - upper, merkle.slots(levels - upper)
        for number in range(8**upper):
            start = merkle.address(upper, number, levels)
            assert start == merkle.slots(upper) + number * width
            last = merkle.address(levels - 1, (number + 1) * 8 ** (lower - 1) - 1, levels)
            assert start <= last < start + width


@pytest.mark.parametrize("count", (1, 2, 7, 8, 9, 63, 64, 65, 511, 512))
def test_a_block_is_the_tree_over_its_leaves(count):
    hashes = [digest(str(i)) for i in range(count)]
    root, proofs = climb(hashes)
    nodes = merkle.build([bytes.fromhex(h) for h in hashes], count)
    assert merkle.node(nodes, 0) == root
    for i in {0, count // 2, count - 1}:
        beside = merkle.siblings(nodes, count, count, i)
        assert beside == "".join(h for before, after in proofs[i] for h in before + after)
        assert merkle.fold(hashes[i], beside, list(merkle.path(i, count))) == root
        assert merkle.fold(digest("other"), beside, list(merkle.path(i, count))) != root


def test_equals_brute_force_over_two_tiers(documents):
    rows = [(i, f"Text {i % 90}", "en" if i < 1100 else ["fr", None, "é", "de"][i % 4], f"s{i % 3}") for i in range(1300)]
    got = checked(documents(rows), rows)
    assert {row[6] for row in got} == {True, False}


def test_three_tiers(spark):
    total = 512 * 512 + 3
    nodes = spark.range(total).select(
        F.lit("=en").alias("tree"), F.col("id").alias("rank"), F.lit(total).cast("long").alias("total"),
        F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"),
    )
    trees = merkle.forest(nodes)
    assert len(trees.tiers) == 3
    hashes = [digest(str(i)) for i in range(total)]
    root, proofs = climb(hashes)
    assert [row.subroot.hex() for row in trees.roots().collect()] == [root]
    crown = spark.createDataFrame([("=en", "")], "tree string, beside string")
    blocks = {row.block: row for row in merkle.descend(trees, crown).where("block IN (0, 300, 512)").collect()}
    for i in (5, 300 * 512 + 77, total - 1):
        block = blocks[i // 512]
        beside = merkle.siblings(bytes(block.nodes), block["count"], total, i % 512) + block.beside
        assert beside == "".join(h for before, after in proofs[i] for h in before + after)
        assert merkle.fold(hashes[i], beside, list(merkle.path(i, total))) == root


def test_odd_rows(documents, odd_rows, tmp_path):
    checked(documents(odd_rows), odd_rows)
    assert merkle.audit(documents([])).collect() == []
    checked(documents([(3, "One", "en", None)]), [(3, "One", "en", None)])
    path = str(tmp_path / "manifest")
    merkle.manifest(documents(odd_rows)).languages.save(path)
    back = documents(odd_rows).sparkSession.read.parquet(path)
    assert back.where("tier = 0").agg(F.sum("count")).first()[0] == len(odd_rows)
