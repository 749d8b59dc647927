"""The Merkle manifest against a plain tree, its files and odd rows."""

import hashlib
import random
import zlib

import pytest

from tests.llm.conftest import SCHEMA
from weekpanel.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 16 * 16
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
        i //= 16
    return out


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0], digest(*[field(r[k]) for k in (0, 3, 2, 4, 1)]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {}
    for name in names:
        trees[name].sort(key=lambda t: ((t[0] is not None, t[0] or 0), t[1]))
        levels[name] = plain_tree([t[1] for t in trees[name]])
    top = plain_tree([levels[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (key, leaf, row) in enumerate(trees[name]):
            path = plain_path(levels[name], i) + plain_path(top, k)
            x = leaf
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0 and row[1] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
                x = digest(*[field(v) for v in (row[0], row[3], row[2], row[4], low)])
            for left, right in path:
                x = digest(left, x, right)
            out.append((key, leaf, levels[name][-1][0], top[-1][0], digest(*[a + b for a, b in path]), x, x == top[-1][0]))
    return out


def by_text(rows):
    return sorted(map(tuple, rows), key=repr)


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert by_text(merkle.verified(docs).collect()) == by_text(plain(rows))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1], [15, 256, 257, 4100, 1, 2]])
def test_equals_a_plain_tree(spark, sizes):
    rng = random.Random(3)
    rows = [(rng.randrange(10**12) - 10**11, f"Text {i} ÄÖ Ünd", "de", f"s{k}é", i) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    check(spark, rows)


def test_many_sources_make_a_deep_top_tree(spark):
    check(spark, [(i, f"T{i}", "en", None if i % 50 == 0 else f"source {i % 700}", 2) for i in range(1500)])


def test_odd_rows(spark, odd_texts):
    rows = [(i if i % 3 else None, t, None if i % 2 else "en", "s" if i % 4 else None, None if i % 5 == 0 else i)
            for i, t in enumerate(odd_texts)]
    check(spark, rows + rows[:4] + [(7, "same", "en", "s", 1)] * 40 + [(None, None, None, None, None)] * 3)


def test_one_source_with_a_third_of_the_rows_and_equal_keys(spark):
    check(spark, [(5 if i % 2 else i, f"x{i % 7}", "en", "hot" if i % 3 == 0 else f"s{i % 40}", 1) for i in range(900)])


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.verified(docs).count() == 0
    rows = [(i, f"A{i}", "en", "s", 1) for i in range(20)]
    clash = spark.createDataFrame([(*r, "x", 1, "p") for r in rows], SCHEMA + ", tree string, pos int, path string")
    assert by_text(merkle.verified(clash).collect()) == by_text(plain(rows))


def test_written_blocks_hold_every_level(spark, tmp_path):
    rows = [(i, f"A{i}", "en", f"s{i % 2}", 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    leaves = docs.selectExpr("source AS tree", "sha2(text, 256) AS digest", "doc_id AS item")
    made = merkle.build(leaves, [leaves["item"]])
    made.write(f"file://{tmp_path}/manifest")
    blocks = spark.read.parquet(f"file://{tmp_path}/manifest/blocks").orderBy("kind", "round", "tree", "block").collect()
    root = spark.read.parquet(f"file://{tmp_path}/manifest/root").first()["root"]
    for name in ("s0", "s1"):
        want = plain_tree([digest(f"A{i}") for i in range(1200) if f"s{i % 2}" == name])
        first = [b for b in blocks if (b["kind"], b["round"], b["tree"]) == ("leaves", 0, name)]
        assert ["".join(b[f"level{k}"] for b in first) for k in range(3)] == ["".join(level) for level in want[:3]]
    tops = [plain_tree([digest(f"A{i}") for i in range(k, 1200, 2)])[-1][0] for k in range(2)]
    assert root == digest(*tops)
    paths = {r["item"]: r for r in made.proofs().collect()}
    assert len(paths) == 1200 and all(r["root"] == root for r in paths.values())


def test_a_changed_row_fails(spark):
    rows = [(i, "Capital" if i % 2 else "plain", "en", "s", 1) for i in range(300)]
    found = {r["doc_id"]: r["verified"] for r in merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(ok == (i % 2 == 0 or zlib.crc32(str(i).encode()) % 5 != 0) for i, ok in found.items())
