"""The postorder manifest against trees built level by level."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    """(left, right) per level."""
    out = []
    for row in tree[:-1]:
        run = i // 3 * 3
        out.append((row[run:i], row[i + 1:run + 3]))
        i //= 3
    return out


@pytest.mark.parametrize("n", [*range(1, 30), 80, 81, 82, 243, 244, 1000])
def test_log_is_in_postorder_and_positions_are_closed_form(n):
    leaves = [H(str(i)) for i in range(n)]
    tree, h = levels(leaves), merkle.height(n)
    assert len(tree) == h + 1
    log = [d.decode() for d in merkle.append_log([x.encode() for x in leaves], h)]
    want = []

    def visit(level, i):
        if level:
            for c in range(3 * i, min(3 * i + 3, len(tree[level - 1]))):
                visit(level - 1, c)
        want.append(tree[level][i])

    visit(h, 0)
    assert log == want
    for level, row in enumerate(tree):
        assert [log[p] for p in merkle.place(level, np.arange(len(row)), n, h).tolist()] == row
    paths = merkle.paths([d.encode() for d in log], n, h)
    for i in {0, n // 2, n - 1}:
        assert [(a.decode(), b.decode()) for a, b in paths[i]] == [("".join(a), "".join(b)) for a, b in siblings(tree, i)]
        assert merkle.decode(merkle.encode(paths[i])) == paths[i]
        assert merkle.fold(leaves[i].encode(), paths[i]).decode() == tree[-1][0]


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> sorted result tuples."""
    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return H(*map(value, (r[0], r[1], r[2], r[3], text)))

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, mine, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = siblings(trees[s], i) + siblings(top, k)
            torn = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            cur = leaf(r, r[4].replace("\n", "")) if torn else mine
            for a, b in path:
                cur = H(*a, cur, *b)
            out.append((r[0], mine, trees[s][-1][0], top[-1][0], H(*[x for a, b in path for x in a + b]), cur, cur == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, idx int"


def rows_of(n, sources, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = int(rng.integers(0, 3 * sources))
        source = None if k == 1 else "" if k == 2 else f"src-{k}é" if k < sources else "hot"  # two thirds in one source
        out.append((None if i % 17 == 3 else int(rng.integers(0, n)), source, None if i % 5 == 0 else "en", None if i % 7 == 0 else i, None if i % 11 == 0 else f"línea {i % 9}\n\nend\n"))
    return out + out[:5]


def table(spark, rows):
    return spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("n,sources", [(0, 1), (1, 1), (40, 1), (300, 7), (120, 60)])
def test_query_equals_brute_force(spark, tmp_path, n, sources):
    rows = rows_of(n, sources) if n > 1 else rows_of(n, sources)[:n]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_postorder_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_tiers_do_not_change_the_trees(spark):
    """Blocks of three nodes: the trees reach over several tiers of segments."""
    rows = rows_of(150, 20, seed=4)
    leaves = merkle.document_leaves(table(spark, rows))
    small = merkle.manifest(leaves, ["id", "tie"], levels=1)
    assert len(small.groups) >= 4 and len(small.top) >= 2
    got = small.proofs().withColumn("doc_id", F.col("item.doc_id")).collect()
    want = {(r[0], r[1]): r for r in brute(rows)}
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"], r["digest"].hex()]
        assert (r["subroot"].hex(), r["root"].hex()) == (w[2], w[3])
        assert merkle.fold(r["digest"].hex().encode(), merkle.decode(bytes(r["path"]))).decode() == w[3]
    segments = small.groups[0].collect()  # each holds the nodes of its own aligned block, none is missing
    assert all(len(s["nodes"]) % 32 == 0 and s["size"] <= 3 for s in segments)
    assert sum(s["size"] for s in segments) == len(rows)


def test_a_changed_row_changes_the_root_and_a_wrong_proof_fails(spark):
    rows = [(i, "a", "en", 1, f"text {i}") for i in range(10)]
    one = brute(rows)
    two = brute([*rows[:4], (4, "a", "en", 1, "text  4"), *rows[5:]])
    assert one[0][3] != two[0][3]
    leaves = merkle.document_leaves(table(spark, rows))
    proofs = merkle.manifest(leaves, ["id", "tie"]).proofs().collect()
    a, b = proofs[0], proofs[-1]
    assert merkle.fold(a["digest"].hex().encode(), merkle.decode(bytes(b["path"]))) != a["root"].hex().encode()
