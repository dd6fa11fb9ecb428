"""The Merkle manifest against a plain tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gleanwright.llm import merkle

COLUMNS = ["doc_id", "lang", "n", "text"]


def digest(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def path(tree, at, fanout):
    out = []
    for level in tree[:-1]:
        lo = at // fanout * fanout
        run = level[lo : lo + fanout]
        out.append((at - lo, run[: at - lo] + run[at - lo + 1 :]))
        at //= fanout
    return out


def plain(rows, fanout, change=lambda r: r):
    """(doc_id, leaf, subroot, root, proof hash, folded root) of each row, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]], fanout) for g in names}
    top = levels([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps, own = path(trees[g], i, fanout) + path(top, k, fanout), leaf(change(r))
            for at, others in steps:
                own = digest(*others[:at], own, *others[at:])
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], digest(*(x for _, o in steps for x in o)), own))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,bucket", [(2, 1024), (2, 4), (3, 9), (5, 5)])
def test_manifest_is_that_of_the_plain_tree(spark, monkeypatch, fanout, bucket):
    monkeypatch.setattr(merkle, "BUCKET", bucket)
    rows = [(i * 7 % 83, ["en", "de", "en", "en", "fr", "ü", None][i % 7], i if i % 5 else None, f"text {i}" if i % 3 else "") for i in range(83)]
    rows += [(None, "en", 1, None), (None, "en", 1, None), (5, "en", 2, "x" * 100_000), (5, "en", 2, "a"), (5, "en", 2, "a"), (9, "single", None, "é")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, lang string, n long, text string, leaf string, grp int").repartition(3)
    odd = F.col("doc_id") % 2 == 1
    out = merkle.manifest(df, COLUMNS, "lang", "doc_id", fanout, {"n": F.when(odd, F.col("n") + 1).otherwise(F.col("n"))}).collect()
    want = plain(rows, fanout, lambda r: (*r[:2], r[2] + 1 if r[0] is not None and r[0] % 2 and r[2] is not None else r[2], r[3]))
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.again) for r in out), key=str) == want
    assert any(r.again != r.root for r in out) and any(r.again == r.root for r in out)
    for r in out[:20]:  # the proof itself, too
        if r.again == r.root:
            assert merkle.fold(bytes.fromhex(r.leaf), r.proof).hex() == r.root


def test_small_manifests(spark):
    kind = "doc_id long, lang string, n long, text string"
    assert merkle.manifest(spark.createDataFrame([], kind), COLUMNS, "lang", "doc_id").count() == 0
    r = merkle.manifest(spark.createDataFrame([(1, None, None, None)], kind), COLUMNS, "lang", "doc_id").first()
    assert r.leaf == r.subroot == r.root == r.again == leaf((1, None, None, None)) and r.proof_sha256 == digest()
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], kind), COLUMNS, "lang", "doc_id", fanout=1)
