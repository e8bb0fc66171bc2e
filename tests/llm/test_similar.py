"""Recall of similar texts on a corpus of one template, with the parameters of production."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import similar, simhash


def template_corpus(pairs, seed):
    """Texts in one template, pairwise 0.77 alike, each 0.80 to 0.85 alike to one other and to no third."""
    r = np.random.default_rng(seed)
    template = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(pairs):
        own = [f"p{k}_{i}" for i in range(40)]
        shared = int(r.integers(8, 20))
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(template + own[:shared] + [f"q{k}_{i}" for i in range(40 - shared)]))]
    return [rows[i] for i in r.permutation(len(rows))]


def brute_force(rows, least):
    """All pairs of texts at least so alike, from the sets of their shingles."""
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for _, t in rows]
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    common = np.zeros((len(sets), len(sets)), np.int32)
    for column in np.split(owner[order], np.flatnonzero(np.diff(at[order])) + 1):
        if len(column) > 1:
            common[np.ix_(column, column)] += 1
    n = np.array([len(s) for s in sets])
    np.fill_diagonal(common, n)
    alike = common / (n[:, None] + n[None, :] - common)
    i, j = np.nonzero(np.triu(alike >= least, 1))
    return {tuple(sorted((rows[a][0], rows[b][0]))) for a, b in zip(i, j)}, alike


def families(seed):
    """Sets of all sizes in families with a common core, many at about 0.8, and their classes, some of which are large."""
    r = np.random.default_rng(seed)
    sets = []
    for f in range(12):
        core = r.integers(0, 1 << 40, 40)
        for _ in range(18):
            own = np.concatenate([core[r.random(40) < r.choice([0.8, 0.9, 0.95, 1.0])], r.integers(0, 1 << 40, r.integers(0, 9))])
            sets.append(np.unique(own)[: r.integers(1, 60)])
    sets += [np.array([x]) for x in (7, 7, 8)] + [r.integers(0, 30, 25) for _ in range(30)]
    sets = [np.unique(x).astype(np.int64) for x in sets]
    return sets, r.integers(0, 3, len(sets)) * (r.random(len(sets)) < 0.4) + np.where(r.random(len(sets)) < 0.5, 1000 + np.arange(len(sets)), 1)


@pytest.mark.parametrize(("longest", "block", "frequent", "common"), [(1024, 512, 1 << 18, 32), (2, 3, 1 << 18, 2), (3, 2, 4, 1), (6, 100, 0, 1)])
def test_exact_links(spark, monkeypatch, longest, block, frequent, common):
    """The links join classes as all similar pairs of sets do, by lists and by blocks, whatever is known of how frequent shingles are."""
    for name, value in (("LIST", longest), ("BLOCK", block), ("FREQUENT", frequent), ("COMMON", common)):
        monkeypatch.setattr(similar, name, value)
    sets, classes = families(longest)
    df = spark.createDataFrame([(i, int(c), x.tolist()) for i, (x, c) in enumerate(zip(sets, classes))], "node long, class long, shingles array<long>").repartition(3)
    up = {int(c): int(c) for c in classes}

    def joined(pairs):
        top = dict(up)
        for a, b in pairs:
            top = {k: min(top[a], top[b]) if v in (top[a], top[b]) else v for k, v in top.items()}
        return top

    alike = [(int(classes[i]), int(classes[j])) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    got = [(r["a"], r["b"]) for r in similar.exact_links(df, 0.8).collect()]
    assert len(set(alike)) > 40 and joined(got) == joined(alike)


def test_prefix():
    """The smaller's first part and the larger's whole prefix share a shingle if the sets are similar enough."""
    r = np.random.default_rng(2)
    for _ in range(400):
        a = np.unique(r.integers(0, 60, r.integers(1, 50)))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.95], r.integers(0, 60, r.integers(0, 4))]))
        if not len(b) or len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        order = (np.arange(60), r.integers(0, 5, 60))
        (x, n), (y, m) = similar.prefix(a, order, 0.8), similar.prefix(b, order, 0.8)
        assert (len(a) > len(b) or set(x[:n]) & set(y)) and (len(b) > len(a) or set(y[:m]) & set(x))


def test_recall_on_a_template(spark, monkeypatch):
    """Texts alone decide here: fingerprints, which a common template makes equal, are set apart."""
    signed = similar.signatures
    monkeypatch.setattr(similar, "signatures", lambda *x: signed(*x).withColumn("fp", F.xxhash64("node")))
    rows = template_corpus(650, 9)
    links, alike = brute_force(rows, 0.8)
    assert len(links) == 650 and all(a // 2 == b // 2 for a, b in links)
    other = alike[alike < 0.8]
    assert np.median(other) > 0.76
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in similar.similar_classes(docs, 5, 0, 0.8, "doc_id", "text").collect()}
    found = sum(got[a] == got[b] for a, b in links)
    print(f"recall {found} of {len(links)}")
    assert found >= 0.99 * len(links)
    assert all(i // 2 == c // 2 for i, c in got.items())
