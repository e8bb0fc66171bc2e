import random

import numpy as np
import pytest
import xxhash

from paperloom.llm import simhash
from paperloom.llm.components import connected_components


def plain(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(rows, radius):
    ids, fps = zip(*rows)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(ids[i])
    return {(ids[i], min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))}


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One two", "a b c", "A b\x0bc d e f " * 50, "Ünï cödé ß wörds here"])
def test_fingerprint(text):
    for size in (3, 5):
        assert simhash.fingerprint(text, size) == plain(text, size)


def clustered(n, seed):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n // 2)]
    while len(out) < n:  # chains of small steps
        out.append(r.choice(out) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) * r.randrange(2))
    return out


def test_search_and_route_are_exact(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 60)
    monkeypatch.setattr(simhash, "DIRECT", 16)
    fps = np.array(sorted(set(clustered(1500, 3))), dtype=np.uint64)
    tree = simhash.routing_tree(fps[::3], len(fps), 2)
    leaves = tree.leaves
    assert leaves > 5
    leaf, at, own = simhash.route(tree, fps, 2)
    assert own.sum() == len(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    met = np.zeros_like(near)
    for x in range(leaves):
        here, mine = at[leaf == x], own[leaf == x]
        met[np.ix_(here[mine], here)] = True
        roots = simhash.search(fps[here], mine, 2)
        a, b = np.nonzero(near[np.ix_(here, here)] & (mine[:, None] | mine[None, :]))
        assert (roots[a] == roots[b]).all()
        assert len(set(roots)) == len(set(plain_roots(len(here), zip(a, b))))
    assert (met | met.T)[near].all()


def test_route_again(monkeypatch):
    """Owners and visitors of a leaf, dealt again by a tree of the leaf's own, still meet all that they are linked to."""
    fps = np.array(sorted(set(clustered(900, 8))), dtype=np.uint64)
    own = np.random.default_rng(1).random(len(fps)) < 0.6
    tree = simhash.routing_tree(fps[own], int(own.sum()), 2, leaf=40)
    assert tree.leaves > 3
    leaf, at, mine = simhash.route(tree, fps, 2, own)
    assert sorted(at[mine]) == list(np.flatnonzero(own))
    met = np.zeros((len(fps), len(fps)), bool)
    for x in range(tree.leaves):
        met[np.ix_(at[leaf == x][mine[leaf == x]], at[leaf == x])] = True
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2) & (own[:, None] | own[None, :])
    assert (met | met.T)[near].all()


def plain_roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("unit", "few", "subs", "jobs"), [(1 << 20, 1024, False, False), (160, 400, True, False), (60, 64, True, True), (20, 64, True, True), (30, 1, False, True)])
def test_classes(spark, monkeypatch, unit, few, subs, jobs):
    """One tree, trees of large leaves, and leaves in blocks: the classes are those of all pairs, and no task holds more than a unit."""
    monkeypatch.setattr(simhash, "LEAF", 80)
    monkeypatch.setattr(simhash, "MEMBERS", 3)
    monkeypatch.setattr(simhash, "UNIT", unit)
    monkeypatch.setattr(simhash, "FEW", few)
    units = simhash.units
    seen = {}

    def watched(placed):
        seen["sub"] = placed.where("sub > 0").count()
        out = units(placed)
        sizes = out.groupBy("shard", "sub", "job").count()
        seen["jobs"] = out.where("job > 0").count()
        seen["most"] = sizes.agg({"count": "max"}).first()[0]
        return out

    monkeypatch.setattr(simhash, "units", watched)
    fps = clustered(500, 5)
    rows = [(i * 7 % 1000, fps[i % 450]) for i in range(500)] + [(None, fps[0]), (None, 12345)]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "id long, fp long")
    got = df.join(simhash.fingerprint_classes(df), "fp").select("id", "component_id").collect()
    assert {tuple(x) for x in got} == plain_classes(rows, 2)
    assert (bool(seen["sub"]), bool(seen["jobs"])) == (subs, jobs)
    assert seen["most"] <= 2 * unit


def test_cases(spark):
    docs = spark.createDataFrame([(3, "a b c d", 1), (1, None, 2), (2, "", 3), (3, "a b c d", 1), (None, "x y z", 4), (9, "A  b\nc D", 5)], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((x["id"] or -1, x["component_id"]) for x in got) == [(-1, None), (1, 1), (2, 1), (3, 3), (3, 3), (9, 3)]
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((x["doc_id"] or -1, x["fp"]) for x in kept) == [(-1, 4), (1, 2), (3, 1)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (None, 3), (5, 5)], "a long, b long")
    got = {x["node"]: x["root"] for x in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}
