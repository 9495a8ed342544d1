"""The forest at work: split labels, crowds, ids of other types, and less work than all pairs."""

import numpy as np
import pytest

from tessera.llm import rpforest


def _union(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _clustered(rng, n, dim=32):
    """Vectors in a narrow region of the space, in clusters, some of them near copies of others."""
    middle = rng.standard_normal(dim)
    centres = middle + 0.7 * rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.5 * rng.standard_normal((n, dim))
    near = rng.integers(0, n, n // 10)
    x[rng.integers(0, n, n // 10)] = x[near] + 0.03 * rng.standard_normal((n // 10, dim))
    return x


def test_forest_finds_links_with_less_work_than_all_pairs():
    rng = np.random.default_rng(6)
    x = _clustered(rng, 4000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for sample in (u, u[::4]):  # a label that is fitted whole, and one fitted on a part
        forest = rpforest.Forest(sample, len(u), rpforest.TREES, 0.1, rpforest.LEAF, rpforest.TILE)
        row, leaf, tile = forest.leaves(u, 5)
        assert set(row.tolist()) == set(range(len(u)))
        sizes = np.unique(leaf, return_counts=True)[1]
        assert (sizes * (sizes - 1) / 2).sum() < 0.25 * len(u) * (len(u) - 1) / 2
        leaves = [set() for _ in u]
        for r, v in zip(row.tolist(), leaf.tolist(), strict=True):
            leaves[r].add(v)
        a, b = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
        found = sum(bool(leaves[i] & leaves[j]) for i, j in zip(a, b, strict=True))
        assert len(a) > 300 and found >= 0.995 * len(a)
        inside = {}
        for v, w in zip(leaf.tolist(), tile.tolist(), strict=True):
            assert inside.setdefault(v, w) == w  # a leaf travels in one tile


@pytest.mark.parametrize("tile, fit_rows", [(1024, 4096), (40, 4096), (40, 100)])
def test_near_duplicates_through_trees(spark, tile, fit_rows):
    rng = np.random.default_rng(8)
    x = _clustered(rng, 700)
    crowd = x[0] + 0.01 * rng.standard_normal((90, x.shape[1]))  # no split parts these
    x = np.concatenate([x, crowd])
    label = np.concatenate([np.arange(700) % 2, np.zeros(90, int)])
    rows = [(f"v{k:04d}", [float(v) for v in r], str(label[k])) for k, r in enumerate(x)]
    rows += [rows[3], rows[3], ("v0003", rows[8][1], rows[8][2])]  # a repeated row, and an id on another vector
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rpforest.near_duplicates(df, tile=tile, fit_rows=fit_rows).collect())
    y = np.array([r[1] for r in rows])
    u, l = y / np.linalg.norm(y, axis=1, keepdims=True), np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.98) & (l[:, None] == l[None, :])
    near[np.all(y[:, None] == y[None], axis=2) & (l[:, None] == l[None, :])] = True
    np.fill_diagonal(near, False)
    root = _union(len(rows), np.argwhere(near).tolist())
    ids = np.array([r[0] for r in rows])
    low = {}
    for k, i in zip(root, ids, strict=True):
        low[k] = min(low.get(k, i), i)
    want = sorted((ids[k], int(near[k].sum()), low[root[k]], bool(low[root[k]] == ids[k])) for k in range(len(rows)))
    assert [g == w for g, w in zip(got, want, strict=True)].count(True) >= 0.995 * len(want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
