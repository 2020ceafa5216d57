from __future__ import annotations

import math

import numpy as np
import pytest

from pricelens.llm import lattice
from tests.conftest import local_frame

DDL = "vec_id long, embedding array<float>, label int, component string"


def frame(spark, rows):
    return local_frame(spark, [(i, v, 0, "clash") for i, v in rows], DDL)


def brute(x: np.ndarray, ids: list[int]) -> dict[int, tuple[int, int]]:
    units = x / np.linalg.norm(x, axis=1)[:, None]
    near = units @ units.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True)}
        label = least


def test_nearest_points_of_the_lattice():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 2
    near = lattice.nearest_e8(x)
    doubled = (2 * near).astype(int)
    assert ((doubled % 2 == 0).all(axis=1) | (doubled % 2 == 1).all(axis=1)).all()
    assert (near.sum(axis=1) % 2 == 0).all()
    steps = lattice.e8_neighbours()
    assert len(np.unique(steps, axis=0)) == 240 and (np.abs((steps**2).sum(axis=1) - 2) < 1e-9).all()
    own = ((x - near) ** 2).sum(axis=1)
    for step in steps:  # no neighbour is nearer: these steps bound the cell of a point
        assert (own <= ((x - near - step) ** 2).sum(axis=1) + 1e-9).all()


def test_recall_at_and_above_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (a * side).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    for cosine, least in ((0.9, 0.95), (0.92, 0.99), (0.95, 0.998)):
        b = cosine * a + math.sqrt(1 - cosine**2) * side
        met = [len(set(x) & set(y)) > 0 for x, y in zip(lattice.cells(a), lattice.cells(b), strict=True)]
        assert np.mean(met) >= least


@pytest.mark.parametrize("dimension", [3, 16, 64])
def test_links_match_brute_force(spark, dimension, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(dimension)
    centres = rng.normal(size=(6, dimension))
    noise = np.repeat([0.02, 0.1, 0.25, 0.3, 0.35, 0.5], 30)[:, None] / math.sqrt(dimension)
    groups = np.repeat(centres, 30, axis=0)
    groups = groups / np.linalg.norm(groups, axis=1)[:, None] + noise * rng.normal(size=groups.shape)
    x = np.concatenate([groups, rng.normal(size=(100, dimension))]).astype(np.float32).astype(float)
    ids = list(range(len(x)))
    got = lattice.near_vectors(spark, frame(spark, list(zip(ids, x.tolist(), strict=True)))).collect()
    want = brute(x, ids)
    found = sum(r["n_links"] for r in got)
    assert found >= 0.99 * sum(n for n, _ in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
    same = [(r["n_links"], r["component_id"]) == want[r["vec_id"]] for r in got]
    assert np.mean(same) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, None), (2, []), (3, [0.0] * 4), (4, [nan, 1.0, 1.0, 1.0]), (5, [inf, 1.0, 1.0, 1.0]),
        (6, [None, 2.0, 3.0, 4.0]), (7, v), (7, v), (8, [2 * x for x in v]), (None, v),
        (9, [1.0, 2.0, 3.0]), (10, [-x for x in v]), (11, [1e30 * x for x in v]),
    ]
    got = [tuple(r) for r in lattice.near_vectors(spark, frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    for i in (1, 2, 3, 4, 5, 6, 9, 10):
        assert (i, 0, i, True) in got
    assert got.count((7, 4, 7, True)) == 2
    assert (8, 4, 7, False) in got and (11, 4, 7, False) in got and (None, 4, 7, False) in got
    assert lattice.near_vectors(spark, frame(spark, [])).collect() == []


def test_a_large_tight_group_is_counted(spark):
    rng = np.random.default_rng(5)
    x = np.ones((3000, 8)) + 0.01 * rng.normal(size=(3000, 8))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = lattice.near_vectors(spark, frame(spark, rows)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(2999, 0)}
