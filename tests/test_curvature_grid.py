"""Minimum-curvature gridding against a dense least-squares solution of the whole grid."""

import numpy as np
import pytest

from terrane.operators import curvature_grid


def dense(value, known, tension):
    """The least sum of weighted squares by the normal equations of the whole grid."""
    h, w = value.shape
    lines = []
    for weight, parts in curvature_grid.stencils(tension):
        down, along = max(p[0] for p in parts), max(p[1] for p in parts)
        for i in range(h - down):
            for j in range(w - along):
                line = np.zeros((h, w))
                for a, b, x in parts:
                    line[i + a, j + b] += x * np.sqrt(weight)
                lines.append(line.ravel())
    lines, flat, loose = np.array(lines), value.ravel().copy(), ~known.ravel()
    flat[loose] = np.linalg.lstsq(lines[:, loose], -lines[:, ~loose] @ flat[~loose], rcond=None)[0]
    return flat.reshape(h, w)


def table(spark, value, known, i0=5, j0=-3):
    rows = [(int(i) + i0, int(j) + j0, float(value[i, j]) if known[i, j] else None, 1) for i, j in np.argwhere(np.ones_like(known))]
    return spark.createDataFrame(rows, "inl int, crl int, val double, known int")


@pytest.mark.parametrize(("shape", "tension"), [((9, 12), 0.0), ((13, 8), 0.3), ((2, 7), 0.2), ((30, 27), 0.0)])
def test_solve(shape, tension):
    rng = np.random.default_rng(1)
    value, known = rng.normal(size=shape) * 5, rng.random(shape) < 0.25
    known[0, 0] = known[0, -1] = known[-1, 1] = True
    want = dense(value, known, tension)
    got = np.where(known, value, 0.0)
    for _ in range(30):
        got = curvature_grid.solve(got, ~known, tension)
    assert np.abs(got - want).max() < 1e-6


def test_a_plane_stays_a_plane():
    i, j = np.mgrid[:40, :33]
    plane, known = 2.0 + 0.5 * i - 0.25 * j, (i % 13 == 0) & (j % 11 == 0)
    got = np.where(known, plane, 7.0)
    for _ in range(40):
        got = curvature_grid.solve(got, ~known, 0.0)
    assert np.abs(got - plane).max() < 1e-5


@pytest.mark.parametrize("tension", [0.0, 0.4])
def test_fill_in_blocks(spark, tension):
    rng = np.random.default_rng(2)
    i, j = np.mgrid[:31, :26]
    value, known = np.sin(i / 6) * 3 + np.cos(j / 5) + rng.normal(size=i.shape) * 0.1, rng.random(i.shape) < 0.2
    known[0, 0] = known[30, 25] = True
    want = dense(value, known, tension)
    got = curvature_grid.fill(table(spark, value, known), tension, 1e-8, block=12, overlap=6).collect()
    assert len(got) == i.size
    for r in got:
        k = known[r.inl - 5, r.crl + 3]
        assert r.known == k and abs(r.val - want[r.inl - 5, r.crl + 3]) < 1e-4, (r, want[r.inl - 5, r.crl + 3])


def test_odd_tables(spark):
    kind = "inl long, crl long, val double"
    assert curvature_grid.fill(spark.createDataFrame([], kind)).count() == 0
    got = curvature_grid.fill(spark.createDataFrame([(1, 1, None), (2, 3, None), (None, 2, 5.0)], kind)).collect()
    assert len(got) == 6 and not any(r.known or r.val is not None for r in got)
    got = curvature_grid.fill(spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (0, 3, 8.0), (4, 0, 2.0), (4, 3, None)], kind)).collect()
    assert {(r.inl, r.crl): round(r.val, 6) for r in got}[4, 3] == 8.0 and sum(r.known for r in got) == 3
    with pytest.raises(ValueError):
        curvature_grid.fill(spark.createDataFrame([(0, 0, 1.0)], kind), 1.0)


@pytest.mark.parametrize(("shape", "tension"), [((40, 37), 0.0), ((33, 41), 0.3), ((2, 9), 0.2), ((1, 9), 0.2), ((9, 1), 0.0)])
def test_steps_alone_solve_what_has_known_nodes_near(monkeypatch, shape, tension):
    rng = np.random.default_rng(4)
    value, known = rng.normal(size=shape) * 5 + 300, rng.random(shape) < 0.3
    known[0, 0] = known[0, -1] = known[-1, min(1, shape[1] - 1)] = True
    monkeypatch.setattr(curvature_grid, "solve", None)  # no block is eliminated
    got = curvature_grid.nearer(np.where(known, value, 0.0), ~known, tension)
    assert np.abs(got - dense(value, known, tension)).max() < 1e-7
    assert np.array_equal(got[known], value[known])


def test_what_steps_do_not_settle_is_eliminated():
    i, j = np.mgrid[:60, :50]
    value, known = 2.0 + 0.5 * i - 0.25 * j, np.zeros((60, 50), bool)
    known[0, 0] = known[59, 0] = known[3, 49] = True
    got, flat = np.where(known, value, 7.0), np.full((6, 5), 3.0)
    for _ in range(60):
        got = curvature_grid.nearer(got, ~known, 0.0)
    assert np.abs(got - value).max() < 1e-4
    assert np.array_equal(curvature_grid.nearer(flat, np.ones((6, 5), bool), 0.2), flat)


def test_only_blocks_that_hold_what_moved_are_solved_again(spark):
    grid = curvature_grid._Grid(40, 24, 8, 4)
    rng = np.random.default_rng(6)
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(rng.normal(size=(40, 24))) if rng.random() < 0.3]
    blocks = curvature_grid._start(spark.createDataFrame(rows, "i long, j long, val double"), grid, 0.0).localCheckpoint()
    first = curvature_grid._round(blocks, None, grid, 0.2).localCheckpoint()
    assert curvature_grid._called(first, grid, 0.0).count() == 15 and curvature_grid._called(first, grid, 1e9).count() == 0
    todo = spark.createDataFrame([(2, 1)], "bi long, bj long")
    second = curvature_grid._round(first.drop("moved"), todo, grid, 0.2).localCheckpoint()
    before, after = ({(r.bi, r.bj): r.value for r in t.collect()} for t in (first, second))
    assert {at for at in after if after[at] != before[at]} == {(2, 1)} and len(after) == 15
    # its neighbours hold what moved, others do not
    called = {(r.bi, r.bj) for r in curvature_grid._called(second, grid, 0.0).collect()}
    assert called <= {(i, j) for i in (1, 2, 3) for j in (0, 1, 2)} - {(2, 1)} and called
    whole = curvature_grid._round(first.drop("moved"), None, grid, 0.2)
    assert {(r.bi, r.bj): r.value for r in whole.collect()}[2, 1] == after[2, 1]


def test_blocks_are_dealt_to_as_many_tasks_as_shuffles_have(spark):
    grid = curvature_grid._Grid(200, 24, 8, 4)
    blocks = curvature_grid._start(spark.createDataFrame([(0, 0, 1.0)], "i long, j long, val double"), grid, 0.0)
    assert curvature_grid._dealt(blocks, None, grid, 6).rdd.getNumPartitions() == 4
