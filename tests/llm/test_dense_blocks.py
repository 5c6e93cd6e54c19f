"""Blocks of vectors that nearly all link, within bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import embedding_dedup


def block(x, own, low, high):
    n = len(x)
    column = lambda v, kind: pa.array([v] * n, kind)
    return pa.table({
        "label": column("a", pa.string()), "width": column(x.shape[1], pa.int32()), "cell": column(0, pa.int32()), "low": column(low, pa.int32()), "high": column(high, pa.int32()), "own": pa.array(own, pa.int32()),
        "gid": pa.array(np.arange(n)), "rep": pa.array(1000 + np.arange(n)), "copies": column(1, pa.int64()), "cells": pa.array([[0]] * n, pa.list_(pa.int32())), "v": pa.array(list(x), pa.list_(pa.float64())),
    })


@pytest.mark.parametrize("width", [64, 256])
def test_a_dense_block_stays_small(width):
    rng = np.random.default_rng(1)
    x = rng.normal(size=width) + 0.01 * rng.normal(size=(4096, width))
    table = block(x, np.zeros(4096, np.int32), 0, 0)
    tracemalloc.start()
    out = embedding_dedup._compare(0.98)(table)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 400
    links = [r for r in out.to_pylist() if r["other"] is None]
    assert len(links) == 4096 and {r["links"] for r in links} == {4095}
    assert {(r["rep"], r["other"]) for r in out.to_pylist() if r["other"] is not None} == {(1000 + i, 1000) for i in range(1, 4096)}


@pytest.mark.parametrize("low,high", [(0, 0), (0, 1)])
def test_blocks_equal_all_pairs(low, high):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(12, size=300)] + 0.08 * rng.normal(size=(300, 16))
    own = np.zeros(300, np.int32) if low == high else rng.integers(2, size=300).astype(np.int32)
    out = embedding_dedup._compare(0.98)(block(x, own, low, high)).to_pylist()
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    near = (unit @ unit.T >= 0.98) & ~np.eye(300, dtype=bool)
    if low != high:
        near &= own[:, None] != own[None, :]
    assert {r["rep"] - 1000: r["links"] for r in out if r["other"] is None} == {i: int(n) for i, n in enumerate(near.sum(1)) if n}
    reach = near | np.eye(300, dtype=bool)
    for _ in range(9):
        reach = reach @ reach
    assert {(r["rep"] - 1000, r["other"] - 1000) for r in out if r["other"] is not None} == {(i, int(np.flatnonzero(reach[i])[0])) for i in range(300) if np.flatnonzero(reach[i])[0] != i}
