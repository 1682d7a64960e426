import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlast.llm import sharding


@pytest.mark.parametrize("good,total,drawn", [(3, 10, 4), (0, 5, 2), (5, 5, 3), (7, 12, 0), (4, 6, 6), (50, 60, 55), (1, 1, 1)])
def test_draws_are_hypergeometric(llm, good, total, drawn):
    """Every count takes its exact share of an even grid of uniforms."""
    grid = 4000
    rows = llm.range(grid).select(F.lit(good).alias("g"), F.lit(total).alias("t"), F.lit(drawn).alias("d"),
                                  ((F.col("id") + 0.5) / grid).alias("u"))
    rows = sharding.with_draw(rows, "g", "t", "d", "u", "x")
    found = Counter(r.x for r in rows.select("x").collect())
    for x in range(max(found) + 2):
        wanted = comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn) if drawn >= x else 0
        assert found[x] / grid == pytest.approx(wanted, abs=1.01 / grid), x


def test_large_draws(llm):
    rows = llm.range(400).select(F.expr("xxhash64(id) / 18446744073709551616D + 0.5D").alias("u"))
    rows = sharding.with_draw(rows, "1000000000L", "8000000000L", "1000000", "u", "x")
    x = np.array([r.x for r in rows.select("x").collect()], float)
    deviation = np.sqrt(10**6 / 8 * 7 / 8)
    assert abs(x.mean() - 125_000) < 4 * deviation / 20 and 0.85 < x.std() / deviation < 1.15


def test_matrix_has_exact_margins_and_the_right_law(llm):
    sizes = {0: 5, 1: 40, 3: 1, 6: 17, 11: 4}
    table = llm.createDataFrame(list(sizes.items()), "part bigint, size bigint")
    cells = []
    for seed in range(6):
        rows = {r.part: r.counts for r in sharding.communication_matrix(table, 4, seed).collect()}
        assert {p: sum(c) for p, c in rows.items()} == sizes
        assert [sum(c) for c in zip(*rows.values())] == [17, 17, 17, 16]
        assert all(c >= 0 for counts in rows.values() for c in counts)
        cells.append(rows[1])
    mean = np.mean(cells, axis=0)  # 40 * 17 / 67 each, with a deviation of 1.8 a draw
    assert np.all(np.abs(mean - np.array([40 * s / 67 for s in (17, 17, 17, 16)])) < 3)
    assert len(set(map(tuple, cells))) > 3


def check(rows, expected, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in expected)
    by_shard = {}
    for r in rows:
        assert (r.law, r.grown_shard) == ("rows", None)
        by_shard.setdefault(r.shard, []).append(r.slot)
    whole, more = divmod(len(expected), shards)
    assert {s: len(v) for s, v in by_shard.items()} == {s: n for s in range(shards) if (n := whole + (s < more))}
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


@pytest.mark.parametrize("parts,shards", [(1, 8), (7, 8), (5, 3)])
def test_documents(documents, parts, shards):
    expected = [(r.doc_id, r.text) for r in documents.collect()]
    check(sharding.shard(documents.repartition(parts), shards).collect(), expected, shards)


def test_shuffle_is_uniform(llm):
    """Neither the shard nor the place in it tells where a row came from."""
    docs = llm.range(0, 4000, 1, 6).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard(docs, 8, 3).collect()
    table = np.zeros((6, 8))
    for r in rows:
        table[r.doc_id * 6 // 4000, r.shard] += 1
    wanted = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / 4000
    assert 12 < ((table - wanted) ** 2 / wanted).sum() < 70  # chi-squared, 35 degrees of freedom
    first = sorted((r.shard, r.slot, r.doc_id) for r in rows)
    ids = np.array([i for _, _, i in first], float)
    assert abs(np.corrcoef(ids[:-1], ids[1:])[0, 1]) < 0.06
    assert [tuple(r) for r in rows] != [tuple(r) for r in sharding.shard(docs, 8, 4).collect()]


def test_odd_rows(odd_documents, odd_rows, no_documents):
    check(sharding.shard(odd_documents).collect(), [r[:2] for r in odd_rows], 8)
    assert sharding.shard(no_documents).collect() == []


def test_plan_is_native(documents):
    plan = sharding.shard(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
