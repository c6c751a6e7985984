import numpy as np
import pandas as pd
import pytest

import tallyfold.llm.embeddings as module
from tallyfold.llm.embeddings import embedding_classes, plan_tables


def brute(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in good.items():
        for j, b in good.items():
            if i < j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return links, [top(i) for i in range(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "'1' as v", "'2' as key", "'3' as n").repartition(4)


@pytest.mark.parametrize("block", [2048, 8])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        centre = rng.standard_normal(24)
        for _ in range(rng.integers(1, 12)):
            rows.append((centre + 0.12 * rng.standard_normal(24)).tolist())
    rows += [rows[0]] * 7 + [[2 * x for x in rows[0]]] + [None, [0.0] * 24, [], [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, rows[0][:5], rows[0][:5]]
    rows = list(enumerate(rows))
    links, comp = brute(rows)
    # many tables of few bits: no pair at the threshold is missed
    got = {r.vec_id: r for r in embedding_classes(frame(spark, rows), bits=4, tables=40).collect()}
    assert [got[i].n_links for i in range(len(rows))] == links
    assert [got[i].component_id for i in range(len(rows))] == comp
    assert all(got[i].kept == (comp[i] == i) for i in range(len(rows)))


@pytest.mark.parametrize("n", [3_000, 16_000])
def test_recall_over_whole_tables(spark, tmp_path, n):
    """The query's own plan over all vectors; ids divisible by 20 against all rows by brute force, cosines around 0.9."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, n, 10):  # a second vector at a planned cosine, and a third close to the first
        away = rng.standard_normal(32)
        away -= (away @ x[i]) * x[i]
        cosine = rng.uniform(0.88, 0.95)
        x[i + 1] = cosine * x[i] + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
        x[i + 2] = x[i] + 0.02 * rng.standard_normal(32)
    x = x.astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(tmp_path / "embeddings.parquet")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.array([(unit @ unit[i] >= 0.9).sum() - 1 for i in range(0, n, 20)])
    got = embedding_classes(spark.read.parquet(str(tmp_path / "embeddings.parquet"))).toPandas().set_index("vec_id")["n_links"]
    found = got.loc[np.arange(0, n, 20)].to_numpy()
    assert (found <= want).all()  # none below the threshold
    assert want.sum() > n / 20 and found.sum() >= 0.95 * want.sum()


def test_few_vectors_move(spark, monkeypatch):
    """Vectors without a near partner go to no bucket: of these rows only 60 do."""
    moved = []
    units = module._units
    monkeypatch.setattr(module, "_units", lambda placed, large, *held: moved.append((held, placed)) or units(placed, large, *held))
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3_000, 64))
    x[:30] = x[30:60] + 0.01 * rng.standard_normal((30, 64))
    got = embedding_classes(frame(spark, list(enumerate(x.tolist()))))
    assert got.where("n_links > 0").count() == 60
    ids = {r.id for held, placed in moved if "v" in held for r in placed.select("id").collect()}
    assert len(moved) == 2 and 60 <= len(ids) < 300


def test_the_sketch_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((20_000, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = rng.standard_normal(a.shape)
    away -= (away * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * away / np.linalg.norm(away, axis=1, keepdims=True)
    planes = rng.standard_normal((48, module.SKETCH))
    differ = ((a @ planes > 0) != (b @ planes > 0)).sum(1)
    assert (differ > module.sketch_limit(0.9)).sum() <= 2 and module.sketch_limit(0.9) < 65


def test_repeated_ids_nulls_and_nothing(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])]
    got = sorted(map(tuple, embedding_classes(frame(spark, rows), bits=2, tables=20).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True), (3, 0, 3, True)], key=str)
    assert embedding_classes(frame(spark, rows).where("vec_id = 9")).count() == 0


def test_tables_grow_with_the_rows():
    bits = [plan_tables(n, 0.9)[0] for n in (10, 10_000, 10_000_000, 10**10)]
    assert bits == sorted(bits) and bits[0] == 4 and bits[-1] <= 30
    for n in (1000, 10**6):
        b, t = plan_tables(n, 0.9)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** b) ** t >= 0.97
