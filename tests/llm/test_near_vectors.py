import numpy as np
import pytest

from chunkloom.llm import near_vectors as nv

SCHEMA = "vec_id long, embedding array<float>, id long, key long, v string, own int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "z", 3) for i, v in rows], SCHEMA)


def brute(rows, threshold=nv.THRESHOLD):
    """(id, class, size, links) from all pairs."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)})
    x = [np.array(v, dtype=np.float32).astype(float) for _, v in good]
    near = [[j for j, b in enumerate(x) if j != i and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold] for i, a in enumerate(x)]
    root = list(range(len(x)))
    for s in root[:]:
        todo = [s] if root[s] == s else []
        while todo:
            for j in near[todo.pop()]:
                if root[j] > s:
                    root[j] = s
                    todo.append(j)
    return sorted((i, good[r][0], root.count(r), len(n)) for (i, _), r, n in zip(good, root, near))


def clusters(dim, seed=0):
    """Singles, pairs at all distances around the threshold, a crowd, equal vectors."""
    r = np.random.default_rng(seed + dim)
    base = r.normal(size=(300, dim))
    copies = base[:100] + r.normal(size=(100, dim)) * np.linalg.norm(base[:100], axis=1)[:, None] * r.uniform(0.05, 0.33, (100, 1)) / np.sqrt(dim)
    crowd = base[0] + 0.05 * r.normal(size=(60, dim))
    same = np.repeat(base[5:8], 4, axis=0)
    return list(enumerate(np.concatenate([base, copies, crowd, same]).astype(np.float32).tolist()))


def got(df):
    return sorted(map(tuple, df.collect()))


def test_hadamard_is_orthogonal():
    x = np.eye(16, dtype=np.float64)
    h = nv.hadamard(x)
    assert np.allclose(h @ h.T, 16 * np.eye(16)) and set(np.unique(h)) == {-1.0, 1.0}


@pytest.mark.parametrize("dim", [64, 50, 3])
def test_classes_and_links_equal_all_pairs(spark, dim):
    rows = clusters(dim)
    want = brute(rows)
    have = got(nv.near_vectors(frame(spark, rows), block=16))
    assert len(have) == len(want) and sum(a != b for a, b in zip(have, want)) <= 0.02 * len(want)
    assert max(n for _, _, n, _ in want) >= 60 and sum(n > 1 for _, _, n, _ in want) > 100
    assert have == got(nv.near_vectors(frame(spark, rows).repartition(5)))


def test_sql_equals_all_pairs(spark, tmp_path):
    import duckdb

    rows = clusters(64)
    frame(spark, rows).select("vec_id", "embedding").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = sorted(con.execute(nv.ORACLE).fetchall())
    assert sql == brute(rows) and sum(n for *_, n in sql) > 3000
    assert sum(a != b for a, b in zip(sql, got(nv.near_vectors(frame(spark, rows))))) <= 0.01 * len(sql)


@pytest.mark.parametrize("dim, threshold", [(64, 0.8), (64, 0.9), (64, 0.95), (384, 0.9), (384, 0.95), (768, 0.95)])
def test_recall_of_pairs_exactly_at_the_threshold(dim, threshold):
    r = np.random.default_rng(dim)
    x, g = r.normal(size=(2, 600, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g -= (x * g).sum(1)[:, None] * x
    g /= np.linalg.norm(g, axis=1)[:, None]
    y = threshold * x + np.sqrt(1 - threshold**2) * g
    k, tables = nv.shape(10_000, dim, threshold)
    a, b = (nv.bucket_keys(z.astype(np.float32), k, tables, nv.PROBES, nv.SEED) for z in (x, y))
    found = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean()
    assert found >= nv.RECALL - 0.006  # three standard errors of 600 trials are 0.012


def test_linked_equals_a_loop():
    r = np.random.default_rng(4)
    v = r.normal(size=(700, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    sizes = [1, 2, 48, 49, 130, 200, 3, 267]
    unit = np.repeat(np.arange(len(sizes)), sizes)
    for mixed in (False, True):
        side = np.zeros(700, dtype=int)
        if mixed:
            for u in (2, 5):
                at = np.flatnonzero(unit == u)
                side[at[len(at) // 3 :]] = 1
        i, j = nv.linked(unit, side, v, 0.9)
        two = {u for u in range(len(sizes)) if side[unit == u].any()}
        want = {(a, b) for a in range(700) for b in range(a + 1, 700) if unit[a] == unit[b] and (unit[a] not in two or side[a] != side[b]) and v[a] @ v[b] >= 0.9}
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)
        label = nv.spanning(i, j, 700)
        assert (label[i] == label[j]).all() and (label <= np.arange(700)).all() and (label[label] == label).all()


def test_odd_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1, 2, 3]), (1, None), (2, []), (3, [0, 0, 0]), (4, [nan, 1, 2]), (5, [inf, 1, 2]), (6, [1, 2, 3]), (6, [1, 2, 3]), (7, [2, 4, 6]), (8, [1, 2, 3, 0]), (9, [1, None, 3]), (10, [5]), (11, [7]), (12, [-7]), (7, [3, -1, 0]), (13, [2e-40, 4e-40, 6e-40]), (14, [1e38, 2e38, 3e38])]
    assert got(nv.near_vectors(frame(spark, rows))) == sorted([(6, 6, 4, 3), (7, 6, 4, 3), (7, 7, 1, 0), (8, 8, 1, 0), (10, 10, 2, 1), (11, 10, 2, 1), (12, 12, 1, 0), (13, 6, 4, 3), (14, 6, 4, 3)])
    assert nv.near_vectors(frame(spark, rows).where("false")).collect() == []
    kept = nv.without_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str((r.vec_id, r.embedding)) for r in kept.collect()) == sorted(str((r.vec_id, r.embedding)) for r in frame(spark, [x for x in rows if x[0] not in (11, 13, 14) and x != (7, [2, 4, 6])]).collect())
    assert nv.without_duplicates(frame(spark, rows).where("false")).collect() == []


def test_equal_vectors_of_many_ids(spark):
    rows = [(i, [1, 2, 3, 4]) for i in range(500)] + [(1000 + i, [1, 2, 3, 4.001 + i / 1000]) for i in range(3)]
    assert got(nv.near_vectors(frame(spark, rows), block=2)) == [(i, 0, 503, 502) for i in sorted(i for i, _ in rows)]


def test_shape_follows_size_and_threshold():
    assert nv.shape(500, 64)[0] <= nv.shape(10**6, 64)[0] < nv.shape(10**10, 64)[0]
    assert nv.shape(10**4, 64, 0.9)[1] > nv.shape(10**4, 64, 0.95)[1]
    assert nv.shape(10**9, 1)[1] >= 1
