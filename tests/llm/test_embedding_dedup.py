import numpy as np

from tidepool.llm.embedding_dedup import dedup_embeddings, linked_pairs


def brute(rows, cosine):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    links, up = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, x, l) in enumerate(ok):
        for j, y, m in ok[k + 1 :]:
            if l == m and len(x) == len(y):
                a, b = np.array(x, np.float64), np.array(y, np.float64)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((top(i), top(j)))
                    up[q] = p
    return {i: (links[i], top(i), top(i) == i) for i in links}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    base, rows = rng.normal(size=(40, 16)), []
    for i in range(500):
        x = base[rng.integers(40)] * rng.uniform(0.5, 3) + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.2, 1])
        rows.append((i, np.float32(x).tolist(), int(rng.integers(3)) if rng.random() < 0.95 else None))
    rows += [(500 + k, rows[3][1], rows[3][2]) for k in range(30)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [1.0, None] * 8, 1), (604, [float("nan")] * 16, 1), (605, [float("inf")] * 16, 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for tile in (2000, 40):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in dedup_embeddings(df, tile=tile).collect()}
        assert got == brute(rows, 0.98)
    assert dedup_embeddings(df.limit(0)).collect() == []
    assert {r.n_links for r in dedup_embeddings(spark.createDataFrame([(1, [1.0], None), (None, [1.0], 1)], "vec_id long, embedding array<double>, label int")).collect()} == {0}


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24)) @ np.diag(np.linspace(3, 0.1, 24))
    y = x[::2] + rng.normal(size=(150, 24)) * 0.1
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = linked_pairs(x, y, axes, 0.97)
    c = x @ y.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(c >= 0.97)), strict=True))
