import numpy as np

from pointloom.llm import ann


def brute(ids, vectors, query, query_id, k=5):
    scores = (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query_id][:k]
    return [(int(ids[i]), scores[i]) for i in order]


def test_recall_against_brute_force(spark, sf):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = {}
    for r in ann.op5_nearest(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        want = brute(ids, vectors, vectors[ids == q][0], q)
        assert len(found) == 5 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        hits += len({i for i, _ in found} & {i for i, _ in want})
        scores = dict(found)
        assert all(abs(scores[i] - s) < 1e-12 for i, s in want if i in scores)
    assert hits >= 0.9 * 5 * len(got)


def test_recall_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((2000, 32)) + 2 * rng.standard_normal((20, 32))[rng.integers(0, 20, 2000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for i, _ in brute(np.arange(2000), vectors, vectors[q], q)}) for q in got)
    assert len(got) == 40 and hits >= 0.9 * 200


def test_query_chunks_change_nothing(spark, monkeypatch, sf):
    from helpers import spark_rows

    whole = spark_rows(ann.op5_nearest(spark, sf))
    monkeypatch.setattr(ann, "QUERY_CHUNK", 8)
    assert spark_rows(ann.op5_nearest(spark, sf)) == whole


def test_repeated_ids_do_not_end_the_search():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((400, 16))
    query = rng.standard_normal(16)
    close = query + 0.01 * rng.standard_normal((10, 16))  # one id, ten times, next to the query
    ids, vectors = np.concatenate([np.arange(400), np.full(10, 900)]), np.concatenate([vectors, close])
    ((_, found, scores),) = ann.Block(ids, vectors).search(np.array([-1]), query[None, :])
    got = ann.best_of(found, scores, 5)[0].tolist()
    every = (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))
    want = ann.best_of(ids, every, 5)[0].tolist()
    assert got[0] == 900 and len(got) == 5 and len(set(got) & set(want)) >= 4


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0], 1), (50, [2.0, 0.0], 1), (1, [3.0, 0.0], 1), (2, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1),
        (6, [float("inf"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (9, [], 1), (100, None, 1), (None, [1.0, 0.0], 1), (150, [1.0, 2.0, 3.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (0, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]  # ties to the smaller id
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_components_of_any_finite_size(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e-200, 0.0]), (2, [1e200, 0.0]), (3, [0.0, 1e-320]), (4, [-1e308, 1e308]), (5, [1e308, 1e-308]), (6, [0.0, 0.0])]
    df = spark.createDataFrame([(50 * i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 12)))
    assert set(got) == {0, 50, 100, 150, 200, 250}
    assert sorted(got[0])[:3] == [(1, 50, 1.0), (2, 100, 1.0), (3, 250, 1.0)] and sorted(got[0])[4][1] == 200
    assert abs(sorted(got[150])[0][2] - 0.5**0.5) < 1e-9


def test_bounds_of_earlier_blocks_keep_the_recall(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((3000, 48)) + 2 * rng.standard_normal((30, 48))[rng.integers(0, 30, 3000)]
    ids, hits = np.arange(3000), 0
    blocks = [ann.Block(ids[k : k + 500], ann.scaled(vectors[k : k + 500])) for k in range(0, 3000, 500)]
    asked = np.arange(0, 3000, 60)
    best = {}
    for block in blocks:
        bounds = np.array([best[q][1][-1] if q in best and len(best[q][1]) == 5 else -np.inf for q in range(len(asked))])
        for q, i, s in block.search(asked, ann.scaled(vectors[asked]), 5, bounds):
            old = best.get(q, (ids[:0], np.zeros(0)))
            best[q] = ann.best_of(np.concatenate([old[0], i]), np.concatenate([old[1], s]), 5)
    for q, i in enumerate(asked):
        hits += len(set(best[q][0].tolist()) & {j for j, _ in brute(ids, vectors, vectors[i], i)})
    assert hits >= 0.9 * 5 * len(asked)
