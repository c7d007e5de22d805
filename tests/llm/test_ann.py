import numpy as np
from pyspark.sql import functions as F

from strada.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, v int, code string, b int, q int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(None if (ids or range(len(vectors)))[k] is None else int((ids or range(len(vectors)))[k]), x, 0, 1, "c", 2, 3) for k, x in enumerate(vectors)], SCHEMA)


def recall(x, found, k=20):
    hit = 0
    asked = range(0, len(x), 20)
    for q in asked:
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        best = set(np.lexsort((np.arange(len(x)), -score))[:k].tolist())
        hit += len(best & set(found[q]))
    return hit / (k * len(asked))


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_recall_of_clustered_and_even_vectors(spark, path):
    r = np.random.RandomState(0)
    for k, x in enumerate((r.randn(2000, 32), r.randn(40, 32)[r.randint(0, 40, 2000)] + 0.4 * r.randn(2000, 32), r.randn(2000, 16) * r.rand(2000, 1) * 5)):
        x = x.astype(np.float32).astype(np.float64)
        got = found_by(ann.neighbours(frame(spark, x.tolist()), f"{path}/{k}", F.col("vec_id") % 20 == 0))
        assert all(len(v) == 20 for v in got.values())
        assert recall(x, got) >= 0.9


def test_blocks_don_t_change_what_is_found(spark, path, monkeypatch):
    x = np.random.RandomState(1).randn(600, 8).astype(np.float32).tolist()
    monkeypatch.setattr(ann, "ROWS", 100)
    monkeypatch.setattr(ann, "QUERIES", 7)
    got = found_by(ann.neighbours(frame(spark, x), path, F.col("vec_id") % 20 == 0))
    assert recall(np.array(x, dtype=np.float64), got) >= 0.9
    assert all(len(set(v)) == 20 for v in got.values())


def test_ties_scores_and_odd_vectors(spark, path):
    good = [[1.0, 0.0], [0.0, 1.0]] * 30
    odd = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 2.0, 3.0]]
    got = ann.neighbours(frame(spark, good + odd + [[5.0, 5.0]], [*range(60), *range(60, 67), None]), path, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == [0, 20, 40]
    assert sorted(by[20]) == [(k + 1, i, 1.0) for k, i in enumerate([i for i in range(0, 60, 2) if i != 20][:20])]


def test_few_candidates_give_all(spark, path):
    got = ann.neighbours(frame(spark, [[1.0, 2.0], [2.0, 1.0], [-1.0, 0.5]], [0, 1, 20]), path, F.col("vec_id") % 20 == 0)
    assert found_by(got) == {0: [1, 20], 20: [1, 0]} or found_by(got) == {0: [1, 20], 20: [0, 1]}
    assert ann.neighbours(frame(spark, [[1.0, 2.0]], [0]), f"{path}/one", F.col("vec_id") % 20 == 0).count() == 0
    assert ann.neighbours(spark.createDataFrame([], SCHEMA), f"{path}/none", F.col("vec_id") % 20 == 0).count() == 0


def test_probing_finds_every_code_within_the_radius():
    r = np.random.RandomState(2)
    code = r.randint(0, 256, (500, 32)).astype(np.uint8)
    index = ann.MultiIndex(code)
    for radius in (0, 60, 100, 120, 256):
        q = code[7] ^ (r.rand(32) < 0.3).astype(np.uint8)
        far = np.unpackbits(code ^ q, axis=1).sum(axis=1)
        assert sorted(index.within(q, radius).tolist()) == np.flatnonzero(far <= radius).tolist()


def test_rows_that_repeat_an_id(spark, path):
    x = np.random.RandomState(3).randn(200, 8).astype(np.float32).tolist()
    got = ann.neighbours(frame(spark, [*x, x[7], x[9]], [*range(200), 7, 11]), path, F.col("vec_id") % 20 == 0).collect()
    for q in range(0, 200, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        scores = [s for _, _, s in mine]
        assert scores == sorted(scores, reverse=True) and all(i != q for _, i, _ in mine)
        for i, copies in ((7, 2),):  # each row of an id is a candidate of its own
            own = sum(1 for _, v, _ in mine if v == i)
            assert own in (0, copies) or scores[-1] == next(s for _, v, s in mine if v == i)
