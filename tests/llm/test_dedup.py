import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strada.llm import exact_dedup, near_dedup
from tests.llm.conftest import rows, words

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_by_hand(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[(t or "").translate(ASCII)].append(i)
    return sorted((i, max(groups[k := (t or "").translate(ASCII)]), len(groups[k]), i == max(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t in data)


@pytest.mark.parametrize("history", [None, "false", "true", "doc_id % 2 = 0"])
def test_exact_dedup_is_what_a_dictionary_finds(docs, path, history):
    got = exact_dedup.exact_dedup(docs, path, history=history and F.expr(history))
    assert sorted(tuple(r)[:5] for r in got.collect()) == exact_by_hand([(r[0], r[1]) for r in rows() if r[0] is not None])


def test_exact_dedup_of_nothing(no_docs, path):
    assert exact_dedup.exact_dedup(no_docs, path).count() == 0


def test_a_hot_text_is_one_group(spark, path):
    data = [(k, "same text" if k % 3 else f"own {k}") for k in range(900)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id long, text string"), path)
    assert sorted(tuple(r)[:5] for r in got.collect()) == exact_by_hand(data)


def test_hot_and_other_groups_meet_their_rows(spark, path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 4)
    data = [(k, "Hot text" if k % 3 else f"own {k // 6}") for k in range(300)] + [(5, "hot TEXT"), (7, None), (7, "")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id long, text string"), path)
    assert sorted(tuple(r)[:5] for r in got.collect()) == exact_by_hand(data)


def test_the_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 17, 5000):
        raw = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(n)), dtype="<u8").reshape(-1, 4)
        sizes, bits, slots = exact_dedup.build_hash(raw)
        assert sorted(slots.tolist()) == list(range(n))
        assert (exact_dedup.find_slots(raw, sizes, bits) == slots).all()
    other = np.frombuffer(b"".join(hashlib.sha256(f"x{k}".encode()).digest() for k in range(100)), dtype="<u8").reshape(-1, 4)
    assert exact_dedup.find_slots(other, sizes, bits).max() < 5000


def near_by_hand(data):
    sets = []
    for _, t in data:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(ASCII)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(data)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(data):
        least[root(k)].append(i)
    return sorted((i, len(sets[k]), min(least[root(k)]), i == min(least[root(k)])) for k, (i, _) in enumerate(data))


def test_near_dedup_is_what_all_pairs_find(docs, path):
    got = near_dedup.near_dedup(docs, path)
    assert sorted(map(tuple, got.collect())) == near_by_hand([(r[0], r[1]) for r in rows() if r[0] is not None])


def test_the_sql_of_near_dedup_is_what_all_pairs_find(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().assign(doc_id=lambda d: d.doc_id.astype("Int64")))
    assert sorted(con.execute(near_dedup.SQL).fetchall()) == near_by_hand([(r[0], r[1]) for r in rows() if r[0] is not None])


def test_near_dedup_of_nothing(no_docs, path):
    assert near_dedup.near_dedup(no_docs, path).count() == 0


def test_near_dedup_of_empty_texts(spark, path):
    got = near_dedup.near_dedup(spark.createDataFrame([(1, ""), (2, None), (3, " \n")], "doc_id long, text string"), path)
    assert sorted(map(tuple, got.collect())) == [(k, 0, k, True) for k in (1, 2, 3)]


def test_a_large_family_of_near_copies(spark, path):
    """Copies with edits of many sizes: some link to each other only through others."""
    r, base = random.Random(7), words(9, 150).split()
    data = []
    for k in range(300):
        w = list(base)
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
        data.append((1000 - k, " ".join(w)))
    old = near_dedup.SIGNATURE_BLOCK, near_dedup.TEXT_BLOCK
    near_dedup.SIGNATURE_BLOCK, near_dedup.TEXT_BLOCK = 64, 32  # several blocks
    try:
        got = sorted(map(tuple, near_dedup.near_dedup(spark.createDataFrame(data, "doc_id long, text string"), path).collect()))
    finally:
        near_dedup.SIGNATURE_BLOCK, near_dedup.TEXT_BLOCK = old
    assert got == near_by_hand(data)


def test_signatures_within_the_distance_share_a_key():
    r = np.random.RandomState(3)
    for _ in range(200):
        a = r.randint(0, 1 << 16, (1, near_dedup.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        at = r.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)
        b[0, at] ^= 1
        assert set(near_dedup.chunk_keys(a)[0]) & set(near_dedup.chunk_keys(b)[0])


def test_components_of_a_chain_and_a_star(spark, path):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(200, 199)]
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long"), path)
    assert {r["id"]: r["comp"] for r in got.collect()} == {**{k: 1 for k in range(1, 41)}, **{100 + k: 100 for k in range(60)}, 199: 199, 200: 199}


def test_unlike_texts_of_one_doc_id_are_linked_as_their_sets_are(spark, path):
    data = [(5, words(1, 100)), (5, words(2, 100)), (3, words(1, 100) + " tail"), (9, words(2, 100) + " end"), (7, words(3, 100)), (7, words(3, 100) + " x"), (8, words(4, 9)), (8, "")]
    got = near_dedup.near_dedup(spark.createDataFrame(data, "doc_id long, text string"), path)
    assert sorted(map(tuple, got.collect())) == near_by_hand(data)
