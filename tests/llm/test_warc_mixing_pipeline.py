import gzip
import base64
import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strada.llm import mixing, warc

PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://d\r\nEvil: 1", ""), (5, "http://e", "é\r\n\r\nWARC/1.1\r\n" * 50), (7, "http://g", "z" * 300_000), (9, "http://a", "<p>x</p>"), (None, "u", "h")]


def pages(spark, data):
    return spark.createDataFrame([(i, u, h, "x", 0, 1) for i, u, h in data], "page_id long, url string, html string, digest string, mark int, refers_to int")


def by_hand(data, least=0):
    last = {}
    for i, _, h in data:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in data:
        if i is not None:
            raw = (h or "").encode()
            to = last[h or ""]
            out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("revisit", to) if to != i and len(raw) >= least else ("response", None))))
    return sorted(out)


@pytest.mark.parametrize(("least", "roll"), [(0, 1 << 20), (9, 1), (8, 300)])
def test_archives_hold_every_page(spark, path, least, roll):
    made = warc.write(pages(spark, PAGES), path, f"{path}/warc", least, roll)
    got = warc.read(spark, f"{path}/warc").collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == by_hand(PAGES, least)
    assert sum(m["records"] for m in made) == 7
    assert (len(made) == 7) == (roll == 1) or roll != 1
    assert not [n for n in os.listdir(f"{path}/warc".removeprefix("file://")) if n.endswith(".tmp")]


def test_archives_are_the_same_each_time(spark, path):
    read = lambda d: {n: open(f"{d}/{n}", "rb").read() for n in os.listdir(d)}
    for k in (1, 2):
        warc.write(pages(spark, PAGES).repartition(k), f"{path}/{k}", f"{path}/warc{k}")
    one, two = (b"".join(v for _, v in sorted(read(f"{path}/warc{k}".removeprefix("file://")).items()) if not v.startswith(b"{")) for k in (1, 2))
    assert one == two


def test_archives_of_nothing(spark, path):
    assert warc.write(pages(spark, []), path, f"{path}/warc") == []
    assert warc.read(spark, f"{path}/warc").count() == 0


def test_a_third_of_all_pages_alike(spark, path):
    data = [(k, f"u{k}", "same" if k % 3 == 0 else f"own {k}") for k in range(600)]
    warc.write(pages(spark, data), path, f"{path}/warc")
    got = warc.read(spark, f"{path}/warc").collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == by_hand(data)


def test_raking_meets_the_targets(spark, path):
    cells = [(s, l, t, float(10 + 7 * k)) for k, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in ("en", "de") for t in ("legal", "prose"))]
    want = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"legal": 0.1, "prose": 0.9}}
    got = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens double"), path, want, 0.05).collect()
    for d, shares in want.items():
        for v, share in shares.items():
            assert abs(sum(r["share"] for r in got if r[d] == v) - share) < 1e-6
    total = sum(r["tokens"] for r in got)
    assert abs(sum(r["tokens"] * r["probability"] for r in got) - 0.05 * total) < 1e-6 * total
    for r in got:  # nothing is capped here, so the sample's shares are the raked ones
        assert abs(r["tokens"] * r["probability"] / (0.05 * total) - r["share"]) < 1e-6


def test_probabilities_are_capped_and_keep_the_fraction(spark, path):
    cells = [("a", "en", "prose", 1000.0), ("b", "en", "prose", 10.0), ("c", "en", "prose", 100.0)]
    got = {r["source"]: r for r in mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens double"), path, {"source": 0.0}, 0.5).collect()}
    assert got["b"]["probability"] == 1.0 and got["c"]["probability"] == 1.0
    assert abs(sum(r["tokens"] * r["probability"] for r in got.values()) - 555) < 1e-6


def test_a_target_that_no_cell_has_goes_to_the_others(spark, path):
    cells = [("a", "en", "prose", 30.0), ("b", "en", "prose", 10.0), ("c", "en", "prose", 60.0)]
    got = {r["source"]: r for r in mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens double"), path, {"source": {"a": 0.2, "b": 0.2, "zz": 0.6}}, 0.9).collect()}
    assert [round(got[k]["share"], 9) for k in "abc"] == [0.5, 0.5, 0.0]
    assert [got[k]["probability"] for k in "abc"] == [1.0, 1.0, 0.0]  # 40 of the 90 wanted are all there are


def test_many_cells_are_raked_as_by_numpy(spark, path):
    r = np.random.RandomState(4)
    n = 3000  # nearly all of them in one source
    at = np.stack([np.where(r.rand(n) < 0.7, 0, r.randint(0, 400, n)), r.randint(0, 60, n), r.randint(0, 3, n)], axis=1)
    at = np.unique(at, axis=0)
    tokens = r.randint(0, 1000, len(at)).astype(float)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", float(x)) for (a, b, c), x in zip(at, tokens, strict=True)], "source string, lang string, topic string, tokens double")
    got = {(x["source"], x["lang"], x["topic"]): x for x in mixing.rake(cells, path, {"source": 0.5, "lang": 0.0, "topic": 0.8}, 0.6, 4).collect()}
    w = tokens / tokens.sum()
    powers = (0.5, 0.0, 0.8)
    own = [np.bincount(at[:, d], tokens) / tokens.sum() for d in range(3)]
    want = [np.where(o > 0, np.power(np.where(o > 0, o, 1), p), 0) for o, p in zip(own, powers, strict=True)]
    for _ in range(4):
        for d in range(3):
            held = np.bincount(at[:, d], w, minlength=len(want[d]))[at[:, d]]
            w = np.where(held > 0, w * (want[d] / want[d].sum())[at[:, d]] / np.where(held > 0, held, 1), 0)
    w /= w.sum()
    ratio = np.where(tokens > 0, w / np.where(tokens > 0, tokens / tokens.sum(), 1), 0)
    low, high = 0.0, 1e9
    for _ in range(200):  # halving, where the operator solves
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * ratio)).sum() < 0.6 * tokens.sum() else (low, mid)
    for k, (a, b, c) in enumerate(at):
        x = got[f"s{a}", f"l{b}", f"t{c}"]
        assert abs(x["share"] - w[k]) < 1e-9 and abs(x["probability"] - (min(1, low * ratio[k]) if tokens[k] else 1)) < 1e-6


def test_mixing_is_what_sql_finds(spark, docs, path):
    got = sorted(map(str, map(tuple, mixing.mix(docs, path).collect())))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().assign(doc_id=lambda d: d.doc_id.astype("Int64")))
    assert got == sorted(map(str, con.execute(mixing.SQL).fetchall()))


def test_mixing_of_nothing_and_of_empty_texts(spark, no_docs, path):
    assert mixing.mix(no_docs, path).count() == 0
    assert mixing.sampled(no_docs, f"{path}/s").count() == 0
    empty = spark.createDataFrame([(1, None, None, None), (2, "", "en", "a")], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in mixing.mix(empty, f"{path}/e").collect()] == [True, True]


def test_the_sample_is_what_the_mix_says(docs, path):
    said = sorted(r["doc_id"] for r in mixing.mix(docs, path).where("kept").collect())
    kept = mixing.sampled(docs, f"{path}/s")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == said


def test_the_pipeline_keeps_what_its_stages_keep(spark, tmp_path):
    import corpus_pipeline

    from strada.llm import language, near_dedup
    from tests.llm.conftest import words
    from tests.llm.test_dedup import exact_by_hand, near_by_hand
    from tests.llm.test_texts import prose

    data = [(k, prose(("en", "fr", "de")[k % 3], k, 30 + k), ("en", "fr", "de")[k % 3], "ab"[k % 2]) for k in range(120)]
    data += [(200, "12 !!", "en", "a"), (201, None, None, None), (202, data[5][1], "de", "a"), (203, data[5][1].upper(), "de", "a"), (204, data[100][1] + " tail", "fr", "b")]
    data += [(300 + k, words(k, 80), "en", "a") for k in range(3)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {i: t for i, t, *_ in data}
    found = {r["doc_id"]: r["lang_pred"] for r in language.language_id(docs).collect()}
    one = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    left = sorted(i for i, v in found.items() if v != "und")
    assert sorted(r["doc_id"] for r in one.collect()) == left and one.columns == docs.columns and 200 not in left and 201 not in left
    two = corpus_pipeline.drop_exact_copies(spark, one, str(tmp_path))
    left = sorted(r[0] for r in exact_by_hand([(i, texts[i]) for i in left]) if r[3])
    assert sorted(r["doc_id"] for r in two.collect()) == left and two.columns == docs.columns and 5 not in left
    three = corpus_pipeline.drop_near_copies(spark, two, str(tmp_path))
    left = sorted(r[0] for r in near_by_hand([(i, texts[i]) for i in left]) if r[3])
    assert sorted(r["doc_id"] for r in three.collect()) == left and three.columns == docs.columns and 204 not in left
    four = corpus_pipeline.mix_sources(spark, three, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", three.select("doc_id", "text", "lang", "source").toPandas())
    left = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.SQL}) WHERE kept").fetchall())
    assert sorted(r["doc_id"] for r in four.collect()) == left and four.columns == docs.columns
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]] += r["length"]
    assert sorted(pieces) == left
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "mixing sources", "packing"]
    assert near_dedup and zlib


def test_distinct_texts_of_one_doc_id_survive_both_dedups(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.conftest import words

    a, b, c = (words(k, 80) for k in (1, 2, 3))
    docs = spark.createDataFrame([(5, a, "en"), (7, a.upper(), "en"), (5, b, "en"), (5, c, "en"), (5, c, "de")], "doc_id long, text string, lang string")
    two = corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path))
    want = sorted([(5, b, "en"), (5, c, "de"), (7, a.upper(), "en")])
    assert sorted(map(tuple, two.collect())) == want
    near = spark.createDataFrame([*want, (9, b + " tail", "en"), (5, c + " tail", "en")], docs.schema)
    got = sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, near, str(tmp_path)).collect()))
    assert len(got) == 3 and {(5, b, "en"), (7, a.upper(), "en")} < set(got)


def test_rows_that_repeat_a_page_and_its_payload_have_one_response(spark, path):
    data = [(1, "a", "<p>x"), (1, "b", "<p>x"), (1, "c", "<p>y"), (0, "d", "<p>x"), (0, "d", "<p>x"), (2, "e", "<p>y")]
    warc.write(pages(spark, data), path, f"{path}/warc")
    got = sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in warc.read(spark, f"{path}/warc").collect())
    assert got == [(0, "d", "revisit", 1), (0, "d", "revisit", 1), (1, "a", "response", None), (1, "b", "revisit", 1), (1, "c", "revisit", 2), (2, "e", "response", None)]
    folder, ids = f"{path}/warc".removeprefix("file://"), []
    for name in os.listdir(folder):
        if name.endswith(".gz"):
            with gzip.open(f"{folder}/{name}") as f:
                ids += [line for line in f.read().split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(ids)) == len(data)


@pytest.mark.parametrize("data", [PAGES, [(1, "a", "<p>x"), (1, "b", "<p>x"), (1, "c", "<p>y"), (0, "d", "<p>x"), (0, "d", "<p>x"), (2, "e", "<p>y")], []])
def test_archives_are_what_sql_finds(spark, path, data):
    own = pages(spark, data)
    warc.write(own, path, f"{path}/warc")
    got = warc.read(spark, f"{path}/warc").drop("url").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    for row in data:
        con.execute("INSERT INTO pages VALUES (?, ?, ?)", row)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(warc.SQL).fetchall()))


def test_rows_that_stay_are_neither_sorted_nor_shuffled(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, f"text {k % 7}" if k % 3 else f"own {k}", "en") for k in range(60)] + [(58, "text 2", "de"), (58, "text 2", "en")], "doc_id long, text string, lang string")
    for most in (100_000, 0):
        corpus_pipeline.BROADCAST, was = most, corpus_pipeline.BROADCAST
        try:
            out = corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path))
            rows = sorted(map(tuple, out.collect()))
        finally:
            corpus_pipeline.BROADCAST = was
        plan = corpus_pipeline.drop_exact_copies(spark, docs.where("lang = 'en' AND doc_id < 58"), str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Aggregate" not in plan
        want, data = {}, sorted(map(tuple, docs.collect()))
        for r in data:
            if r[0] == max(x[0] for x in data if x[1] == r[1]):
                want.setdefault(r[:2], r)
        assert rows == sorted(want.values())


def test_workers_get_small_batches_in_the_pipeline(spark, monkeypatch):
    import pyarrow as pa

    import corpus_pipeline

    def sizes(docs):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

        return docs.mapInArrow(run, "rows long, bytes long")

    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('some text ', 500) AS text", "'en' AS lang").coalesce(1)
    monkeypatch.setattr(corpus_pipeline.language, "accepted", sizes)
    try:
        found = corpus_pipeline.identify_language(spark, docs, "").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sum(r["rows"] for r in found) == 3000 and max(r["bytes"] for r in found) < 1.1 * corpus_pipeline.BATCH
