import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strada.llm import packing, token_files
from strada.llm.tokens import Encoder, resolve
from tests.llm.conftest import rows

NAMES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
ENCODERS = {name: (Encoder(resolve(name), spaced), Tokenizer.from_file(resolve(name))) for name, spaced in NAMES}
HARD = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "\na", "a\n", "a\tb c", "a\t b", "don't we'll I'M", "a<|endoftext|>b", "x <|endoftext|> y", "naïve café", "é àb", "ß x y z", "日本 語", "😀 😀a", "a\x1cb \x1c c", "1234 5.6", "Σας ΣΑΣ", "a ́b", "​ x", "a.b,c. d ,e ..f", "é. É, x.\ny", "a\x01. b", "a.\n\nb", "Ab.Cd", "1.5, 2,5.", "a.'s", "a.. b,,c", "x. ."]


@pytest.mark.parametrize("name", ENCODERS)
def test_pieces_give_the_ids_of_the_whole(name):
    encoder, tokenizer = ENCODERS[name]
    for t, ids in zip(HARD, encoder.encode(HARD), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_are_forgotten_and_learned_again(monkeypatch):
    from strada.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 7)
    monkeypatch.setattr(tokens, "TOGETHER", 20)
    texts = [" ".join(f"w{(k * j) % 13}" for j in range(9)) for k in range(40)]
    for name, spaced in NAMES:
        got = Encoder(resolve(name), spaced).encode(texts)
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [ENCODERS[name][1].encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' \n\t.,1é́ 'sSΣ😀<|>")), max_size=30))
def test_pieces_give_the_ids_of_any_text(text):
    for encoder, tokenizer in ENCODERS.values():
        assert np.frombuffer(encoder.encode([text])[0], dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=60), st.data())
def test_packed_ids_come_back(bits, ids, data):
    ids = [i & ((1 << bits) - 1) for i in ids]
    raw = token_files.pack(np.array(ids, dtype="<u4"), bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    first = data.draw(st.integers(0, len(ids) - 1))
    assert token_files.unpack(raw, len(ids) - first, bits, first).tolist() == ids[first:]


@pytest.mark.parametrize("bits", [7, 16, 17])
def test_a_file_gives_any_range(bits):
    r = np.random.RandomState(1)
    docs = [(k, r.randint(0, 1 << bits, n).astype("<u4")) for k, n in ((5, 1), (7, 70_000), (8, 0), (9, 40_000))]
    f = io.BytesIO()
    w = token_files.Writer(f, bits)
    for k, ids in docs:
        w.add(k, ids.tobytes())
    w.close()
    reader = token_files.Reader(f)
    every = np.concatenate([ids for _, ids in docs])
    assert [(k, first, raw) for k, first, raw in reader.documents()] == [(k, sum(len(x) for _, x in docs[:n]), ids.tobytes()) for n, (k, ids) in enumerate(docs)]
    for first, count in ((0, 5), (32_760, 20), (69_999, 40_002), (110_000, 1), (3, 0)):
        assert (reader.ids(first, count) == every[first : first + count]).all()


def expected(name, end):
    tokenizer = ENCODERS[name][1]
    data = sorted(((r[0], r[1] or "") for r in rows() if r[0] is not None))
    return [(i, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, end], dtype="<u4")) for i, t in data]


def test_files_hold_every_document(spark, docs, path):
    token_files.write(docs, path, resolve("word_bpe_49k.json"), 49_408, 2)
    got = [tuple(r) for r in token_files.read(spark, path).withColumn("c", F.crc32("ids")).select("doc_id", "start", "n_tokens", "c").orderBy("start").collect()]
    want, start = [], 0
    for i, ids in expected("word_bpe_49k.json", 2):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_files_of_nothing(spark, no_docs, path):
    assert token_files.write(no_docs, path, resolve("word_bpe_49k.json"), 49_408, 2) == []
    assert token_files.read(spark, path).count() == 0


@pytest.mark.parametrize("length", [16, 2048])
def test_pieces_fill_the_sequences(docs, path, length):
    got = packing.pack(docs, path, resolve("byte_bpe_50k.json"), length=length).collect()
    want = expected("byte_bpe_50k.json", 1)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by) == list(range(len(by)))
    for k, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or k == len(by) - 1
    total = sum(len(ids) for _, ids in want)
    assert len(by) == -(-total // length)
    last = total % length
    assert {r["padded_to"] for r in by[len(by) - 1]} == {last if last and last & (last - 1) == 0 else length}
    ids = {}
    for i, x in want:
        ids.setdefault(i, []).append(x)
    covered = {}
    for r in got:
        x = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(x)
        assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == {i: sum(map(len, x)) for i, x in ids.items()}


def test_packing_nothing(no_docs, path):
    assert packing.pack(no_docs, path, resolve("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name", ENCODERS)
def test_special_tokens_in_other_cases_are_plain_text(name):
    encoder, tokenizer = ENCODERS[name]
    texts = ["a <|ENDOFTEXT|> b", "a <|EndOfText|> b", "<|ENDOFTEXT|>", "a <|endoftext|> b <|ENDOFTEXT|> c"]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_an_encoder_remembers_the_pieces_of_many_texts():
    from strada.llm import tokens

    e = tokens.Encoder(tokens.resolve("byte_bpe_50k.json"), True)
    e.encode([" ".join(f"w{k}" for k in range(at, at + 1000)) for at in range(0, 200_000, 1000)])
    assert len(e.new) >= 199_000 and not e.old  # once the first ones were dropped, and encoded again with the next texts


def test_batches_are_cut_by_their_bytes():
    from strada.llm.common import slices

    def cut(*lengths):
        b = pa.RecordBatch.from_arrays([pa.array(range(len(lengths))), pa.array([None if n is None else "é" * (n // 2) for n in lengths], pa.string())], ["a", "text"])
        return [s.column("a").to_pylist() for s in slices([b.slice(0, 0), b], 1, 10)]

    assert cut() == [] and cut(0, 0) == [[0, 1]] and cut(30) == [[0]]
    assert cut(6, 4, 6, 30, 2, 0) == [[0, 1], [2], [3], [4, 5]] and cut(None, 4, None) == [[0, 1, 2]] and cut(0, 0, 30, 0, 0) == [[0, 1], [2], [3, 4]]


@pytest.mark.parametrize("name,spaced", NAMES)
def test_remembered_pieces_take_few_bytes(name, spaced):
    import gc
    import tracemalloc

    e, texts = Encoder(resolve(name), spaced), [" ".join(f"w{k}" for k in range(at, at + 1000)) for at in range(0, 100_000, 1000)]
    tracemalloc.start()
    try:
        before = pa.total_allocated_bytes()
        e.encode(texts)
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert len(e.new) >= 99_000 and held < 60 * len(e.new)  # a dict of strings and bytes: 140 each and more


def test_other_tasks_drop_a_workers_encoder():
    from strada.llm import tokens
    from strada.llm.common import tidied

    path = resolve("byte_bpe_50k.json")
    held = tokens.encoder(path, True)
    assert list(tidied(iter, encodes=True)([1])) == [1] and tokens.encoder(path, True) is held
    assert list(tidied(iter)([1])) == [1] and not tokens._encoders
    assert tokens.encoder(path, True).encode(["a b"]) == held.encode(["a b"])
    tokens.forget()
