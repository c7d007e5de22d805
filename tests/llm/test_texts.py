import time
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strada.llm import html_text, language, toxicity
from tests.llm.conftest import rows

SYLLABLES = {"en": "the ing tion er on and re at".split(), "fr": "eau oi que eux é le ou ai".split(), "de": "sch ung ich ver ge ei ö ß".split()}


def prose(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled(spark):
    data = [(k, prose(lang := ("en", "fr", "de")[k % 3], k, 5 + k % 60), lang if k % 10 else None) for k in range(400)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3).cache()


def test_languages_of_held_out_documents(labelled):
    got = {r["doc_id"]: r for r in language.language_id(labelled).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(got) == 400
    assert {k for k, r in got.items() if r["held_out"]} == set(held)
    assert np.mean([got[k]["lang_pred"] == ("en", "fr", "de")[k % 3] for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_a_mixture_has_both_languages(spark, labelled):
    mixed = spark.createDataFrame([(1, prose("en", 1, 200) + " " + prose("de", 2, 100)), (2, "  12 !! 3"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.language_id(mixed, labelled).collect()}
    assert got[1]["langs"] == ["en", "de"] and got[1]["lang_pred"] == "en" and got[1]["score"] < 0.9
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["langs"] == [] for k in (2, 3, 4))


def test_language_of_messy_rows(docs, no_docs):
    got = language.language_id(docs).collect()
    ids = sorted(r[0] for r in rows() if r[0] is not None)
    assert sorted(r["doc_id"] for r in got) == ids
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {3, 4, 5, 14}
    assert language.language_id(no_docs).count() == 0
    assert language.accepted(no_docs).count() == 0
    kept = language.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in ids if i not in (3, 4, 5, 14)]
    assert kept.where("lang IS NULL").count() == 0


def test_nothing_learned_is_und(docs):
    got = language.language_id(docs, docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in got.collect()} == {"und"}


def test_em_raises_the_likelihood():
    r = np.random.RandomState(0)
    p, n = r.rand(50, 4) + 0.01, r.randint(1, 5, 50).astype(float)
    share, last = np.full(4, 0.25), -np.inf
    for _ in range(20):
        share, like = language._mixture(p, n, n.sum(), share, 1)
        assert like >= last - 1e-9 and abs(share.sum() - 1) < 1e-9
        last = like


@pytest.mark.parametrize(("text", "folded"), [("IDIOT", "idiot"), ("1d10t", "idiot"), ("іdіоt", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("ïdíöt", "idiot"), ("i​diot", "idiot"), ("LOSER l0$er", "ioser ioser"), ("", "")])
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_weights_boundaries_and_exceptions():
    a = toxicity.automaton({toxicity.fold("trash"): 2.0, toxicity.fold("clown"): 3.0})
    w = lambda t: toxicity.weigh(toxicity.fold(t), a)
    assert (w("such trash!"), w("trashy"), w("the trash can"), w("two Cl0wns"), w("clown trash"), w("retrash"), w("")) == (2.0, 0, 0, 3.0, 5.0, 0, 0)
    assert toxicity.weigh("x", toxicity.automaton({}, ())) == 0
    stems = toxicity.automaton({"grumb*": 2.0, "grumb": 1.0, "snari": 1.5})
    assert [toxicity.weigh(t, stems) for t in ("grumbiing", "a grumb x", "agrumb", "snaris snaried")] == [2.0, 2.0, 0, 1.5]


def test_toxicity_of_held_out_documents(spark, path):
    r, bad = random.Random(3), ["grumble", "snarl", "hiss"]
    data = []
    for k in range(900):
        w = prose("en", k, r.randint(3, 200)).split()
        if k % 5 == 0:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w) + 1), r.choice([*bad, "gr0mble".replace("0", "u"), "SNARL", "h1ss"]))
        data.append((k, " ".join(w)))
    docs = spark.createDataFrame([*data, (2000, ""), (2001, None), (None, "hiss")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(900)] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, text int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels, path).collect()}
    assert len(got) == 902
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k in got if got[k]["held_out"] and k < 900} == set(held)
    assert np.mean([got[k]["predicted"] == int(k % 5 == 0) for k in held]) > 0.97
    assert got[2000]["predicted"] == got[2001]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def naive_weight(text, lexicon, exceptions):
    """The same by looking at every place of the text for every word."""
    harmless = [(i, i + len(e)) for e in map(toxicity.fold, exceptions) for i in range(len(text)) if text.startswith(e, i)]
    harmless = [(i, k + text.startswith("s", k)) for i, k in harmless]
    harmless = [(i, k) for i, k in harmless if not (i and text[i - 1].isalnum()) and not (k < len(text) and text[k].isalnum())]
    total = 0.0
    for i in range(len(text)):
        best = 0.0
        for w, weight in lexicon.items():
            part = w.rstrip("*")
            k = i + len(part)
            if not text.startswith(part, i) or (i and text[i - 1].isalnum()) or (w != part + "*" and part + "*" in lexicon):
                continue
            if w == part:
                k += text.startswith("s", k)
                if k < len(text) and text[k].isalnum():
                    continue
            if not any(p <= i and k <= q for p, q in harmless):
                best = max(best, weight)
        total += best
    return total


def test_weights_are_what_a_naive_matcher_finds():
    r = random.Random(8)
    lexicon = {"ab": 1.0, "abba": 2.5, "abbac*": 1.5, "ba": 0.5, "caa": 3.0, "caa*": 2.0}
    exceptions = ("ba ab", "abba c", "caa")
    a = toxicity.automaton(lexicon, exceptions)
    for _ in range(3000):
        text = "".join(r.choice("aabbcs  5é") for _ in range(r.randrange(40)))
        assert toxicity.weigh(toxicity.fold(text), a) == pytest.approx(naive_weight(toxicity.fold(text), lexicon, exceptions)), text


def test_repeated_labels_and_labels_without_documents(spark, path):
    docs = spark.createDataFrame([(k, ("what a grumble " if k % 4 == 0 else "") + prose("en", k, 30)) for k in range(200)], "doc_id long, text string")
    labels = [(k, int(k % 4 == 0)) for k in range(200)]
    once = sorted(map(tuple, toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), path).collect()))
    again = spark.createDataFrame([*labels, *labels, *((k, 0) for k in range(0, 200, 4))], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.toxicity(docs, again, f"{path}/again").collect())) == once
    assert sum(p for *_, p in once) == 50
    quiet = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), f"{path}/quiet", exceptions=("a grumble",))
    assert {r["predicted"] for r in quiet.collect()} == {0}
    strangers = spark.createDataFrame([(k + 1000, k % 2) for k in range(50)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, strangers, f"{path}/none").collect()} == {0.0}


def test_toxicity_without_labels(docs, no_docs, spark, path):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none, path).collect()} == {0.0}
    assert toxicity.toxicity(no_docs, none, f"{path}/none").count() == 0


PAGES = [
    ("<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li></ul></nav><article><h1>A  title</h1><p>First &amp; <b>bold</b>\n text here, which goes on for a while.<p>Second paragraph is long enough too.</article><footer>&copy; 2024 Us. All rights reserved.</footer></body></html>", "A title\nFirst & bold text here, which goes on for a while.\nSecond paragraph is long enough too."),
    ("<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><div class='cookie-notice'>We use cookies. Accept them please.</div><main><p>The only paragraph of the page, with several words in it.</p></main><script>var p = '<p>no</p>';</script>", "The only paragraph of the page, with several words in it."),
    ("<body><div class=ad>Buy this thing now, it is very cheap today.</div><article><p>One sentence of text that is in the article.</p></article><section class='comments'><h3>Comments</h3><div class='comment'><p>I do not like it at all, sorry to say.</p></div></section><form><p>Your name here</p><input></form>", "One sentence of text that is in the article."),
    ("", ""), (None, ""), ("<html><body></body></html>", ""),
]


def test_main_text_of_pages(spark):
    df = spark.createDataFrame([(k, f"http://x/{k}", h, "c", 1) for k, (h, _) in enumerate(PAGES)] + [(None, "u", "<p>x</p>", "c", 1), (0, None, PAGES[0][0], "c", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(df).collect())
    assert got == sorted([(k, t, len(t)) for k, (_, t) in enumerate(PAGES)] + [(0, PAGES[0][1], len(PAGES[0][1]))])
    assert html_text.main_text(df.limit(0)).count() == 0


def test_the_field_on_pages_it_has_not_seen():
    f, right, total, whole = html_text.field(), 0, 0, 0
    unseen = html_text.labelled(150, 99)
    for feats, y in unseen:
        got = f.decode(feats)
        right += sum(a == b for a, b in zip(got, y, strict=True))
        total += len(y)
        whole += got == y
    assert right / total > 0.97
    assert whole / len(unseen) > 0.75


def test_viterbi_finds_the_best_sequence():
    import itertools

    f = html_text.Field({"a": np.array([0.3, 0.1]), "b": np.array([-0.2, 0.4]), "c": np.array([0.9, 0.2])}, np.array([[0.5, -0.7], [-0.4, 0.6]]))
    feats = [["a"], ["b"], ["c"], ["a", "b"], ["b"], ["c", "c"]]
    e = f.emissions(feats)
    score = lambda y: sum(e[k, v] for k, v in enumerate(y)) + sum(f.turn[a, b] for a, b in itertools.pairwise(y))
    assert f.decode(feats) == list(max(itertools.product((0, 1), repeat=len(feats)), key=score))
    ge, gt = html_text._gradient(e, f.turn, np.array([0, 1, 0, 1, 1, 0]))
    assert np.allclose(ge.sum(axis=1), 0) and abs(gt.sum()) < 1e-9


@pytest.mark.parametrize("page", ["<", "<p", "a < b and c > d", "<p>x</b></i></p>", "<div><div><p>deep", "&#x41;&bogus;&am", "<b><p>in</b> out", "<!-- never closed <p>x", "<script>never closed", "<a href='never closed>x</a><p>y", "<p>" * 3000 + "x"])
def test_broken_pages_are_read(page):
    assert isinstance(html_text.extract(page, html_text.field()), str)


def test_likelihoods_know_every_letter_of_the_model(spark):
    r = random.Random(7)
    scripts = {"en": [chr(k) for k in range(0x61, 0x7B)], "el": [chr(k) for k in range(0x3B1, 0x3CA)], "zh": [chr(k) for k in range(0x4E00, 0x4E00 + 900)], "ko": [chr(k) for k in range(0xAC00, 0xAC00 + 700)]}
    write = lambda lang, n: " ".join("".join(r.choice(scripts[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    data = [(k, write(lang := ("en", "el", "zh", "ko")[k % 4], 1500 if lang in ("zh", "ko") else 20), lang) for k in range(48)]
    model = language.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    held, langs = language.Likelihoods(model), model["langs"]
    assert language.predict(held, langs, [write(lang, 8) for lang in langs])[0] == langs

    p, floors = {g: np.array(x) for g, x in model["p"].items()}, [np.array(f) for f in model["floors"]]

    def log(g):  # of the longest n-gram kept at the end of g
        g = next((g[k:] for k in range(len(g)) if g[k:] in p), "")
        return np.log(sum(w * (p.get(g[-m:], floors[m - 1]) if m <= len(g) else floors[m - 1]) for m, w in enumerate(language.WEIGHTS, 1)))

    some = [w for _, text, _ in data for w in text.split()[:5]] + ["a" + scripts["zh"][5] + "b", "ж", "aж" + scripts["ko"][0]]
    for word, row in zip(some, held.of(some)[0], strict=True):
        want = sum(log(f"^{word}$"[k : k + 3]) for k in range(len(word)))
        assert np.allclose(np.log(row), np.maximum(want - want.max(), -language.WORD_LIMIT), atol=1e-3)


ARTICLE = "<article><h1>A title</h1><p>One sentence of text that is in the article.</p></article>"
FOUND = ["A title", "One sentence of text that is in the article."]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (f"<html><head><title>T</title>{ARTICLE}", FOUND),
        (f"<head><meta charset=utf-8><style>p{{}}</style><script>'</head>'</script><title>T</title></head>{ARTICLE}", FOUND),
        *[(f"<body><{t} class=x>gone<b>gone</b>{ARTICLE}</body>", [*FOUND] if t not in ("svg", "math") else ["gone", *FOUND]) for t in "noscript template svg math object canvas audio video select".split()],
        (f"<body><noscript>gone{ARTICLE}<noscript><p>gone</p></noscript>", FOUND),
        (f"<head><noscript><link rel=x><body>{ARTICLE}", FOUND),
        (f"<div><span>kept <select><option>gone<option>gone<span>gone</span>gone</span> too</div>{ARTICLE}", ["kept too", *FOUND]),
        ("<p>before <svg><svg><text>gone</text></svg><text>gone</text></svg> after", ["before after"]),
        ("<p>before <noscript><p>gone</p></noscript> after<video><p>gone</p></video>", ["before after"]),
        ("<p>before<script>gone<p>gone", ["before"]),
    ],
)
def test_a_dropped_element_without_end_tag_leaves_the_rest(page, texts):
    assert [b.text for b in html_text.blocks_of(page)] == texts


def test_many_unclosed_elements_are_read_in_linear_time():
    assert [b.text for b in html_text.blocks_of("<svg><object><noscript>" * 20_000 + "<p>x")] == ["x"]


def test_shares_come_from_a_likelihood_near_its_greatest():
    r = np.random.RandomState(1)
    p, n = r.rand(400, 3) * 0.1 + 0.7, r.randint(1, 20, 400).astype(float)
    p[:150, 0] += 0.3
    p[150:, 1] += 0.3
    chosen, share, _ = language.infer(p, n, penalty=0.0)
    rise = ((n / (p[:, chosen] @ share)) @ p[:, chosen]) / n.sum()
    assert len(chosen) > 1 and n.sum() * np.log(rise.max()) <= 0.01


def test_words_are_parted_at_white_space_of_any_kind(labelled):
    model = language.train(labelled.where("lang IS NOT NULL"))
    held, langs = language.Likelihoods(model), model["langs"]
    text = prose("en", 1, 200) + " " + prose("de", 2, 100)
    names, scores, sets = language.predict(held, langs, [s.join(text.split()) for s in (" ", "\t", " ", " ", "\r\n", "\x0b\x85")])
    assert set(names) == {"en"} and len(set(scores)) == 1 and all(s == ["en", "de"] for s in sets)


def test_all_languages_are_learned(spark):
    data = [(k, chr(0x4E00 + k) * 3, f"l{k:04}") for k in range(600)]
    model = language.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model["langs"] == [lang for _, _, lang in data]


def test_a_model_is_as_large_as_stated_at_most(labelled, monkeypatch):
    monkeypatch.setattr(language, "NUMBERS", 300)
    model = language.train(labelled)
    assert model["langs"] and 0 < len(model["p"]) * len(model["langs"]) <= 300


def test_without_a_model_every_document_with_a_letter_is_accepted(docs):
    kept = language.accepted(docs.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == docs.columns and kept.where("lang IS NOT NULL").count() == 0
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows() if r[0] not in (None, 3, 4, 5, 14))


@pytest.mark.parametrize("piece", ["<div>x", "<svg/>x", "<b>x", "</i>x", "<p class=menu>x", "<a>x</a><li>"])
def test_deep_and_long_pages_take_time_in_proportion(piece):
    began = time.process_time()
    html_text.features_of(html_text.blocks_of(piece * 100_000))
    assert time.process_time() - began < 60
