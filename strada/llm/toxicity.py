"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding maps letters that look alike to one letter (accents, full-width forms, Greek and Cyrillic look-alikes), digits and
signs that stand for letters to those letters, and drops invisible characters; l, 1 and | fold to i, so that a digit that
stands for two letters is found either way. A match must stand between non-letters (a plural s may follow). A match inside
an exception phrase doesn't count; the phrases are an input, EXCEPTIONS unless others are given. The text's weight is the
sum of the matched words' weights; a ridge logistic function of it and of the weight per 100 words (the length norm; words
are parted by white space of any kind) is the score.

The lexicon is learned. Of the labelled rows that aren't held out, a bounded sample (POSITIVE and NEGATIVE rows on average,
by a hash of doc_id) is folded; words in at least LEAST toxic rows with a log odds of at least ODDS are candidates, and so
are stems, the first STEM letters of longer words, which match whatever ends the word. Those that only go along with others
are left out by greedy cover: the word or stem that explains the most toxic rows is taken, those rows are set aside, and so
on while one explains GAIN rows more. A weight is a log odds.

Cases. Null text is empty; an empty text has no weight and scores as any text without a match. With no labelled row of
one kind, or none that a document goes with, nothing is learned and the score is 0. Labels repeated for a doc_id count once, toxic if any is. Rows with a
null doc_id are left out; rows that repeat a doc_id are scored each. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.llm.common import crc_mod, materialize, prepared, table, work_dir

POSITIVE, NEGATIVE, LEAST, GAIN, ODDS, STEM = 4000, 12_000, 4, 2, 2.5, 5
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clownfish", "idiot proof", "idiot-proof", "sore loser rule", "pond scum", "soap scum")

_LOOKS = {
    "a": "аαａ@4", "b": "вβЬ8", "c": "сϲ", "d": "ԁ", "e": "еεєё3", "f": "ƒ", "g": "ɡ9", "h": "һн", "i": "іιї1l|ӏӀ", "j": "јϳ", "k": "кκ", "m": "мμ",
    "n": "пηո", "o": "оοσ0օ", "p": "рρ", "q": "ԛ", "r": "гɾ", "s": "ѕ5$ʂ", "t": "тτ7", "u": "υսц", "v": "νѵ", "w": "ԝωш", "x": "хχ", "y": "уүγ", "z": "ᴢ2",
}


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for lo, hi in ((0xAA, 0x250), (0x1D00, 0x1F00), (0x2100, 0x2150), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for c in range(lo, hi):
            base = [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]
            if base and all(x.isascii() for x in base):
                out[c] = "".join(base).lower()
    out |= {c: chr(c + 32) for c in range(65, 91)}
    for letter, others in _LOOKS.items():
        for o in others:
            out[ord(o)] = letter
            if o.upper() != o and len(o.upper()) == 1 and o != "l":
                out[ord(o.upper())] = letter
    out |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)} | {c: None for c in range(0x300, 0x370)}
    out[ord("L")] = "i"
    return {c: "".join("i" if x == "l" else x for x in v) if v else v for c, v in out.items()}


_FOLD = _table()
_FOLD_ASCII = bytes(ord(_FOLD.get(c, chr(c)) or chr(c)) if c < 128 else c for c in range(256))


def fold(text: str) -> str:
    if text.isascii():
        return text.encode().translate(_FOLD_ASCII).decode()
    return text.translate(_FOLD)


def folded_words(text: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in fold(text)).split()


def units_of(text: str) -> list[str]:
    """The distinct words of a text, and the stems of the longer ones, marked with a star."""
    words = set(folded_words(text))
    return sorted(words | {f"{w[:STEM]}*" for w in words if len(w) > STEM})


def automaton(lexicon: dict[str, float], exceptions=EXCEPTIONS):
    import ahocorasick

    a = ahocorasick.Automaton()
    held: dict[str, list] = {}  # a phrase may be a word of the lexicon
    for w, weight in lexicon.items():
        if w[-1] == "*":
            held.setdefault(w[:-1], []).append((len(w) - 1, weight, True))
        elif f"{w}*" not in lexicon:
            held.setdefault(w, []).append((len(w), weight, False))
    for f in sorted({fold(phrase) for phrase in exceptions} - {""}):
        held.setdefault(f, []).append((len(f), None, False))
    for w, kinds in held.items():
        a.add_word(w, kinds)
    if len(a):
        a.make_automaton()
    return a


def weigh(text: str, a) -> float:
    """The summed weights of the words matched in a folded text, without those inside an exception phrase."""
    if not len(a):
        return 0.0
    spans, free = [], []
    for end, kinds in a.iter(text):
        for n, weight, stem in kinds:
            lo, hi = end - n + 1, end + 1
            if not stem and hi < len(text) and text[hi] == "s":
                hi += 1
            if (lo and text[lo - 1].isalnum()) or (not stem and hi < len(text) and text[hi].isalnum()):
                continue
            (spans if weight is None else free).append((lo, hi, weight))
    at: dict[int, float] = {}
    for lo, hi, w in free:  # a word counts once, by its stem or whole
        if not any(p <= lo and hi <= q for p, q, _ in spans):
            at[lo] = max(w, at.get(lo, 0.0))
    return sum(at.values())


def features(text: str, a) -> tuple[float, float]:
    """(weight, weight per 100 words), each as log(1 + x)."""
    w = weigh(fold(text), a)
    if not w:
        return 0.0, 0.0
    return math.log1p(w), math.log1p(100.0 * w / max(1, len(text.split())))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """n: how many rows have these x and y."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ b)
    return b


def learn(docs: DataFrame, labels: DataFrame, path: str, exceptions=EXCEPTIONS) -> dict:
    """docs: (doc_id, text), labels: (doc_id, toxic); {"lexicon": word -> weight, "exceptions": phrases, "b": three coefficients or None}"""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return {"lexicon": {}, "exceptions": exceptions, "b": None}
    u = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) / float(1 << 20)
    rows = marked.where(u < F.when(F.col("toxic") == 1, min(1.0, POSITIVE / counts[1])).otherwise(min(1.0, NEGATIVE / counts[0])))

    def words(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([units_of(t) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    # the sampled ids are broadcast: POSITIVE + NEGATIVE short rows on average, so that no text is shuffled
    sample = materialize(docs.join(F.broadcast(rows), "doc_id").select("doc_id", "toxic", "text"), f"{path}/labelled")
    held = materialize(sample.mapInArrow(words, "doc_id long, toxic int, words array<string>"), f"{path}/words")
    n = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {"lexicon": {}, "exceptions": exceptions, "b": None}
    each = held.select("doc_id", "toxic", F.explode("words").alias("w")).where(F.length("w") > 2)
    odds = F.log((F.col("p") + 0.5) / (n1 + 1.0)) - F.log((F.col("q") + 0.5) / (n0 + 1.0))
    found = each.groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).where(F.col("p") >= LEAST).withColumn("o", odds).where(F.col("o") >= ODDS).select("w", "o")
    weights, in_rows = {}, {}
    for r in each.where("toxic = 1").join(found, "w").groupBy("w", "o").agg(F.collect_set("doc_id").alias("ids")).collect():  # ids of POSITIVE rows
        weights[r["w"]], in_rows[r["w"]] = r["o"], set(r["ids"])
    lexicon: dict[str, float] = {}
    of_row: dict[int, list[str]] = {}
    for w, ids in in_rows.items():
        for i in ids:
            of_row.setdefault(i, []).append(w)
    # the gains only fall, so a word whose gain is still what the heap says is the best
    heap = [(-len(ids), w[-1] == "*", w) for w, ids in in_rows.items()]
    heapq.heapify(heap)
    while heap:
        gain, star, w = heapq.heappop(heap)
        if -gain != len(in_rows[w]):
            heapq.heappush(heap, (-len(in_rows[w]), star, w))
            continue
        if -gain < GAIN:
            break
        lexicon[w] = weights[w]
        for i in list(in_rows[w]):
            for other in of_row[i]:
                in_rows[other].discard(i)

    def measured(batches):
        a = automaton(lexicon, exceptions)
        for b in batches:
            x = [features(t, a) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64())], ["toxic", "x", "y"])

    got = sample.select("toxic", "text").mapInArrow(measured, "toxic int, x double, y double").groupBy("toxic", "x", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # of POSITIVE + NEGATIVE rows
    values = np.array(sorted(tuple(r) for r in got), dtype=np.float64)
    b = _logistic(values[:, 1:3], values[:, 0], values[:, 3])
    return {"lexicon": lexicon, "exceptions": exceptions, "b": b.tolist()}


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score)."""
    own = prepared(docs, key, text).select(F.col(key).alias("doc_id"), "text")
    lexicon, exceptions, c = model["lexicon"], model["exceptions"], model["b"]

    def run(batches):
        a = automaton(lexicon, exceptions)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                x, y = features(t, a)
                out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, c[0] + c[1] * x + c[2] * y)))) if c else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return own.mapInArrow(run, "doc_id long, score double")


def held_out():
    return crc_mod(F.col("doc_id"), 4) == 2


def toxicity(docs: DataFrame, labels: DataFrame, path: str, threshold: float = 0.3, exceptions=EXCEPTIONS) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns from the labels of rows that aren't held out."""
    own = prepared(docs, "doc_id", "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out())
    model = learn(own, known, path, exceptions)
    return score(own, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), work_dir(spark))
