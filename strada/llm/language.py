"""Language identification as inference of a multilingual mixture.

A model holds, for each language of the training rows, the log probabilities of letter n-grams (n = 1 to 3, a word led and
ended by a mark), interpolated over n. A word's likelihood in a language is the product over its n-grams. A document is a
mixture: expectation-maximisation over its words (parted by white space of any kind) estimates the share of each language, on
the whole text, until the log likelihood is within TOLERANCE of its greatest. The set of
languages is chosen by penalised likelihood: from all languages down, the one of the least share goes as long as the
likelihood falls by less than the penalty, PENALTY * log(words) for each language. The prediction is the language of the
largest share in that set, the score its share times the posterior weight of the set against the best other language.

Training counts n-grams over a bounded sample: for each language, rows are taken in the order of a hash of their doc_id by
a threshold that leaves PER_LANGUAGE rows on average. The most frequent n-grams of a language are kept, NGRAMS / 2 of each length at most, or
fewer where there are so many languages that the model would hold more than NUMBERS numbers. All languages of the training
rows are told apart.

Cases. A text that is null or has no letter is `und` with score 0 and an empty set. With no training rows every text is
`und`. Rows with a null doc_id are left out; rows that repeat a doc_id are predicted each. Ties go to the first language
in order of name. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strada.llm.common import crc_mod, prepared, ship, slices, table, tidied, work_dir

PER_LANGUAGE, NGRAMS, PENALTY, TOLERANCE = 1500, 40_000, 2.0, 0.01
#: Numbers in a model at most, one for each n-gram and language: 64 MB to broadcast.
NUMBERS = 1 << 24
#: Letters whose n-grams have a dense table (those of others are searched), and characters (of Arrow batches: bytes) of the texts that are taken together.
LETTERS, TOGETHER = 200, 2_000_000
#: Of the letter, the bigram and the trigram in a letter's probability.
WEIGHTS = (0.1, 0.3, 0.6)
#: The largest difference of log likelihood between languages that a single word counts for.
WORD_LIMIT = 12.0


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def ngrams_of(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def train(rows: DataFrame, per_language: int = PER_LANGUAGE, keep: int = NGRAMS) -> dict:
    """rows: (doc_id, text, lang). {"langs": [...], "p": {n-gram: [probability by language]}, "floors": by n, of those that were not kept}"""
    ship(rows.sparkSession)
    known = rows.where("lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    keep = min(keep, NUMBERS // (3 * len(langs) ** 2) * 2) if langs else keep
    if not langs:
        return {"langs": [], "p": {}, "floors": []}
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    taken = known.where(u < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches):
        for b in batches:
            got: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                into = got.setdefault(lang, Counter())
                for w, n in Counter(words_of(text)).items():
                    for g in ngrams_of(w):
                        into[g] += n
            rows = [(lang, g, n) for lang, c in got.items() for g, n in c.items()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "gram": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

    grams = taken.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = grams.withColumn("r", F.row_number().over(W.partitionBy("lang", F.length("gram")).orderBy(F.desc("n"), "gram"))).where(F.col("r") <= keep // 2).select("lang", "gram", "n")
    place = {k: i for i, k in enumerate(langs)}
    tables: list[dict[str, np.ndarray]] = [{}, {}, {}]
    for r in top.collect():  # at most 1.5 * NGRAMS short rows a language
        tables[len(r["gram"]) - 1].setdefault(r["gram"], np.zeros(len(langs)))[place[r["lang"]]] = r["n"]
    logp: dict[str, np.ndarray] = {}
    floors = []
    for t in tables:
        total = sum(t.values()) if t else np.zeros(len(langs))
        v = len(t) + 1
        floors.append(1.0 / (total + 0.5 * v) * 0.5)
        for g, c in t.items():
            logp[g] = (c + 0.5) / (total + 0.5 * v)
    return {"langs": langs, "p": {g: x.tolist() for g, x in logp.items()}, "floors": [f.tolist() for f in floors]}


class Likelihoods:
    """The likelihoods of words in each language, computed for the distinct words of some texts at once.

    Letters become numbers, 0 standing for whatever is no letter and for a word's ends, the last for letters that no n-gram
    has. A letter has the probability of the n-gram that ends in it: the trigram's, or where that wasn't kept, its last
    bigram's or letter's. Of the LETTERS most frequent letters a table over three numbers says which n-gram that is; of
    three that hold another letter, a search among the n-grams' sorted codes.
    """

    def __init__(self, model: dict):
        p = {g: np.array(x) for g, x in model["p"].items()}
        floors = [np.array(f) for f in model["floors"]]
        often = sorted({c for g in p for c in g if c.isalpha()}, key=lambda c: (-p[c].max() if c in p else 0.0, c))
        self.number = {c: k + 1 for k, c in enumerate(often)}
        self.size, self.near = len(often) + 2, min(len(often), LETTERS) + 1
        logs = [np.log(sum(w * f for w, f in zip(WEIGHTS, floors, strict=True)))]
        self.sorted = []
        for n in (1, 2, 3):
            codes = {}
            for g in (g for g in p if len(g) == n):
                if "^" not in g[1:] and "$" not in g[:-1]:
                    codes[self._code([self.number.get(c, 0) for c in g])] = len(logs)
                    logs.append(np.log(sum(w * (p.get(g[-m:], floors[m - 1]) if m <= n else floors[m - 1]) for m, w in enumerate(WEIGHTS, 1))))
            keys = np.array(list(codes), dtype=np.int64)
            order = np.argsort(keys)
            self.sorted.append((keys[order], np.array(list(codes.values()), dtype=np.int32)[order]))
        self.logs = np.array(logs, dtype=np.float32)
        self._fill()

    def _fill(self) -> None:
        place = np.zeros((self.near,) * 3, dtype=np.int32)
        for n, (keys, places) in enumerate(self.sorted, 1):  # the longer ones take the place of the shorter
            at = [keys // self.size**k % self.size for k in range(n - 1, -1, -1)]
            use = np.max(at, axis=0) < self.near if len(keys) else np.zeros(0, dtype=bool)
            place[(..., *(x[use] for x in at))] = places[use]
        self.place = place.ravel()

    def __getstate__(self):
        """What is broadcast: the n-grams' codes and logarithms, without the table."""
        return {k: v for k, v in self.__dict__.items() if k != "place"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fill()

    def _code(self, at):
        """One number for up to three; below 2^63, as there are fewer than 2^21 characters."""
        code = 0
        for x in at:
            code = code * self.size + x
        return code

    def _places(self, letters: np.ndarray) -> np.ndarray:
        """For each three letters in a row, the place in logs of the longest n-gram kept that ends them."""
        three = letters[:-2], letters[1:-1], letters[2:]
        far = np.maximum(np.maximum(three[0], three[1]), three[2]) >= self.near
        if not far.any():
            return self.place[(three[0] * self.near + three[1]) * self.near + three[2]]
        a, b, c = (x[~far] for x in three)
        out = np.zeros(len(far), dtype=np.int32)
        out[~far] = self.place[(a * self.near + b) * self.near + c]
        three = [x[far] for x in three]
        found = np.zeros(len(three[0]), dtype=np.int32)
        for n, (keys, places) in enumerate(self.sorted, 1):
            if len(keys):
                code = self._code(three[3 - n :])
                k = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                found = np.where(keys[k] == code, places[k], found)
        out[far] = found
        return out

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(likelihoods, whether the word has a letter); a word may hold other characters, which part it."""
        rows, known, at = np.ones((len(words), self.logs.shape[1])), np.zeros(len(words), dtype=bool), 0
        while at < len(words):
            size, begin = 0, at
            while at < len(words) and size < 500_000:
                size += len(words[at]) + 1
                at += 1
            text = " " + " ".join(words[begin:at]) + "  "
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            kinds, which = np.unique(points, return_inverse=True)
            letters = np.array([(self.number.get(c, self.size - 1) if (c := chr(k)).isalpha() else 0) for k in kinds.tolist()], dtype=np.int64)[which]
            starts = np.cumsum([0, *(len(w) + 1 for w in words[begin : at - 1])])  # where each word's space stands
            got = self.logs[self._places(letters)]
            got[letters[1:-1] == 0] = 0  # no word is led on from the one before
            total = np.add.reduceat(got, starts, axis=0)
            rows[begin:at] = np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -WORD_LIMIT))
            known[begin:at] = np.add.reduceat((letters[1:] > 0).astype(np.int64), starts) > 0
        return rows, known


def _mixture(p: np.ndarray, n: np.ndarray, total: float, share: np.ndarray, rounds: float = math.inf) -> tuple[np.ndarray, float]:
    """Expectation-maximisation until the log likelihood is within TOLERANCE of its greatest, or for some rounds."""
    k = 0
    while k < rounds:
        rise = ((n / (p @ share)) @ p) / total
        if rounds == math.inf and total * math.log(max(1.0, rise.max())) <= TOLERANCE:  # no shares gain more, as the likelihood is concave
            break
        share = np.maximum(share * rise, 1e-100)
        k += 1
    return share, float(n @ np.log(p @ share))


def infer(p: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray, float]:
    """p: likelihood of each distinct word by language; n: how often it occurs. (languages chosen, their shares, the penalised advantage over the best single other)."""
    total, langs = float(n.sum()), list(range(p.shape[1]))
    cost = penalty * math.log(total + 1)
    share, like = _mixture(p, n, total, np.full(len(langs), 1.0 / len(langs)))
    while len(langs) > 1:
        least = int(np.argmin(share[::-1]))
        least = len(langs) - 1 - least
        fewer = langs[:least] + langs[least + 1 :]
        start = np.delete(share, least) + 1e-9
        new_share, new_like = _mixture(p[:, fewer], n, total, start / start.sum())
        if like - new_like > cost:
            break
        langs, share, like = fewer, new_share, new_like
    rest = [k for k in range(p.shape[1]) if k not in langs]
    single = n @ np.log(p[:, rest]) if rest else np.array([-np.inf])
    return langs, share, like - float(single.max())


def predict(held: Likelihoods, langs: list[str], texts: list) -> tuple[list[str], list[float], list[list[str]]]:
    """For each text the prediction, its score and the chosen set, the largest share first."""
    names: list[str] = []
    scores: list[float] = []
    sets: list[list[str]] = []
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and size < TOGETHER:
            some.append(" ".join((texts[at] or "").lower().split()))
            size += len(some[-1])
            at += 1
        lists = pc.split_pattern(pa.array(some, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        rows, known = held.of(coded.dictionary.to_pylist())
        index, edges = coded.indices.to_numpy(), np.asarray(lists.offsets)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            seen, n = np.unique(index[lo:hi], return_counts=True)
            own = known[seen]
            if not own.any():
                names.append("und")
                scores.append(0.0)
                sets.append([])
                continue
            chosen, share, ahead = infer(rows[seen[own]], n[own].astype(np.float64))
            best = int(np.argmax(share))
            names.append(langs[chosen[best]])
            scores.append(float(min(1.0, share[best] / share.sum()) / (1.0 + math.exp(-min(50.0, max(-50.0, ahead))))))
            sets.append([langs[chosen[k]] for k in np.argsort(-share, kind="stable")])
    return names, scores, sets


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, langs): langs holds the chosen set, the largest share first."""
    spark, langs = docs.sparkSession, model["langs"]
    own = prepared(docs, key, text).select(F.col(key).alias("doc_id"), "text")
    schema = "doc_id long, lang_pred string, score double, langs array<string>"
    if not langs:
        return own.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("langs"))
    sent = spark.sparkContext.broadcast(Likelihoods(model))  # at most NUMBERS numbers

    def run(batches):
        held = sent.value
        for b in slices(batches, 1, TOGETHER):
            names, scores, sets = predict(held, langs, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "langs"])

    return own.mapInArrow(tidied(run), schema)


def held_out():
    return crc_mod(F.col("doc_id"), 3) == 1


def _learnable(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where("doc_id IS NOT NULL").where(~held_out())


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang and others) that have a letter, whole and unshuffled; a null lang becomes the prediction, if there are training rows."""
    spark, model = docs.sparkSession, train(_learnable(docs))
    langs, names, schema = model["langs"], docs.columns, docs.schema
    if not langs:

        def lettered(batches):
            for b in batches:
                yield b.filter(pa.array([any(map(str.isalpha, (t or "").lower())) for t in b.column(names.index("text")).to_pylist()], pa.bool_()))

        return docs.where("doc_id IS NOT NULL").mapInArrow(lettered, schema)
    sent = spark.sparkContext.broadcast(Likelihoods(model))

    def run(batches):
        held = sent.value
        for b in slices(batches, names.index("text"), TOGETHER):
            found, _, _ = predict(held, langs, b.column(names.index("text")).to_pylist())
            columns = list(b.columns)
            k = names.index("lang")
            columns[k] = pa.array([f if x is None else x for x, f in zip(columns[k].to_pylist(), found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([f != "und" for f in found], pa.bool_()))

    return docs.where("doc_id IS NOT NULL").mapInArrow(tidied(run), schema)


def language_id(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs) for docs (doc_id, text); the model learns from the rows of learn_from that aren't held out."""
    model = train(_learnable(docs if learn_from is None else learn_from))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    work_dir(spark)
    return language_id(table(spark, sf_dir, "documents"))
