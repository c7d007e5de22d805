"""Near dedup by a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A document's set holds its distinct 5-word shingles (64-bit hashes of them). Its signature has SYMBOLS b-bit symbols, each
from one minhash. The signature is split into CHUNKS chunks; by the pigeonhole principle two signatures that differ in at
most DISTANCE = CHUNKS * (ERRORS + 1) - 1 symbols have a chunk that differs in at most ERRORS symbols, so enumerating the
chunk with each ERRORS symbols left out gives them an equal key: every pair within the distance meets. Most pairs farther
apart meet too; those that do are kept up to KEPT symbols. Two sets with a similarity of 0.75 differ in 24 of the 96 symbols
on average, with a deviation of 4.2; they don't meet, or differ in more than KEPT, in about 1 of 100,000 cases, and sets
with a similarity of 0.8 in 1 of 20 million. Five symbols to a key keep unlike texts that share a passage apart.

1. Documents with equal sets form a class with an id of its own: copies are gone before any pairing.
2. Each task sorts the keys of its classes. Classes of one task that share a key are told off at once against the smallest
   of them; one row a key goes on, so that a hot key is one row a task before the shuffle. Keys travel packed, those of a
   range of keys together, once; where they meet, the smallest members of the tasks are told off against the smallest of all.
   Buckets of two that hold nothing else give a pair each, larger ones a star: one row a member.
3. Pairs whose signatures differ in at most KEPT symbols are confirmed on full sets by exact integer counts. Members of a
   star are dealt to several tasks, each with its smallest member's text, so that no task holds a bucket.
4. Components of the confirmed links are nodes. Buckets of more than two whose members are in several nodes are open. Open
   buckets with the same head, the member that is in the most buckets, overlap: they become one where that leaves fewer
   pairs to compare. Buckets are cut into blocks, and each pair of blocks is one unit of work on signatures. It says which nodes have members within
   KEPT symbols, as a spanning forest, and which classes these are.
5. Nodes that met so are a family. Its classes are cut into blocks again; each pair of blocks confirms, on full sets, what
   is near by signature and isn't joined yet. Classes without such a partner are not dealt.
6. Components of all confirmed links, by minimum labels with pointer jumping over checkpoint tables.

Nothing is capped: a large bucket or family becomes more block pairs, which are dealt to tasks.

Cases. Null text is empty; a document without words has an empty set, is its own component and is kept. With fewer than
five words the whole word sequence is the one shingle. Rows with a null doc_id are left out; rows that repeat a doc_id are
each returned, linked as their sets are. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strada.llm.common import materialize, prepared, table, tidied, work_dir

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
CHUNKS, CHUNK, ERRORS = 16, 6, 1
SYMBOLS, DISTANCE, KEPT = CHUNKS * CHUNK, CHUNKS * (ERRORS + 1) - 1, 44
#: Signatures and texts in a block; a unit of work has two.
SIGNATURE_BLOCK, TEXT_BLOCK = 1024, 128
#: Members of a star that are confirmed by one unit of work; keys that a task sorts at once; keys in a range, on average; ranges to a task.
STAR, TASK_KEYS, RANGE_KEYS, RANGES = 512, 2_000_000, 250_000, 4

_RNG = np.random.RandomState(20_250_101)
_SALT = _RNG.randint(0, 2**31, SYMBOLS).astype(np.uint32)
_FACTOR = (_RNG.randint(0, 2**31, SYMBOLS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_ODD = _RNG.randint(0, 2**62, CHUNK).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a UTF-8 text; split() and lower() of bytes are ASCII's."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    out = h[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        out += h[k : n - WORDS + 1 + k] * _PLACE[k]
    out ^= out >> np.uint64(31)
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), SYMBOLS) uint16; the sets must not be empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    low = (np.concatenate(sets) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), SYMBOLS), dtype=np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((low ^ _SALT[k]) * _FACTOR[k], starts)
        out[:, k] = (least * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(n, CHUNKS * CHUNK) int64: a hash of each chunk with each one of its symbols left out."""
    s = sig.astype(np.uint64).reshape(-1, CHUNKS, CHUNK) + np.uint64(1)
    keys = np.empty(s.shape, dtype=np.uint64)
    whole = (s * _ODD).sum(axis=2, dtype=np.uint64)
    for p in range(CHUNK):
        h = whole - s[:, :, p] * _ODD[p] + (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(p)) * _PLACE[4]
        h = (h ^ (h >> np.uint64(29))) * _PLACE[1]
        keys[:, :, p] = h ^ (h >> np.uint64(32))
    return keys.view(np.int64).reshape(len(sig), -1)


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, print, sig) of (doc_id, text, mark): print tells equal sets; sig is null for an empty set."""

    def run(batches):
        for b in batches:
            ids, texts, at = b.column(0).to_numpy(), b.column(1), 0
            while at < len(ids):
                sets, held, begin = [], 0, at
                while at < len(ids) and held < 1_000_000:  # bounds the work arrays, whatever the texts' lengths
                    sets.append(shingles(texts[at].as_py()))
                    held, at = held + len(sets[-1]), at + 1
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full) if full else ())
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[begin:at]), b.column(2).slice(begin, at - begin), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], ["doc_id", "mark", "n_shingles", "print", "sig"])

    return docs.mapInArrow(tidied(run), "doc_id long, mark long, n_shingles long, print binary, sig binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted batches."""
    pending: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(b)], strict=True):
            now = tuple(c[lo] for c in cols)
            if pending and now != last:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(b.slice(lo, hi - lo))
            last = now
    if pending:
        yield pa.Table.from_batches(pending)


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A star from the smallest id of each component of the links (places a, b)."""
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            if ids[x] < ids[y]:
                up[y] = x
            else:
                up[x] = y
    tops = [root(x) for x in range(len(ids))]
    pairs = [(int(ids[t]), int(ids[x])) for x, t in enumerate(tops) if t != x]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def _near(sig: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = [], []
    step = max(1, 2_000_000 // max(1, len(other)))
    for lo in range(0, len(sig), step):
        far = np.zeros((min(step, len(sig) - lo), len(other)), dtype=np.uint8)
        for k in range(SYMBOLS):
            far += sig[lo : lo + step, k, None] != other[None, :, k]
        x, y = np.nonzero(far <= KEPT)
        a.append(x + lo)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _alike(one: np.ndarray, two: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of two sorted sets."""
    if not len(one) or not len(two) or DENOMINATOR * min(len(one), len(two)) < NUMERATOR * max(len(one), len(two)):
        return False
    meet = len(np.intersect1d(one, two, assume_unique=True))
    return DENOMINATOR * meet >= NUMERATOR * (len(one) + len(two) - meet)


def _blocks(members: DataFrame, size: int) -> DataFrame:
    """(key, i, j, blk, id, node): a key's n members in ceil(n / size) blocks, each block once for each block it is paired with."""
    nb = F.ceil(F.col("n") / F.lit(size)).cast("int")
    blk = F.pmod(F.xxhash64("id", F.lit(7)), nb).cast("int")
    return members.withColumn("nb", nb).withColumn("blk", blk).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "id", "node"
    )


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)


def _units(batches) -> Iterator[tuple]:
    """(table, places of block i, places of block j, nodes) of each unit of work (key, i, j) that holds several nodes, each member once."""
    for t in _groups(batches, ["key", "i", "j"]):
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        ids, blk, node = (t[c].to_numpy() for c in ("id", "blk", "node"))
        _, first = np.unique(ids, return_index=True)
        one, two = first[blk[first] == i], first[blk[first] == j]
        if len(one) and len(two) and len(np.unique(node[np.concatenate([one, two])])) > 1:
            yield t, one, two, node


def _pairs_of(t: pa.Table, one: np.ndarray, two: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of members of different nodes whose signatures are near; each pair once."""
    left = _signatures(t["sig"].take(pa.array(one)))
    same = len(one) == len(two) and (one == two).all()
    right = left if same else _signatures(t["sig"].take(pa.array(two)))
    a, b = _near(left, right)
    if same:
        a, b = a[a < b], b[a < b]
    x, y = one[a], two[b]
    apart = node[x] != node[y]
    return x[apart], y[apart]


def _dealt(work: DataFrame) -> DataFrame:
    return work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _met(work: DataFrame) -> DataFrame:
    """From units (key, i, j, blk, id, node, sig): (a, b, id) with a forest of the nodes that have near members (id null), and those members with their node (b null)."""

    def run(batches):
        for t, one, two, node in _units(batches):
            x, y = _pairs_of(t, one, two, node)
            if len(x):
                names, place = np.unique(np.concatenate([node[x], node[y]]), return_inverse=True)
                a, b = _forest(names, place[: len(x)], place[len(x) :])
                near = np.unique(np.concatenate([x, y]))
                ids = t["id"].to_numpy()[near]
                yield pa.RecordBatch.from_arrays([pa.array([*a, *node[near].tolist()], pa.int64()), pa.array([*b, *[None] * len(near)], pa.int64()), pa.array([*[None] * len(a), *ids.tolist()], pa.int64())], ["a", "b", "id"])

    return _dealt(work).mapInArrow(run, "a long, b long, id long")


def _confirmed(work: DataFrame) -> DataFrame:
    """From units (key, i, j, blk, id, node, sig, text): links (a, b) between nodes, confirmed on full sets; those that others already join are not made."""

    def run(batches):
        for t, one, two, node in _units(batches):
            x, y = _pairs_of(t, one, two, node)
            held: dict[int, np.ndarray] = {}
            texts = t["text"]

            def full(k: int, held=held, texts=texts) -> np.ndarray:
                if k not in held:
                    held[k] = shingles(texts[k].as_py())
                return held[k]

            up: dict[int, int] = {}

            def root(k: int, up=up) -> int:
                while up.setdefault(k, k) != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            a, b = [], []
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                u, v = int(node[p]), int(node[q])
                if root(u) != root(v) and _alike(full(p), full(q)):
                    up[root(u)] = root(v)
                    a.append(u)
                    b.append(v)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _dealt(work).mapInArrow(tidied(run), "a long, b long")


def components(links: DataFrame, path: str) -> DataFrame:
    """(id, comp): the smallest id reachable over the links (a, b), for each id that has one."""
    edges = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{path}/edges")
    now = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), f"{path}/0")
    for k in range(1, 64):
        heard = edges.join(now.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        step = now.join(heard, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("mid"))
        hop = now.select(F.col("id").alias("mid"), F.col("comp").alias("over"))
        new = materialize(step.join(hop, "mid").select("id", F.least("mid", "over").alias("comp"), (F.least("mid", "over") != F.col("old")).alias("moved")), f"{path}/{k}")
        now = new.select("id", "comp")
        if not new.where("moved").limit(1).count():
            return now
    raise RuntimeError("components did not settle")


def _planes(x: np.ndarray) -> bytes:
    """Longs byte by byte, the first bytes of all before the second ones: sorted or narrow numbers leave few bytes to the shuffle's compression."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def buckets(classes: DataFrame, n: int) -> DataFrame:
    """(key, a, b) from n classes (id, sig): the stars of the keys that classes share, a being the smallest member (of a task's or of all); key is null for a bucket of two that is whole."""
    bits = max(0, math.ceil(math.log2(max(1, n * SYMBOLS / RANGE_KEYS))))
    shift = np.uint64(64 - bits)

    def packed(batches):
        ids: list[np.ndarray] = []
        sigs: list[np.ndarray] = []
        spread = 0

        def out():
            nonlocal spread
            own = np.concatenate(ids)
            order = np.argsort(own, kind="stable")
            own = own[order].astype(np.uint64)
            keys = chunk_keys(np.concatenate(sigs)[order]).view(np.uint64).ravel()
            at = np.argsort(keys, kind="stable")
            keys, who = keys[at], own[at // SYMBOLS]
            starts, lengths = _runs(keys)
            more = lengths > 1
            inner = np.ones(len(keys), dtype=bool)
            inner[starts] = False
            if inner.any():  # told off here, and only passed on
                leads = np.repeat(who[starts], lengths)[inner]
                spread += 1
                yield -1 - spread, keys[inner], leads, who[inner]
            ranges = keys[starts] >> shift if bits else np.zeros(len(starts), dtype=np.uint64)
            cuts, sizes = _runs(ranges)
            marked = who[starts] << np.uint64(1) | more.astype(np.uint64)
            for lo, size in zip(cuts.tolist(), sizes.tolist(), strict=True):
                yield int(ranges[lo]), keys[starts[lo : lo + size]], marked[lo : lo + size], None

        def rows():
            held = 0
            for b in batches:
                if len(b):
                    ids.append(b.column(0).to_numpy())
                    sigs.append(_signatures(b.column(1)))
                    held += len(b) * SYMBOLS
                    if held >= TASK_KEYS:
                        yield from out()
                        ids.clear(), sigs.clear()
                        held = 0
            if held:
                yield from out()

        for route, keys, a, b in rows():
            yield pa.RecordBatch.from_arrays([pa.array([route], pa.int64()), *[pa.array([None if x is None else _planes(x)], pa.binary()) for x in (keys, a, b)]], ["route", "keys", "a", "b"])

    def stars(batches):
        columns = lambda key, a, b: pa.RecordBatch.from_arrays([key, pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["key", "a", "b"])
        for t in _groups(batches, ["route"]):
            if t["route"][0].as_py() < 0:
                for keys, a, b in zip(*(t[c].to_pylist() for c in ("keys", "a", "b")), strict=True):
                    yield columns(pa.array(_from_planes(keys).view(np.int64)), _from_planes(a), _from_planes(b))
                continue
            keys, who = (np.concatenate([_from_planes(x) for x in t[c].to_pylist()]) for c in ("keys", "a"))
            at = np.lexsort((who, keys))
            keys, who = keys[at], who[at]
            starts, lengths = _runs(keys)
            more = np.repeat(lengths, lengths) > 1
            whole = np.repeat((lengths == 2) & (np.add.reduceat(who & np.uint64(1), starts) == 0), lengths) if len(starts) else more
            who = who >> np.uint64(1)
            more[starts] = False
            leads = np.repeat(who[starts], lengths)
            two = np.unique(np.stack([leads[more & whole], who[more & whole]], axis=1), axis=0)
            if len(two):
                yield columns(pa.nulls(len(two), pa.int64()), two[:, 0], two[:, 1])
            star = more & ~whole
            if star.any():
                yield columns(pa.array(keys[star].view(np.int64)), leads[star], who[star])

    parts = max(1, (1 << bits) // RANGES)
    return classes.select("id", "sig").mapInArrow(tidied(packed), "route long, keys binary, a binary, b binary").repartition(parts, "route").sortWithinPartitions("route").mapInArrow(tidied(stars), "key long, a long, b long")


def _near_only(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most KEPT symbols."""

    def against(batches):
        for b in batches:
            if len(b):
                far = (_signatures(b.column(2)) != _signatures(b.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(far <= KEPT))

    sides = pairs.hint("merge").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")).hint("merge"), "b")
    sides = sides.hint("merge").join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")).hint("merge"), "a")
    return sides.select("a", "b", "sa", "sb").mapInArrow(against, "a long, b long")


def _stars_confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike. A star's members are dealt by a hash, STAR to a unit on average; each unit streams by, its first text being a's."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR)).cast("int").alias("units"))
    members = pairs.join(sizes.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("units")).cast("int").alias("unit"), F.col("b").alias("id"), F.lit(1).alias("role"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.col("a").alias("id"), F.lit(0).alias("role"))
    work = members.unionByName(heads).hint("merge").join(texts.hint("merge"), "id")

    def run(batches):
        now, head, done = None, None, None
        for b in batches:
            a, unit, ids, role = (b.column(k).to_numpy() for k in range(4))
            texts, out = b.column(4), ([], [])
            for k in range(len(b)):
                if (a[k], unit[k]) != now:
                    now, head, done = (a[k], unit[k]), None, None
                if not role[k]:
                    head = shingles(texts[k].as_py()) if head is None else head
                elif ids[k] != done:  # equal rows of one document come one after the other
                    done = ids[k]
                    if _alike(head, shingles(texts[k].as_py())):
                        out[0].append(int(a[k]))
                        out[1].append(int(ids[k]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    work = work.select("a", "unit", "id", "role", "text").repartition("a", "unit").sortWithinPartitions("a", "unit", "role", "id")
    return work.mapInArrow(tidied(run), "a long, b long")


def mark_of(text):
    """Tells the texts of one doc_id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def components_of(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, mark, n_shingles, comp, component_id; comp tells components, also those that have the same smallest doc_id, and is null for an empty set."""
    own = prepared(docs, key, text).select(F.col(key).alias("doc_id"), F.col("text").cast("binary").alias("text"), mark_of(F.col("text")).alias("mark"))
    seen = materialize(prints(own), f"{path}/prints")
    classes = seen.where("print IS NOT NULL").groupBy("print").agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.first("sig").alias("sig"))
    classes = materialize(classes.select("print", F.monotonically_increasing_id().alias("id"), "one", "sig"), f"{path}/classes")
    sigs = classes.select("id", "sig")
    stars = materialize(buckets(sigs, classes.count()), f"{path}/stars")
    pairs = materialize(_near_only(stars.select("a", "b").distinct(), sigs), f"{path}/pairs")
    ids = lambda df: df.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = ids(pairs).unionByName(ids(stars.where("key IS NOT NULL"))).distinct()
    at = classes.select("id", "one.doc_id", "one.mark").hint("merge").join(wanted.hint("merge"), "id", "left_semi")
    texts = materialize(at.hint("merge").join(own.hint("merge"), ["doc_id", "mark"]).select("id", "text"), f"{path}/texts")
    links = materialize(_stars_confirmed(pairs, texts), f"{path}/confirmed")
    linked = _of_open(stars, components(links, f"{path}/first"), sigs, texts, path)
    low = linked.join(classes.select("id", "one.doc_id"), "id").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(linked.join(low, "comp"), "id", "left").select("print", F.coalesce("comp", "id").alias("comp"), F.coalesce("component_id", "one.doc_id").alias("component_id"))
    out = seen.select("doc_id", "mark", "n_shingles", "print").join(named, "print", "left")
    return out.select("doc_id", "mark", "n_shingles", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def _of_open(stars: DataFrame, linked: DataFrame, sigs: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """(id, comp) of all links, from linked, the components so far: what they leave apart within buckets of more than two is compared."""
    members = stars.where("key IS NOT NULL").select("key", F.explode(F.array("a", "b")).alias("id")).distinct()
    members = members.join(linked.select("id", F.col("comp").alias("node")), "id", "left").select("key", "id", F.coalesce("node", "id").alias("node"))
    members = materialize(members.withColumn("often", F.count(F.lit(1)).over(W.partitionBy("id"))), f"{path}/members")  # at most SYMBOLS rows to an id
    open_ = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.max(F.struct("often", "id")).alias("head"))
    open_ = materialize(open_.where("lo <> hi AND n > 2").select("key", "n", F.col("head.id").alias("head")), f"{path}/open")
    rows = materialize(members.join(open_.select("key", "head"), "key").select("head", "key", "id", "node"), f"{path}/apart")
    # buckets of one head become one where that is less to compare: its members are counted once then
    apiece = open_.groupBy("head").agg(F.sum(F.col("n") * F.col("n")).alias("apiece"))
    union = rows.select("head", "id").distinct().groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    whole = union.join(apiece, "head").where(F.col("n") * F.col("n") <= F.col("apiece")).select("head", F.lit(True).alias("whole"))
    rows = rows.join(whole, "head", "left").select(F.when(F.col("whole"), F.xxhash64("head", F.lit("head"))).otherwise(F.col("key")).alias("key"), "id", "node")
    members = materialize(rows.distinct(), f"{path}/dealt")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("other"))
    sizes = sizes.groupBy("n", "mark", "other").agg(F.min("key").alias("key")).select("key", "n")  # of buckets with equal members one
    work = _blocks(members.join(sizes, "key"), SIGNATURE_BLOCK).join(sigs, "id")
    met = materialize(_met(work), f"{path}/met")
    if not met.limit(1).count():
        return linked
    family = components(met.where("b IS NOT NULL").select("a", "b"), f"{path}/families")
    active = met.where("id IS NOT NULL").select(F.col("a").alias("node"), "id").distinct()
    active = materialize(active.join(family.select(F.col("id").alias("node"), F.col("comp").alias("key")), "node"), f"{path}/active")
    sizes = active.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    work = _blocks(active.join(sizes, "key"), TEXT_BLOCK).join(sigs, "id").join(texts, "id")
    further = materialize(_confirmed(work), f"{path}/further")
    return components(linked.select(F.col("comp").alias("a"), F.col("id").alias("b")).unionByName(further), f"{path}/all")


def near_dedup(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return components_of(docs, path, key, text).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), work_dir(spark))


#: The same by an inverted index of shingles, without signatures.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), words AS (
  SELECT row_no, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t
), runs AS (
  SELECT row_no, n, i, x || coalesce(' ' || lead(x, 1) OVER v, '') || coalesce(' ' || lead(x, 2) OVER v, '') || coalesce(' ' || lead(x, 3) OVER v, '') || coalesce(' ' || lead(x, 4) OVER v, '') AS x
  FROM words WINDOW v AS (PARTITION BY row_no ORDER BY i)
), grouped AS (
  SELECT row_no, list_sort(list(DISTINCT x)) AS s FROM runs WHERE i <= greatest(n - 4, 1) GROUP BY row_no
), sets AS (
  SELECT t.doc_id, coalesce(grouped.s, []) AS s FROM t LEFT JOIN grouped ON t.row_no = grouped.row_no
), classes AS (
  SELECT s, len(s) AS n, row_number() OVER () AS c, min(doc_id) AS low FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT c, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached AS (
  SELECT c AS a, c AS b FROM classes
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), named AS (
  SELECT reached.a AS c, min(low) AS component_id FROM reached JOIN classes ON reached.b = classes.c GROUP BY reached.a
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id,
       sets.doc_id = coalesce(component_id, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN named ON classes.c = named.c
"""

assert math.comb(CHUNK, ERRORS) * CHUNKS == SYMBOLS
