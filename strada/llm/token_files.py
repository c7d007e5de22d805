"""Token ids in fixed-width bit-packed files, with block offsets for random access.

A file: the magic, blocks of packed ids, the block offsets, the documents' ids and token counts, and a footer. Each id
takes the least number of bits that the vocabulary needs, lowest bit first; a block holds BLOCK ids and begins at a byte,
so any id is found from its number alone and a block is unpacked by a few numpy operations. Documents are dealt to files
by ranges of doc_id; a task writes its file under a temporary name and renames it, and a manifest lists what was written.
Where a file's first id stands in the corpus is the sum of the files before it, one number per file.

Cases. Null text is empty: the document's only id is the end id. Rows with a null doc_id are left out; rows that repeat a
doc_id are each written, in order of their text. An empty table gives no files and an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.llm import files
from strada.llm.common import n_partitions, prepared, table, work_dir
from strada.llm.tokens import encoder, resolve

MAGIC, BLOCK = b"STRIDS1\n", 1 << 15
_FOOTER = struct.Struct("<QQQQII")  # documents, ids, where the offsets stand, where the documents stand, bits, ids in a block


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at a fixed width, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int, first: int = 0) -> np.ndarray:
    """count ids of a block from its first-th on, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count, offset=first * bits // 8).astype(np.uint32)
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    at = (np.arange(first, first + count, dtype=np.int64)) * bits
    byte, out = at >> 3, np.zeros(count, dtype=np.uint64)
    for k in range((bits + 14) // 8):
        out |= raw[byte + k] << np.uint64(8 * k)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Writes one file, block by block; only the open block and the documents' table are held."""

    def __init__(self, f, bits: int):
        self.f, self.bits, self.at = f, bits, 0
        self.held, self.n_held, self.offsets, self.docs, self.total = [], 0, [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.f.write(data)
        self.at += len(data)

    def add(self, doc_id: int, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        new = np.frombuffer(ids, dtype="<u4")
        self.docs.append((doc_id, len(new)))
        self.total += len(new)
        self.held.append(new)
        self.n_held += len(new)
        if self.n_held >= BLOCK:
            ready = np.concatenate(self.held)
            cut = len(ready) // BLOCK * BLOCK
            for k in range(0, cut, BLOCK):
                self.offsets.append(self.at)
                self._put(pack(ready[k : k + BLOCK], self.bits))
            self.held, self.n_held = [ready[cut:].copy()], len(ready) - cut

    def close(self) -> None:
        if self.n_held:
            self.offsets.append(self.at)
            self._put(pack(np.concatenate(self.held), self.bits))
        at_offsets = self.at
        self._put(np.array(self.offsets, dtype="<u8").tobytes())
        at_docs = self.at
        self._put(np.array(self.docs, dtype="<i8").reshape(-1, 2).tobytes())
        self._put(_FOOTER.pack(len(self.docs), self.total, at_offsets, at_docs, self.bits, BLOCK))


class Reader:
    """Reads one file; ids(first, count) reads only the blocks that hold them."""

    def __init__(self, f):
        self.f = f
        if self._get(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        f.seek(0, 2)
        end = f.tell() - _FOOTER.size
        self.n_docs, self.total, at_offsets, at_docs, self.bits, self.block = _FOOTER.unpack(self._get(end, _FOOTER.size))
        self.offsets = np.frombuffer(self._get(at_offsets, at_docs - at_offsets), dtype="<u8")
        self.docs = np.frombuffer(self._get(at_docs, self.n_docs * 16), dtype="<i8").reshape(-1, 2)
        self.end = at_offsets

    def _get(self, at: int, n: int) -> bytes:
        self.f.seek(int(at))
        return self.f.read(int(n))

    def ids(self, first: int, count: int) -> np.ndarray:
        out, last = [], first + count
        for k in range(first // self.block, -(-last // self.block) if count else 0):
            lo, hi = max(first, k * self.block), min(last, (k + 1) * self.block, self.total)
            stop = self.offsets[k + 1] if k + 1 < len(self.offsets) else self.end
            out.append(unpack(self._get(self.offsets[k], stop - self.offsets[k]), hi - lo, self.bits, lo - k * self.block))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def documents(self):
        """(doc_id, first id's number in the file, ids as little-endian bytes), reading each block once."""
        block, held, at = -1, np.zeros(0, dtype="<u4"), 0
        for doc_id, n in self.docs.tolist():
            parts, first, left = [], at, n
            while left:
                if at // self.block != block:
                    block = at // self.block
                    held = self.ids(block * self.block, min(self.block, self.total - block * self.block))
                take = held[at % self.block : at % self.block + left]
                parts.append(take)
                at, left = at + len(take), left - len(take)
            yield doc_id, first, b"".join(p.astype("<u4").tobytes() for p in parts)


def write(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Writes the files and the manifest below folder; the manifest: name, part, documents, tokens, first (ids before it)."""
    bits = bits_for(vocabulary)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        part, tokens = TaskContext.get().partitionId(), encoder(tokenizer, False)
        first = next(batches, None)
        if first is None:
            return
        name = f"part-{part:06d}.ids"
        with files.committed(f"{folder}/{name}") as f:
            w = Writer(f, bits)
            while first is not None:
                for doc_id, ids in zip(first.column(0).to_pylist(), tokens.encode(first.column(1).to_pylist()), strict=True):
                    w.add(doc_id, ids + end)
                first = next(batches, None)
            w.close()
        yield pa.RecordBatch.from_pydict({"name": [name], "part": [part], "documents": [len(w.docs)], "tokens": [w.total]})

    own = prepared(docs, key, text)
    dealt = own.repartitionByRange(n_partitions(docs.sparkSession), key).sortWithinPartitions(key, "text")
    rows = [r.asDict() for r in dealt.mapInArrow(run, "name string, part long, documents long, tokens long").collect()]  # one row a file
    rows.sort(key=lambda r: r["part"])
    first = 0
    for r in rows:
        r["first"] = first
        first += r["tokens"]
    with files.committed(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"bits": bits, "tokens": first, "files": rows}).encode())
    return rows


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of the files that the manifest lists, one task a file."""
    with files.opened(f"{folder}/manifest.json") as f:
        listed = json.load(f)["files"]

    def run(batches):
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.opened(f"{folder}/{name}") as f:
                    rows: list = []
                    size = 0
                    for doc_id, first, ids in Reader(f).documents():
                        rows.append((doc_id, before + first, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 8_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    names = spark.createDataFrame([(r["name"], r["first"]) for r in listed], "name string, first long")
    return names.repartition(max(1, len(listed))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids"])


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = f"{work_dir(spark)}/ids"
    write(table(spark, sf_dir, "documents"), folder, tokenizer or resolve("word_bpe_49k.json"), 49_408, 2)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


assert zlib.crc32(b"") == 0
