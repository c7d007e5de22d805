"""Token ids of whole texts, equal to encoding each text at once, by memoising the pieces between spaces.

Both vocabularies here split a text before they merge, and neither split crosses a space that stands alone between two
other characters, so a text's ids are the ids of its space-led pieces one after the other. Texts are cut by Arrow, some MB
at a time; each distinct piece is looked up once, encoded by the tokenizers library where it is new, and remembered in a
bounded table of arrays; numpy lays the pieces' ids out. A stop or comma after a letter is a piece of its own, since both splits part
it from the letter; it is marked, as it has no space before it. A text with other white space than single spaces and single
line breaks between characters, with the mark itself, or with the text of a special token, is encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in each of the two generations that a worker remembers; the older one is dropped when the newer is full.
REMEMBERED = 400_000
#: Characters of the texts that are cut together.
TOGETHER = 4_000_000
#: Texts or pieces that the tokenizers library encodes at a time: its results take some hundred bytes each.
ENCODED = 4096
_MARK = "\x01"


class Pieces:
    """Distinct pieces and their ids, in arrays: a third of what a dict of strings and bytes takes, and given back whole."""

    def __init__(self):
        self.texts = pa.array([], pa.large_string())
        self.lengths, self.ids = np.zeros(0, dtype=np.int32), np.zeros(0, dtype="<u4")

    def __len__(self) -> int:
        return len(self.texts)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Where each of pieces stands, -1 for others."""
        return np.array(pc.fill_null(pc.index_in(pieces, value_set=self.texts), -1), dtype=np.int64)

    def add(self, pieces: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        """lengths: how many ids each of the pieces has, -1 where it can't be cut; ids: one after the other."""
        self.texts = pa.concat_arrays([self.texts, pieces])
        self.lengths, self.ids = np.concatenate([self.lengths, lengths.astype(np.int32)]), np.concatenate([self.ids, ids])

    def starts(self) -> np.ndarray:
        held = np.maximum(self.lengths, 0).astype(np.int64)
        return np.cumsum(held) - held

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of the pieces at places."""
        lengths = self.lengths[places]
        held = np.maximum(lengths, 0).astype(np.int64)
        return lengths, self.ids[np.repeat(self.starts()[places] - (np.cumsum(held) - held), held) + np.arange(held.sum())]


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    spaced: the vocabulary keeps white space (a word is led by its space); else white space only parts words.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.special = [_MARK, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.new, self.old = Pieces(), Pieces()
        self.line = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), ENCODED):
            out += [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[k : k + ENCODED], add_special_tokens=False)]
        return out

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Where each of some distinct pieces stands in new, once those that aren't there are put at its end."""
        places = self.new.find(pieces)
        fresh = np.flatnonzero(places < 0)
        if len(self.new) + len(fresh) > REMEMBERED:
            self.old, self.new = self.new, Pieces()
            fresh = np.arange(len(pieces))
            places = np.full(len(pieces), -1)
        if not len(fresh):
            return places
        texts = pieces.take(pa.array(fresh))
        known = self.old.find(texts)
        for of, some in ((known >= 0, lambda of: self.old.at(known[of])), (known < 0, lambda of: self._encoded(texts.filter(pa.array(of)).to_pylist()))):
            if of.any():
                places[fresh[of]] = len(self.new) + np.arange(of.sum())
                self.new.add(texts.filter(pa.array(of)), *some(of))
        return places

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of pieces, with the space or line break that they are led by."""
        ids: list[bytes | None] = [None] * len(pieces)  # None: white space that can't be cut, so that the text is encoded whole
        words, lines, bare = [], [], []
        for k, p in enumerate(pieces):
            if not self.spaced:
                words.append((k, p))
            else:  # a piece is led by a space, or by the line break that it begins with
                body = p[1:] if p[:1] in ("\n", _MARK) else p
                if body and not body[0].isspace() and not body[-1].isspace():
                    if body is p:
                        words.append((k, " " + p))
                    else:
                        (lines if p[0] == "\n" else bare).append((k, body))
        for some, lead in ((words, b""), (bare, b""), (lines, self.line)):
            for (k, _), got in zip(some, self._ids([p for _, p in some]), strict=True):
                ids[k] = lead + got
        lengths = np.fromiter((-1 if i is None else len(i) // 4 for i in ids), dtype=np.int64, count=len(ids))
        return lengths, np.frombuffer(b"".join(i for i in ids if i), dtype="<u4")

    def _some(self, texts: list[str]) -> list[bytes]:
        whole = np.array([not t or any(s in t or (not self.spaced and s in t.lower()) for s in self.special) for t in texts], dtype=bool)
        flat_texts = pc.replace_substring(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.large_string()), "\n", " \n" if self.spaced else " ")
        if not self.spaced:  # this vocabulary is in lower case
            flat_texts = pc.ascii_lower(flat_texts)
        lists = pc.split_pattern(pc.replace_substring_regex(flat_texts, r"(\pL)([.,])", rf"\1 {_MARK}\2" if self.spaced else r"\1 \2"), " ")
        starts = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        pieces, at = coded.dictionary, coded.indices.to_numpy()
        heads: list[bytes] = []
        if self.spaced:  # a text's first piece has no space before it
            first = pieces.take(pa.array(at[starts[:-1]])).to_pylist()
            whole |= np.array([not h or h[0].isspace() or h[-1].isspace() for h in first], dtype=bool)
            heads = self._ids(["" if w else h for h, w in zip(first, whole, strict=True)])
            rest = np.ones(len(at), dtype=bool)
            rest[starts[:-1]] = False
            used = np.unique(at[rest])
        else:
            rest, used = np.ones(len(at), dtype=bool), np.arange(len(pieces))
        places = self._learn(pieces.take(pa.array(used)))
        bad, lengths, begin = np.zeros(len(pieces), dtype=bool), np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        lengths[used], begin[used] = np.maximum(self.new.lengths[places], 0), self.new.starts()[places]
        bad[used] = self.new.lengths[places] < 0
        each = np.where(rest, lengths[at], 0)
        ends = np.cumsum(each)
        place = np.repeat(begin[at] - (ends - each), each)
        place += np.arange(len(place))
        out_ids = self.new.ids[place]
        edges = np.concatenate([[0], ends])[starts]
        wrong = np.concatenate([[0], np.cumsum(bad[at] & rest)])[starts]
        whole |= wrong[1:] > wrong[:-1]
        again = iter(self._ids([t for t, w in zip(texts, whole, strict=True) if w]))
        return [next(again) if whole[k] else (heads[k] if heads else b"") + out_ids[edges[k] : edges[k + 1]].tobytes() for k in range(len(texts))]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size > TOGETHER:
                out += self._some(held)
                held, size = [], 0
        return out + self._some(held) if held else out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder, kept between tasks until forget()."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def forget() -> None:
    """Drops this worker's encoders; the next task that needs one makes it anew."""
    _encoders.clear()


def resolve(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
