"""Ids of texts in a byte-level vocabulary, each distinct piece between spaces coded once."""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Splits a text before each space and line end; texts that hold it are coded whole.
_CUT = "\x01"
#: A space or line end inside longer white space: what a pre-token of it takes depends on both sides.
_WIDE = r"[ \t\n\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n](?:[ \t\n\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
_WHOLE = rf"{_CUT}|<\||{_WIDE}"

_OPENING = (" ", "\n")


class Generation:
    """Ids of pieces, all in one array; ``begins`` has the place of each piece's ids and the end."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.begins = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Their indices."""
        n, used = len(self.index), int(self.begins[-1])
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[:used], np.zeros(max(used, len(ids)) + len(ids), np.uint32)))
        self.flat[used : used + len(ids)] = ids
        self.begins = np.concatenate((self.begins, used + np.cumsum(sizes, dtype=np.int64)))
        self.index.update(zip(pieces, range(n, n + len(pieces))))
        return np.arange(n, n + len(pieces))

    def find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))


def gathered(flat: np.ndarray, begins: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of the pieces ``own``, with sizes of them (at least their own) each."""
    after = np.cumsum(sizes, dtype=np.int64)
    if not len(own) or not after[-1]:
        return np.zeros(0, np.uint32)
    return flat[np.repeat(begins[own] - after + sizes, sizes) + np.arange(after[-1])]


class BytePieces:
    """Ids of pieces, in two generations of at most ``most`` pieces each (and those of one call).

    The vocabulary's pre-tokens are letters, digits or other signs with at most one space before
    them, and white space up to the last sign of it. So a text may be cut before a space or line
    end, unless white space stands on both sides of it; such texts, and those that may hold a
    special token, go to the tokenizer whole.
    """

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = Tokenizer.from_file(path)
        self.batch, self.most, self.young, self.old = own.encode_batch_fast, most, Generation(), Generation()
        vocabulary = own.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] in "ĠĊ"]] = True

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, end_id after each, and how many each has with it."""
        if len(self.young.index) >= self.most:
            self.young, self.old = Generation(), self.young
        whole = pc.match_substring_regex(texts, _WHOLE)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(odd):
            held, texts = texts.take(pa.array(odd)).to_pylist(), pc.if_else(whole, "", texts)
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", _CUT + "\n"), _CUT)
        pieces = split.flatten().dictionary_encode()
        # One string of all pieces, cut again: much faster than a Python object for each.
        all_of = pa.ListArray.from_arrays(pa.array([0, len(pieces.dictionary)], pa.int32()), pieces.dictionary)
        distinct = pc.binary_join(all_of, _CUT)[0].as_py().split(_CUT)
        known = self.young.find(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self._learn([distinct[i] for i in new.tolist()])
        own, flat, begins = known[pieces.indices.to_numpy()], self.young.flat, self.young.begins
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        if len(odd):  # a text that is coded whole is one piece, the empty one, till here
            coded = [np.array(e.ids, np.uint32) for e in self.batch(held, add_special_tokens=False)]
            own[offsets[odd]] = len(begins) - 1 + np.arange(len(odd))
            flat = np.concatenate((flat[: begins[-1]], *coded))
            begins = np.concatenate((begins, begins[-1] + np.cumsum([len(c) for c in coded])))
        if len(flat) == begins[-1]:
            flat = np.concatenate((flat, np.zeros(1, np.uint32)))  # the end id's place after the last piece
        n = begins[own + 1] - begins[own]
        n[offsets[1:] - 1] += 1  # every text has a piece, if an empty one
        ids, after = gathered(flat, begins, own, n), np.concatenate(([0], np.cumsum(n)))[offsets]
        ids[after[1:] - 1] = end_id
        return ids, np.diff(after)

    def rest(self) -> None:
        """Between tasks, which may be another stage's, only the young generation is kept."""
        self.old = Generation()

    def _learn(self, pieces: list[str]) -> np.ndarray:
        out, old = self.old.find(pieces), self.old
        moved, new = np.flatnonzero(out >= 0), np.flatnonzero(out < 0).tolist()
        own = out[moved]
        sizes = old.begins[own + 1] - old.begins[own]
        out[moved] = self.young.add([pieces[i] for i in moved.tolist()], gathered(old.flat, old.begins, own, sizes), sizes)
        # Most are coded as one text, in which each piece starts with a token that opens with a space or line end.
        words = [i for i in new if (p := pieces[i])[:1] in _OPENING and len(p) > 1 and p[1:].isprintable()]
        if words:
            own = [pieces[i] for i in words]
            ids = np.array(self.batch(["".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(words):
                out[words] = self.young.add(own, ids, np.diff(starts, append=len(ids)))
        rest = [i for i in new if out[i] < 0]
        for at in range(0, len(rest), 5000):
            own = [pieces[i] for i in rest[at : at + 5000]]
            coded = [e.ids for e in self.batch(own, add_special_tokens=False)]
            out[rest[at : at + 5000]] = self.young.add(own, np.fromiter(chain.from_iterable(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)))
        return out


_PIECES: dict[str, BytePieces] = {}


def pieces_of(path: str, most: int) -> BytePieces:
    """This worker's pieces: they outlive a task."""
    if path not in _PIECES:
        _PIECES[path] = BytePieces(path, most)
    return _PIECES[path]
