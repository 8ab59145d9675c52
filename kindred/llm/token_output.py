"""Token-ID / binary output: Simple-8b word-aligned coding of token ids.

A file set is a folder of Parquet parts, one row per chunk of whole documents in ascending
doc_id order. A chunk holds 64-bit words: four bits of selector above sixty of payload; the
selector says how many ids of how many bits the payload packs. An id of over 60 bits is an
escape: a word with selector 0, then the raw id as a word of its own. Ids are coded in blocks of
``block`` ids; the word at which each block starts is kept, so that blocks decode on their own
and all at once.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.byte_pieces import Generation, gathered
from kindred.llm.common import scratch_path, slices, whole_text

# Fixed values: (ids, bits) of selectors 1 to 14 of Simple-8b; selector 0 is the escape here.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([1, *(n for n, _ in SELECTORS)])
BLOCK = 512
_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)
END_ID = 2
CHUNK_IDS = 250_000
CHUNK_SCHEMA = "shard int, chunk int, start long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, words binary, blocks binary, raw binary"


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    top = int(ids.max())
    if top < 1 << 16:
        return _BITS[ids]
    if top < 1 << 52:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    return np.array([i.bit_length() for i in ids.tolist()], np.uint8)


def encode_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word at which each block starts, and the places of raw (escaped) words."""
    ids = np.asarray(ids)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    bits = _bit_lengths(ids)
    at = np.arange(n, dtype=np.int32)
    last = np.minimum((at // block + 1) * block, n).astype(np.int32)
    step, choice = np.ones(n, np.int32), np.zeros(n, np.int8)
    # What fits a selector of more ids fits all of fewer ids and more bits, so each looks at what is left.
    left = at
    over, padded_bits = np.zeros(n + 1, np.int32), np.concatenate((bits, np.zeros(64, np.uint8)))
    top = int(bits.max())
    widest = max((s for s, (_, width) in enumerate(SELECTORS, 1) if width < top), default=0) + 1  # fits every id
    if widest <= len(SELECTORS):
        choice[:] = widest
        step = np.minimum(last - at, np.int32(SELECTORS[widest - 1][0]))
    for s in range(min(widest - 1, len(SELECTORS)), 0, -1):
        count, width = SELECTORS[s - 1]
        stop = np.minimum(left + np.int32(count), last[left])
        if len(left) * count < n:  # few places are left: look at them alone
            near = left[:, None] + np.arange(count, dtype=np.int32)
            fits = ~((padded_bits[near] > width) & (near < stop[:, None])).any(axis=1)
        else:
            np.cumsum(bits > width, dtype=np.int32, out=over[1:])
            fits = over[stop] == over[left]
        left = left[fits]
        if not len(left):
            break
        choice[left] = s
        step[left] = stop[fits] - left
    live, found = np.arange(0, n, block), []
    while len(live):
        found.append(live)
        live = live + step[live]
        live = live[(live % block != 0) & (live < n)]
    starts = np.sort(np.concatenate(found))
    chosen = choice[starts]
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(chosen == 0)[:-1]))
    words = np.zeros(len(starts) + int((chosen == 0).sum()), np.uint64)
    raw = place[chosen == 0] + 1
    words[raw] = ids[starts[chosen == 0]]
    padded = np.concatenate((ids.astype(np.uint64), np.zeros(64, np.uint64)))
    for s, (count, width) in enumerate(SELECTORS, 1):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            from_, n_own = starts[mine], step[starts[mine]]
            short = np.flatnonzero(n_own < count)
            word = np.full(len(mine), s << 60, np.uint64)
            for lane in range(count):
                got = padded[from_ + lane]
                got[short[n_own[short] <= lane]] = 0
                word |= got << np.uint64(lane * width)
            words[place[mine]] = word
    return words, place[starts % block == 0].astype(np.uint32), raw.astype(np.uint32)


def decode_words(words: np.ndarray, blocks: np.ndarray, raw: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of a chunk, all blocks at once."""
    coded = np.ones(len(words), bool)
    coded[raw] = False
    place = np.flatnonzero(coded)
    selector = (words[place] >> np.uint64(60)).astype(np.int64)
    owner = np.searchsorted(blocks, place, side="right") - 1
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    first = np.searchsorted(place, blocks)
    starts = before - before[first][owner] + owner * block
    stop = np.minimum((owner + 1) * block, n)
    out = np.zeros(n + 64, np.uint64)
    for s, (count, width) in enumerate(SELECTORS, 1):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            to, word, room = starts[mine], words[place[mine]], stop[mine] - starts[mine]
            for lane in range(count):
                if lane:
                    word = word >> np.uint64(width)
                    if lane >= least_room:  # the last word of a block may hold fewer
                        full = room > lane
                        to, word, room = to[full], word[full], room[full]
                else:
                    least_room = room.min()
                out[to + lane] = word & np.uint64((1 << width) - 1)
    mine = np.flatnonzero(selector == 0)
    out[starts[mine]] = words[place[mine] + 1]
    return out[:n]


#: A piece of plain letters and one of these are two pre-tokens.
_MARKS = {".", ","}
#: Marks that make one letter with a lower-case ASCII letter and none with its upper case.
_JOINING = ("\u0308", "\u030a", "\u030c", "\u0331")


def plain_letters(piece: str) -> bool:
    """Whether a piece is letters before and after the vocabulary's normalising (NFC, lower case).

    Some letters fall apart into a letter and a mark, which then joins what follows. Only Latin,
    Greek and Cyrillic count, since what is a letter beyond depends on the Unicode version.
    """
    if piece.isascii():
        return piece.isalpha()
    normal = unicodedata.normalize("NFC", piece).lower()
    return piece.isalpha() and normal.isalpha() and max(normal) < "\u0530"


class Pieces:
    """Ids of pieces of text between spaces.

    Two generations of at most ``most`` pieces each: what a full generation's successor asks for
    again moves over, what nothing asks for goes.
    """

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = Tokenizer.from_file(path)
        self.batch, self.most, self.young, self.old = own.encode_batch_fast, most, Generation(), Generation()
        vocabulary = own.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, end_id after each, and how many each has.

        No pre-token of this vocabulary spans a white space, so each distinct piece is coded once.
        A-Z are lowered first, as the vocabulary does, unless a special token may be about, or a
        mark that would then make another letter.
        """
        if len(self.young.index) >= self.most:
            self.young, self.old = Generation(), self.young
        if not any(pc.any(pc.match_substring(texts, x)).as_py() for x in ("<|", *_JOINING)):
            texts = pc.ascii_lower(texts)
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), " ")
        pieces = split.flatten().dictionary_encode()
        # One string of all pieces, cut again: much faster than a Python object for each. None has a line end.
        all_of = pa.ListArray.from_arrays(pa.array([0, len(pieces.dictionary)], pa.int32()), pieces.dictionary)
        distinct = pc.binary_join(all_of, "\n")[0].as_py().split("\n")
        known = self.young.find(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            missing = [distinct[i] for i in new.tolist()]
            self._learn(missing)
            known[new] = self.young.find(missing)
        own, flat, begins = known[pieces.indices.to_numpy()], self.young.flat, self.young.begins
        if len(flat) == begins[-1]:
            flat = np.concatenate((flat, np.zeros(1, np.uint32)))  # the end id's place after the last piece
        n = begins[own + 1] - begins[own]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        if end_id is not None:
            n[offsets[1:] - 1] += 1  # every text has a piece, if an empty one
        ids, after = gathered(flat, begins, own, n), np.concatenate(([0], np.cumsum(n)))[offsets]
        if end_id is not None:
            ids[after[1:] - 1] = end_id
        return ids, np.diff(after)

    def rest(self) -> None:
        """Between tasks, which may be another stage's, only the young generation is kept."""
        self.old = Generation()

    def _learn(self, pieces: list[str]) -> None:
        young, old, every = self.young, self.old, set(pieces)
        found = old.find(pieces)
        own = np.flatnonzero(found >= 0)
        sizes = old.begins[found[own] + 1] - old.begins[found[own]]
        young.add([pieces[i] for i in own.tolist()], gathered(old.flat, old.begins, found[own], sizes), sizes)
        marked = [p for p in pieces if p not in young.index and p[-1:] in _MARKS and plain_letters(p[:-1])]
        new = [p for p in (every | {p[:-1] for p in marked} | _MARKS).difference(marked) if p not in young.index]
        words = [p for p in new if p.isalpha()]
        if words:
            ids = np.array(self.batch([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words):  # else a word is more than one pre-token
                young.add(words, ids, np.diff(ends, prepend=0))
        rest = [p for p in new if p not in young.index]
        for at in range(0, len(rest), 5000):
            coded = [e.ids for e in self.batch(rest[at : at + 5000], add_special_tokens=False)]
            young.add(rest[at : at + 5000], np.fromiter(chain.from_iterable(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)))
        if marked:  # letters, then their mark
            parts = np.stack((young.find([p[:-1] for p in marked]), young.find([p[-1] for p in marked])), axis=1)
            sizes = young.begins[parts + 1] - young.begins[parts]
            young.add(marked, gathered(young.flat, young.begins, parts.ravel(), sizes.ravel()), sizes.sum(axis=1))


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str, most: int) -> Pieces:
    """This worker's pieces: they outlive a task."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path, most)
    return _PIECES[path]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID, block: int = BLOCK, cache: int = 500_000) -> None:
    """Encode every text, end_id after each, and write the coded ids in ascending doc_id order.

    A null text is empty; null doc_ids come first; rows with the same doc_id follow by text. The
    order comes from a range shuffle by doc_id and the first letters of the text, so that many rows
    without an id, or with one, are dealt to many parts; each part codes its documents in a stream.
    tokenizer_path must be a vocabulary that drops white space.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, shard = pieces_of(tokenizer_path, cache), TaskContext.get().partitionId()
        start = chunk = size = 0
        ids, parts, lengths = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal start, chunk, size, ids, parts, lengths
            flat = np.concatenate(parts)
            words, blocks, raw = encode_words(flat, block)
            row = {"shard": shard, "chunk": chunk, "start": start, "n_tokens": len(flat), "doc_ids": ids, "lengths": np.concatenate(lengths), "words": words.astype("<u8").tobytes(), "blocks": blocks.astype("<u4").tobytes(), "raw": raw.astype("<u4").tobytes()}
            start, chunk, size, ids, parts, lengths = start + len(flat), chunk + 1, 0, [], [], []
            return pa.RecordBatch.from_pylist([row], schema=_chunk_schema())

        for batch in batches:
            for part in slices(batch, 1, 6_000_000):
                coded, n = pieces.encode(part.column(1), end_id)
                ids += part.column(0).to_pylist()
                parts.append(coded)
                lengths.append(n)
                size += len(parts[-1])
                if size >= CHUNK_IDS:
                    yield flush()
        if ids:
            yield flush()
        pieces.rest()

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        .repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, CHUNK_SCHEMA).write.option("compression", "zstd").parquet(path))


def _chunk_schema() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("blocks", pa.binary()), ("raw", pa.binary())])


def _decoded(batch: pa.RecordBatch, block: int) -> Iterator[tuple[dict, np.ndarray]]:
    for row in batch.to_pylist():
        words, blocks, raw = (np.frombuffer(row[k], kind) for k, kind in (("words", "<u8"), ("blocks", "<u4"), ("raw", "<u4")))
        yield row, decode_words(words, blocks, raw, row["n_tokens"], block)


def _with_base(spark: SparkSession, path: str) -> DataFrame:
    """The chunks with the ids before their part; the totals are one row per part."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return chunks.join(F.broadcast(base), "shard")


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids, decoded from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids in _decoded(batch, block):
                ends = np.cumsum(row["lengths"])
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + row["start"] + ends - row["lengths"]), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], ["doc_id", "start", "ids"])

    return _with_base(spark, path).mapInArrow(decode, "doc_id long, start long, ids array<bigint>")


def digest_token_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, decoded from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids in _decoded(batch, block):
                flat, ends = ids.astype("<u4"), np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + row["start"] + starts), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _with_base(spark, path).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kindred.llm.registry import table

    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return digest_token_files(spark, path)
