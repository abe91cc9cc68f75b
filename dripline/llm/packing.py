"""Packing documents into sequences of a fixed length by first-fit decreasing.

1. Every document becomes its token ids and one end id. Words are looked up in a cache of each
   worker (:mod:`dripline.llm.pretokens`); what the cache has not seen is encoded by the library.
2. A document longer than a sequence is cut into full sequences, which need no partner, and a rest.
   Full pieces and rests are written once to the shared folder.
3. Rests are dealt into groups at random (by the hash of a row number, so that equal ids and equal
   texts spread), about ``group_docs`` in each, whatever the table holds.
4. In each group the rests are placed longest first, each in the first sequence with room for it.
   A tournament tree over the room left in the sequences finds that one in logarithmic time.
5. Sequences with more than ``most_padding`` ids of room are filled up by cutting the emptiest ones.
   What is left of the last one is cut into sequences whose lengths are powers of two, which are
   not padded. So a sequence has at most ``most_padding`` ids of padding, and most texts stay whole.

A group holds about ``group_docs`` pieces of less than a sequence: some 8 MB at most with the
defaults (ids below 65,536 travel as two bytes). No group sees how many rows the table has.

Defined results: a null or empty text is the end id alone. Every row is packed, also repeated rows
and rows with equal or null ids. Each id of a document lies in exactly one piece. A sequence has no
gaps from offset 0 on. An empty table gives no rows. Columns other than the named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dripline.llm.pretokens import Codes, Words
from dripline.llm.support import ship, store, strings

LENGTH = 4096
END_ID = 2
GROUP_DOCS = 1024
MOST_PADDING = 16
CACHE_SIZE = 1_000_000
_GROUP_CHARS = 1 << 20
_LOCAL_BITS = 24


class IdEncoder:
    """Token ids of whole texts as bytes of ``dtype``, from a cache of words."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        self.words = Words(path)
        small = self.words.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype = np.dtype("<u2" if small else "<u4")
        self.cache = Codes()
        self.cache_size = cache_size

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        cut = [self.words.of(text) for text in texts]
        known = [None if words is None else self.cache.of(words) for words in cut]
        if self.cache.new:
            without = self.cache.fill(self.words.encode_words(self.cache.new, self.dtype))
            if without:
                known = [
                    None if words is None or not without.isdisjoint(words) else found
                    for words, found in zip(cut, known, strict=True)
                ]
        out = [None if found is None else b"".join(found) for found in known]
        entire = [i for i, ids in enumerate(out) if ids is None]
        encoded = self.words.encode([texts[i] for i in entire])
        for i, ids in zip(entire, encoded, strict=True):
            out[i] = np.array(ids, dtype=self.dtype).tobytes()
        return out


_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """This worker's encoder for a tokenizer; it outlives the tasks that use it."""
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


class RoomTree:
    """A tournament tree over bins: every inner node holds the most room of the bins below it."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The first bin with room for ``size``, which it takes."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        found = i - self.leaves
        room[i] -= size
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
        return found


@dataclass
class Piece:
    """``length`` ids of an item, from its id number ``start`` on."""

    item: int
    start: int
    length: int


def first_fit_decreasing(lengths: Sequence[int], length: int) -> list[list[Piece]]:
    """Sequences of whole items, longest first, each in the first sequence that has room."""
    tree = RoomTree(len(lengths), length)
    bins: list[list[Piece]] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        place = tree.first_fit(lengths[item])
        if place == len(bins):
            bins.append([])
        bins[place].append(Piece(item, 0, lengths[item]))
    return bins


def _take(pieces: list[Piece], most: int) -> Piece:
    """The last piece of a sequence, or its first ``most`` ids if it is longer."""
    last = pieces[-1]
    if last.length <= most:
        return pieces.pop()
    head = Piece(last.item, last.start, most)
    last.start, last.length = last.start + most, last.length - most
    return head


def fill_up(bins: list[list[Piece]], length: int, most_padding: int) -> list[list[Piece]]:
    """Move the ids of the emptiest sequences into the room of the others; cut what is left of the
    last one into powers of two."""
    fill = [sum(p.length for p in pieces) for pieces in bins]
    order = sorted(range(len(bins)), key=lambda i: (-fill[i], i))
    first, last = 0, len(order) - 1
    while first < last:
        into, giver = order[first], order[last]
        room = length - fill[into]
        if room <= most_padding:
            first += 1
            continue
        moved = _take(bins[giver], room)
        bins[into].append(moved)
        fill[into] += moved.length
        fill[giver] -= moved.length
        if not bins[giver]:
            last -= 1
    kept = [bins[i] for i in order[:last]]
    if not order:
        return kept
    rest, left = bins[order[last]], fill[order[last]]
    if length - left <= most_padding:
        return [*kept, rest]
    while left:
        size = room = 1 << (min(left, length).bit_length() - 1)
        own: list[Piece] = []
        while room:
            own.append(_take(rest, room))
            room -= own[-1].length
        kept.append(own)
        left -= size
    return kept


def pack_lengths(
    lengths: Sequence[int], length: int = LENGTH, most_padding: int = MOST_PADDING
) -> list[list[Piece]]:
    """Sequences of at most ``length`` for items of at most that length."""
    return fill_up(first_fit_decreasing(lengths, length), length, most_padding)


def token_pieces(
    documents: DataFrame, tokenizer: str, doc_id: str, text: str, length: int, end_id: int
) -> DataFrame:
    """(row, doc_id, start, doc_tokens, n, ids) of full pieces (n = length) and rests (n < length).

    ``row`` numbers the pieces, each task from its own beginning; ids are bytes of the encoder's
    type.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        width = own.dtype.itemsize
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = strings(batch.column("text"))
            begin = size = 0
            for i, one in enumerate(texts):
                size += len(one)
                if size < _GROUP_CHARS and i + 1 < len(texts):
                    continue
                source, starts, totals, ids = [], [], [], []
                for j, found in enumerate(own.encode(texts[begin : i + 1]), begin):
                    found += end
                    n = len(found) // width
                    for start in range(0, n, length):
                        source.append(j)
                        starts.append(start)
                        totals.append(n)
                        ids.append(found[start * width : (start + length) * width])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(source), dtype=np.int64)),
                        batch.column("doc_id").take(pa.array(source, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array([len(x) // width for x in ids], pa.int32()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["row", "doc_id", "start", "doc_tokens", "n", "ids"],
                )
                row += len(source)
                begin, size = i + 1, 0

    return docs.mapInArrow(
        run,
        f"row long, doc_id {id_type}, start long, doc_tokens long, n int, ids binary",
    )


def pack(
    documents: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    group_docs: int = GROUP_DOCS,
    most_padding: int = MOST_PADDING,
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of each piece.

    ``start`` counts the document's ids before the piece, ``doc_tokens`` all of them with the end
    id; ``offset`` is the place in the sequence. ``ids`` holds the piece's ids as unsigned 32-bit
    numbers, little-endian. ``tokenizer`` is the path of a ``.json`` file on every machine.
    """
    ship(documents.sparkSession)
    pieces = store(token_pieces(documents, tokenizer, doc_id, text, length, end_id), "pieces")
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    output = (
        f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, "
        "offset long, ids binary"
    )

    def as_32_bits(ids: bytes) -> bytes:
        return np.frombuffer(ids, dtype=encoder(tokenizer).dtype).astype("<u4").tobytes()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            # Even numbers are for the groups.
            number = 2 * batch.column("row").to_numpy() + 1
            ids = [as_32_bits(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("start"),
                    pa.array(np.full(n, length, np.int64)),
                    batch.column("doc_tokens"),
                    pa.array(number),
                    pa.array(np.zeros(n, np.int64)),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        first = group.column("group")[0].as_py() << _LOCAL_BITS
        sizes = group.column("n").to_pylist()
        texts = group.column("ids").to_pylist()
        starts = group.column("start").to_pylist()
        width = encoder(tokenizer).dtype.itemsize
        source, start, size, number, offsets, ids = [], [], [], [], [], []
        for k, members in enumerate(pack_lengths(sizes, length, most_padding)):
            offset = 0
            for piece in members:
                source.append(piece.item)
                start.append(starts[piece.item] + piece.start)
                size.append(piece.length)
                number.append(2 * (first + k))
                offsets.append(offset)
                own = texts[piece.item][piece.start * width : (piece.start + piece.length) * width]
                ids.append(as_32_bits(own))
                offset += piece.length
        at = pa.array(source, pa.int64())
        return pa.table(
            {
                "doc_id": group.column("doc_id").take(at),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(size, pa.int64()),
                "doc_tokens": group.column("doc_tokens").take(at),
                "sequence_id": pa.array(number, pa.int64()),
                "offset": pa.array(offsets, pa.int64()),
                "ids": pa.array(ids, pa.binary()),
            }
        )

    rests = pieces.where(F.col("n") < length)
    n_groups = max(1, -(-rests.count() // group_docs))
    group = F.pmod(F.xxhash64("row"), F.lit(n_groups)).alias("group")
    return (
        rests.select(group, "*")
        .groupBy("group")
        .applyInArrow(packed, output)
        .unionByName(pieces.where(F.col("n") == length).mapInArrow(whole, output))
    )
