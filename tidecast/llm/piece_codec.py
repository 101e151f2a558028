"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut into units (a run of spaces and the word after it; no piece goes
on past such a boundary).  A task keeps the ids of up to KEPT_UNITS units that it
met; a batch's distinct units that are not among them are concatenated and indexed
by a suffix array over packed character codes.  Every piece of the vocabulary is
looked up by binary search, which gives the range of its occurrences; the
occurrences are edges, laid by position into a table.  Relaxation then settles every unit: starting
from single characters, the adjacent pair whose joint edge ranks best is merged
until no pair has an edge (the model is a merge model, so that order, and not
the best sum of scores, gives the library's pieces).  All units of a batch take
a step at a time in numpy; very long units are relaxed with a heap.

The vocabulary file is read on the driver (its size is fixed, under 1 MB) and
sent with the task.

Defined results: null or empty text gives no pieces, and none decode to the
empty text; bytes that are not UTF-8 become U+FFFD; the character U+2581 stands
for a space, as in the library, so it decodes to one; rows that repeat an id
are encoded on their own; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 48              # units of more characters are relaxed with a heap
INDEX_CHARS = 100_000  # characters that one suffix array indexes
CHUNK_BYTES = 2 << 20  # of texts that a task splits at once
BLOCK_UNITS = 8_000    # units that are relaxed side by side
KEPT_UNITS = 200_000   # above that a task forgets the units that its last batch did not use
NONE = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a merge model with byte fallback, by id."""

    pieces: tuple[str, ...]    # "" where the id is no ordinary piece
    ranks: tuple[int, ...]     # 0 merges first; equal scores share a rank
    bytes_at: int              # id of byte 0

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids]
        pieces = tuple(sp.id_to_piece(i) if ok else "" for i, ok in zip(ids, plain, strict=True))
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in ids if plain[i]}, reverse=True))}
        ranks = tuple(order[sp.get_score(i)] if plain[i] else int(NONE) for i in ids)
        return cls(pieces, ranks, next(i for i in ids if sp.is_byte(i)))

    @cached_property
    def width(self) -> int:
        return max(map(len, self.pieces))

    @cached_property
    def rank_of(self) -> np.ndarray:
        return np.array([*self.ranks, NONE], np.int32)  # the last stands for "no piece"

    @cached_property
    def units(self) -> re.Pattern | None:
        """Splits a text into units; None if a piece holds a space after another character."""
        inner = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        return None if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the pieces, their code points (padded with 0) and lengths."""
        ids = np.array([i for i, p in enumerate(self.pieces) if p])
        chars = np.zeros((len(ids), self.width), np.uint32)
        for row, i in enumerate(ids):
            chars[row, :len(self.pieces[i])] = list(map(ord, self.pieces[i]))
        return ids, chars, np.array([len(self.pieces[i]) for i in ids])

    @cached_property
    def alphabet(self) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' distinct characters, and ``codes``'s characters as places in them (from 1; 0 pads)."""
        _, chars, _ = self.codes
        letters, at = np.unique(chars, return_inverse=True)
        if len(letters) and not letters[0]:
            return letters[1:], at.reshape(chars.shape).astype(np.int32)
        return letters, at.reshape(chars.shape).astype(np.int32) + 1

    @cached_property
    def outputs(self) -> list[bytes]:
        out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b in range(256):
            out[self.bytes_at + b] = bytes([b])
        return out


def edges(points: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Table [position, length] -> id of the piece that matches there, or -1.

    ``points``: code points of the concatenated units, 0 between them."""
    ids, _, lengths = vocabulary.codes
    letters, spelled = vocabulary.alphabet
    width, n = vocabulary.width, len(points)
    table = np.full((n, width + 2), -1, np.int32)  # the last column stays empty: longer than any piece
    code_of = np.zeros(0x110000, np.uint32)
    code_of[points] = 1
    code_of[0] = 0
    used = np.flatnonzero(code_of[letters])
    if not len(used):
        return table
    code_of[points] = 0
    code_of[letters[used]] = np.arange(1, len(used) + 1)
    text = code_of[points].astype(np.uint64)
    small = np.zeros(len(letters) + 1, np.uint64)
    small[used + 1] = np.arange(1, len(used) + 1)
    piece = small[spelled]
    present = ((piece > 0) | (spelled == 0)).all(axis=1)
    ids, piece, lengths = ids[present], piece[present], lengths[present]
    bits = int(len(used)).bit_length()
    per = 63 // bits
    levels = -(-width // per)
    padded = np.concatenate([text, np.zeros(levels * per, np.uint64)])

    # suffix array of the positions that hold a known character, by packed words of `per` characters
    word = np.zeros(n, np.uint64)
    for j in range(per):
        word <<= np.uint64(bits)
        word |= padded[j:j + n]
    at = np.flatnonzero(text)
    word = word[at]
    order = np.argsort(word)
    word, suffixes = word[order], at[order]

    # binary search: per level the class of equal prefixes, then the range of the last, partial word
    group = np.zeros(len(suffixes), np.int64)   # classes of the suffixes in order
    holds = np.zeros(len(ids), np.int64)        # class of each piece so far
    alive = np.ones(len(ids), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(levels):
        if level:  # only suffixes that begin like a longer piece go on
            wanted = np.zeros(group[-1] + 1 if len(group) else 0, bool)
            wanted[holds[alive]] = True
            on = wanted[group]
            suffixes, group = suffixes[on], group[on]
            if not len(suffixes):
                break
            word = np.zeros(len(suffixes), np.uint64)
            for j in range(level * per, (level + 1) * per):
                word = (word << np.uint64(bits)) | padded[suffixes + j]
            order = np.lexsort((word, group))
            suffixes, group, word = suffixes[order], group[order], word[order]
        if level:
            known, place = np.unique(word, return_inverse=True)
        else:
            place = np.cumsum(np.r_[False, word[1:] != word[:-1]])
            known = word[np.r_[True, place[1:] != place[:-1]]]
        code = group * (len(known) + 1) + place
        low = np.zeros(len(ids), np.uint64)
        for j in range(per):
            k = level * per + j
            low = (low << np.uint64(bits)) | (piece[:, k] if k < width else np.uint64(0))
        rest = np.clip((level + 1) * per - lengths, 0, per).astype(np.uint64)
        high = low | ((np.uint64(1) << (rest * np.uint64(bits))) - np.uint64(1))
        first = holds * (len(known) + 1) + np.searchsorted(known, low, "left")
        last = holds * (len(known) + 1) + np.searchsorted(known, high, "right")
        start, end = np.searchsorted(code, first, "left"), np.searchsorted(code, last, "left")
        ending = alive & (lengths <= (level + 1) * per) & (end > start)
        count = end[ending] - start[ending]
        which = np.repeat(ids[ending], count)
        run = np.repeat(start[ending] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(which))
        found.append((suffixes[run], which))
        alive &= (lengths > (level + 1) * per) & (end > start)
        fresh = np.r_[False, code[1:] != code[:-1]]
        group = np.cumsum(fresh)
        holds = np.where(alive, group[np.minimum(start, len(group) - 1)], 0)
    size = np.zeros(len(vocabulary.pieces), np.int64)
    size[ids] = lengths
    where, which = (np.concatenate(x) for x in zip(*found, strict=True))
    table[where, size[which]] = which
    return table


def relax(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rank_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merges every unit's best-ranked adjacent pair (the leftmost of equals) until none
    is left: (unit, start, end) of the symbols, ordered."""
    over = table.shape[1] - 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    def ranked(first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Ranks of the pairs first..middle..last; an empty second symbol lies beyond the unit's end."""
        length = np.minimum(last - first, over)
        length[last == middle] = over
        return rank_of[table[first, length]]

    by_length = np.argsort(lengths, kind="stable")
    by_length = by_length[lengths[by_length] <= LONG]
    for block in np.array_split(by_length, max(1, -(-len(by_length) // BLOCK_UNITS))):
        unit, most = block, int(lengths[block].max(initial=0))
        bounds = starts[unit][:, None] + np.minimum(np.arange(most + 1), lengths[unit][:, None])
        rank = ranked(bounds[:, :-2], bounds[:, 1:-1], bounds[:, 2:])
        while len(unit):
            row = np.arange(len(unit))
            if rank.shape[1]:
                best = rank.argmin(axis=1)
                open_ = rank[row, best] < NONE
            else:
                open_ = np.zeros(len(unit), bool)
            if not open_.all():
                done = bounds[~open_]
                row, col = np.nonzero(done[:, 1:] > done[:, :-1])
                out.append((unit[~open_][row], done[row, col], done[row, col + 1]))
                unit, bounds, rank = unit[open_], bounds[open_], rank[open_]
                if not len(unit):
                    break
                best, row = best[open_], np.arange(len(unit))
            keep = np.ones(bounds.shape, bool)
            keep[row, best + 1] = False
            bounds = bounds[keep].reshape(len(unit), -1)
            rank = rank[keep[:, 1:-1]].reshape(len(unit), -1)
            if rank.shape[1]:  # only the pairs that the merged symbol is part of have changed
                for at in (np.maximum(best - 1, 0), np.minimum(best, rank.shape[1] - 1)):
                    rank[row, at] = ranked(bounds[row, at], bounds[row, at + 1], bounds[row, at + 2])
    for u in np.flatnonzero(lengths > LONG):
        cuts = _relax_long(table, int(starts[u]), int(lengths[u]), rank_of)
        out.append((np.full(len(cuts) - 1, u), cuts[:-1], cuts[1:]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    unit, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((start, unit))
    return unit[order], start[order], end[order]


def _relax_long(table: np.ndarray, start: int, n: int, rank_of: np.ndarray) -> np.ndarray:
    after = list(range(1, n + 1))   # symbol at i ends at after[i]; 0 once merged away
    before = list(range(-1, n))     # start of the symbol before
    widest = table.shape[1] - 2
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i < 0 or after[i] >= n:
            return
        end = after[after[i]]
        if end - i <= widest:
            rank = int(rank_of[table[start + i, end - i]])
            if rank < NONE:
                heapq.heappush(heap, (rank, i, end))
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = after[i]
        if not middle or middle >= n or after[middle] != end:
            continue  # one of the two symbols has changed
        after[i], after[middle] = end, 0
        if end < n:
            before[end] = i
        offer(before[i])
        offer(i)
    cuts, i = [0], 0
    while i < n:
        i = after[i]
        cuts.append(i)
    return start + np.array(cuts)


def encode_units(units: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units in a row and the number of each unit's."""
    values, counts = [], []
    for part in _parts(units):
        points = np.frombuffer(("\0".join(part) + "\0").encode("utf-32-le"), np.uint32).copy()
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
        table = edges(points, vocabulary)
        unit, start, end = relax(table, starts, lengths, vocabulary.rank_of)
        ids = table[start, end - start]
        unknown = ids < 0  # single characters without a piece: their bytes
        point = points[start]
        width = np.where(unknown, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        out = np.repeat(ids, width)
        if unknown.any():
            tail = np.concatenate([np.frombuffer(chr(p).encode(), np.uint8) for p in point[unknown].tolist()])
            out[np.repeat(unknown, width)] = vocabulary.bytes_at + tail.astype(np.int32)
        values.append(out.astype(np.int32))
        counts.append(np.bincount(unit, weights=width, minlength=len(part)).astype(np.int64))
    if not values:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(counts)


def _parts(units: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for u in units:
        part.append(u)
        held += len(u) + 1
        if held >= INDEX_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


class _Numbers(dict):
    """Numbers units in the order in which they are met."""

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


class Encoder:
    """Encodes batch after batch and keeps the ids of units that it met."""

    def __init__(self, vocabulary: Vocabulary, most: int = KEPT_UNITS):
        self.vocabulary, self.most = vocabulary, most
        self.known = _Numbers()
        self.values = np.zeros(0, np.int32)     # the ids of all known units in a row
        self.counts = np.zeros(0, np.int64)     # and the number of each unit's

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and the offsets of the texts in them."""
        units, before = self.vocabulary.units, len(self.known)
        codes, lengths = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                marked = SPACE + t.replace(" ", SPACE)
                split = units.findall(marked) if units else [marked]
                codes.append(np.fromiter(map(self.known.__getitem__, split), np.int32, len(split)))
                lengths[i] = len(split)
        codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        values, counts = encode_units(list(islice(self.known, before, None)), self.vocabulary)
        self.values, self.counts = np.concatenate([self.values, values]), np.concatenate([self.counts, counts])
        ends = np.r_[0, np.cumsum(self.counts[codes])]
        found = self._ids(codes), ends[np.r_[0, np.cumsum(lengths)]]
        if len(self.known) > self.most:
            self._forget(codes)
        return found

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        """The ids of the known units ``codes`` in a row."""
        many = self.counts[codes]
        first = (np.cumsum(self.counts) - self.counts)[codes]
        ends = np.cumsum(many)
        return self.values[np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]

    def _forget(self, codes: np.ndarray) -> None:
        """Keeps the units ``codes`` alone."""
        used = np.flatnonzero(np.bincount(codes, minlength=len(self.known)))
        names = list(self.known)
        self.known = _Numbers((names[i], k) for k, i in enumerate(used.tolist()))
        self.values, self.counts = self._ids(used), self.counts[used]


def encode_batch(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row and the offsets of the texts in them."""
    return Encoder(vocabulary)(texts)


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of the ids (the space that encoding puts first is taken off again)."""
    out = vocabulary.outputs
    text = b"".join([out[i] for i in ids])
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    start, held = 0, 0
    sizes = [len(v) if v is not None else 0 for v in (x.as_buffer() for x in batch.column(column))]
    for i, size in enumerate(sizes):
        if i > start and held + size > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip (whether the ids decode to the text)."""
    vocabulary = Vocabulary.read(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in _pieces(batch, 1):
                texts = [t.decode("utf-8", "replace") for t in part.column(1).to_pylist()]
                values, offsets = encoder(texts)
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                same = [decode(values[a:b].tolist(), vocabulary) == t.replace(SPACE, " ")
                        for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets), pa.int32()), listed, pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "token_ids", "round_trip"])
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, token_ids) -> doc_id, text."""
    vocabulary = Vocabulary.read(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(ids or [], vocabulary) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, text string")
