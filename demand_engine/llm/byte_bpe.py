"""Byte-level BPE (operator 2): texts to token ids by the ranks of a vocabulary file, and back.

Pieces of the split pattern are put into padded matrices by length. Every round each row merges its leftmost pair of
lowest rank (found in a hashed table of pairs) and closes the gap. Distinct segments of a slice of texts are split and
merged once.

Nulls and empty texts have no tokens. No special tokens. Pieces of over ``LONG`` bytes take the same merges from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from demand_engine.llm.text import data_of, ranges, slices

NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
LONG = 2048
CELLS = 1 << 17  # of one matrix
SLICE = 1 << 20  # bytes of text whose distinct segments are split and merged together
LETTER = regex.compile("\\p{L}")
# A white-space character right before a space: there a space doesn't start a segment.
IRREGULAR = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "


class PairTable:
    """Open-addressing table from a pair of ids to the rank of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(rank) * 4).bit_length())
        keys = self.key(left, right)
        self.keys = np.full(1 << self.bits, EMPTY, np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        pending, slot = np.arange(len(keys)), self.slot(keys)
        while len(pending):
            free = self.keys[slot[pending]] == EMPTY
            places, first = np.unique(slot[pending[free]], return_index=True)
            placed = pending[free][first]
            self.keys[places], self.ranks[places] = keys[placed], rank[placed]
            pending = np.setdiff1d(pending, placed, assume_unique=True)
            slot[pending] = (slot[pending] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where there is no merge or an id is negative."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.nonzero((left >= 0) & (right >= 0))[0]
        keys = self.key(left[at], right[at])
        slot = self.slot(keys)
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.ranks[slot[hit]]
            more = ~hit & (there != EMPTY)
            at, keys, slot = at[more], keys[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out


    def get(self, left: int, right: int) -> int:
        """As ``find`` for one pair."""
        key = (left << 32) | right
        slot = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)
        while (there := int(self.keys[slot])) != key:
            if there == 2**64 - 1:
                return int(NONE)
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return int(self.ranks[slot])


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        pairs = []
        for token, rank in ranks.items():
            tokens[rank] = token
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a, b, rank))
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        # Tokens that their own merges don't give back are taken whole, as the library does.
        known = [t for t in tokens if 1 < len(t) <= LONG]
        flat, sizes = self.merged(np.frombuffer(b"".join(known), np.uint8), np.array([len(t) for t in known], np.int64))
        self.whole = {known[k]: ranks[known[k]] for k in np.nonzero(sizes != 1)[0]}

    def matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of single bytes padded by -1 (changed in place), one row after the other, and their counts."""
        out, sizes = np.full(ids.shape, -1, np.int32), np.zeros(len(ids), np.int64)
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), ids.shape[1] - 1)
        rows = np.arange(len(ids))
        while len(rows) and rank.shape[1]:
            at = rank.argmin(1)  # the leftmost of the lowest
            best = rank[np.arange(len(rows)), at]
            live = best != NONE
            if not live.all():
                out[rows[~live], : ids.shape[1]] = ids[~live]
                rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
            every = np.arange(len(rows))
            ids[every, at] = best
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            column = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), 1)
            if rank.shape[1]:
                before, after = every[at > 0], every[at < rank.shape[1]]
                left, right = at[before], at[after]
                found = self.pairs.find(np.concatenate([ids[before, left - 1], ids[after, right]]),
                                        np.concatenate([ids[before, left], ids[after, right + 1]]))
                rank[before, left - 1], rank[after, right] = found[: len(before)], found[len(before):]
        out[rows, : ids.shape[1]] = ids
        used = out >= 0
        np.sum(used, 1, out=sizes)
        return out[used], sizes

    def merged(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (one piece after the other) and counts of pieces given by their bytes and lengths."""
        starts, sizes = np.cumsum(lengths) - lengths, np.ones(len(lengths), np.int64)
        width = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.unique(width).tolist():
            members = np.nonzero(width == w)[0]
            if w <= 1:
                found.append((members[lengths[members] == 1], self.single[data[starts[members[lengths[members] == 1]]]]))
                sizes[members] = lengths[members]
            elif w > LONG:
                for k in members:
                    ids = self.long(data[starts[k]: starts[k] + lengths[k]])
                    sizes[k] = len(ids)
                    found.append((np.array([k]), ids))
            else:
                step = max(1, CELLS // w)
                for i in range(0, len(members), step):
                    part = members[i: i + step]
                    column = np.arange(w)
                    inside = column < lengths[part][:, None]
                    ids = np.full((len(part), w), -1, np.int32)
                    ids[inside] = self.single[data[(starts[part][:, None] + column)[inside]]]
                    ids, sizes[part] = self.matrix(ids)
                    found.append((part, ids))
        flat, at = np.zeros(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        for part, ids in found:
            flat[ranges(at[part], sizes[part])] = ids
        return flat, sizes

    def long(self, piece: np.ndarray) -> np.ndarray:
        """The same merges for a very long piece: a heap of (rank, position) over a linked list."""
        start = self.single[piece]
        ids = start.tolist()
        n = len(ids)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pairs.find(start[:-1], start[1:])
        at = np.nonzero(ranks != NONE)[0]
        heap = list(zip(ranks[at].tolist(), at.tolist()))
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = following[i]
            if ids[i] < 0 or j >= n or self.pairs.get(ids[i], ids[j]) != r:
                continue  # an entry of a pair that is gone
            ids[i], ids[j], following[i] = r, -1, following[j]
            if following[i] < n:
                before[following[i]] = i
            for a in (before[i], i):
                if a >= 0 and following[a] < n and (s := self.pairs.get(ids[a], ids[following[a]])) != NONE:
                    heapq.heappush(heap, (s, a))
        return np.array([i for i in ids if i >= 0], np.int32)

    def pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = data_of(pieces)
        flat, sizes = self.merged(data, np.diff(offsets))
        if self.whole:
            for k in np.nonzero(np.isin(np.diff(offsets), [len(t) for t in self.whole]))[0]:
                rank = self.whole.get(data[offsets[k]: offsets[k + 1]].tobytes())
                if rank is not None:
                    at = int(sizes[:k].sum())
                    flat, sizes[k] = np.concatenate([flat[:at], [rank], flat[at + sizes[k]:]]).astype(np.int32), 1
        return flat, sizes

    def segments(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of text segments: the letters in front are one piece, the pattern splits the rest."""
        lead = pc.extract_regex(texts, "^(?P<lead> ?\\p{L}+|)(?P<rest>(?s:.*))$")
        leads, rests = pc.struct_field(lead, 0).dictionary_encode(), pc.struct_field(lead, 1).dictionary_encode()
        # RE2 may know fewer letters than the pattern: such segments are split as a whole.
        missed = np.array([bool(LETTER.match(r)) for r in rests.dictionary.to_pylist()], bool)[rests.indices.to_numpy()]
        distinct: dict[str, int] = {}
        split = [[distinct.setdefault(p, len(distinct)) for p in self.pattern.findall(r)]
                 for r in [*rests.dictionary.to_pylist(), *texts.filter(pa.array(missed)).to_pylist()]]
        counts = np.array([len(x) for x in split], np.int64)
        order = np.array([p for x in split for p in x], np.int64)
        n_leads = len(leads.dictionary)
        flat, sizes = self.pieces(pa.concat_arrays([leads.dictionary, pa.array(list(distinct), pa.string())]))
        starts = np.cumsum(sizes) - sizes
        # Pieces of each segment: its lead, then those of its rest; missed ones have no lead.
        index = rests.indices.to_numpy().astype(np.int64)
        index[missed] = len(rests.dictionary) + np.arange(missed.sum())
        first = np.cumsum(counts) - counts
        piece = np.empty(len(texts) + int(counts[index].sum()), np.int64)
        at = np.cumsum(counts[index] + 1) - counts[index] - 1
        piece[at] = leads.indices.to_numpy()
        rest = np.ones(len(piece), bool)
        rest[at] = False
        piece[rest] = order[ranges(first[index], counts[index])] + n_leads
        size = sizes[piece]
        size[at[missed]] = 0
        total = np.add.reduceat(size, at) if len(at) else np.zeros(0, np.int64)
        return flat[ranges(starts[piece], size)], total

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of texts without nulls. A space after a non-space starts a segment; no piece crosses it."""
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar(""), texts), " ")
        flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = flat.dictionary_encode()
        firsts = np.cumsum(counts) - counts  # the first part of a text has no space before it; an odd text is one segment
        heads = pc.if_else(pa.array(odd), texts, flat.take(pa.array(firsts)))
        spaced = pc.binary_join_element_wise(pa.scalar(" "), parts.dictionary, pa.scalar(""))
        pool, sizes = self.segments(pa.concat_arrays([spaced, heads]))
        index = parts.indices.to_numpy().astype(np.int64)
        index[firsts] = len(spaced) + np.arange(len(heads))
        size = sizes[index]
        ids = pool[ranges((np.cumsum(sizes) - sizes)[index], size)]
        ends = np.concatenate(([0], np.cumsum(size)))
        return ends[np.concatenate(([0], np.cumsum(counts)))], ids

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and bytes of the texts that the ids stand for."""
        size = self.token_size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        return ends[offsets], self.token_bytes[ranges(self.token_start[ids], size)]


@lru_cache(maxsize=2)
def coder(vocabulary: bytes, pattern: str) -> ByteBpe:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
    return ByteBpe(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids). Other columns are not read.

    ``path`` is a rank file the driver can read; executors get its bytes (under 1 MB) by broadcast. A null text counts as
    empty. Repeated rows and null ids give a row each; an empty table gives an empty one.
    """
    with open(path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary.value, pattern)
        for batch in batches:
            doc_id, texts = batch.columns
            for a, b in slices(texts, SLICE):  # what a slice needs is gone before the next one
                offsets, ids = bpe.encode(pc.fill_null(texts.slice(a, b - a), ""))
                back, data = bpe.decode(offsets, ids)
                ids = ids.astype("<u4", copy=False)
                coded = [hashlib.sha256(ids[i:j]).hexdigest() for i, j in zip(offsets[:-1], offsets[1:])]
                decoded = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(back[:-1], back[1:])]
                columns = [doc_id.slice(a, b - a), pa.array(np.diff(offsets)), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, kind)
