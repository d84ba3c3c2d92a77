"""LM scoring (operator 5): a weighted backoff automaton of smoothed n-grams (n up to 2).

States are the words seen in training (and the start of a text). The arc of word w out of state h has
log10((c(hw) + mu P(w)) / (c(h) + mu)) if the pair was seen; else the failure arc of weight log10(mu / (c(h) + mu)) leads
to the root, whose arcs are P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). An unseen word leads back to the root. One pass from
left to right carries the state of every text and adds up the weights.

The model is never in one place. Documents are dealt to blocks of about ``BLOCK`` bytes of text. Each block counts its
distinct n-grams, known by 64-bit hashes, and sends them, sorted and packed by hash range, to the range's bucket; a
bucket adds up and answers each block with the totals of what it asked for, and the block builds the part of the automaton
that its own texts can reach. What is shuffled grows with the distinct n-grams of each block, what a task holds with the
block and bucket sizes, which are fixed.

Null texts are empty: they have the end token only. A null id counts as an empty text in the fold and so is held out.
Repeated rows count and are scored each; rows are dealt to blocks by their place, so they
don't meet in one. A very long text makes its block longer, and is worked on whole. Ties can't matter. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demand_engine.llm.text import slices, sums, words

BLOCK = 16 << 20
BUCKET = 3_000_000  # n-grams of all blocks in one bucket, about
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)  # keys of the end and of the start state
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    added: float = 0.1  # to every count of the root
    mu: float = 20.0  # weight of the root in a state


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def keys_of(dictionary: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(dictionary))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left ^ (left >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + right
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def vocabulary(docs: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens (with the end) of the documents to learn from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens = np.zeros(0, np.uint64), 0
        for batch in batches:
            fresh = [seen]
            for a, b in slices(batch.column(0)):
                offsets, flat = words(batch.column(0).slice(a, b - a), lower=True)
                tokens += int(offsets[-1]) + b - a
                fresh.append(keys_of(flat.dictionary_encode().dictionary))
            seen = np.unique(np.concatenate(fresh))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, END).view(np.int64)), pa.array(np.append(np.zeros(len(seen), np.int64), tokens))], ["key", "n"])

    found = docs.where(~held_out()).select("text").mapInArrow(count, "key bigint, n bigint")
    got = found.groupBy("key").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.count("*")).first()
    return int(got[0] or 0), int(got[1])


@dataclass
class Tokens:
    """Tokens of a block's texts, each text with the end behind: places in the sorted word keys, and keys of the pairs with the state before."""

    offsets: np.ndarray
    words: np.ndarray  # distinct keys in order, with those of the end and of the start state
    place: np.ndarray
    pairs: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    found, parts, sizes = [np.array([END, BEGIN])], [], []
    for a, b in slices(texts):
        offsets, flat = words(texts.slice(a, b - a), lower=True)
        coded = flat.dictionary_encode()
        out = np.zeros(int(offsets[-1]) + b - a, np.int32)  # 0: the end
        inside = np.ones(len(out), bool)
        inside[offsets[1:] + np.arange(b - a)] = False
        out[inside] = coded.indices.to_numpy() + sum(map(len, found))
        found.append(keys_of(coded.dictionary))
        parts.append(out)
        sizes.append(np.diff(offsets) + 1)
    keys, number = np.unique(np.concatenate(found), return_inverse=True)
    place = number.astype(np.int32)[np.concatenate([*parts, np.zeros(0, np.int32)])]
    ends = np.concatenate(([0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))))
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[ends[:-1]] = number[1]  # the start
    return Tokens(ends, keys, place, pair_keys(keys[before], keys[place]))


def pack(values: np.ndarray) -> bytes:
    """Byte planes, so that the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, len(data) // width).T).view(kind).ravel()


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each hash range starts in sorted keys."""
    limits = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(limits, np.uint64)), [len(keys)])).astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[bytes], list[bytes]]:
    """Sorted keys, as differences, and their counts, for each hash range."""
    cuts = bucket_cuts(keys, buckets)
    ranges_ = list(zip(cuts[:-1], cuts[1:]))
    return [pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in ranges_], [pack(counts[a:b]) for a, b in ranges_]


def count_block(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = tokens(table["text"].combine_chunks())
        train = ~table["held_out"].combine_chunks().to_numpy(zero_copy_only=False)
        kept = np.repeat(train, np.diff(t.offsets))
        count = np.bincount(t.place[kept], minlength=len(t.words)).astype(np.uint32)
        count[np.searchsorted(t.words, BEGIN)] += train.sum()
        pairs = np.sort(t.pairs)
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]
        there = np.sort(t.pairs[kept])
        count_pairs = (np.searchsorted(there, pairs, "right") - np.searchsorted(there, pairs, "left")).astype(np.uint32)
        made = [*packed(t.words, count, buckets), *packed(pairs, count_pairs, buckets)]
        used = [k for k in range(buckets) if made[0][k] or made[2][k]]
        return pa.table({"bucket": pa.array(used, pa.int64()), "block": pa.array(np.full(len(used), key[0].as_py())),
                         **{name: pa.array([x[k] for k in used], pa.binary()) for name, x in zip(("words", "word_counts", "pairs", "pair_counts"), made)}})

    return run


def sum_up(keys: list[bytes], counts: list[bytes]) -> list[bytes]:
    """The totals over all blocks of each key, for each block in the order of its own keys."""
    asked = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in keys]
    every = np.concatenate(asked)
    if not len(every):
        return [b""] * len(keys)
    order = np.argsort(every)
    new = np.concatenate([[True], every[order[1:]] != every[order[:-1]]])
    group = np.cumsum(new) - 1
    count = np.concatenate([unpack(c, np.uint32) for c in counts]).astype(np.uint64)
    answer = np.empty(len(every), np.uint64)
    answer[order] = np.add.reduceat(count[order], np.nonzero(new)[0])[group]
    cuts = np.cumsum([0] + [len(a) for a in asked])
    return [pack(answer[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def add_up(table: pa.Table) -> pa.Table:
    made = [sum_up(table[k].to_pylist(), table[n].to_pylist()) for k, n in (("words", "word_counts"), ("pairs", "pair_counts"))]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "words": pa.array(made[0], pa.binary()), "pairs": pa.array(made[1], pa.binary())})


@dataclass
class Automaton:
    """The part of the automaton that a block's texts can reach. States are words; arcs of the root and failure arcs by word."""

    root: np.ndarray  # log10 weight of each word's arc out of the root
    failure: np.ndarray  # log10 weight of each state's failure arc to the root; 0 where the word is no state
    arcs: np.ndarray  # log10 weight of each pair's arc out of the state of its first word; no number where there is none

    def walk(self, state: np.ndarray, word: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """Weight of one step of many traversals: along the arc, or the failure arc and then the root's."""
        step = self.arcs[arc]
        fails = np.isnan(step)
        step[fails] = self.failure[state[fails]] + self.root[word[fails]]
        return step


def built(c: np.ndarray, c_pair: np.ndarray, first: np.ndarray, last: np.ndarray, train_tokens: int, train_types: int, s: Settings) -> Automaton:
    """From the counts of words (of the start: of texts) and pairs, and the words that the pairs join."""
    p = (c + s.added) / (train_tokens + s.added * (train_types + 1))
    failure, seen = np.zeros(len(c)), c_pair > 0
    failure[c > 0] = np.log10(s.mu / (c[c > 0] + s.mu))
    arcs = np.full(len(c_pair), np.nan)
    arcs[seen] = np.log10((c_pair[seen] + s.mu * p[last[seen]]) / (c[first[seen]] + s.mu))
    return Automaton(np.log10(p), failure, arcs)


def score_block(train_tokens: int, train_types: int, s: Settings):
    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        t = tokens(texts["text"].combine_chunks())
        totals = totals.sort_by("bucket")
        c, c_pair = (np.concatenate([np.zeros(0, np.uint64), *(unpack(x, np.uint64) for x in totals[k].to_pylist())]).astype(np.float64) for k in ("words", "pairs"))
        # The state before each token is the word before it, so all steps of the traversal can be taken at once.
        state = np.empty_like(t.place)
        state[1:] = t.place[:-1]
        state[t.offsets[:-1]] = np.searchsorted(t.words, BEGIN)
        order = np.argsort(t.pairs)
        t.pairs = t.pairs[order]
        new = np.concatenate([[True], t.pairs[1:] != t.pairs[:-1]])[: len(order)]
        t.pairs = None
        arc = np.empty(len(order), np.int32)
        arc[order] = np.cumsum(new, dtype=np.int32) - 1
        one = order[new]
        del order, new
        made = built(c, c_pair, state[one], t.place[one], train_tokens, train_types, s)
        weight = made.walk(state, t.place, arc)
        n = len(t.offsets) - 1
        return pa.table({
            "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": pa.array(np.diff(t.offsets)),
            "n_known": pa.array(sums(c[t.place] > 0, t.offsets)), "train_tokens": pa.array(np.full(n, train_tokens, np.int64)),
            "base_score": pa.array(sums(made.root[t.place], t.offsets)), "score": pa.array(sums(weight, t.offsets))})

    return run


def score_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: the columns of ``SCORED``."""
    n_tokens, n_types = vocabulary(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    buckets = max(1, -(-2 * n_tokens // BUCKET))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"),
                        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))  # repeated rows are dealt out, too
    asked = dealt.groupBy("block").applyInArrow(count_block(buckets), "bucket bigint, block bigint, words binary, word_counts binary, pairs binary, pair_counts binary")
    totals = asked.groupBy("bucket").applyInArrow(add_up, "block bigint, bucket bigint, words binary, pairs binary")
    return dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score_block(n_tokens, n_types, s), SCORED)
