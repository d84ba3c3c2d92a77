"""Phrase collocation mining (operator 13): a weighted de Bruijn graph of words.

Texts are split into pieces and words. Nodes are runs of ``LONGEST - 1`` words, an edge is a run of ``LONGEST`` words
between two overlapping nodes and weighs its occurrences. Only edges are counted over the corpus; shorter phrases come
from the flow: a node occurs as often as the edges that leave it weigh, plus the pieces that end in it, and in the same
way pairs get their counts from nodes and words from pairs.

A phrase can't be frequent if one of its words, or of its pairs of neighbours, is not, so pieces are cut at rare words and
within rare pairs first (such a cut is a piece end like any other, and the flow stays exact). Words are therefore counted
before the graph, and pairs by 32-bit hashes. What is frequent is known to the tasks by two bitmaps of fixed size (``BITS``), set
at the hashes of frequent words and pairs: what collides with one is merely not cut at, so no result depends on a hash.
Slices of text count their distinct edges by whole numbers and send them as words.

Unary paths of the frequent graph (a node with one edge in and one out, of equal weight) are compacted by pointer
doubling into long phrases of one weight; they say which shorter candidates lie inside an edge of what weight.

Null texts are empty, a null language is ``und``. Repeated rows count each. Very long texts are a slice of their own. Ties of
score and count go by phrase. Other columns are not read. An empty table, or one without a frequent phrase, gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demand_engine.llm.text import data_of, keep_table, ranges, slices, words

LONGEST = 4  # words of an edge
BITS = 27  # the bitmap of frequent words has 2^27 bits, 16 MB, at every size of the corpus
PART = 23  # pair hashes are counted in 2^(32 - 23) parts
PAIRS = 8_000_000  # pairs of words that a task counts before it sends them
SEED = 42  # of Spark's xxhash64
CHUNK = 1024  # edges of a compacted path in one row
DEALT = 64  # parts that the candidates of a language are ranked in first
BREAKS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
MINED = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"


@dataclass(frozen=True)
class Settings:
    least: int = 30  # occurrences of a candidate
    scale: int = 2_000_000  # of the score
    inside: int = 80  # per cent of a candidate's occurrences in a longer one that drop it
    top: int = 2000  # per language


@dataclass
class Pieces:
    """The words of a slice of texts: code of (language, word), piece of each, and the words written one after the other."""

    codes: np.ndarray
    piece: np.ndarray
    langs: pa.Array  # of the codes
    words: pa.Array
    keys: np.ndarray
    flat: pa.Array


def classes() -> np.ndarray:
    """Byte to byte: A-Z lower-cased, breaks as line feeds, tabs as blanks."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(BREAKS)] = 10
    table[9] = 32
    return table


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left ^ (left >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def keys_of(langs: pa.Array, lang_of: np.ndarray, words_: pa.Array, word_of: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(lang, word)`` of each pair of language and word."""
    seeds = [xxhash.xxh64_intdigest(lang, SEED) for lang in langs.cast(pa.binary()).to_pylist()]
    plain, digest = words_.cast(pa.binary()).to_pylist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(plain[w], seeds[x]) for x, w in zip(lang_of.tolist(), word_of.tolist())), np.uint64, len(word_of))


def pieces(texts: pa.Array, langs: pa.Array) -> Pieces:
    data, offsets = data_of(pc.fill_null(texts, ""))
    data = classes()[data]
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    ends, flat = words(plain)
    blank = (data == 10) | (data == 32)
    first = np.ones(len(data), bool)
    first[1:] = blank[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.nonzero(first & ~blank)[0]
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    piece = np.cumsum(data == 10, dtype=np.int64)[starts] + text if len(starts) else np.zeros(0, np.int64)
    word, lang = flat.dictionary_encode(), pc.fill_null(langs, UNKNOWN).dictionary_encode()
    pair = lang.indices.to_numpy()[text].astype(np.int64) * max(1, len(word.dictionary)) + word.indices.to_numpy()
    found, codes = np.unique(pair, return_inverse=True)
    lang_of, word_of = np.divmod(found, max(1, len(word.dictionary)))
    return Pieces(codes, piece, lang.dictionary.take(pa.array(lang_of)), word.dictionary.take(pa.array(word_of)),
                  keys_of(lang.dictionary, lang_of, word.dictionary, word_of), flat)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word; the row without a word has all words of the language."""
    for batch in batches:
        texts, langs = batch.columns
        for a, b in slices(texts):
            p = pieces(texts.slice(a, b - a), langs.slice(a, b - a))
            if not len(p.codes):
                continue
            n = np.bincount(p.codes, minlength=len(p.keys))
            coded = p.langs.dictionary_encode()
            whole = np.bincount(coded.indices.to_numpy(), weights=n, minlength=len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([p.langs, coded.dictionary]), pa.concat_arrays([p.words, pa.nulls(len(whole), pa.string())]),
                                              pa.array(np.concatenate([n, whole]))], ["lang", "word", "n"])


def frequent_words(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, n) of the words with ``least`` occurrences, and (lang, null, n) for all words of a language."""
    counted = docs.select("text", "lang").mapInArrow(word_counts, "lang string, word string, n bigint")
    total = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return keep_table(total.where((F.col("n") >= least) | F.col("word").isNull()), "words")


def word_bits(frequent: DataFrame) -> np.ndarray:
    """2^BITS bits as bytes. The driver gets 4 KB for each part of the bitmap that has a bit set, 16 MB at most."""
    place = F.shiftrightunsigned(F.xxhash64("lang", "word"), 64 - BITS) + 1
    parts = (frequent.where("word is not null").select(place.alias("place"))
             .groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")))
    return joined_bits(parts, 4096)


def joined_bits(parts: DataFrame, width: int) -> np.ndarray:
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for row in parts.toLocalIterator():
        out[(row["part"] - 1) * width: row["part"] * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def known_words(p: Pieces, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the frequent words, and which of them follow the one before without a gap in the same piece."""
    at = np.nonzero(has(bits, (p.keys >> np.uint64(64 - BITS)).astype(np.int64))[p.codes])[0]
    follows = np.zeros(len(at), bool)
    follows[1:] = (np.diff(at) == 1) & (np.diff(p.piece[at]) == 0)
    return at, follows


def pair_places(p: Pieces, at: np.ndarray, second: np.ndarray) -> np.ndarray:
    """32-bit hash of the pair of words that ends at each of ``at[second]``."""
    key = p.keys[p.codes[at]]
    return (mixed(key[second - 1], key[second]) >> np.uint64(32)).astype(np.uint32)


def pair_counts(bits: np.ndarray, least: int):
    """How often each pair hash occurs, sorted and packed by its upper bits; counts stop at ``least``, which is all that is asked."""

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint32)]), return_counts=True)
        low = (value & np.uint32((1 << PART) - 1)).astype(np.uint32)
        cuts = np.searchsorted(value >> np.uint32(PART), np.arange((1 << (32 - PART)) + 1))
        rows = np.nonzero(np.diff(cuts))[0]
        n = np.minimum(n, min(least, 65535)).astype(np.uint16)
        return pa.RecordBatch.from_arrays([pa.array((rows + 1).astype(np.int32)), pa.array([low[cuts[k]: cuts[k + 1]].tobytes() for k in rows], pa.binary()),
                                           pa.array([n[cuts[k]: cuts[k + 1]].tobytes() for k in rows], pa.binary())], ["part", "pairs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            texts, langs = batch.columns
            for a, b in slices(texts):
                p = pieces(texts.slice(a, b - a), langs.slice(a, b - a))
                at, follows = known_words(p, bits)
                found.append(pair_places(p, at, np.nonzero(follows)[0]))
                size += len(found[-1])
                if size > PAIRS:
                    yield packed(found)
                    found, size = [], 0
        if size:
            yield packed(found)

    return run


def summed_pairs(least: int):
    """Adds up one part of the pair hashes, batch by batch; a bit is set if one of its 32 hashes has ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(1 << PART, np.uint32), None
        for batch in batches:
            part = batch["part"][0]
            for pairs, n in zip(batch["pairs"], batch["n"]):
                low = np.frombuffer(pairs.as_buffer(), np.uint32)
                total[low] = np.minimum(total[low] + np.frombuffer(n.as_buffer(), np.uint16), 1 << 30)
        bits = np.packbits((total >= min(least, 65535)).reshape(-1, 1 << (32 - BITS)).any(1), bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    return run


def pair_bits(docs: DataFrame, bits: np.ndarray, least: int) -> np.ndarray:
    """The bitmap of frequent pairs, of the size of that of words; the driver gets its 16 MB in parts."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    packed = docs.select("text", "lang").mapInArrow(lambda b: pair_counts(sent.value, least)(b), "part int, pairs binary, n binary")
    parts = keep_table(packed.groupBy("part").applyInArrow(summed_pairs(least), "part int, bits binary"), "pairs")
    return joined_bits(parts, 1 << (PART + BITS - 32 - 3))


def numbered(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """A number for each distinct pair of numbers, below the count of pairs."""
    return np.unique(left * size + right, return_inverse=True)[1]


def edges_of(word_map: np.ndarray, pair_map: np.ndarray):
    """Edges and piece ends of the slices: language, node (the first words), the word after it (null: an end), size of the node, weight."""

    def rows(p: Pieces) -> Iterator[pa.RecordBatch]:
        at, follows = known_words(p, word_map)
        second = np.nonzero(follows)[0]
        rare = ~has(pair_map, (pair_places(p, at, second) >> np.uint32(32 - BITS)).astype(np.int64))
        follows[second[rare]] = False
        within = follows.copy()  # words alone in their run say nothing
        within[:-1] |= follows[1:]
        at, follows = at[within], follows[within]
        if not len(at):
            return
        begin = np.nonzero(~follows)[0]
        length = np.diff(np.append(begin, len(at)))
        left = np.repeat(begin + length, length) - np.arange(len(at))  # words up to the end of the run, the word itself included
        data, offsets = data_of(p.flat)
        code = p.codes[at]
        number = [code]  # of the phrase of 1, 2, ... words at each place, where there is one
        for k in range(1, LONGEST):
            inside = left > k
            grown = np.zeros(len(at), np.int64)
            grown[inside] = numbered(number[-1][inside], code[k:][inside[: len(at) - k]], len(p.keys) + 1)
            number.append(grown)
        for k in range(2, LONGEST + 1):
            where = np.nonzero(left >= k if k == LONGEST else left == k)[0]
            if not len(where):
                continue
            _, one, weight = np.unique(number[k - 1][where], return_index=True, return_counts=True)
            first = at[where[one]]
            inner = min(k, LONGEST - 1)
            after = phrases(data, offsets, first + inner, 1) if k == LONGEST else pa.nulls(len(first), pa.string())
            yield pa.RecordBatch.from_arrays([p.langs.take(pa.array(p.codes[first])), phrases(data, offsets, first, inner), after,
                                              pa.array(np.full(len(first), inner, np.int32)), pa.array(weight.astype(np.int64))],
                                             ["lang", "node", "after", "size", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.columns
            for a, b in slices(texts):
                yield from rows(pieces(texts.slice(a, b - a), langs.slice(a, b - a)))

    return run


def phrases(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, size: int) -> pa.Array:
    """The ``size`` words from each of ``first`` on, joined by blanks. Words lie one after the other in ``data``."""
    lengths = offsets[first + size] - offsets[first] + size  # every word with a blank behind
    ends = np.cumsum(lengths)
    out = np.full(int(ends[-1]), 32, np.uint8)
    to = ends - lengths
    for k in range(size):
        n = offsets[first + k + 1] - offsets[first + k]
        out[ranges(to, n)] = data[ranges(offsets[first + k], n)]
        to = to + n + 1
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False  # the last blank
    bounds = np.concatenate(([0], ends - np.arange(1, len(ends) + 1)))
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out[keep]))


def flow(counted: DataFrame, size: int, least: int) -> DataFrame:
    """From phrases with their size and count ``n`` to those of one word less: sums of those that start with them, plus their ends.

    Frequent phrases of ``size`` words and more pass through, rarer ones only count in what they start with.
    """
    start = F.struct(F.substring_index("phrase", " ", size - 1).alias("phrase"), F.lit(size - 1).alias("size"))
    same = F.struct("phrase", "size")
    whole = F.when(F.col("size") < size, F.array(same)).when(F.col("size") > size, F.array(same))
    out = whole.otherwise(F.when(F.col("n") >= least, F.array(same, start)).otherwise(F.array(start)))
    return (counted.select("lang", "n", F.explode(out).alias("p")).groupBy("lang", "p.phrase", "p.size").agg(F.sum("n").alias("n")))


def frequent_phrases(docs: DataFrame, frequent: DataFrame, s: Settings) -> DataFrame:
    """(lang, phrase, size, n) of all phrases of up to LONGEST words with ``s.least`` occurrences."""
    word_map = word_bits(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((word_map, pair_bits(docs, word_map, s.least)))
    found = docs.select("text", "lang").mapInArrow(lambda b: edges_of(*sent.value)(b), "lang string, node string, after string, size int, n bigint")
    # one exchange by node serves the edges and the flow out of the node
    edges = found.repartition("lang", "node").groupBy("lang", "node", "size", "after").agg(F.sum("n").alias("n"))
    both = F.when(F.col("after").isNotNull() & (F.col("n") >= s.least), F.array(F.col("after"), F.lit(None).cast("string"))).otherwise(
        F.array(F.lit(None).cast("string")))
    nodes = edges.select("lang", "node", "size", "n", F.explode(both).alias("after")).groupBy("lang", "node", "size", "after").agg(F.sum("n").alias("n"))
    counted = nodes.select("lang", F.concat_ws(" ", "node", "after").alias("phrase"), (F.col("size") + F.col("after").isNotNull().cast("int")).alias("size"), "n")
    for size in range(LONGEST - 1, 2, -1):
        counted = flow(counted, size, s.least)
    single = frequent.where("word is not null").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    return keep_table(counted.where(F.col("n") >= s.least).unionByName(single), "phrases")


def without_first(phrase: str) -> Column:
    return F.expr(f"substr({phrase}, locate(' ', {phrase}) + 1)")


def compact_paths(edges: DataFrame) -> DataFrame:
    """Unary paths of (lang, phrase, n): (lang, phrase, n) with the edges between unary nodes joined, in rows of up to CHUNK edges.

    An edge is followed by another if it alone leads into its last node, the other alone leaves it, and both weigh the same.
    Heads are found by pointer doubling, every round kept as a table; edges on a cycle of unary nodes have no head and stay alone.
    """
    into = edges.select("lang", without_first("phrase").alias("node"), F.col("phrase").alias("before"), F.col("n").alias("n_in"))
    out = edges.select("lang", F.substring_index("phrase", " ", LONGEST - 1).alias("node"), F.col("phrase").alias("edge"), F.col("n").alias("n_out"))
    single_in = into.groupBy("lang", "node").agg(F.count("*").alias("ins"), F.first("before").alias("before"), F.first("n_in").alias("n_in"))
    single_out = out.groupBy("lang", "node").agg(F.count("*").alias("outs"), F.first("edge").alias("edge"), F.first("n_out").alias("n_out"))
    unary = single_in.join(single_out, ["lang", "node"]).where("ins = 1 and outs = 1 and n_in = n_out and before <> edge")
    joined = edges.select("lang", F.col("phrase").alias("edge"), "n").join(unary.select("lang", "edge", "before"), ["lang", "edge"], "left")
    step = keep_table(joined.select("lang", "edge", "n", F.coalesce("before", "edge").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("hops"),
                                    F.col("before").isNull().alias("done")), "paths")
    reach = 1
    while True:
        open_ones = step.where("not done").count()
        if open_ones == 0 or reach > 2 * open_ones:
            break
        there = step.select("lang", F.col("edge").alias("head"), F.col("head").alias("far"), F.col("hops").alias("more"), F.col("done").alias("end"))
        step = keep_table(step.join(there, ["lang", "head"]).select(
            "lang", "edge", "n", F.when(F.col("done"), F.col("head")).otherwise(F.col("far")).alias("head"),
            F.when(F.col("done"), F.col("hops")).otherwise(F.col("hops") + F.col("more")).alias("hops"), (F.col("done") | F.col("end")).alias("done")), "paths")
        reach *= 2
    step = step.select("lang", "edge", "n", F.when(F.col("done"), F.col("head")).otherwise(F.col("edge")).alias("head"),
                       F.when(F.col("done"), F.col("hops")).otherwise(0).alias("hops"))
    chunk = step.groupBy("lang", "head", "n", F.floor(F.col("hops") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("hops", "edge"))).alias("es"))
    last = F.transform(F.slice("es", F.lit(2), F.size("es")), lambda e: F.substring_index(e["edge"], " ", -1))
    return chunk.select("lang", F.concat_ws(" ", F.col("es")[0]["edge"], last).alias("phrase"), "n")


def parts_of(longer: DataFrame, sizes: list[int]) -> DataFrame:
    """(lang, phrase, n) of all contiguous parts of ``sizes`` words of the phrases of ``longer``."""
    w = F.split("phrase", " ")

    def of(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))

    each = [of(size) for size in sizes]
    return longer.select("lang", F.explode(F.array_distinct(F.concat(*each))).alias("phrase"), "n")


def covered(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the greatest count of a longer candidate that a phrase lies in."""
    found = [parts_of(compact_paths(frequent.where(F.col("size") == LONGEST)), list(range(2, LONGEST)))]
    found += [parts_of(frequent.where(F.col("size") == size), list(range(2, size))) for size in range(3, LONGEST)]
    return reduce(DataFrame.unionByName, found).groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def scored(frequent: DataFrame, scale: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates at their lowest-scoring cut."""
    cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cut = frequent.where("size >= 2").select("lang", "phrase", F.col("n").alias("a"), "size", cuts.alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    known = frequent.where(F.col("size") < LONGEST)
    l = known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    r = known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr(f"(cast({scale} as decimal(10, 0)) * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))")
    best = cut.join(l, ["lang", "first"]).join(r, ["lang", "rest"]).groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def mine(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The columns of ``MINED``: the first ``s.top`` phrases of each language by score, count and phrase."""
    counted = frequent_words(docs, s.least)
    frequent = frequent_phrases(docs, counted, s)
    kept = scored(frequent, s.scale).join(covered(frequent), ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.lit(100) * F.col("longest") < F.lit(s.inside) * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= s.top)  # so one task ranks at most DEALT times as many
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= s.top)
    every = counted.where("word is null").select("lang", "n")
    return ranked.join(every, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
with pieces as (
    select coalesce(lang, 'und') lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[.,;:!?\\n\\x0b\\x0c\\r]')) piece from documents),
runs as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') w from pieces),
total as (select lang, cast(sum(len(w)) as bigint) n from runs group by lang),
grams as (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from runs, (select unnest([1, 2, 3, 4]) k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) n from grams group by all having count(*) >= 30),
cuts as (select lang, k, phrase, n a, unnest(range(1, k)) c from f where k >= 2),
parts as (
    select *, array_to_string(string_split(phrase, ' ')[1:c], ' ') x, array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') y from cuts),
scores as (
    select p.lang, p.phrase, p.a, p.c, l.n l, r.n r, cast((2000000::hugeint * p.a) // (l.n + r.n) as bigint) score
    from parts p join f l on l.lang = p.lang and l.phrase = p.x join f r on r.lang = p.lang and r.phrase = p.y),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, c) = 1),
longer as (
    select f.lang, array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ') phrase, max(n) n
    from f, (select unnest([2, 3]) s), (select unnest([1, 2, 3]) i) where k > s and i + s - 1 <= k group by all),
kept as (select b.* from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase where g.n is null or 100 * g.n < 80 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, total.n, score
from kept join total using (lang) qualify rank <= 2000
"""
