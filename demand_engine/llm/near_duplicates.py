"""SimHash near-duplicates (operator 8) by covering locality-sensitive hashing.

Fingerprints are majority bits of the 64-bit hashes of word shingles. Every bit position gets a nonzero vector of
``radius + 1`` bits; for each of the ``2^(radius+1) - 1`` nonzero vectors v, table v looks at the positions whose vector
has an odd product with v. Any ``radius`` positions leave some v with even products only, so two fingerprints that differ
in at most ``radius`` bits agree in that table: no link is missed.

Copies are folded into one row per fingerprint before the tables. Small buckets are compared pair by pair (links only are
emitted); in large ones fingerprints meet at a common neighbour at one bit, as two within two bits share one, so the work
grows with the members and not with their pairs. Components come from star contraction, checkpointed every round.

A null text has no word; texts without a word have fingerprint zero and are linked like any other. Repeated rows are kept
as rows. A null doc_id has a null component unless a linked document has an id. A very long text is printed whole. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demand_engine.llm.text import data_of, keep_table, slices, words

BITS = 64
SEED = 42
SLICE = 256 << 10  # bytes of text worked on at once
SMALL = 64  # members of a bucket that are compared pair by pair


def masks(radius: int = 2) -> list[int]:
    """One 64-bit mask for each table; position i has vector 1 + i mod (2^(radius+1) - 1)."""
    tables = (1 << (radius + 1)) - 1
    vector = [1 + i % tables for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, tables + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, text by text, and their number in each; words are lower-cased in A-Z.

    Fewer words than ``size`` are one shingle, no word none.
    """
    offsets, flat = words(texts, lower=True)
    data, ends = data_of(flat)
    length = np.diff(ends)
    spaced = np.full(len(data) + len(length), 32, np.uint8)  # every word followed by one space
    starts = ends[:-1] + np.arange(len(length))
    inside = np.ones(len(spaced), bool)
    inside[starts + length] = False
    spaced[inside] = data
    text_bytes, stops = spaced.tobytes(), starts + length
    count = np.diff(offsets)
    n = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    first = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = np.minimum(first + size, np.repeat(offsets[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text_bytes[i:j], SEED) for i, j in zip(starts[first].tolist(), stops[last].tolist())), np.uint64, len(first))
    return hashes, n


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of each run of ``n`` hashes: the bits that more than half of them have; zero for an empty run."""
    some = np.nonzero(n)[0]
    ones = np.zeros((len(n), BITS), np.int64)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[some] = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8").ravel()


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """SimHash of the texts' word shingles, repeats included, as a bigint."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [majority(*shingles(batch.slice(a, b - a), shingle)) for a, b in slices(batch, SLICE)]
            yield pa.array(np.concatenate([*out, np.zeros(0, np.int64)]))

    return run(text)


def links(prints: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column ``fp``) that connect all within ``radius`` of each other.

    Buckets of up to ``small`` members give every link; larger ones give links through common neighbours, for
    which ``radius`` has to be 2.
    """
    if radius != 2:
        raise ValueError("common neighbours at one bit cover a radius of 2")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks(radius))])
    members = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    sizes = members.groupBy("t", "key").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    shared = members.join(sizes, ["t", "key"])
    few = shared.where(F.col("m") <= small).select("t", "key", "fp")
    other = few.withColumnRenamed("fp", "b")
    near = (F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius)
    pairs = few.join(other, (few["t"] == other["t"]) & (few["key"] == other["key"]) & near).select(F.col("fp").alias("a"), "b")
    many = shared.where(F.col("m") > small).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)])
    meets = many.select("fp", F.explode(around).alias("z"))
    hubs = meets.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    stars = meets.join(hubs, "z").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges (a, b): root is the least node of its component.

    Alternates large-star and small-star steps; each round is written to the shared folder.
    """
    edges = keep_table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # now every b sees smaller nodes only: link them, and b itself, to the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = keep_table(small.union(least.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if mark == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = seen


def classes(docs: DataFrame, shingle: int = 3, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """Prints (doc_id, h, fp), h a hash of the text, and per fingerprint the least (id, h) of its component."""
    prints = keep_table(docs.select("doc_id", F.xxhash64("text").alias("h"), fingerprint(F.col("text"), shingle).alias("fp")), "fingerprints")
    folded = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("least"))
    roots = components(links(folded.select("fp"), radius))
    merged = folded.join(roots, folded["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = merged.groupBy("root").agg(F.min("least").alias("first"))
    return prints, merged.join(ids, "root").select(F.col("fp").alias("key"), "first")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    prints, labels = classes(docs, shingle, radius)
    return prints.join(labels, prints["fp"] == labels["key"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id (null ids come last).

    Of rows that repeat an id the one with the smallest hash of its text stays, of rows that repeat id and text one.
    """
    prints, labels = classes(docs, shingle, radius)
    best = labels.select(F.col("first.doc_id").alias("id"), F.col("first.h").alias("h")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_h"))
    kept = rows.join(best, rows["row_id"].eqNullSafe(best["id"]) & (rows["row_h"] == best["h"]), "left_semi")
    one = kept.groupBy("row_id", "row_h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*")
