"""Token-ID output (operator 9): Parquet files of token-ID lists that can be read by column, row group and page.

A folder holds files in ascending order of doc_id, each row ``doc_id, n_tokens, ids``. ``ids`` is dictionary-encoded (a
vocabulary fits one dictionary), ``doc_id`` and ``n_tokens`` are delta-encoded. Row groups and pages are small enough to
skip, and the writer's page indexes tell which page holds which ids. ``start`` (the tokens before a document) follows from
the counts alone: sums per file, then within each file by the rows' places.

Null texts are empty and get the end id only. Very long texts are encoded whole, each in a slice of its own. Rows with equal ids are ordered by a hash of their text; null ids come first.
An empty table gives an empty folder that can be read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demand_engine.llm.text import ranges, slices, words
from demand_engine.session import shared_folder

SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>"
ROW_GROUP = 32 << 20
PAGE = 128 << 10
PAGE_ROWS = 2000


# Letters that all Unicode versions know and that stay one letter in lower case, then nothing or other ASCII: there the
# tokenizer starts anew, and no letter composes with what follows.
LEAD = "^(?P<lead>[A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{12F}\\x{131}-\\x{24F}]+)(?P<rest>(?:[!-@\\[-`{-~](?s:.*))?)$"
CACHED = 300_000  # parts of words
JOINED = 1000  # words that the library encodes as one text
FIRST = -(2**63)  # where null ids are put
SEED = 7


class Words:
    """Ids of words by the tokenizers library; a worker keeps those of the parts it has seen, up to ``CACHED``."""

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_buffer(vocabulary)
        self.made.no_truncation()
        self.made.no_padding()
        tokens = self.made.get_vocab()
        self.last = np.zeros(max(tokens.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        # The library looks for these in the text as it is, across words: texts with one of them are encoded whole.
        self.special = [t.content.lower() for t in self.made.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.pool, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(i) for i in ids], np.int64)

    def encode_words(self, listed: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode`` for parts that are one word each: many are encoded as one text and told apart by their ends."""
        ids, _ = self.encode([" ".join(listed[i: i + JOINED]) for i in range(0, len(listed), JOINED)])
        ends = np.nonzero(self.last[ids])[0] + 1
        if len(ends) != len(listed) or (len(ends) and ends[-1] != len(ids)):
            return self.encode(listed)  # a vocabulary without word ends
        return ids, np.diff(ends, prepend=0)

    def find(self, parts: pa.StringArray, single: bool) -> np.ndarray:
        """Places of the parts in ``starts`` and ``sizes``; ``single`` parts are one word each."""
        coded = parts.dictionary_encode()
        listed = coded.dictionary.to_pylist()
        places = [self.seen.get(p, -1) for p in listed]
        new = [p for p, i in zip(listed, places) if i < 0]
        if new:
            ids, sizes = self.encode_words(new) if single else self.encode(new)
            first = len(self.starts)
            self.seen.update(zip(new, range(first, first + len(new))))
            self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.pool)])
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
        found = np.array(places, np.int64)
        found[found < 0] = np.arange(len(new)) + len(self.starts) - len(new)
        return found[coded.indices.to_numpy()]

    def ids(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and their counts."""
        if len(self.seen) > CACHED:
            self.clear()
        split = pc.extract_regex(distinct, LEAD)
        lead, rest = pc.struct_field(split, 0), pc.struct_field(split, 1)
        known = lead.is_valid().to_numpy(zero_copy_only=False)
        parts = np.empty((len(distinct), 2), np.int64)
        parts[known, 0] = self.find(lead.drop_null(), True)
        parts[:, 1] = self.find(pc.coalesce(rest, distinct), False)
        size = self.sizes[parts[:, 1]]
        both = np.where(known, size + self.sizes[np.where(known, parts[:, 0], 0)], size) if len(distinct) else size
        lengths = np.stack([both - size, size], axis=1).ravel()
        starts = np.stack([self.starts[np.where(known, parts[:, 0], 0)], self.starts[parts[:, 1]]], axis=1).ravel() if len(distinct) else lengths
        return self.pool[ranges(starts, lengths)], both


@lru_cache(maxsize=2)
def word_ids(vocabulary: bytes) -> Words:
    return Words(vocabulary)


def encode(texts: pa.Array, made: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids, each text with the end id behind. Distinct words are encoded once for all texts.

    Right for tokenizers that drop white space and let no token cross it, as those that split by words do. Texts that hold a
    special token's string are encoded whole, as the library reads it as that token.
    """
    texts = pc.fill_null(texts, "")
    odd = np.zeros(len(texts), bool)
    for token in made.special:
        odd |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
    whole, counts = made.encode(texts.filter(pa.array(odd)).to_pylist()) if odd.any() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    offsets, flat = words(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
    flat = pc.if_else(pc.string_is_ascii(flat), pc.ascii_lower(flat), flat)  # the vocabulary has lower case only
    coded = flat.dictionary_encode()
    pool, sizes = made.ids(coded.dictionary)
    index = coded.indices.to_numpy().astype(np.int64)
    size = sizes[index]
    n = np.diff(np.concatenate(([0], np.cumsum(size)))[offsets])
    n[odd] = counts
    before = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(int(before[-1]), end, np.int32)
    inside = np.ones(len(out), bool)
    inside[before[1:] - 1] = False
    if odd.any():
        places = ranges(before[:-1][odd], counts)
        out[places], inside[places] = whole, False
    out[inside] = pool[ranges((np.cumsum(sizes) - sizes)[index], size)]
    return before, out


def bounds_of(docs: DataFrame, parts: int) -> np.ndarray:
    """Ids that cut the table into about equal ``parts``, from a sample of the ids alone: at most a few hundred a part."""
    share = min(1.0, 100 * parts / max(1, docs.count()))
    ids = np.sort([FIRST if r[0] is None else r[0] for r in docs.select(F.col("doc_id").cast("long")).sample(share, SEED).collect()])
    return ids[np.arange(1, parts) * len(ids) // parts] if len(ids) else np.zeros(0, np.int64)


def part_of(ids: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The part of each row. Rows of an id that is several bounds are spread over the parts between them by their hash, in its order."""
    left, right = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
    return left + np.minimum((share * (right - left + 1)).astype(np.int64), right - left)


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = 2) -> None:
    """Write the token files of all documents below ``folder``, in ascending doc_id order, one for each part of the input.

    Executors get the tokenizer file's bytes by broadcast. Texts are encoded where they are read; only ids are shuffled.
    """
    with open(path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    parts = max(1, docs.rdd.getNumPartitions())
    bounds = bounds_of(docs, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = word_ids(vocabulary.value)
        for batch in batches:
            doc_id, h, texts = batch.columns
            part = part_of(pc.fill_null(doc_id, FIRST).to_numpy(), h.to_numpy(), bounds).astype(np.int32)
            for a, b in slices(texts):
                offsets, ids = encode(texts.slice(a, b - a), made, end)
                yield pa.RecordBatch.from_arrays([pa.array(part[a:b]), doc_id.slice(a, b - a), h.slice(a, b - a),
                                                  pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["part", "doc_id", "h", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    coded = texts.mapInArrow(run, "part int, doc_id bigint, h bigint, ids array<int>")
    rows = coded.repartitionById(parts, "part").sortWithinPartitions("doc_id", "h").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    rows.write.options(**{
        "compression": "zstd", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false",
    }).parquet(folder)


def ids_crc32(ids: pa.Array) -> pa.Array:
    """crc32 of each list as little-endian unsigned 32-bit integers."""
    data = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
    return pa.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.int64())


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The token files' rows; select doc_id and n_tokens alone to leave the ids unread, filter doc_id to skip pages."""
    return spark.read.schema(SCHEMA).parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    crc32 = F.arrow_udf(ids_crc32, "bigint")
    rows = read_tokens(spark, folder).select(
        "doc_id", "n_tokens", crc32(F.col("ids")).alias("ids_crc32"), F.col("_metadata.row_index").alias("place"),
        F.regexp_extract(F.col("_metadata.file_name"), "^part-([0-9]+)", 1).cast("long").alias("file"))
    counts = read_tokens(spark, folder).select("n_tokens", F.regexp_extract(F.col("_metadata.file_name"), "^part-([0-9]+)", 1).cast("long").alias("number"))
    files = counts.groupBy("number").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = F.coalesce(F.sum("n").over(W.orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    starts = files.select("number", before.alias("before"))
    return summed.join(starts, summed["file"] == starts["number"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_documents(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write the token files below the shared folder and return their index."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, path, end)
    return read_index(docs.sparkSession, folder)
