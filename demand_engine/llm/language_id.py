"""Language ID (operator 10): sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from all labelled documents. The weights are fitted by follow-the-regularised-leader with
elastic net on a bounded sample of them (``Settings.max_train``), and a temperature is then set on a part of the sample
kept aside. Prediction is one vectorised pass over whole texts.

Null or letterless text: ``und`` with score 0. Without any labelled document all texts are ``und``. Repeated rows and
null ids are judged like any other; texts of any length are read in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demand_engine.llm.text import slices

UNKNOWN = "und"
SPACE = 32
SLICE = 256 << 10  # bytes of text worked on at once; arrays of all n-grams take about 100 times that


@dataclass(frozen=True)
class Settings:
    longest: int = 3  # characters of an n-gram, from 1
    bits: int = 16  # of the hashed n-grams
    max_train: int = 4000  # documents the weights are fitted on, dealt evenly to the languages
    max_labels: int = 400  # the most frequent languages are learned
    passes: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001
    scale: float = 100.0  # of a term frequency, a share of all n-grams
    kept_aside: int = 5  # one in so many sampled documents sets the temperature


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


@dataclass
class Grams:
    """N-grams of a slice of texts: bins, the text each belongs to, and per text whether it has a letter."""

    bins: list[np.ndarray]
    texts: list[np.ndarray]
    lettered: np.ndarray


def grams(texts: list[str | None], s: Settings) -> Grams:
    """Lower-cased letters, everything else one blank; n-grams with two blanks in a row don't count."""
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in low], np.int64)  # a blank on either side, so two between texts
    code = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    starts = np.cumsum(sizes) - sizes
    seen = np.concatenate(([0], np.cumsum(letter)))
    lettered = seen[starts + sizes] > seen[starts]
    code = np.where(letter, code, np.uint32(SPACE))
    owner = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    blank = ~letter
    double = np.concatenate([blank[:-1] & blank[1:], [True]])
    bins, own = [], []
    mixed, bad = code * np.uint32(0x9E3779B1), blank
    for n in range(1, s.longest + 1):
        if n > 1:
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + code[n - 1:] * np.uint32(0xC2B2AE3D)
            bad = (bad[:-1] if n > 2 else False) | double[n - 2: n - 2 + len(mixed)]
        good = ~bad
        final = mixed[good] * np.uint32(0x27D4EB2F) + np.uint32(n)
        bins.append((final >> np.uint32(32 - s.bits)).astype(np.int64))
        own.append(owner[: len(good)][good])
    return Grams(bins, own, lettered)


def by_slice(batch: pa.Array, s: Settings) -> Iterator[Grams]:
    for a, b in slices(batch, SLICE):
        yield grams(batch.slice(a, b - a).to_pylist(), s)


def document_frequencies(texts: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """In how many of the texts (column ``text``) each bin occurs, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(1 << s.bits, np.int64), 0
        for batch in batches:
            for g in by_slice(batch.column(0), s):
                n = len(g.lettered)
                for a in range(0, n, 64):  # a table of flags of 64 texts at a time
                    flags = np.zeros((min(64, n - a), 1 << s.bits), bool)
                    for bins, owner in zip(g.bins, g.texts):
                        i, j = np.searchsorted(owner, [a, a + 64])
                        flags[owner[i:j] - a, bins[i:j]] = True
                    found += flags.sum(0)
                rows += n
        used = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(found[used], rows))], ["bin", "n"])

    counts = texts.select("text").mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most one row for each bin
    found, bins, n = np.zeros(1 << s.bits), got["bin"].to_numpy(), got["n"].to_numpy()
    found[bins[bins >= 0]] = n[bins >= 0]
    return found, int(n[bins < 0].sum())


def sample(docs: DataFrame, s: Settings) -> tuple[list[str], DataFrame]:
    """The languages, and at most ``max_train`` labelled documents, as many of each language; chosen by hash of the id."""
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(s.max_labels).collect()}
    names = sorted(sizes)
    quota = max(1, s.max_train // max(1, len(names)))
    chance = F.lit(0.0)
    for name, n in sizes.items():  # somewhat more than the quota; the window cuts it
        chance = F.when(F.col("lang") == name, F.lit(min(1.0, 1.3 * quota / n + 20 / n))).otherwise(chance)
    order = F.xxhash64("doc_id")
    picked = docs.where(F.pmod(order, F.lit(1_000_003)) < chance * 1_000_003).withColumn("order", order)
    ranked = picked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("order", "doc_id")))
    return names, ranked.where(F.col("rank") <= quota).select("text", "lang", "order")


def sampled_counts(rows: DataFrame, s: Settings) -> list[tuple[np.ndarray, np.ndarray, str, int]]:
    """(bins, counts, language, order) of each sampled text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, out = 0, []
            for g in by_slice(batch.column(0), s):
                bins, owner = np.concatenate(g.bins), np.concatenate(g.texts)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(g.lettered) + 1))
                for i in range(len(g.lettered)):
                    used, n = np.unique(bins[order[cuts[i]: cuts[i + 1]]], return_counts=True)
                    out.append((used.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), batch.column(1), batch.column(2)], ["bins", "n", "lang", "order"])

    got = rows.mapInArrow(count, "bins binary, n binary, lang string, order bigint").toArrow().to_pylist()
    return [(np.frombuffer(r["bins"], np.int32), np.frombuffer(r["n"], np.int32), r["lang"], r["order"]) for r in sorted(got, key=lambda r: (r["order"], r["lang"]))]


@dataclass
class Model:
    """``weights`` hold the inverse document frequency; logits are their mean over a text's n-grams plus the bias."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(examples: list, names: list[str], frequency: np.ndarray, n_texts: int, s: Settings) -> Model:
    """FTRL-proximal with per-coordinate rates; the last bin stands for the bias."""
    inverse = (np.log((1 + n_texts) / (1 + frequency)) + 1.0) * s.scale
    k = len(names)
    bias_bin = 1 << s.bits
    z, n = np.zeros((bias_bin + 1, k)), np.zeros((bias_bin + 1, k))

    def weights(rows):
        zr, nr = z[rows], n[rows]
        return np.where(np.abs(zr) <= s.l1, 0.0, -(zr - np.sign(zr) * s.l1) / ((s.beta + np.sqrt(nr)) / s.alpha + s.l2))

    data = []
    for bins, counts, lang, _ in examples:
        value = counts / max(1, counts.sum()) * inverse[bins]
        data.append((np.append(bins, bias_bin), np.append(value, 1.0), names.index(lang)))
    aside, main = data[:: s.kept_aside], [d for i, d in enumerate(data) if i % s.kept_aside] or data
    turn = np.random.default_rng(7)
    for _ in range(s.passes):
        for i in turn.permutation(len(main)):
            rows, value, label = main[i]
            w = weights(rows)
            gap = softmax(value @ w)
            gap[label] -= 1
            g = value[:, None] * gap
            n_new = n[rows] + g * g
            z[rows] += g - (np.sqrt(n_new) - np.sqrt(n[rows])) / s.alpha * w
            n[rows] = n_new
    w = weights(np.arange(bias_bin + 1))
    logits = np.array([value @ w[rows] for rows, value, _ in aside])
    labels = np.array([label for _, _, label in aside])

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).sum() + 0.01 * log_t**2

    low, high = -3.0, 3.0  # golden-section search of the temperature's logarithm
    ratio = (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return Model(names, (w[:bias_bin] * inverse[:, None]).astype(np.float32), w[bias_bin], float(np.exp((low + high) / 2)))


def learn(docs: DataFrame, s: Settings = Settings()) -> Model | None:
    """Learn from the rows of ``docs`` with text and lang; reads doc_id, text and lang only."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    names, rows = sample(labelled, s)
    if not names:
        return None
    frequency, n_texts = document_frequencies(labelled, s)
    return fit(sampled_counts(rows, s), names, frequency, n_texts, s)


def predict(spark, text: Column, model: Model | None, s: Settings = Settings()) -> Column:
    """Struct of lang_pred and score (the calibrated probability of that language)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for g in by_slice(batch, s):
                n = len(g.lettered)
                best, score = np.full(n, -1), np.zeros(n)
                if m is not None:
                    total, logits = np.zeros(n), np.zeros((n, len(m.names)))
                    for bins, owner in zip(g.bins, g.texts):
                        cuts = np.searchsorted(owner, np.arange(n + 1))
                        total += np.diff(cuts)
                        some = np.nonzero(np.diff(cuts))[0]
                        if len(some):
                            logits[some] += np.add.reduceat(m.weights[bins], cuts[:-1][some], axis=0, dtype=np.float64)
                    p = softmax((logits / np.maximum(total, 1)[:, None] + m.bias) / m.temperature)
                    best = np.where(g.lettered, p.argmax(1), -1)
                    score = np.where(g.lettered, p.max(1), 0.0)
                names += [m.names[i] if i >= 0 else UNKNOWN for i in best.tolist()]
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["lang_pred", "score"])

    return run(text)


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the id as text is 2 modulo 4 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; other columns are not read."""
    model = learn(docs.where(~held_out()), s)
    judged = predict(docs.sparkSession, F.col("text"), model, s)
    return docs.select("doc_id", held_out().alias("held_out"), judged.alias("judged")).select("doc_id", "held_out", "judged.*")


def keep_known(docs: DataFrame, least: float = 0.5, s: Settings = Settings()) -> DataFrame:
    """The documents, with all their columns, whose language is known with a score of at least ``least``."""
    model = learn(docs.where(~held_out()), s)
    judged = predict(docs.sparkSession, F.col("text"), model, s)
    rows = docs.select(F.struct("*").alias("row"), judged.alias("judged"))
    return rows.where((F.col("judged.lang_pred") != UNKNOWN) & (F.col("judged.score") >= least)).select("row.*")
