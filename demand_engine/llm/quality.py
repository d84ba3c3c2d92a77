"""Quality rules (operator 3): a linear-chain conditional random field labels the lines of a text as content or boilerplate.

The field is fitted on a bounded sample of labelled documents (``Settings.max_train``), whose lines carry the label of
their document. Viterbi decoding marks each line; a document is kept if content lines hold at least ``least_share`` of
its characters. Before that a document fails on few words or on repeated ones (``base_failed``).

Lines without a word aren't labelled. A null text has no word and fails. Without labelled documents of both kinds all
lines count as content. Texts of any length are read whole, in slices of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demand_engine.llm.text import data_of, slices, sums, words

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?;:=_~^@/\\+{}[]()\""
FEATURES = 12


@dataclass(frozen=True)
class Settings:
    max_train: int = 1200  # labelled documents the field is fitted on, half of each kind
    max_lines: int = 400  # longer documents aren't fitted on
    rounds: int = 150
    rate: float = 0.1
    ridge: float = 1e-3
    least_words: int = 50
    most_repeated: int = 50  # percent of the words
    least_share: float = 0.5


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(chars)] = 1
    return out


IS_SYMBOL, IS_MARK, IS_DIGIT = table(SYMBOLS), table(MARKS), table(b"0123456789")
IS_UPPER, IS_LOWER = table(bytes(range(65, 91))), table(bytes(range(97, 123)))


@dataclass
class Lines:
    """Counts per text, and per line with a word: features, characters, and the place of each text's lines."""

    counts: dict[str, np.ndarray]
    features: np.ndarray
    chars: np.ndarray
    offsets: np.ndarray


def earlier(owner: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the same (owner, id) came before; owners are in order."""
    out = np.ones(len(ids), bool)
    if len(ids):
        out[np.unique(owner.astype(np.int64) * (int(ids.max()) + 1) + ids, return_index=True)[1]] = False
    return out


def repeated_words(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text the words that lie in a 3-word window found twice or more in it."""
    out = np.zeros(len(offsets) - 1, np.int64)
    if len(ids) < 3:
        return out
    distinct = int(ids.max()) + 1
    pair = ids[:-1].astype(np.int64) * distinct + ids[1:]
    if distinct >= 1 << 21:  # three ids don't fit in 63 bits: number the pairs
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * distinct + ids[2:]
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b - a < 4:
            continue
        own = code[a: b - 2]
        order = own.argsort()
        ordered = own[order]
        same = ordered[1:] == ordered[:-1]
        if not same.any():
            continue
        first = np.zeros(b - a, bool)
        first[order[1:][same]] = True
        first[order[:-1][same]] = True
        cover = first.copy()  # a window covers its word and the next two
        cover[1:] |= first[:-1]
        cover[2:] |= first[:-2]
        out[k] = cover.sum()
    return out


def measure(texts: pa.Array) -> Lines:
    """Counts and line features of texts."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, "\n")
    lines, per_text = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), per_text)
    offsets, flat = words(lines)
    n_words = np.diff(offsets)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy()
    word_chars = sums(pc.utf8_length(flat).to_numpy(), offsets)
    data, ends = data_of(lines)
    per = {name: sums(chosen[data], ends) for name, chosen in (("symbol", IS_SYMBOL), ("mark", IS_MARK), ("digit", IS_DIGIT), ("upper", IS_UPPER), ("lower", IS_LOWER))}
    full = n_words > 0
    line_ids = lines.dictionary_encode().indices.to_numpy()
    seen = np.zeros(len(lines), bool)
    seen[full] = earlier(owner[full], line_ids[full])
    same = np.concatenate([[0], (ids[1:] == ids[:-1]).astype(np.int8)]) if len(ids) else np.zeros(0, np.int8)
    if len(ids):
        same[offsets[:-1][full]] = 0  # the first word of a line
    chars = pc.utf8_length(lines).to_numpy()
    last = np.zeros(len(lines), np.uint8)
    last[full] = data[ends[1:][full] - 1]
    text_words = np.concatenate(([0], np.cumsum(per_text)))
    at = offsets[text_words]
    whole = lambda x: np.bincount(owner, weights=x, minlength=len(texts)).astype(np.int64)
    counts = {"n_words": np.diff(at), "word_chars": whole(word_chars), "n_symbols": whole(per["symbol"]), "n_dup_lines": whole(seen),
              "n_repeat_words": repeated_words(ids, at)}
    c, w = np.maximum(chars, 1), np.maximum(n_words, 1)
    features = np.stack([
        np.ones(len(lines)), np.log1p(chars), np.log1p(n_words), word_chars / w, per["symbol"] / c, per["mark"] / c,
        per["digit"] / c, per["upper"] / np.maximum(per["upper"] + per["lower"], 1), sums(same, offsets) / w, seen,
        np.isin(last, list(b".,!?")), (per["symbol"] / w > 0.5)], axis=1)[full]
    return Lines(counts, features, chars[full], np.concatenate(([0], np.cumsum(np.bincount(owner[full], minlength=len(texts))))))


@dataclass
class Field:
    """Two labels, 0 content and 1 boilerplate; scores of a line are its scaled features times ``emit``."""

    mean: np.ndarray
    spread: np.ndarray
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.spread @ self.emit


def decode(scores: np.ndarray, offsets: np.ndarray, field: Field) -> np.ndarray:
    """Viterbi labels of the lines of many texts, one step along all texts at a time; ties go to content."""
    counts = np.diff(offsets)
    order = np.argsort(-counts, kind="stable")
    longest, starts = counts[order], offsets[:-1][order]
    n = int((longest > 0).sum())
    labels = np.zeros(len(scores), np.int8)
    if not n:
        return labels
    back = np.zeros((len(scores), 2), np.int8)
    best = scores[starts[:n]] + field.start
    steps = int(longest[0])
    live = np.searchsorted(-longest, -np.arange(1, steps + 1), side="right")  # texts with at least so many lines
    for t in range(1, steps):
        m = live[t]
        rows = starts[:m] + t
        via = best[:m, :, None] + field.move
        back[rows] = via.argmax(1)
        best[:m] = via.max(1) + scores[rows]
    state = best.argmax(1).astype(np.int8)
    labels[starts[:n] + longest[:n] - 1] = state
    for t in range(steps - 1, 0, -1):
        rows = starts[: live[t]] + t
        labels[rows - 1] = back[rows, labels[rows]]
    return labels


def fit(examples: list[tuple[np.ndarray, int]], s: Settings) -> Field:
    """Gradient ascent (with Adam's step sizes) on the log-likelihood of the line labels; sums by forward and backward passes."""
    every = np.concatenate([x for x, _ in examples])
    mean, spread = every.mean(0), every.std(0) + 1e-6
    mean[0], spread[0] = 0.0, 1.0  # the constant
    sizes = np.array([len(x) for x, _ in examples])
    order = np.argsort(-sizes, kind="stable")
    steps, n = int(sizes.max()), len(examples)
    x = np.zeros((steps, n, FEATURES))
    inside = np.zeros((steps, n), bool)
    label = np.array([examples[k][1] for k in order])
    for j, k in enumerate(order):
        x[: sizes[k], j] = (examples[k][0] - mean) / spread
        inside[: sizes[k], j] = True
    live = inside.sum(1)
    weight = (1 / np.sqrt(sizes[order])) / (1 / np.sqrt(sizes[order])).sum()  # long texts don't outweigh the others
    truth = np.eye(2)[label]
    theta = np.zeros(FEATURES * 2 + 4 + 2)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, s.rounds + 1):
        emit, move, start = theta[: FEATURES * 2].reshape(FEATURES, 2), theta[FEATURES * 2: -2].reshape(2, 2), theta[-2:]
        score = x @ emit
        alpha, beta = np.zeros((steps, n, 2)), np.zeros((steps, n, 2))
        alpha[0] = score[0] + start
        for t in range(1, steps):
            m = live[t]
            alpha[t, :m] = np.logaddexp(alpha[t - 1, :m, 0, None] + move[0], alpha[t - 1, :m, 1, None] + move[1]) + score[t, :m]
        for t in range(steps - 2, -1, -1):
            m = live[t + 1]
            ahead = score[t + 1, :m] + beta[t + 1, :m]
            beta[t, :m] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
        z = np.logaddexp(alpha[0, :, 0] + beta[0, :, 0], alpha[0, :, 1] + beta[0, :, 1])
        p = np.exp(alpha + beta - z[None, :, None]) * inside[:, :, None]
        gap = (truth[None] * inside[:, :, None] - p) * weight[None, :, None]
        grad_emit = np.einsum("tnf,tnk->fk", x, gap)
        pair = alpha[:-1, :, :, None] + move + (score[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]
        pair = np.where(inside[1:, :, None, None], np.exp(np.minimum(pair, 0)), 0)
        stays = (truth[:, :, None] * truth[:, None, :]) * (sizes[order] - 1)[:, None, None]
        grad_move = ((stays - pair.sum(0)) * weight[:, None, None]).sum(0)
        grad = np.concatenate([grad_emit.ravel(), grad_move.ravel(), gap[0].sum(0)]) - s.ridge * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta += s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Field(mean, spread, theta[: FEATURES * 2].reshape(FEATURES, 2), theta[FEATURES * 2: -2].reshape(2, 2), theta[-2:])


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Field | None:
    """Fit on documents with a label in ``labels`` (doc_id, quality 0 or 1; of repeated ids the lowest label counts)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    parts = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_train // 2) for q in (0, 1)]
    chosen = parts[0].union(parts[1])  # at most max_train rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.size(F.split("text", "\n")) <= s.max_lines)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in slices(batch.column(1)):
                found = measure(batch.column(1).slice(a, b - a))
                out += [found.features[i:j].astype(np.float32).tobytes() for i, j in zip(found.offsets[:-1], found.offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["doc_id", "features", "quality"])

    got = texts.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(lines, "doc_id bigint, features binary, quality int").toArrow().to_pylist()
    examples = [(np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES).astype(float), 1 - r["quality"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["features"])) if r["features"]]
    if len({label for _, label in examples}) < 2:
        return None
    return fit(examples, s)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(spark, text: Column, field: Field | None, s: Settings = Settings()) -> Column:
    """Struct of the counts, base_failed, kept and content_share."""
    shared = spark.sparkContext.broadcast(field)
    kind = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ", base_failed: boolean, kept: boolean, content_share: double>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = shared.value
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {c: [np.zeros(0, np.int64)] for c in COUNTS} | {"share": [np.zeros(0)]}
            for a, b in slices(batch):
                found = measure(batch.slice(a, b - a))
                content = decode(f.scores(found.features), found.offsets, f) == 0 if f is not None else np.ones(len(found.chars), bool)
                total = sums(found.chars, found.offsets)
                parts["share"].append(sums(found.chars * content, found.offsets) / np.maximum(total, 1))
                for c in COUNTS:
                    parts[c].append(found.counts[c])
            got = {c: np.concatenate(p) for c, p in parts.items()}
            failed = (got["n_words"] < s.least_words) | (100 * got["n_repeat_words"] > s.most_repeated * got["n_words"])
            kept = ~failed & (got["share"] >= s.least_share)
            yield pa.StructArray.from_arrays([*[pa.array(got[c].astype(np.int64)) for c in COUNTS], pa.array(failed), pa.array(kept), pa.array(got["share"])],
                                             [*COUNTS, "base_failed", "kept", "content_share"])

    return run(text)


def quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, the counts, base_failed, kept and content_share of every document; other columns are not read."""
    judged = judge(docs.sparkSession, F.col("text"), learn(docs, labels, s), s)
    return docs.select("doc_id", judged.alias("judged")).select("doc_id", "judged.*")
