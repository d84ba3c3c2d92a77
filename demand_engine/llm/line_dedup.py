"""Line dedup (operator 7): overlapping windows of consecutive lines that were seen before are removed.

A window is ``size`` consecutive lines that hold a character other than white space; blank lines don't count and stay.
Windows are hashed; of all windows with the same hash the one of the smallest (doc_id, hash of the text, position) is the
first, and the lines covered by any later one go. Only ids, positions and hashes are shuffled for that; the joined sides
are split by Spark where a passage is common.

``without_repeats``, which the pipeline's stage uses, also removes passages of ``PASSAGE`` words or more that lie on fewer
lines or begin and end inside lines; white space doesn't matter to them. Of the hashes of ``GRAM`` words in a row the least
of every ``PASSAGE - GRAM + 1`` neighbours is picked, so two texts that share a passage pick an equal one in it. Picks that
lie on one diagonal with the first text that has them give ranges of equal words; what is equal beyond a range's ends is less
than the ``MARGIN`` up to the next pick, so only these few words of the first text are sent to be compared. Where parts of a
passage come from several texts, every ``GRAM`` words of it have been seen before, and its last words on either side can stay
if the first text with the outermost pick goes on differently. ``dedup_lines`` keeps to lines, as its SQL.

Null texts stay null, texts of fewer lines stay whole, an empty table stays empty. What a very long text costs grows with
its lines, however many of them go. Null ids come first. Rows that agree in id and text are one
document read twice: they are treated alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demand_engine.llm.text import keep_table, slices, words

PASSAGE = 50  # words of a repeated passage that is removed, at least
GRAM = 32  # words that are hashed together, a power of two
MARGIN = PASSAGE - GRAM  # words beyond the outermost pick that can be equal, at most
SLICE = 256 << 10  # bytes of text worked on at once
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
BLANK = "^[\\x09-\\x0D\\x20]*$"


def lines_of(text: Column) -> Column:
    """Array of (n, h) of the lines that aren't blank: their place among all lines and their hash."""
    numbered = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("n"), F.when(~line.rlike(BLANK), F.xxhash64(line)).alias("h")))
    return F.filter(numbered, lambda x: x["h"].isNotNull())


def windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """(id, h, pos, w, places): a row for each window, with its hash and the places of its lines."""
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), lines_of(F.col("text")).alias("lines")).where(F.size("lines") >= size)
    starts = F.sequence(F.lit(0), F.size("lines") - size)
    hashed = F.transform(starts, lambda i: F.struct(
        i.alias("pos"), F.xxhash64(*[F.col("lines")[i + k]["h"] for k in range(size)]).alias("w"),
        F.array(*[F.col("lines")[i + k]["n"] for k in range(size)]).alias("places")))
    return lines.select("id", "h", F.explode(hashed).alias("x")).select("id", "h", "x.*")


def repeats(found: DataFrame, key: str) -> DataFrame:
    """The rows of (id, h, pos, ``key``, ...) that aren't the first with their key, with that ``first`` (id, h, pos).

    First places are combined before the shuffle and kept as a table, so that both sides of the join come straight from
    a shuffle and Spark splits a key that a large part of the rows hold.
    """
    place = F.struct("id", "h", "pos")
    firsts = found.groupBy(key).agg(F.count("*").alias("n"), F.min(place).alias("first")).where(F.col("n") > 1)
    firsts = keep_table(firsts.select(key, "first"), "firsts")
    return found.join(firsts, key).where(~place.eqNullSafe(F.col("first")))


def covered(docs: DataFrame, size: int = 3) -> DataFrame:
    """(id, h, gone): the places of the lines to remove, for the documents that have some."""
    later = repeats(windows(docs, size), "w")
    return later.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("gone"))


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed, and the text that is left, for every document.

    Texts travel as arrays of lines, so that what is left is picked by place: work grows with the lines, however many go.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_h"), F.split("text", "\n", -1).alias("lines"))
    gone = covered(docs, size)
    marked = rows.join(gone, rows["doc_id"].eqNullSafe(gone["id"]) & (rows["row_h"] == gone["h"]), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.col("lines")[i]))
    count = lambda array: F.when(array.isNull(), 0).otherwise(F.size(array)).cast("long")
    return marked.select("doc_id", count(F.col("lines")).alias("n_lines"), count(F.col("gone")).alias("n_removed"), F.array_join(kept, "\n").alias("text"))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text by text, and the offsets of the texts."""
    offsets, flat = words(texts)
    coded = pa.array(flat).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)], offsets


def picks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the picked runs of ``GRAM`` words of one text."""
    if len(hashes) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, width = hashes, 1
    while width < GRAM:
        left, right = g[:-width], g[width:]
        g = (left ^ (left >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        width *= 2
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    n = PASSAGE - GRAM + 1
    least = np.lib.stride_tricks.sliding_window_view(g, n).min(1)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(least, n - 1), n).max(1)
    at = np.nonzero(g == around)[0]
    return at, g[at]


def picked(text: Column) -> Column:
    @F.arrow_udf("array<struct<pos: bigint, g: bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [pa.array([], pa.list_(pa.struct([("pos", pa.int64()), ("g", pa.int64())])))]
            for a, b in slices(batch, SLICE):
                hashes, offsets = word_hashes(batch.slice(a, b - a))
                found = [picks(hashes[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
                ends = np.cumsum([0, *(len(at) for at, _ in found)]).astype(np.int32)
                at, g = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(at), pa.array(g.view(np.int64))], ["pos", "g"])))
            yield pa.concat_arrays(out)

    return run(text)


def borders(text: Column, ends: Column) -> Column:
    """For every (pos, side) the hashes of up to ``MARGIN`` words of ``text`` before (side 0) or from (side 1) word ``pos`` on."""

    @F.arrow_udf("array<struct<pos: bigint, side: int, words: binary>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("side", pa.int32()), ("words", pa.binary())]))
        for texts, asked in batches:
            out = []
            for k in range(len(texts)):
                hashes = word_hashes(texts.slice(k, 1))[0]
                out.append([{"pos": x["pos"], "side": x["side"], "words": (hashes[x["pos"]: x["pos"] + MARGIN] if x["side"] else
                                                                         hashes[max(0, x["pos"] - MARGIN): x["pos"]]).tobytes()} for x in asked[k].as_py()])
            yield pa.array(out, kind)

    return run(text, ends)


def runs_of(later: DataFrame) -> DataFrame:
    """(id, h, first_id, first_h, shift, a, b): picks on one diagonal whose words touch are one range of equal words, a to b - 1."""
    pick = F.struct(F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"), (F.col("pos") - F.col("first.pos")).alias("shift"), "pos")
    sets = later.groupBy("id", "h").agg(F.sort_array(F.collect_set(pick)).alias("p"))  # at most the picks of one text
    p = F.col("p")
    same = lambda x, y: F.struct(x["first_id"], x["first_h"], x["shift"]).eqNullSafe(F.struct(y["first_id"], y["first_h"], y["shift"]))
    opens = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | ~same(p[i], p[i - 1]) | (p[i]["pos"] > p[i - 1]["pos"] + GRAM))
    sets = sets.withColumn("opens", opens)
    last = lambda k: p[F.coalesce(F.get("opens", k + 1), F.size(p)) - 1]["pos"] + GRAM
    runs = F.transform("opens", lambda i, k: F.struct(p[i]["first_id"].alias("first_id"), p[i]["first_h"].alias("first_h"), p[i]["shift"].alias("shift"),
                                                      p[i]["pos"].alias("a"), last(k).alias("b")))
    return sets.select("id", "h", F.explode(runs).alias("r")).select("id", "h", "r.*")


def passages(docs: DataFrame) -> DataFrame:
    """(id, h, runs): ranges of words seen before, with the words that stood around them then, for the documents that have some.

    Texts travel once, to answer for the borders of the ranges; between the picks of a range all words are known to be equal.
    """
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")
    found = keep_table(texts.select("id", "h", F.explode(picked(F.col("text"))).alias("x")).select("id", "h", "x.*"), "picks")
    runs = keep_table(runs_of(repeats(found, "g")), "runs")
    ends = F.array(F.struct((F.col("a") - F.col("shift")).alias("pos"), F.lit(0).alias("side")), F.struct((F.col("b") - F.col("shift")).alias("pos"), F.lit(1).alias("side")))
    asked = runs.select("first_id", "first_h", F.explode(ends).alias("e")).groupBy("first_id", "first_h").agg(F.collect_set("e").alias("ends"))
    beside = texts.join(asked, texts["id"].eqNullSafe(asked["first_id"]) & (texts["h"] == asked["first_h"]))
    answers = beside.select("first_id", "first_h", F.explode(borders(F.col("text"), F.col("ends"))).alias("e")).select("first_id", "first_h", "e.*")
    answers = keep_table(answers.distinct(), "borders")  # repeated rows answer alike
    for side, at, name in ((0, "a", "before"), (1, "b", "behind")):
        one = answers.where(F.col("side") == side).toDF("f_id", "f_h", "f_pos", "side", name).drop("side")
        runs = runs.join(one, runs["first_id"].eqNullSafe(one["f_id"]) & (runs["first_h"] == one["f_h"]) & (runs[at] - runs["shift"] == one["f_pos"])).drop("f_id", "f_h", "f_pos")
    return runs.groupBy("id", "h").agg(F.collect_set(F.struct("a", "b", "before", "behind")).alias("runs"))


def grown(hashes: np.ndarray, runs: list[dict]) -> list[dict]:
    """The ranges, in order, with the equal words around them: words of the text (``hashes``) against those of the first place."""
    out = []
    for r in runs:
        before, behind = np.frombuffer(r["before"], np.uint64), np.frombuffer(r["behind"], np.uint64)
        n, m = min(len(before), r["a"]), min(len(behind), len(hashes) - r["b"])
        other = np.nonzero(hashes[r["a"] - n: r["a"]][::-1] != before[len(before) - n:][::-1])[0]
        more = np.nonzero(hashes[r["b"]: r["b"] + m] != behind[:m])[0]
        out.append({"a": r["a"] - int(other[0] if len(other) else n), "b": r["b"] + int(more[0] if len(more) else m)})
    return sorted(out, key=lambda x: (x["a"], x["b"]))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order, joined where every ``GRAM`` words across are in one of them; those of a passage's length."""
    out: list[list[int]] = []
    for x in spans:
        if out and x["a"] <= out[-1][1] - GRAM + 1:
            out[-1][1] = max(out[-1][1], x["b"])
        else:
            out.append([x["a"], x["b"]])
    return [(a, b) for a, b in out if b - a >= PASSAGE]


def without_spans(text: str, gone: list[int], spans: list[dict]) -> str:
    """``text`` without the lines ``gone`` and the passages of ``spans``; a line of which nothing is left goes, too."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)] if spans else []
    cuts, dropped, kept, at = [(starts[a], starts[b]) for a, b in merged(spans)], set(gone), [], 0
    ahead = 0  # the first of the cuts, in order, that doesn't end before the line
    for n, line in enumerate(text.split("\n")):
        left, place, end = "", at, at + len(line)
        while ahead < len(cuts) and cuts[ahead][1] <= at:
            ahead += 1
        for k in range(ahead, len(cuts)):
            a, b = cuts[k]
            if a >= end:
                break
            left += text[place: max(place, a)]
            place = max(place, min(b, end))
        left += text[place:end]
        if n not in dropped and (left == line or WORD.search(left)):
            kept.append(left)
        at += len(line) + 1
    return "\n".join(kept)


def lines_or_none() -> Column:
    return F.coalesce("gone", F.array().cast("array<int>"))


def runs_or_none() -> Column:
    kind = "array<struct<a: bigint, b: bigint, before: binary, behind: binary>>"
    return F.coalesce(F.col("runs").cast(kind), F.array().cast(kind))


def cut(text: Column, gone: Column, runs: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lines, ranges in batches:
            out = []
            for k in range(len(texts)):
                text, found = texts[k].as_py(), ranges[k].as_py()
                spans = grown(word_hashes(texts.slice(k, 1))[0], found) if found else []
                out.append(None if text is None else without_spans(text, lines[k].as_py(), spans))
            yield pa.array(out, pa.string())

    return run.asNondeterministic()(text, gone, runs)  # so that Spark doesn't run it once in a filter and once more for the column


def without_repeats(docs: DataFrame, size: int = 3) -> DataFrame:
    """The documents with their repeated passages removed (and n_chars set anew); those of which nothing is left go."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_h"))
    gone, spans = covered(docs, size), passages(docs).toDF("span_id", "span_h", "runs")
    marked = rows.join(gone, rows["row_id"].eqNullSafe(gone["id"]) & (rows["row_h"] == gone["h"]), "left")
    marked = marked.join(spans, marked["row_id"].eqNullSafe(spans["span_id"]) & (marked["row_h"] == spans["span_h"]), "left")
    touched = F.col("gone").isNotNull() | F.col("runs").isNotNull()
    # only texts with something to remove go to Python
    shorter = cut(F.when(touched, F.col("row.text")), lines_or_none(), runs_or_none())
    out = marked.select("row", touched.alias("touched"), shorter.alias("shorter"))
    out = out.withColumn("kept_text", F.when(F.col("touched"), F.col("shorter")).otherwise(F.col("row.text")))
    out = out.where((F.col("row.text").isNull()) | (F.col("kept_text") == F.col("row.text")) | ~F.col("kept_text").rlike(BLANK))
    columns = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[columns[c].alias(c) if c in columns else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = """
WITH lines AS (
  SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
  WHERE NOT regexp_full_match(line, '[\\x09-\\x0D\\x20]*')),
win AS (
  SELECT a.doc_id, a.k, a.n AS n0, b.n AS n1, c.n AS n2, a.line || chr(10) || b.line || chr(10) || c.line AS w
  FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN lines c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS occurrence FROM win) WHERE occurrence > 1),
gone AS (SELECT DISTINCT doc_id, unnest([n0, n1, n2]) AS n FROM later),
every AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
left_over AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM every ANTI JOIN gone USING (doc_id, n) GROUP BY doc_id),
removed AS (SELECT doc_id, COUNT(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(COALESCE(r.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN r.n IS NULL THEN d.text ELSE COALESCE(l.text, '') END AS text
FROM documents d LEFT JOIN left_over l USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""
