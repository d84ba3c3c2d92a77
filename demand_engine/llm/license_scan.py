"""License scans (operator 11): ordered signature rules behind a keyword prefilter.

Texts are reduced to words (runs of digits, letters and characters beyond ASCII, A-Z lower-cased), joined by blanks. One
automaton of all keywords runs over each slice of texts; only rules whose keyword occurs in a text are searched there.
What they find are intervals. In order of priority (``license_rules``; longer intervals first within a kind, then rules as
written) an interval is dropped if it lies inside one that was kept. Base phrases are always kept, and hide only mentions and
what says the same.

``scan`` returns the detections with their places and words; ``digest`` derives counts, labels and the score from them.
The score is 1 minus the product of (1 - weight) over the kinds of rules that were kept: 0 without a detection.

A null or empty text has no word and no detection. Texts are searched whole, whatever their length. Repeated rows are rows of
their own, a null id stays null. Ties can't occur, as rules are in order. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demand_engine.llm.license_rules import WEIGHTS, Rule, all_rules
from demand_engine.llm.text import data_of, slices

FOUND = "array<struct<label:string,kind:string,rule:int,first_word:bigint,words:int,text:string>>"
DETECTION = pa.struct([("label", pa.string()), ("kind", pa.string()), ("rule", pa.int32()), ("first_word", pa.int64()), ("words", pa.int32()), ("text", pa.string())])
ORDER = list(WEIGHTS)


def letters() -> np.ndarray:
    """Byte to byte: A-Z lower-cased, everything that is not in a word a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    for first, last in ((48, 57), (97, 122)):
        table[first: last + 1] = np.arange(first, last + 1)
    table[65:91] = np.arange(97, 123)
    return table


def normalised(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of all texts, each with a blank behind, where each text starts in them, and the number of words of each."""
    data, offsets = data_of(pc.fill_null(texts, ""))
    data = letters()[data]
    blank = data == 32
    stop = np.zeros(len(data) + 1, bool)  # the byte before is the last of a word
    stop[1:] = ~blank
    ends = stop[1:].copy()
    ends[:-1] &= blank[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] |= ~blank[last]  # words do not run on into the next text
    size = 1 + ends.astype(np.int64)
    size[blank] = 0
    place = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(place[-1]), 32, np.uint8)
    out[place[:-1][~blank]] = data[~blank]
    words = np.concatenate(([0], np.cumsum(ends)))
    return out.tobytes(), place[offsets], words[offsets[1:]] - words[offsets[:-1]]


class Scanner:
    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        self.expressions = [r.compiled() for r in rules]
        self.gates = ahocorasick.Automaton()
        gated: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            gated.setdefault(r.keyword, []).append(i)
        for keyword, which in gated.items():
            self.gates.add_word(keyword, which)
        self.gates.make_automaton()

    def find(self, text: str, which: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches of the rules, and of those the ones that no kept one hides, by start."""
        found = [(m.start(), m.end(), i) for i in which for m in self.expressions[i].finditer(text)]
        found.sort(key=lambda d: (ORDER.index(self.rules[d[2]].kind), d[0] - d[1], d[2], d[0]))
        kept: list[tuple[int, int, int]] = []  # by start
        longest = 0
        for start, end, i in found:
            hidden, k = False, bisect_right(kept, (start, len(text) + 1, 0))
            while not hidden and k > 0 and kept[k - 1][0] >= start - longest and self.rules[i].kind != "base":
                k -= 1
                hidden = kept[k][1] >= end and self.hides(kept[k][2], i)
            if not hidden:
                insort(kept, (start, end, i))
                longest = max(longest, end - start)
        return kept

    def hides(self, kept: int, other: int) -> bool:
        """Whether a kept rule hides another one inside it: a base phrase only what says the same, or a mention."""
        a, b = self.rules[kept], self.rules[other]
        return a.kind != "base" or a.label == b.label or b.kind == "mention"

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        data, starts, n_words = normalised(texts)
        plain = data.decode("latin-1")  # one character a byte, so places are those of the bytes
        hit: dict[int, set[int]] = {}
        for end, which in self.gates.iter(plain):
            hit.setdefault(int(np.searchsorted(starts, end, side="right")) - 1, set()).update(which)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for row, which in hit.items():
            text = plain[starts[row]: starts[row + 1]]
            at, before = 0, 0
            for start, end, i in self.find(text, sorted(which)):
                before += text.count(" ", at, start)
                at = start
                rule, said = self.rules[i], text[start:end]
                out[row].append({"label": rule.label, "kind": rule.kind, "rule": i, "first_word": before, "words": said.count(" ") + 1,
                                 "text": said.encode("latin-1").decode("utf-8", "replace")})
        return n_words, out


@cache
def scanner() -> Scanner:
    return Scanner(all_rules())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the detections of every text: label, kind and number of the rule, first word, words, and the words found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                n, found = scanner().scan(batch["text"].slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(n), pa.array(found, pa.list_(DETECTION))],
                                                 ["doc_id", "n_words", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, found {FOUND}")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found."""
    base = F.filter("found", lambda d: d["kind"] == "base")
    listed = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda d: d["label"]))), ",")
    kinds = F.array_distinct(F.transform("found", lambda d: d["kind"]))
    doubt = reduce(lambda x, kind: x * F.when(F.array_contains(kinds, kind), 1 - WEIGHTS[kind]).otherwise(1.0), ORDER, F.lit(1.0))
    firsts = F.transform(base, lambda d: d["first_word"])
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"),
                          F.array_max(firsts).alias("last_word"), listed(base).alias("base_labels"), listed(F.col("found")).alias("labels"),
                          (1 - doubt).alias("score"), F.size("found").cast("long").alias("n_found"))
