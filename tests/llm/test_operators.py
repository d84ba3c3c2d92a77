"""The text operators against brute force, round trips and held-out accuracy on small texts."""

import base64
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from demand_engine.llm import (
    byte_bpe,
    chat_format,
    decontamination,
    language_id,
    line_dedup,
    lm_score,
    near_duplicates,
    quality,
    token_files,
    url_filter,
)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    parts = ["ab", "C", " ", "  ", "\n", "\t", "'s", "é", "漢", "🙂", "12", ",", "!!", "　", "\x85", "x" * 40, "<|endoftext|>", "\x1c", "İ", "Σ", "\u0301", "-"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    return [None, "", " ", "a", "a b", "a b c", *some, some[3], some[3], LONG]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Texts with columns that the operators use as names of their own, in several partitions."""
    rows = [(i, t, "x", "s", 1, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, h string, block int, fp long").repartition(3)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_byte_bpe_equals_the_library_and_gives_the_text_back(docs, texts):
    import hashlib

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(byte_bpe.encode_documents(docs, RANKS, PATTERN, with_ids=True))
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_very_long_pieces_take_the_same_merges():
    bpe = byte_bpe.coder(open(RANKS, "rb").read(), PATTERN)
    rng = random.Random(2)
    piece = "".join(rng.choice("abcdefgh") for _ in range(byte_bpe.LONG + 500))
    data = np.frombuffer(piece.encode(), np.uint8)
    by_rows = bpe.matrix(bpe.single[data][None].copy())[0]
    assert bpe.long(data).tolist() == by_rows.tolist()
    assert bpe.encode(pa.array([piece]))[1].tolist() == by_rows.tolist()


def test_token_files_equal_the_library(spark, docs, texts):
    made = Tokenizer.from_file(WORD_BPE)
    got, start = rows_of(token_files.token_documents(docs, WORD_BPE)), 0
    for i, t in enumerate(texts):
        ids = made.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_can_be_read_by_column_and_page(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    folder = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, folder, WORD_BPE)
    files = sorted(glob.glob(f"{folder}/part-*.parquet"))
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(k) for f in files for k in range(3)]
    assert all(c.has_offset_index and (c.has_column_index or c.path_in_schema.startswith("ids")) for c in columns)
    assert any("RLE_DICTIONARY" in c.encodings for c in columns if c.path_in_schema.startswith("ids"))
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.path_in_schema == "doc_id")
    plan = token_files.read_tokens(spark, folder).where("doc_id = 3").select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def print_of(text):
    w = [lower(x) for x in WORDS.findall(text or "")]
    shingles = [" ".join(w[i: i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, texts):
    got = rows_of(near_duplicates.near_duplicates(docs))
    prints = [print_of(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == root


def test_every_pair_within_two_bits_meets_in_a_table():
    masks = near_duplicates.masks(2)
    assert len(masks) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m & (1 << i | 1 << j) for m in masks)


@pytest.mark.parametrize("small", [2, 64])
def test_links_connect_what_all_pairs_connect(spark, small):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = set(base)
    for b in base[:2]:  # dense groups and chains around two of them
        walk = b
        for _ in range(60):
            values.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
            walk ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(walk)
    signed = sorted(near_duplicates.signed(v) for v in values)
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = near_duplicates.links(prints, small=small)
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in found.collect())
    root = {v: v for v in signed}
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and root[a] != root[b]:
            x, y = sorted((root[a], root[b]))
            root = {v: x if r == y else r for v, r in root.items()}
    got = {r["node"]: r["root"] for r in near_duplicates.components(found).collect()}
    assert {v: got.get(v, v) for v in signed} == root


def test_one_document_of_each_component_stays(spark):
    text = "one two three four five six"
    rows = [(3, text, "a"), (1, text, "b"), (1, text, "b"), (1, "another text of its own here", "c"), (None, text, "d"), (None, "only without an id", "e")]
    kept = near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted(kept.collect(), key=repr) == sorted([(1, text, "b"), (1, "another text of its own here", "c"), (None, "only without an id", "e")], key=repr)


def test_one_of_each_component_stays(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, values = [word() for _ in range(600)], [word() for _ in range(8)]
    slots = rng.sample(range(600), 4)
    texts = []
    for _ in range(150):
        w = list(base)
        for i in slots:
            w[i] = rng.choice(values)
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(50)) for _ in range(20)] + [texts[3].upper(), texts[3], "one two", "one  Two", "", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(4)
    prints, root = [print_of(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if root[a] != root[b] and (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    got = near_duplicates.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(root)) and all(r["text"] == texts[r["doc_id"]] for r in got)


def test_lines_of_a_long_text_are_cut_in_proportion():
    import time

    text = lambda n: "\n".join(f"line number {i}" for i in range(n))
    spent = []
    for n in (20_000, 160_000):
        start = time.perf_counter()
        kept = line_dedup.without_spans(text(n), list(range(1, n, 2)), [{"a": 6 * i, "b": 6 * i + 3} for i in range(n // 2)])
        spent.append(time.perf_counter() - start)
        assert kept == "\n".join(f"line number {i}" for i in range(0, n, 2))
    assert spent[1] < 30 * spent[0]


def removed_lines(texts, size=3):
    """Kept texts by brute force over (id, text) in order."""
    seen, gone = {}, {}
    for i, t in enumerate(texts):
        lines = [(n, x) for n, x in enumerate((t or "").split("\n")) if WORDS.search(x)]
        for k in range(len(lines) - size + 1):
            window = tuple(x for _, x in lines[k: k + size])
            if window in seen:
                gone.setdefault(i, set()).update(n for n, _ in lines[k: k + size])
            seen.setdefault(window, i)
    return [t if i not in gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in enumerate(texts)]


def test_later_occurrences_of_line_windows_go(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["a", "b", "c", "", " ", "d e"]) for _ in range(rng.randint(0, 14))) for _ in range(60)] + [None, "", "a\nb\nc", "a\nb\nc", "z\na\nb\nc\ny", "q\nq\nq\nq\nq"]
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in enumerate(texts)], "doc_id long, text string, pos string, w int").repartition(4)
    got = rows_of(line_dedup.dedup_lines(docs))
    assert [got[i]["text"] for i in range(len(texts))] == removed_lines(texts)
    left = rows_of(line_dedup.without_repeats(docs.selectExpr("*", "cast(0 as long) AS n_chars")))
    for i, t in enumerate(removed_lines(texts)):
        if t == texts[i] or WORDS.search(t or ""):
            assert left[i]["text"] == t and left[i]["pos"] == "p" and left[i]["n_chars"] == (None if t is None else len(t))
        else:
            assert i not in left


def test_later_occurrences_of_long_passages_inside_lines_go(spark):
    rng = random.Random(14)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts, kept = [], []
    for n in (50, 51, 60, 200, 900, 49, 30):
        passage, sides = some(n), [some(20) for _ in range(4)]
        texts += [f"{sides[0]} {passage} {sides[1]}", f"{sides[2]} {passage} {sides[3]}"]
        kept += [texts[-2], f"{sides[2]} {sides[3]}" if n >= 50 else texts[-1]]
    wrapped, sides = some(70).split(), [some(9) for _ in range(3)]
    texts += [sides[0] + "\n" + " ".join(wrapped), sides[1] + " " + "\n".join([" ".join(wrapped[:33]), " ".join(wrapped[33:])]) + " " + sides[2], " ".join(wrapped)]
    kept += [texts[-3], sides[1] + " \n" + sides[2], None]  # set in other lines; and nothing else
    inside = some(55)
    texts += [f"{sides[0]} x {inside} y {inside} z"]  # twice in one text
    kept += [f"{sides[0]} x {inside} y z"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)
    got = rows_of(line_dedup.without_repeats(docs))
    assert [got[i]["text"] if i in got else None for i in range(len(texts))] == kept
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def counts_of(text):
    w = WORDS.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i: i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def labelled_docs(spark, extra=()):
    rng = random.Random(11)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "house", "river", "stands", "near", "old", "town", "and"]) for _ in range(14)) + "." for _ in range(6))
    bad = lambda: "\n".join(" | ".join(rng.choice(["menu", "login", "$$$", "##", "&&"]) + str(rng.randint(0, 99)) for _ in range(14)) for _ in range(6))
    rows = [(i, (good if i % 2 else bad)(), i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + list(extra), "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows[:50]] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: q for i, _, q in rows}


def test_quality_counts_and_verdicts(spark, texts):
    extra = [(1000 + i, t) for i, t in enumerate(texts)]
    docs, labels, truth = labelled_docs(spark, extra)
    got = rows_of(quality.quality(docs, labels))
    for i, t in extra:
        n, *rest, repeated = counts_of(t)
        assert tuple(got[i][c] for c in quality.COUNTS) == (n, *rest, repeated)
        assert got[i]["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    judged = [i for i in truth if i >= 50 and not got[i]["base_failed"]]
    assert len(judged) > 10 and all(got[i]["kept"] == bool(truth[i]) for i in judged)


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(3)
    field = quality.Field(np.zeros(1), np.ones(1), np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [0, 1, 5, 3, 0, 7]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(size=(offsets[-1], 2))
    labels = quality.decode(scores, offsets, field)
    for a, b in zip(offsets[:-1], offsets[1:]):
        def total(way, a=a):
            return sum(scores[a + k, x] for k, x in enumerate(way)) + (field.start[way[0]] if way else 0) + sum(field.move[x, y] for x, y in zip(way, way[1:]))
        best = max(itertools.product((0, 1), repeat=b - a), key=total)
        assert tuple(labels[a:b]) == best


def test_lm_scores_equal_the_plain_model(spark, docs, texts):
    s = lm_score.Settings()
    tokens = [[lower(x) for x in WORDS.findall(t or "")] + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    one, two = Counter(), Counter()
    for w, out in zip(tokens, held):
        if not out:
            one.update(w)
            one["start "] += 1
            two.update(zip(["start "] + w, w))
    n, v = sum(c for k, c in one.items() if k != "start "), len(one) - 1
    got = rows_of(lm_score.score_documents(docs, s))
    for i, w in enumerate(tokens):
        root = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        score = sum(math.log10((two[h, x] + s.mu * p) / (one[h] + s.mu)) if one[h] else math.log10(p) for h, x, p in zip(["start "] + w, w, root))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(one[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, root)), rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_lm_scores_do_not_depend_on_blocks(spark, docs, monkeypatch):
    whole = {k: r["score"] for k, r in rows_of(lm_score.score_documents(docs)).items()}
    monkeypatch.setattr(lm_score, "BLOCK", 20_000)
    monkeypatch.setattr(lm_score, "BUCKET", 5_000)
    parts = {k: r["score"] for k, r in rows_of(lm_score.score_documents(docs)).items()}
    assert whole.keys() == parts.keys() and all(whole[k] == pytest.approx(parts[k], rel=1e-12) for k in whole)


def test_a_state_s_arcs_are_a_distribution():
    """(c(hw) + mu P(w)) / (c(h) + mu) adds up to one over the vocabulary and one unseen class."""
    one, two, mu = Counter("aab"), Counter([("a", "a"), ("a", "b")]), 20.0
    root = {w: (one[w] + 0.1) / (3 + 0.1 * 3) for w in ("a", "b", "?")}
    assert sum(root.values()) == pytest.approx(1)
    assert sum((two["a", w] + mu * root[w]) / (2 + mu) for w in root) == pytest.approx(1)


def test_languages_are_told_apart(spark):
    rng = random.Random(6)
    stems = {"de": ["nicht", "schön", "über", "und", "der", "ung"], "en": ["the", "thing", "with", "that", "was", "ing"], "fr": ["été", "que", "eau", "les", "où", "çon"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(rng.randint(4, 40))), lang) for i in range(240) for lang in [list(stems)[i % 3]]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", "en"), (903, "the thing", None), (None, "que les eau", "fr"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:240]}
    assert all(r["lang_pred"] == truth[r["doc_id"]] and r["score"] > 0.5 for r in got if r["doc_id"] in truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902)) and by[903]["lang_pred"] == "en" and by[None]["lang_pred"] == "fr"
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({900, 901, 902})


def test_predictions_do_not_depend_on_slices():
    s = language_id.Settings()
    texts = ["über die Brücke", None, "", "a", "x  y", "12", "é" * 50]
    whole = language_id.grams(texts, s)
    for k, t in enumerate(texts):
        alone = language_id.grams([t], s)
        assert alone.lettered[0] == whole.lettered[k]
        for n in range(s.longest):
            assert sorted(alone.bins[n]) == sorted(whole.bins[n][whole.texts[n] == k])


ITEM = "Alice buys 12 apples and 7 pears at the market then gives 12 apples to her friend before walking 5 km home"


@pytest.mark.parametrize("text, caught", [
    (ITEM, True),
    ("Some words before. " + ITEM.upper() + " and after", True),
    (ITEM.replace("12", "30").replace("7", "4").replace("5 km", "9 miles"), True),  # other values, same roles
    (ITEM.replace("12 apples to", "13 apples to"), False),  # one slot, two values
    (" ".join(ITEM.split()[:9]) + " something else entirely follows here", False),
    ("12 7 12 5 km 12 7 12 5 km 12 7 12 5 km", False),
    (None, False), ("", False), ("Alice buys", False),
])
def test_templates_catch_questions_with_other_values(spark, text, caught):
    docs = spark.createDataFrame([(1, text, 3), (1, "a clean text with the same id and more than eight words in it", 3), (None, text, 3)], "doc_id long, text string, at int")
    benchmark = spark.createDataFrame([(0, ITEM), (1, None), (2, "too short"), (None, "")], "item_id long, text string")
    got = decontamination.decontaminate(docs, benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["contaminated"]) for r in got) == sorted([(0, caught), (1, caught), (1, False)])
    kept = decontamination.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == (1 if caught else 3)


def test_hits_carry_their_window_not_the_whole_text(spark):
    docs = spark.createDataFrame([(1, f"{ITEM} {ITEM.replace('12', '15')} and {ITEM.replace('12', '7')}"), (2, None), (3, ITEM)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, ITEM) for i in range(3)] + [(3, None), (4, "")], "item_id long, text string")
    found = decontamination.hits(docs, benchmark, 8)
    for plan in (found, decontamination.whole_matches(docs, benchmark)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        above = text[:text.index("BroadcastHashJoin")]  # what takes the hits; all those of a text are in memory at once
        assert above.count("plain#") == above.count("slice(plain#") == 1
        assert "lambdafunction" not in above.splitlines()[-2]  # cut in the loop that makes the hit, not after it
        items = text[text.index("BroadcastExchange"):]
        assert not any("plain#" in line or "tokens#" in line for line in items[:items.index("Generate")].splitlines())
        assert "posexplode" not in items  # a row for each window of an item, none with the whole item
    rows = found.where("slots[0].value = '12'").selectExpr("id", "values[slots[0].offset] AS value").distinct().collect()
    assert sorted((r["id"], r["value"]) for r in rows) == [(1, "12"), (1, "15"), (1, "7"), (3, "12")]


TOM = "Tom has 3 apples and 2 green pears. Tom eats 1 ripe apple today. Then Mary buys 4 more pears. Mary gives 1 to him"


@pytest.mark.parametrize("item, text, caught", [
    (ITEM, ITEM.replace("12 apples to", "13 apples to"), True),  # one slot broken, all else verbatim
    (ITEM, ITEM.replace("12", "4").replace("7", "4"), True),  # values that coincide
    (TOM, TOM.replace("Tom", "Ivan").replace("Mary", "Olga"), True),  # names that open sentences
    (TOM, TOM.replace("3", "7").replace("Tom", "Ivan").replace("Mary", "Olga").replace("4", "7"), True),
    (ITEM, ITEM.lower(), True), (ITEM, ITEM.upper(), True), (ITEM, ITEM.title(), True), (TOM, TOM.lower().replace("3", "8"), True),
    (TOM, TOM.replace(" ", "  ").replace("  Mary", "\nMary"), True),
    (ITEM, " ".join(ITEM.split()[:9]) + " something else entirely follows here", False),
    (ITEM, "Bob sells 9 plums or 8 figs in a shop and later sells 9 plums for his brother after running 3 km away", False),
    (ITEM, "12 7 12 5 km 12 7 12 5 km 12 7 12 5 km", False), (ITEM, None, False), (ITEM, "", False),
])
def test_the_pipeline_catches_copies_of_any_layout_and_value(spark, item, text, caught):
    docs = spark.createDataFrame([(1, text, 3), (2, "a clean text of its own with more than eight words in it", 3)], "doc_id long, text string, at int")
    benchmark = spark.createDataFrame([(0, item), (1, None)], "item_id long, text string")
    kept = decontamination.keep_clean(docs, benchmark, whole=True)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == ([2] if caught else [1, 2])


def test_a_benchmark_in_several_parts_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"prefix {ITEM if i % 2 else 'nothing of it'} suffix") for i in range(6)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "PART", 3)
    got = decontamination.decontaminate(docs, benchmark).collect()
    assert {r["doc_id"]: r["contaminated"] for r in got} == {i: bool(i % 2) for i in range(6)}


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://www.example.net/fr/1", "www.example.net", "/fr/1", "net/", "block"),
    ("http://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"),
    ("http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
    ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://x.net?q=/", "x.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h"), (1, url, "h")], "page_id long, url string, host string")
    got = url_filter.filter_urls(pages).collect()
    assert [(r["page_id"], r["host"], r["path"], r["rule"]) for r in got] == [(1, host, path, rule)] * 2
    assert all(r["verdict"] == (verdict if rule or not host else ("block" if r["score"] > 0.5 else "allow")) for r in got)


def test_url_model_on_hosts_it_has_not_seen():
    s = url_filter.Settings()
    weights = url_filter.fit(s=s)
    unwanted = ["mega-casino.example.com/en/4", "free-spam.example.org/fr/9", "adult-x.example.org/de/55", "free-bets.example.com/es/7"]
    plain = ["www.ththes.example.org/es/1374", "blog.tionble.example.com/fr/199", "m.ththin.example.org/en/2", "therha.example.com/en/676"]
    assert (url_filter.odds(unwanted, weights, s) > 0).all() and (url_filter.odds(plain, weights, s) < 0).all()


def cheapest(roles):
    """Cost of the best repair by trying every label and way of every turn."""
    best = chat_format.FAR
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for ways in itertools.product(range(3), repeat=len(roles)):
            cost, state = 0, 0
            for role, label, way in zip(roles, labels, ways):
                cost += 0 if role == label else chat_format.RELABEL_COST if role else chat_format.UNKNOWN_COST
                if way == chat_format.START and (state, label) in chat_format.FOLLOWS:
                    pass
                elif way == chat_format.MERGE and state == label:
                    cost += chat_format.MERGE_COST
                elif way == chat_format.INSERT and any((state, x) in chat_format.FOLLOWS and (x, label) in chat_format.FOLLOWS for x in (1, 2, 3)):
                    cost += chat_format.INSERT_COST
                else:
                    break
                state = label
            else:
                best = min(best, cost + chat_format.END_COST[state])
    return best


def legal(rendered):
    roles = re.findall(r"<\|im_start\|>(\w+)\n", rendered)
    tail = roles[1:] if roles[:1] == ["system"] else roles
    return tail and tail == ["user", "assistant"] * (len(tail) // 2) and rendered.count("<|im_end|>") == len(roles)


def test_chat_repair_is_cheapest_and_legal(spark, monkeypatch):
    rng = random.Random(8)
    names = [None, "system", "user", "assistant", "tool", " User "]
    code = {None: 0, "tool": 0, "system": 1, "user": 2, " User ": 2, "assistant": 3}
    chats = {c: [rng.choice(names) for _ in range(rng.randint(1, 5))] for c in range(40)}
    chats[None] = ["user", "user", "assistant"]
    rows = [(c, k, r, f"t{k} <|im_end|>" if k else None, 1) for c, roles in chats.items() for k, r in enumerate(roles)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int").repartition(3)
    for turns in (5000, 2):  # also cut into many segments
        monkeypatch.setattr(chat_format, "TURNS", turns)
        got = {}
        for r in sorted(chat_format.format_chats(table).collect(), key=lambda r: r["segment"]):
            text, cost, n = got.get(r["conv_id"], ("", 0, 0))
            got[r["conv_id"]] = (text + r["rendered"], cost + r["cost"], n + r["n_turns"])
        assert got.keys() == chats.keys()
        for c, roles in chats.items():
            text, cost, n = got[c]
            assert n == len(roles) and legal(text)
            if len(roles) <= 4:
                assert cost == cheapest([code[r] for r in roles])
            assert re.findall(r"t(\d) < \|im_end\|>", text) == [str(k) for k in range(1, len(roles))]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    benchmark, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chats, pages = spark.createDataFrame([], "conv_id long, turn long, role string, text string"), spark.createDataFrame([], "page_id long, url string, html string")
    for df in (byte_bpe.encode_documents(docs, RANKS, PATTERN), token_files.token_documents(docs, WORD_BPE), near_duplicates.near_duplicates(docs),
               near_duplicates.keep_one(docs), line_dedup.dedup_lines(docs), line_dedup.without_repeats(docs), quality.quality(docs, labels),
               lm_score.score_documents(docs), language_id.identify(docs), language_id.keep_known(docs), decontamination.decontaminate(docs, benchmark),
               decontamination.keep_clean(docs, benchmark), url_filter.filter_urls(pages), chat_format.format_chats(chats)):
        assert df.collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text here"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r["base_failed"] and not r["kept"] for r in quality.quality(docs, labels).collect())
    nameless = docs.selectExpr("*", "cast(NULL as string) AS lang")
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in language_id.identify(nameless).collect())
    assert all(not r["contaminated"] for r in decontamination.decontaminate(docs, spark.createDataFrame([(1, "x")], "item_id long, text string")).collect())


def test_token_files_spread_one_id_over_several_parts(spark):
    from pyspark.sql import functions as F

    rows = [(5 if i % 4 else i, f"text {i} " * (i % 5)) for i in range(800)] + [(None, "none")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    bounds = token_files.bounds_of(df, 6)
    ids, hashes = np.array([5] * 1000), np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 1000)
    parts = token_files.part_of(ids, np.sort(hashes), bounds)
    assert len(set(parts.tolist())) >= 3 and (np.diff(parts) >= 0).all()
    got = sorted(token_files.token_documents(df, WORD_BPE).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    assert [r.doc_id is not None for r in got] == [False] * 300 + [True] * 800
    assert [r.doc_id for r in got[300:]] == sorted(r[0] for r in rows[:800])
    assert got[0].n_tokens == df.where(F.col("doc_id").isNull()).count() // 300 + 1


def covered_by_windows(texts, size=50):
    """For every text its words that lie in a window of ``size`` words that was seen before, by looking at every window."""
    seen, out = set(), []
    for text in texts:
        words, marks = WORDS.findall(text or ""), set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i: i + size])
            if window in seen:
                marks.update(range(i, i + size))
            seen.add(window)
        out.append(marks)
    return out


def test_passages_are_those_of_all_windows(spark):
    rng = random.Random(9)
    number = itertools.count()
    new = lambda n: [f"w{next(number)}" for _ in range(n)]
    known = [new(rng.randint(40, 90)) for _ in range(6)]
    texts = []
    for _ in range(40):  # parts of 40 to 90 words, which always stand whole
        texts.append(" ".join(new(rng.randint(0, 60)) + rng.choice(known) + new(rng.randint(1, 60)) + rng.choice([[], rng.choice(known)])))
    texts += [" ".join(["again"] * 130), None, "", " ".join(sum(known[::-1], [])), " ".join(sum(known[::-1], []))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: [x.asDict() for x in r["runs"]] for r in line_dedup.passages(docs).collect()}
    for i, marks in enumerate(covered_by_windows(texts)):
        spans = line_dedup.grown(line_dedup.word_hashes(pa.array([texts[i]], pa.string()))[0], got.get(i, []))
        assert {k for a, b in line_dedup.merged(spans) for k in range(a, b)} == marks, i


def test_texts_with_borrowed_parts_travel_once_and_python_runs_once(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = line_dedup.without_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
