"""License scans, hard negatives and collocations against plain versions of the same contracts."""

from __future__ import annotations

import random
import re
from re import _constants as K
from re import _parser

import duckdb
import numpy as np
import pytest

from demand_engine.llm import collocations, hard_negatives, license_rules, license_scan

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *keys):
    return sorted((tuple(r[k] for k in (keys or df.columns)) for r in df.collect()), key=repr)


def sql_rows(sql, columns, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    rel = con.execute(sql)
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    return sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


# ---- license scans

SENTENCES = ["Released under the MIT License.", "under the mit license under the MIT-license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "cc by nc",
             "SPDX-License-Identifier: GPL-2.0-or-later", "GNU General Public License, version 3", "All rights reserved.", "Größe ünder the mit license", "",
             "https://www.apache.org/licenses/LICENSE-2.0", "plain words only", "smit license", "under\nthe\tmit license2", "CC-BY-NC-SA 4.0", "Creative Commons"]


def plain_scan(text):
    """All rules searched everywhere, all intervals held against all kept ones."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))
    joined, rules = " ".join(words), license_rules.all_rules()
    found = [(license_scan.ORDER.index(r.kind), m.start() - m.end(), i, m.start(), m.end()) for i, r in enumerate(rules) for m in r.compiled().finditer(joined)]
    kept = []
    for _, _, i, a, b in sorted(found):
        inside = [rules[k] for k, x, y in kept if x <= a and b <= y]
        if rules[i].kind == "base" or not any(k.kind != "base" or k.label == rules[i].label or rules[i].kind == "mention" for k in inside):
            kept.append((i, a, b))
    return len(words), sorted((joined.count(" ", 0, a), i) for i, a, b in kept)


def test_license_scan_equals_a_plain_search(spark):
    rng = random.Random(3)
    texts = [None, "", *SENTENCES] + [rng.choice([" ", "\n", ". "]).join(rng.choices(SENTENCES, k=rng.randint(1, 30))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, found int")
    got = {r.doc_id: (r.n_words, sorted((d.first_word, d.rule) for d in r.found)) for r in license_scan.scan(df).collect()}
    assert got == {i: plain_scan(t) for i, t in enumerate(texts)}


def test_license_digest(spark):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    texts = [None, *SENTENCES, "x " * 50_000 + "cc by nc", "Licensed under the Apache License, Version 2.0 or under the MIT license"] + ["cc by nc "] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.digest(license_scan.scan(df)).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").translate(LETTERS))
        places = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i: i + len(p.split())] == p.split()]
        firsts, labels = [p[0] for p in places], sorted({p[1] for p in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(firsts, default=None), max(firsts, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | ({""} if not labels else set())
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.n_found > 0) == (r.labels != "")


def test_license_labels_of_the_method(spark):
    df = spark.createDataFrame([(0, SENTENCES[3]), (1, SENTENCES[5]), (2, SENTENCES[6]), (3, "the gnu affero general public license"), (4, "MIT license")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.digest(license_scan.scan(df)).collect()}
    assert got == {0: "cc-by-nc,cc-by-nc-4", 1: "gpl-2", 2: "gpl-3", 3: "agpl", 4: "mit"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert license_scan.digest(license_scan.scan(docs)).count() == 0
    assert collocations.mine(docs).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def sample(tokens, rng):
    out = ""
    for op, a in tokens:
        if op is K.LITERAL:
            out += chr(a)
        elif op is K.IN:
            kind, value = a[0]
            out += chr(value) if kind is K.LITERAL else chr(value[0]) if kind is K.RANGE else "7" if value is K.CATEGORY_DIGIT else "x"
        elif op is K.BRANCH:
            out += sample(rng.choice(a[1]), rng)
        elif op is K.SUBPATTERN:
            out += sample(a[3], rng)
        else:
            assert op is K.MAX_REPEAT
            out += "".join(sample(a[2], rng) for _ in range(rng.choice([a[0], min(a[1], a[0] + 2)])))
    return out


def test_every_match_of_a_rule_holds_its_keyword():
    rng, rules = random.Random(1), license_rules.all_rules()
    assert len(rules) > 300
    for r in rules:
        for _ in range(40):
            text = sample(_parser.parse(r.pattern), rng)
            assert r.compiled().fullmatch(text) and r.keyword in text, (r, text)


# ---- hard negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors(n, dim, seed, spread=1.0, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, (middle[rng.integers(centres)] + spread * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(10))) for i in range(n)]


@pytest.mark.parametrize(("anchors", "rows", "spread"), [(2048, 4096, 1.0), (5, 100, 1.0), (3, 70, 0.01)])
def test_hard_negatives_equal_their_sql(spark, anchors, rows, spread):
    import pandas as pd

    data = vectors(700, 8, 1, spread)
    data += [(100, data[3][1], 1), (700, data[3][1], None), (701, None, 1), (702, [1.0, None] + [0.0] * 6, 2), (703, [float("nan")] * 8, 2),
             (704, [float("inf")] * 8, 2), (None, data[0][1], 3), (705, data[0][1], 4), (706, data[0][1], 4)]
    df = spark.createDataFrame([(*d, "x", 1) for d in data], "vec_id long, embedding array<float>, label int, score string, rank int")
    got = rows_of(hard_negatives.mine(df, hard_negatives.Settings(anchor_group=anchors, row_group=rows)), *COLUMNS)
    frame = pd.DataFrame(data, columns=["vec_id", "embedding", "label"]).astype({"vec_id": "Int64", "label": "Int32"})
    import pyarrow as pa

    table = pa.table({"vec_id": pa.array([d[0] for d in data], pa.int64()), "embedding": pa.array([d[1] for d in data], pa.list_(pa.float32())),
                      "label": pa.array([d[2] for d in data], pa.int32())})
    assert len(frame) == len(table)
    assert got == sql_rows(hard_negatives.ORACLE, COLUMNS, embeddings=table) and len(got) > 50


def test_bounds_save_products():
    data = vectors(900, 8, 5, 0.02)
    points, labels = np.floor(256 * np.array([d[1] for d in data])), np.array([d[2] for d in data])
    order, parent, edge = hard_negatives.spanning_tree(points[:60])
    windows = [[(0, 0, -np.inf, np.inf)]] * 60
    search = hard_negatives.Search(points[order], order, labels[order], parent, edge, windows, 3, False)
    search.add(points, np.arange(900), labels)
    first = search.scored
    search.add(points, np.arange(900) + 1000, labels)
    assert search.scored - first < 0.5 * 60 * 900  # under half of all
    scores = points[order] @ points.T
    for i in range(60):
        fits = [(-scores[i, j], k) for j in range(900) for k in (j, j + 1000) if labels[j] != labels[order[i]]]
        assert [(-a, int(b)) for a, b in zip(search.best[i], search.who[i])] == [(a, b) for a, b in sorted(fits)[:3]]


def test_products_beyond_float64():
    points = np.array([[2.0**40, 3.0], [1.0, 2.0**40]])
    search = hard_negatives.Search(points, np.array([0, 50]), np.array([1, 1]), np.array([-1, 0]), np.array([0.0, 2.0**41]), [[(None, None, -np.inf, np.inf)]] * 2, 2, True)
    search.add(np.array([[2.0**14, 1.0], [2.0**14, 2.0]]), np.array([7, 8]), np.array([1, 1]))
    assert [int(x) for x in search.best[0]] == [2**54 + 6, 2**54 + 3] and [int(x) for x in search.best[1]] == [2**41 + 2**14, 2**40 + 2**14]


def test_tree_is_minimal():
    points = np.random.default_rng(2).normal(size=(40, 3))
    order, parent, edge = hard_negatives.spanning_tree(points)
    assert sorted(order) == list(range(40)) and all(parent[i] < i for i in range(1, 40))
    far = ((points[:, None] - points[None]) ** 2).sum(2) ** 0.5
    groups, total = list(range(40)), 0.0  # Kruskal
    for d, i, j in sorted((far[i, j], i, j) for i in range(40) for j in range(i)):
        if groups[i] != groups[j]:
            total, groups = total + d, [groups[i] if g == groups[j] else g for g in groups]
    assert edge.sum() == pytest.approx(total)


# ---- collocations

MINED = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_equal_their_sql(spark):
    rng = random.Random(4)
    some = ["the", "of", "new york", "New York City council", "a, b", "a", "b. c", "Zürich", "x\ty", "rare%d", "long passage of words that comes again"]
    texts = [(i, rng.choice([" ", ", ", "\n", "  "]).join(w % rng.randint(0, 500) if "%" in w else w for w in rng.choices(some, k=rng.randint(0, 60))), rng.choice(["en", "de", None, "und"]))
             for i in range(400)]
    texts += [(400, None, "en"), (401, "", None), (402, ". , ;", "en"), (403, "word", "fr"), (404, "a " * 20_000, "en"), (405, texts[0][1], "en"), (405, texts[0][1], "en")]
    df = spark.createDataFrame([(*t, 1, "y") for t in texts], "doc_id long, text string, lang string, n int, phrase string")
    import pandas as pd

    got = rows_of(collocations.mine(df), *MINED)
    assert got == sql_rows(collocations.ORACLE, MINED, documents=pd.DataFrame(texts, columns=["doc_id", "text", "lang"])) and len(got) > 50


def test_collocations_do_not_depend_on_batches(spark):
    texts = [(i, "the same words come again and again in every text " * (1 + i % 3), "en") for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    want = rows_of(collocations.mine(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(collocations.mine(df.repartition(5))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_paths_are_compacted(spark):
    words = "one two three four five six seven".split()
    edges = [("en", " ".join(words[i: i + 4]), 40) for i in range(4)] + [("en", "four five six eight", 31), ("en", "a a a a", 99), ("en", "p q r p", 50), ("en", "q r p q", 50), ("en", "r p q r", 50)]
    got = rows_of(collocations.compact_paths(spark.createDataFrame(edges, "lang string, phrase string, n long")), "phrase", "n")
    # six leaves "four five six" by two edges, so the path ends before it; the cycle of three edges has no head
    assert got == sorted([("one two three four five six", 40), ("four five six seven", 40), ("four five six eight", 31), ("a a a a", 99),
                          ("p q r p", 50), ("q r p q", 50), ("r p q r", 50)])


def test_flow_gives_the_counts_of_shorter_phrases(spark):
    texts = [(i, "a b c d. a b c. a b. b c d e", "en") for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    s = collocations.Settings()
    found = {r.phrase: r.n for r in collocations.frequent_phrases(df, collocations.frequent_words(df, s.least), s).collect()}
    assert found == {"a": 90, "b": 120, "c": 90, "d": 60, "e": 30, "a b": 90, "b c": 90, "c d": 60, "d e": 30, "a b c": 60, "b c d": 60, "c d e": 30, "a b c d": 30, "b c d e": 30}


def test_collocations_ranked_in_parts_are_the_first_of_all(spark):
    rng = random.Random(21)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(40)) for _ in range(150)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    every = sorted(collocations.mine(docs).collect(), key=lambda r: r["rank"])
    some = sorted(collocations.mine(docs, collocations.Settings(top=7)).collect(), key=lambda r: r["rank"])
    assert len(every) > 50 and some == every[:7] and [r["rank"] for r in some] == list(range(1, 8))
