"""Benchmark decontamination (operator 4) by templates, with DataFrame functions only.

Texts become templates: names (a capitalised word after a lower-case letter, comma or semicolon and a space), numbers and
units after a number turn into typed placeholders, the rest is lower-cased letters and digits. Windows of template tokens
are hashed and joined with those of the benchmark. Hits on one diagonal (the same shift between document and item) are one
alignment; it counts if its slots are consistent: equal values of the item stand for equal values of the document and
different ones for different ones. So a question with other numbers or names is caught, and a chance mix is not.

A document is contaminated by an item if consistent alignments cover ``min_tokens`` of the item's tokens, or ``min_share``
of them where that is less. Windows with fewer than half plain words are no evidence, and items (or documents) of fewer
tokens than a window cannot match. Null texts have no tokens. Rows that agree in id and text are one document.

``whole_matches``, which the pipeline's stage uses, goes further. Each text gives two streams of windows: one with every
capitalised word as a name, wherever it stands (but for common words that open sentences), and one with no names at all, so
a copy is found whatever its case and white space. Windows whose slots have equal values are verbatim and always count. The
others count if half of their alignment's slot pairs or more are a one-to-one map, so values that coincide or a slot that
breaks the map lose nothing. Operator 4 itself keeps to its SQL: one stream, and all pairs of an alignment consistent.

The benchmark's windows are broadcast in parts of at most ``PART`` rows, so a part has a proven size at any benchmark size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demand_engine.llm.text import keep_table

PART = 1_000_000
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
SPACES = "[\\x09-\\x0D ]+"
NAMES = "\\p{Lu}(?<=[\\p{Ll},;] \\p{Lu})\\p{L}+"
NUMBERS = "[0-9]+(?:[.,:/][0-9]+)*"
# Units of length, mass, volume, time, money and data.
UNITS = "km|m|cm|mm|mi|miles|mile|feet|foot|ft|inches|inch|kg|g|mg|lb|lbs|pounds|l|ml|litres|liters|hours|hour|h|minutes|minute|min|seconds|second|s|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|cents|percent|kb|mb|gb|tb"
# Words that open sentences, in the languages of the tables; capitalised they are no names.
OPENERS = "A|An|And|As|At|But|By|Does|Do|Each|Every|Find|For|From|He|Her|His|How|If|In|Is|It|Its|Of|On|One|She|So|Some|That|The|Their|Then|There|These|They|This|To|We|What|When|Where|Which|Who|Why|With|You|Das|Der|Die|Ein|Eine|Er|Es|Im|Sie|Und|Wie|Wir|Ce|Cette|Elle|Et|Il|La|Le|Les|Un|Une|El|En|Las|Los|Una"
ANY_NAME = f"(?<![\\p{{L}}\\p{{N}}])(?!(?:{OPENERS})(?!\\p{{L}}))\\p{{Lu}}\\p{{L}}+"
DROPPED = "[^\\p{L}\\p{N}\\x01-\\x03\\x09-\\x0D ]+"


def split_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, DROPPED, ""), SPACES), lambda t: t != "")


def template(text: Column) -> Column:
    """Template of a text; its tokens are those of ``text`` one by one."""
    named = F.lower(F.regexp_replace(text, NAMES, NAME))
    numbered = F.regexp_replace(named, NUMBERS, NUMBER)
    return F.regexp_replace(numbered, f"{NUMBER}( ?)(?:{UNITS})\\b", f"{NUMBER}$1{UNIT}")


def is_slot(token: Column) -> Column:
    return token.rlike("[\\x01-\\x03]")


def with_windows(df: DataFrame, window: int) -> DataFrame:
    """Adds ``tokens`` and ``hashes``, one for each window of ``window`` tokens (a power of two), by doubling."""
    df = df.withColumn("tokens", split_tokens(template(F.col("text"))))
    df = df.withColumn("hashes", F.transform("tokens", lambda t: F.xxhash64(t)))
    width = 1
    while width < window:
        left = F.greatest(F.size("hashes") - width, F.lit(0))
        df = df.withColumn("hashes", F.zip_with(F.slice("hashes", F.lit(1), left), F.slice("hashes", F.lit(width + 1), left), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    return df


def cut_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, n_item, at, hash, slots) of ``items`` with ``tokens``, ``plain`` and ``hashes``: slots are (offset, value) of the placeholders of a window.

    Windows are cut in the arrays before they become rows, so no row carries the whole item.
    """
    def cut(hash: Column, at: Column) -> Column:
        part, plain = F.slice("tokens", at + 1, window), F.slice("plain", at + 1, window)
        marked = F.zip_with(part, F.transform(plain, lambda v, i: F.struct(i.alias("offset"), F.lower(v).alias("value"))), lambda t, v: F.when(is_slot(t), v))
        return F.struct(at.alias("at"), hash.alias("hash"), F.filter(marked, lambda x: x.isNotNull()).alias("slots"))

    sized = items.withColumn("n_item", F.size("tokens"))
    rows = sized.select("item_id", "n_item", F.inline_outer(F.transform("hashes", cut)))  # outer: no filter that cuts twice
    return rows.where(F.col("hash").isNotNull() & (F.size("slots") * 2 <= window))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, n_item, at, hash, slots) of the benchmark, as ``cut_windows`` gives."""
    items = with_windows(benchmark.select("item_id", "text").where(F.col("text").isNotNull()), window)
    return cut_windows(items.withColumn("plain", split_tokens(F.col("text"))), window)


def shared_windows(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(id, h, item_id, n_item, at, shift, slots, values): a row for each window (id, h, plain, pos, hash) that is in ``wanted``.

    ``values`` are the document's tokens of a window with slots. They are cut out right at the join: Spark holds all hits of a
    text in memory until its last window is done, so a hit must not carry ``plain``, all the tokens of the text.
    """
    n_parts = 1 + wanted.count() // PART  # parts of the benchmark, each compared with all documents
    if n_parts > 1:
        wanted = keep_table(wanted, "benchmark_windows")  # cut once, not once a part
    values = F.when(F.size("slots") > 0, F.slice("plain", F.col("pos") + 1, window)).alias("values")
    found = None
    for k in range(n_parts):
        part = wanted.where(F.pmod(F.col("hash"), F.lit(n_parts)) == k) if n_parts > 1 else wanted
        got = rows.join(F.broadcast(part), "hash").select("id", "h", "item_id", "n_item", "at", (F.col("pos") - F.col("at")).alias("shift"), "slots", values)
        found = got if found is None else found.unionByName(got)
    return found


def hits(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """A row for each window that document and item share, as ``shared_windows`` gives."""
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text").where(F.col("text").isNotNull())
    rows = with_windows(texts, window).withColumn("plain", split_tokens(F.col("text")))
    rows = rows.select("id", "h", "plain", F.posexplode_outer("hashes").alias("pos", "hash"))  # outer: no filter that hashes twice
    return shared_windows(rows, item_windows(benchmark, window), window)


def slot_pairs(w: Column) -> Column:
    """(item, doc): the values of the slots of a window with ``slots`` and ``values``."""
    return F.transform(w["slots"], lambda s: F.struct(s["value"].alias("item"), F.lower(F.element_at(w["values"], s["offset"] + 1)).alias("doc")))


def all_pairs(windows: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(windows, slot_pairs)))


def distinct_values(field: str) -> Column:
    return F.size(F.array_distinct(F.transform("slots", lambda s: s[field])))


def covering(lines: DataFrame, window: int, min_tokens: int, min_share: float) -> DataFrame:
    """(id, h, item_id, n_item, covered): the items of which the windows ``at`` of all lines cover enough tokens."""
    starts = F.array_distinct(F.flatten(F.collect_set("at")))  # at most an item's windows
    tokens = F.array_distinct(F.flatten(F.transform(starts, lambda at: F.sequence(at, at + (window - 1)))))
    sums = lines.groupBy("id", "h", "item_id", "n_item").agg(F.size(tokens).cast("long").alias("covered"))
    return sums.where(F.col("covered") >= F.least(F.lit(float(min_tokens)), F.col("n_item") * min_share))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_tokens: int = 13, min_share: float = 0.75) -> DataFrame:
    """(id, h, item_id, covered, n_item): the items that contaminate a document; h is the hash of its text."""
    slotted = F.when(F.size("slots") > 0, F.struct("slots", "values"))
    lines = hits(docs, benchmark, window).groupBy("id", "h", "item_id", "n_item", "shift").agg(
        F.collect_set("at").alias("at"), all_pairs(F.collect_set(slotted)).alias("slots"))  # at most an item's windows
    good = lines.where((distinct_values("item") == F.size("slots")) & (distinct_values("doc") == F.size("slots")))
    return covering(good, window, min_tokens, min_share)


def typed(text: Column, names: bool) -> Column:
    """Template of a text that does not depend on where its words stand; without ``names`` also not on its case."""
    named = F.lower(F.regexp_replace(text, ANY_NAME, NAME) if names else text)
    numbered = F.regexp_replace(named, NUMBERS, NUMBER)
    return F.regexp_replace(numbered, f"{NUMBER}([\\x09-\\x0D ]*)(?:{UNITS})\\b", f"{NUMBER}$1{UNIT}")


def window_hashes(tokens: Column, df: DataFrame, name: str, window: int) -> DataFrame:
    """Adds ``name``, the hashes of all windows of ``window`` tokens (a power of two), by doubling."""
    df, width = df.withColumn(name, F.transform(tokens, lambda t: F.xxhash64(t))), 1
    while width < window:
        left = F.greatest(F.size(name) - width, F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(name, F.lit(1), left), F.slice(name, F.lit(width + 1), left), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    return df


def whole_item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, n_item, at, hash, slots) as ``item_windows`` gives, of both streams."""
    found = None
    for names in (True, False):
        items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
        items = items.withColumn("tokens", split_tokens(typed(F.col("text"), names))).withColumn("plain", split_tokens(F.col("text")))
        rows = cut_windows(window_hashes(F.col("tokens"), items, "hashes", window), window)
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()  # windows without a name are in both


def whole_matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_tokens: int = 13, min_share: float = 0.75) -> DataFrame:
    """(id, h, item_id, covered, n_item) as ``matches`` gives, by both streams, with verbatim windows always counted."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text").where(F.col("text").isNotNull())
    for name, names in (("named", True), ("literal", False)):
        rows = window_hashes(split_tokens(typed(F.col("text"), names)), rows, name, window)
    rows = rows.withColumn("plain", split_tokens(F.col("text")))
    both = F.zip_with("named", "literal", lambda a, b: F.array_distinct(F.array(a, b)))
    rows = rows.select("id", "h", "plain", F.posexplode_outer(both).alias("pos", "both")).select("id", "h", "plain", "pos", F.explode_outer("both").alias("hash"))
    found = shared_windows(rows, whole_item_windows(benchmark, window), window)
    slotted = F.when(F.size("slots") > 0, F.struct("at", "slots", "values"))
    lines = found.groupBy("id", "h", "item_id", "n_item", "shift").agg(
        F.collect_set("at").alias("at"), F.collect_set(F.when(F.size("slots") == 0, F.col("at"))).alias("bare"),
        F.collect_set(slotted).alias("windows"), all_pairs(F.collect_set(slotted)).alias("slots"))
    same = F.filter("windows", lambda w: F.forall(slot_pairs(w), lambda s: s["item"] == s["doc"]))
    verbatim = F.concat("bare", F.transform(same, lambda w: w["at"]))
    counted = F.when(2 * F.least(distinct_values("item"), distinct_values("doc")) >= F.size("slots"), F.col("at")).otherwise(verbatim)
    return covering(lines.select("id", "h", "item_id", "n_item", counted.alias("at")), window, min_tokens, min_share)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, n_items (contaminating it) and contaminated, for every document."""
    found = matches(docs, benchmark, **settings).groupBy("id", "h").agg(F.count("*").alias("n_items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_h"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (rows["row_h"] == found["h"]), "left")
    n = F.coalesce("n_items", F.lit(0)).cast("long")
    return joined.select("doc_id", n.alias("n_items"), (n > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, whole: bool = False, **settings) -> DataFrame:
    """The documents, with all their columns, that no item contaminates, by ``matches`` or ``whole_matches``."""
    found = (whole_matches if whole else matches)(docs, benchmark, **settings).select("id", "h").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_h"))
    return rows.join(found, rows["row_id"].eqNullSafe(found["id"]) & (rows["row_h"] == found["h"]), "left_anti").select("row.*")


def _tokens(table: str, key: str) -> str:
    return f"""
{table}_named AS (
  SELECT {key} AS k, text, array_to_string(list_transform(string_split(text, ' '), lambda x, i: CASE
    WHEN i > 1 AND regexp_matches(string_split(text, ' ')[i - 1], '[\\p{{Ll}},;]$') THEN regexp_replace(x, '^\\p{{Lu}}\\p{{L}}+', chr(1)) ELSE x END), ' ') AS t
  FROM {table} WHERE text IS NOT NULL),
{table}_marked AS (
  SELECT k, text, regexp_replace(regexp_replace(lower(t), '{NUMBERS}', chr(2), 'g'), chr(2) || '( ?)(?:{UNITS})\\b', chr(2) || '\\1' || chr(3), 'g') AS t FROM {table}_named),
{table}_tokens AS (
  SELECT k, list_filter(string_split_regex(regexp_replace(t, '{DROPPED}', '', 'g'), '{SPACES}'), lambda x: x <> '') AS tokens,
         list_filter(string_split_regex(regexp_replace(text, '{DROPPED}', '', 'g'), '{SPACES}'), lambda x: x <> '') AS plain FROM {table}_marked),
{table}_windows AS (
  SELECT k, len(tokens) AS n, p AS at, tokens[p:p + 7] AS w, plain[p:p + 7] AS v
  FROM (SELECT *, unnest(range(1, len(tokens) - 6)) AS p FROM {table}_tokens))"""


ORACLE = f"""
WITH {_tokens('documents', 'doc_id')},
{_tokens('benchmark', 'item_id')},
hits AS (
  SELECT d.k AS doc_id, b.k AS item_id, b.n, b.at AS p, d.at - b.at AS shift,
         list_filter(list_transform(b.w, lambda t, i: CASE WHEN regexp_matches(t, '[\\x01-\\x03]') THEN [lower(b.v[i]), lower(d.v[i])] END), lambda x: x IS NOT NULL) AS slots
  FROM documents_windows d JOIN benchmark_windows b ON d.w = b.w
  WHERE len(list_filter(b.w, lambda t: regexp_matches(t, '[\\x01-\\x03]'))) * 2 <= 8),
lined AS (
  SELECT doc_id, item_id, n, shift, list(p) AS ats, list_distinct(flatten(list(slots))) AS slots FROM hits GROUP BY ALL),
good AS (
  SELECT * FROM lined WHERE len(slots) = len(list_distinct(list_transform(slots, lambda s: s[1]))) AND len(slots) = len(list_distinct(list_transform(slots, lambda s: s[2])))),
covered AS (
  SELECT doc_id, item_id, n, COUNT(DISTINCT token) AS covered
  FROM (SELECT doc_id, item_id, n, unnest(range(p, p + 8)) AS token FROM (SELECT doc_id, item_id, n, unnest(ats) AS p FROM good)) GROUP BY ALL),
found AS (SELECT doc_id, COUNT(*) AS n_items FROM covered WHERE covered >= least(13.0, n * 0.75) GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(f.n_items, 0) AS BIGINT) AS n_items, f.n_items IS NOT NULL AS contaminated
FROM documents d LEFT JOIN found f USING (doc_id)
"""
