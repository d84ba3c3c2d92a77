"""URL filter (operator 6): rules by host and path, and logistic regression on hashed character n-grams for the rest.

The regression is trained on a small labelled table of URLs (``LABELLED`` by default). A rule fits its host and all
subdomains if the path starts with the rule's; the longest fitting rule decides, of equally long ones the first.

A null url or one without ``://`` has an empty host and path; no rule fits, and the model judges the empty text (allow).
Repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Labelled URLs: pairs of one unwanted and one plain place under the same kinds of domains and paths.
UNWANTED = """
spam-farm.example.org/en/1 spam-links.example.com/fr/22 link-farm.example.net/de/303 best-spam.example.org/es/41
free-bets.example.com/en/75 bets-now.example.org/fr/6 sports-bets.example.net/en/812 bet-bonus.example.com/es/9
casino-royal.example.org/de/10 online-casino.example.com/en/11 casino.example.net/fr/1203 slots-casino.example.org/en/13
adult-x.example.com/en/14 adult-video.example.org/de/15 xxx-adult.example.net/en/161 x-adult.example.com/fr/17
porn-tube.example.org/en/18 free-porn.example.com/es/19 xxx-tube.example.net/en/20 hot-xxx.example.org/fr/21
cheap-pills.example.com/en/22 pills-online.example.org/de/230 viagra-shop.example.net/en/24 cheap-viagra.example.com/fr/25
payday-loans.example.org/en/26 fast-loans.example.com/es/27 win-prize.example.net/en/28 free-prize.example.org/de/29
replica-watches.example.com/en/30 fake-watches.example.org/fr/31 malware-load.example.net/en/32 phish-login.example.com/en/33
warez-load.example.org/en/34 crack-keys.example.com/de/35 torrent-warez.example.net/en/36 click-farm.example.org/es/37
"""
PLAIN = """
www.garden.example.org/en/1 blog.mountain.example.com/fr/22 m.history.example.net/de/303 library.example.org/es/41
www.science.example.com/en/75 news.example.org/fr/6 blog.kitchen.example.net/en/812 m.travel.example.com/es/9
school.example.org/de/10 www.museum.example.com/en/11 music.example.net/fr/1203 blog.weather.example.org/en/13
m.forest.example.com/en/14 www.letters.example.org/de/15 theatre.example.net/en/161 blog.river.example.com/fr/17
city.example.org/en/18 m.health.example.com/es/19 www.physics.example.net/en/20 street.example.org/fr/21
blog.thenter.example.com/en/22 www.tionand.example.org/de/230 m.theatre.example.net/en/24 ththere.example.com/fr/25
www.station.example.org/en/26 blog.thread.example.com/es/27 m.motion.example.net/en/28 nation.example.org/de/29
www.other.example.com/en/30 blog.those.example.org/fr/31 m.north.example.net/en/32 therein.example.com/en/33
www.method.example.org/en/34 blog.path.example.com/de/35 m.ration.example.net/en/36 weather.example.org/es/37
"""
LABELLED = tuple((u, 1) for u in UNWANTED.split()) + tuple((u, 0) for u in PLAIN.split())


@dataclass(frozen=True)
class Settings:
    grams: tuple[int, ...] = (3, 4, 5)
    bits: int = 14
    rounds: int = 300
    rate: float = 0.5
    ridge: float = 1e-3
    threshold: float = 0.5


def bins(places: Sequence[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the places (host and path, numbers as 0) and the place each belongs to, repeats once."""
    found, owner = [], []
    for k, place in enumerate(places):
        code = np.frombuffer(f"^{place}$".encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where((code >= 48) & (code <= 57), np.uint32(48), code)
        for n in s.grams:
            if len(code) < n:
                continue
            mixed = np.full(len(code) - n + 1, n, np.uint32)
            for i in range(n):
                mixed = (mixed ^ code[i: len(code) - n + 1 + i]) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
            used = np.unique(mixed >> np.uint32(32 - s.bits))
            found.append(used.astype(np.int64))
            owner.append(np.full(len(used), k))
    return np.concatenate([*found, np.zeros(0, np.int64)]), np.concatenate([*owner, np.zeros(0, np.int64)])


def odds(places: Sequence[str], weights: np.ndarray, s: Settings) -> np.ndarray:
    found, owner = bins(places, s)
    count = np.maximum(np.bincount(owner, minlength=len(places)), 1)
    return np.bincount(owner, weights=weights[found], minlength=len(places)) / np.sqrt(count) + weights[-1]


def fit(labelled: Sequence[tuple[str, int]] = LABELLED, s: Settings = Settings()) -> np.ndarray:
    """Weights of the bins and a bias, by full-batch gradient descent; label 1 is unwanted."""
    places, label = [u for u, _ in labelled], np.array([y for _, y in labelled], float)
    found, owner = bins(places, s)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(places)), 1))
    weights = np.zeros((1 << s.bits) + 1)
    for _ in range(s.rounds):
        gap = 1 / (1 + np.exp(-odds(places, weights, s))) - label
        gradient = np.bincount(found, weights=(gap * scale)[owner], minlength=len(weights))
        gradient[-1] = gap.sum()
        weights -= s.rate * (gradient / len(places) * 10 + s.ridge * weights)
    return weights


class RuleBook:
    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[int, int, str, str, str]]] = {}
        for k, (action, host, path) in enumerate(rules):
            self.by_host.setdefault(host, []).append((-len(host + path), k, action, path, host + path))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest rule that fits."""
        best, at = None, 0
        while True:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule[3]) and (best is None or rule < best):
                    best = rule
            at = host.find(".", at) + 1
            if not at:
                return None if best is None else (best[4], best[2])


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(spark, host: Column, path: Column, rules=RULES, labelled=LABELLED, s: Settings = Settings()) -> Column:
    """Struct of rule, verdict and score (the model's probability of unwanted)."""
    shared = spark.sparkContext.broadcast((tuple(rules), fit(labelled, s)))

    @F.arrow_udf("struct<rule: string, verdict: string, score: double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rules, weights = shared.value
        book = RuleBook(rules)
        for hosts, paths in batches:
            hosts, paths = hosts.to_pylist(), paths.to_pylist()
            score = np.zeros(len(hosts))
            for a in range(0, len(hosts), 2000):
                places = [h + p for h, p in zip(hosts[a: a + 2000], paths[a: a + 2000])]
                score[a: a + 2000] = 1 / (1 + np.exp(-odds(places, weights, s)))
            found = [book.find(h, p) for h, p in zip(hosts, paths)]
            learned = np.where((score > s.threshold) & np.array([bool(h) for h in hosts], bool), "block", "allow").tolist()
            yield pa.StructArray.from_arrays([pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else v for f, v in zip(found, learned)], pa.string()), pa.array(score)],
                                             ["rule", "verdict", "score"])

    return run(host, path)


def filter_urls(pages: DataFrame, rules=RULES, labelled=LABELLED, s: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page; only page_id and url are read."""
    places = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judge(pages.sparkSession, F.col("host"), F.col("path"), rules, labelled, s)
    return places.select("page_id", "host", "path", judged.alias("judged")).select("page_id", "host", "path", "judged.*")
