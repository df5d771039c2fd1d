"""URL filters: allow and block rules, then naive Bayes over words that a unigram Viterbi finds in hosts and paths."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.shared import Workspace, column

#: Words of sites that training data should not come from, and words of ordinary sites; both are parameters of `fit`.
BLOCK_WORDS = tuple(
    "adult ads advert banner bet bets betting bingo bonus casino cheap click clicks crack cracked dating download escort farm free gamble gambling hack jackpot keygen loan loans "
    "lottery lotto malware nude pharma phish pills poker porn promo proxy replica scam sex sexy slots spam spin spyware torrent track tracker tracking viagra virus warez win winner xxx".split()
)
ALLOW_WORDS = tuple(
    "about academy archive art article author blog board book books city class code college common community course daily data docs edu encyclopedia en example forum garden guide "
    "health help history home house info journal kitchen lab language learn library local magazine map market math mobile museum music nature news open org page paper park people "
    "photo post press project public radio recipe report research review river school science service shop site sport start station story study teacher team tech text times topic "
    "town travel university video village water weather web wiki work world writing www".split()
)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Letters of the longest stretch that the split tries as one; longer ones are several.
LONGEST = 40
_LETTERS = re.compile(r"[^\W\d_]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    place = F.instr(url, "://")
    tail = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (host itself or a subdomain of the rule's, path with the rule's as prefix), and its verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last to be wrapped is asked first
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


@dataclass
class Segmenter:
    """Splits a run of letters into the words whose product of unigram probabilities is highest.

    An unknown stretch costs as much as a word seen once in the whole table, and more for each letter.
    """

    counts: Counter
    longest: int = field(init=False)
    costs: dict = field(init=False)
    seen: dict = field(init=False, default_factory=dict)

    def __post_init__(self):
        total = sum(self.counts.values()) + 1
        self.longest = max(map(len, self.counts), default=1)
        self.costs = {w: math.log(total / n) for w, n in self.counts.items()}
        self.unknown, self.per_letter = math.log(total) + 2, 2.5

    def split(self, run: str) -> list[str]:
        if run in self.seen:
            return self.seen[run]
        n = len(run)
        best = [(0.0, 0)] + [(math.inf, 0)] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                if (cost := self.costs.get(run[start:end])) is not None and best[start][0] + cost < best[end][0]:
                    best[end] = best[start][0] + cost, start
            for start in range(max(0, end - LONGEST), end):  # an unknown stretch; a longer one is several
                cost = best[start][0] + self.unknown + self.per_letter * (end - start)
                if cost < best[end][0]:
                    best[end] = cost, start
        words, end = [], n
        while end:
            start = best[end][1]
            words.append(run[start:end])
            end = start
        if len(self.seen) < 100_000:
            self.seen[run] = words[::-1]
        return words[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        return [w for part in (host, path) for run in _LETTERS.findall(part.lower()) for w in self.split(run)]


@dataclass
class UrlBayes:
    """Multinomial naive Bayes with even priors; tokens that training never saw don't count."""

    segmenter: Segmenter
    weights: dict[str, float]

    def score(self, tokens: list[str]) -> float:
        return sum(self.weights.get(t, 0.0) for t in tokens)


def _counts(rows: DataFrame, count, schema: str) -> DataFrame:
    """The keys that `count` finds in lists of hosts and paths, with n, the sum of their counts over all rows."""

    def run(batches):
        for batch in batches:
            found = count(column(batch, "host").to_pylist(), column(batch, "path").to_pylist())
            keys = list(zip(*found)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, kinds)), pa.array(found.values(), pa.int64())], names=[*names, "n"])

    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [{"string": pa.string(), "boolean": pa.bool_()}[part.split()[1]] for part in schema.split(", ")]
    return rows.mapInArrow(run, f"{schema}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


def fit(pages: DataFrame, url_col: str = "url", block_words: tuple[str, ...] = BLOCK_WORDS, allow_words: tuple[str, ...] = ALLOW_WORDS, most: int = 1 << 19, alpha: float = 0.5) -> UrlBayes:
    """A model of the hosts and paths of all urls, each distinct (host, path) counted once.

    Runs of letters that stand alone in hosts and paths at least twice join the unigram table with their counts, unless
    a block word is one of several parts of theirs. The given words count 20, or a ten-thousandth of all runs, more.
    Urls with a block word anywhere in host or path train the block class, the others the allow class; the given words
    count five times and once more for their class, so a class is never empty. Nothing but urls is read.

    Counts are distributed sums. The model that goes to the tasks has at most `most` runs and `most` tokens beside the
    given words: only those with at least 1 / `most` of their kind's whole count are collected, and there can't be more.
    The class totals count every token, and so does the vocabulary's size.
    """
    host, path = host_and_path(pages[url_col])
    work = Workspace(pages.sparkSession, "urls")
    urls = work.put("urls", pages.select(host.alias("host"), path.alias("path")).filter("host != ''").distinct())
    given, blocked = (*block_words, *allow_words), frozenset(block_words)

    def runs(hosts, paths):
        found = Counter(run for part in (*hosts, *paths) for run in _LETTERS.findall(part.lower()))
        return Counter({(run,): n for run, n in found.items()})

    alone = work.put("runs", _counts(urls, runs, "word string"))
    everything = alone.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = Segmenter(Counter({w: 20 for w in given}))

    def simple(batches):
        for batch in batches:
            parts = [first.split(w) for w in column(batch, "word").to_pylist()]
            yield batch.filter(pa.array([len(p) < 2 or blocked.isdisjoint(p) for p in parts], pa.bool_()))

    common = alone.filter((F.col("n") >= 2) & (F.length("word").between(2, LONGEST)) & (F.col("n") * most >= everything))
    table = Counter({w: max(20, everything // 10_000) for w in given})
    for r in common.mapInArrow(simple, alone.schema).collect():
        table[r["word"]] += r["n"]
    segmenter = Segmenter(table)

    def classes(hosts, paths):
        found = Counter()
        for h, p in zip(hosts, paths):
            tokens = set(segmenter.tokens(h, p))
            found.update(dict.fromkeys(((t, not blocked.isdisjoint(tokens)) for t in tokens), 1))
        return found

    seen = work.put("tokens", _counts(urls, classes, "word string, blocked boolean").groupBy("word").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("b", F.col("blocked")), ("a", ~F.col("blocked")))]))
    b_total, a_total, distinct, known = seen.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("b"), F.sum("a"), F.count(F.lit(1)), F.sum(F.col("word").isin(*given).cast("int")))]).first()
    counts = {r["word"]: (r["b"], r["a"]) for r in seen.filter(((F.col("a") + F.col("b")) * most >= b_total + a_total) | F.col("word").isin(*given)).collect()}
    size = distinct + len(set(given)) - known
    more_b, more_a = Counter({w: 5 for w in block_words}), Counter(allow_words)
    totals = b_total + sum(more_b.values()) + alpha * size, a_total + sum(more_a.values()) + alpha * size
    weights = {}
    for w in sorted({*counts, *given}):
        b, a = counts.get(w, (0, 0))
        weights[w] = math.log((b + more_b[w] + alpha) / totals[0]) - math.log((a + more_a[w] + alpha) / totals[1])
    work.drop()
    segmenter.seen.clear()
    return UrlBayes(segmenter, weights)


def judge(pages: DataFrame, model: UrlBayes, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """The pages' columns (but those of the new names) with host, path, rule, tokens, score and verdict; one row each, no shuffle.

    A rule's verdict stands; else a positive score (log odds of block over allow, summed over the tokens) blocks. A null
    url, and one without `://`, has an empty host and path, no rule and the verdict allow.
    """
    new = ("host", "path", "rule", "tokens", "score", "verdict")
    host, path = host_and_path(pages[url_col])
    kept = [f for f in pages.schema if f.name not in new]
    read = pages.select(*[pages[f.name] for f in kept], host.alias("host"), path.alias("path"))
    schema = T.StructType([*kept, T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            pairs = zip(column(batch, "host").to_pylist(), column(batch, "path").to_pylist())
            tokens = [model.segmenter.tokens(h, p) for h, p in pairs]
            added = [pa.array(tokens, pa.list_(pa.string())), pa.array([model.score(t) for t in tokens], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[f.name for f in schema])

    scored = read.mapInArrow(run, schema)
    rule, verdict = matching_rule(scored["host"], scored["path"], rules)
    own = F.when(scored["score"] > 0, "block").otherwise("allow")
    return scored.select(*[f.name for f in kept], "host", "path", rule.alias("rule"), "tokens", "score", F.coalesce(verdict, own).alias("verdict"))
