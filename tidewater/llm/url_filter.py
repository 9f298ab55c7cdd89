"""URL rules as an exact Bloom filter cascade, in DataFrame functions only.

Level 1 encodes the listed keys; level 2 the corpus keys that level 1 wrongly lets through; level 3 the listed keys
that level 2 wrongly lets through; and so on until no key is wrong. The first level sized so that its false positives
are about as many as the listed keys, all levels together take a few bits per listed key and log2 of the universe.
Over that universe (every key of the corpus) membership is exact, so a url is judged by bit tests, without a join.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end, A-Z lower-cased; null or no :// gives the empty string."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def keys_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Keys under which a rule could be listed that fits, longest first: host suffixes by labels, path prefixes by length.

    Only as many labels and only such prefix lengths as some rule has. Of equally long keys the one with the longer
    host comes first.
    """
    depth, lengths = max((r.host.count(".") + 1 for r in rules), default=0), sorted({len(r.path) for r in rules})
    if not rules:
        return F.array().cast("array<string>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(labels))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    made = F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda n: F.struct((-F.length(s) - n).alias("a"), (-F.length(s)).alias("b"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.transform(F.array_sort(made), lambda x: x["key"])


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(j)), F.lit(self.bits)) for j in range(self.hashes)]

    def has(self, key: Column) -> Column:
        # one folded literal of the filter's words
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        test = F.lit(True)
        for p in self.positions(key):
            test &= F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
        return test


def _level(keys: DataFrame, number: int, n: int, p: float) -> Level:
    """A Bloom filter of n keys with about p false positives; the words collected are the filter itself."""
    hashes = max(1, round(-math.log2(p)))
    empty = Level(number, max(64, math.ceil(n * hashes / math.log(2))), hashes, ())
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("x")).collect()
    words = [0] * -(-empty.bits // 64)
    for r in rows:
        words[r["w"]] = r["x"]
    return Level(number, empty.bits, hashes, tuple(words))


class Cascade:
    """Exact membership in `listed` (key) for every key of `universe` (key, distinct)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, most_levels: int = 64):
        self.levels: list[Level] = []
        n, total = listed.count(), universe.count()
        inside, outside = listed.select("key"), universe.select("key").join(listed, "key", "left_anti")
        p = min(0.5, math.sqrt(0.5) * n / max(total, 1))
        while n and len(self.levels) < most_levels:
            level = _level(inside, len(self.levels) + 1, n, p)
            self.levels.append(level)
            wrong = stored(outside.where(level.has(F.col("key"))), "wrong")
            # what this level wrongly lets through is what the next one encodes, to be told from this one's keys
            inside, outside, n, p = wrong, inside, wrong.count(), 0.5
        if n:
            raise ValueError(f"{most_levels} levels leave {n} keys undecided")

    def has(self, key: Column) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for at in range(len(self.levels), 0, -1):
            found = F.when(self.levels[at - 1].has(key), found).otherwise(F.lit(at % 2 == 0))
        return found


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    The longest rule that fits decides; with none, `default` does. Null urls and urls without :// have empty host and
    path, which no rule fits. Repeated rows and ids stay as they are; other columns are ignored; an empty table or an
    empty rule list is fine.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), tuple(rules)))
    universe = stored(urls.select(F.explode("keys").alias("key")).distinct(), "universe")
    verdicts = sorted({r.verdict for r in rules})
    if len({r.key for r in rules}) < len({(r.key, r.verdict) for r in rules}):
        raise ValueError("a rule has two verdicts")
    cascades = {v: Cascade(spark.createDataFrame([(k,) for k in sorted({r.key for r in rules if r.verdict == v})], "key string"), universe) for v in verdicts}
    dropped(universe)

    def listed(key: Column) -> Column:
        out = F.lit(False)
        for c in cascades.values():
            out |= c.has(key)
        return out

    judged = urls.withColumn("rule", F.get(F.filter("keys", listed), F.lit(0)))
    verdict = F.lit(default)
    for v, c in cascades.items():
        verdict = F.when(F.col("rule").isNotNull() & c.has(F.col("rule")), F.lit(v)).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'allow'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'block'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'allow'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""
