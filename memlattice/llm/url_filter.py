"""URL filter: exact membership of listed keys through a cascade of Bloom filters.

A single Bloom filter over the listed keys accepts some unlisted ones. Here the whole key universe of the
corpus is known, so the accepted unlisted keys are found and encoded in a second filter, the listed keys
which that one accepts in a third, and so on until a level makes no mistake. A key is then judged by the
first level that refuses it: exact over the universe, without a join and without the key list.

Sizes: with r listed keys and u keys in the universe, the first level gets a false-positive rate of about
r / (u * sqrt 2), so that all later levels hold O(r) keys. The cascade therefore needs O(r log(u / r)) bits;
u is not bounded, and nothing of size u reaches the driver. The filters travel in the plan, so more than MAX_LISTED
listed keys are told by an equi-join with the list instead, which is as exact.

Everything is DataFrame functions. Rows with a null key are in no list; an empty universe or an empty
list gives a cascade that refuses everything; repeated keys count once.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm._shared import written

MAX_LISTED = 200_000


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def has(self, key: Column) -> Column:
        """True where every bit of the key is set."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folds to one literal

        def is_set(i: Column) -> Column:
            at = _position(key, self.number, i, self.bits)
            return F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1

        return F.forall(F.sequence(F.lit(0), F.lit(self.hashes - 1)), is_set)


def _position(key: Column, number: int, i: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(number), i), F.lit(bits))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact over the universe the cascade was built for."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.has(key), F.lit(level.number % 2 == 1)).otherwise(out)
        return F.coalesce(out, F.lit(False))


def _level(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    per_key = max(1.0, -math.log(max(rate, 1e-12)) / math.log(2) ** 2)
    bits = max(64, 64 * math.ceil(n * per_key / 64))
    hashes = max(1, min(24, round(per_key * math.log(2))))
    word = F.shiftright("pos", 6)
    rows = (
        keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("i"))
        .select(_position(F.col("key"), number, F.col("i"), bits).alias("pos"))
        .groupBy(word.alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("set"))
        .collect()  # at most bits / 64 rows, and bits is O(MAX_LISTED)
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["set"]
    return Level(number, bits, hashes, tuple(words))


def keys_of(spark: SparkSession, listed: list[str]) -> DataFrame:
    """A short list as a table of one column, key."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(listed)), "array<string>")).alias("key"))


def build_cascade(universe: DataFrame, listed: DataFrame, n: int, max_levels: int = 64) -> Cascade:
    """universe, listed: one column `key`, nulls allowed; repeats allowed in the universe. n: the number of listed keys, which are distinct."""
    if not n:
        return Cascade(())
    universe = universe.where(F.col("key").isNotNull())
    u = max(1, universe.select(F.approx_count_distinct("key")).first()[0])
    levels = [_level(listed, 0, n, min(0.5, n / (u * math.sqrt(2))))]
    # What the first level accepts of the universe: the listed keys in it and O(r) others.
    accepted = written(universe.where(levels[0].has(F.col("key"))).distinct(), "accepted")
    ins, outs = accepted.join(listed, "key", "left_semi"), accepted.join(listed, "key", "left_anti")
    encode, other = outs, ins
    for number in range(1, max_levels):
        n = encode.count()
        if not n:
            return Cascade(tuple(levels))
        levels.append(_level(encode, number, n, 0.5))
        encode, other = written(other.where(levels[-1].has(F.col("key"))), "level"), encode
    raise RuntimeError(f"no exact cascade within {max_levels} levels")


def _new_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def with_membership(rows: DataFrame, key: str, listed: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column name: whether their key (a column) is among the listed (one column, key)."""
    listed = written(listed.where(F.col("key").isNotNull()).distinct(), "listed")
    n = listed.count()
    if n <= MAX_LISTED:
        cascade = build_cascade(rows.select(F.col(key).alias("key")), listed, n)
        return rows.withColumn(name, cascade.contains(F.col(key)))
    other = _new_name(rows, "key")
    found = rows.join(listed.select(F.col("key").alias(other), F.lit(True).alias(name)), F.col(key) == F.col(other), "left")
    return found.drop(other).withColumn(name, F.coalesce(name, F.lit(False)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; path: on to ? # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_keys(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Every key (domain suffix of the host + start of the path) that a rule of these shapes could be."""
    labels = sorted({h.count(".") + 1 for h, _ in rules})
    starts = sorted({len(p) for _, p in rules})
    parts = F.split(host, r"\.")
    keys = [
        F.when((F.size(parts) >= n) & (F.length(path) >= k), F.concat(F.array_join(F.slice(parts, -n, n), "."), F.substring(path, 1, k)))
        for n in labels
        for k in starts
    ]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict (null without a rule). rules: (verdict allow|block, host, path).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule
    wins. One cascade per verdict, both over the universe of candidate keys of all pages, decides which
    candidate keys are rules.
    """
    spark = pages.sparkSession
    h, p = host_and_path(F.col(url))
    keyed = pages.drop(*{"rule", "verdict"} - {url}).withColumns({"host": h, "path": p})
    keys = rule_keys(F.col("host"), F.col("path"), [(a, b) for _, a, b in rules])
    universe = keyed.select(F.explode(keys).alias("key"))
    longest = lambda c: F.reduce(
        F.filter(keys, c.contains), F.lit(None).cast("string"),
        lambda best, k: F.when(best.isNull() | (F.length(k) > F.length(best)), k).otherwise(best))
    names = {}
    for verdict in ("allow", "block"):
        listed = sorted({a + b for w, a, b in rules if w == verdict})
        if len(listed) > MAX_LISTED:
            raise ValueError(f"{len(listed)} rules; longer lists are tables, see with_membership")
        names[verdict] = _new_name(keyed, verdict)
        keyed = keyed.withColumn(names[verdict], longest(build_cascade(universe, keys_of(spark, listed), len(listed))))
    allow, block = (F.col(names[v]) for v in ("allow", "block"))
    blocks = block.isNotNull() & (allow.isNull() | (F.length(block) >= F.length(allow)))
    rule = F.when(blocks, block).otherwise(allow)
    verdict = F.when(rule.isNull(), F.lit(None).cast("string")).when(blocks, F.lit("block")).otherwise(F.lit("allow"))
    return keyed.withColumn("rule", rule).withColumn("verdict", verdict).drop(*names.values())


def bad_hosts(judged: DataFrame) -> DataFrame:
    """(key): hosts more of whose ruled pages are blocked than allowed."""
    block = F.count_if(F.col("verdict") == "block") > F.count_if(F.col("verdict") == "allow")
    return judged.where((F.col("host") != "") & F.col("rule").isNotNull()).groupBy(F.col("host").alias("key")).agg(block.alias("bad")).where("bad").select("key")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict: the longest fitting rule's, else block if the host is listed, else `default`.

    listed: a table of hosts (one column, key) of any length; without one, the hosts more of whose ruled pages are blocked
    than allowed. A cascade over the universe of all hosts of the pages tells which are listed.

    Columns of the input named like the four new ones are replaced, no other is touched. Null urls have empty host
    and path, no rule and the default verdict. Repeated pages are judged alike; an empty table gives no rows.
    """
    out = ruled(pages, rules, url)
    name = _new_name(out, "listed")
    out = with_membership(out, "host", bad_hosts(out) if listed is None else listed, name)
    other = F.when(F.col(name) & (F.col("host") != ""), F.lit("block")).otherwise(F.lit(default))
    return out.withColumn("verdict", F.coalesce("verdict", other)).drop(name)
