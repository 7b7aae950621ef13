"""URL filter by a Bloom filter cascade.

A list of domains is tested exactly without a join of the pages: level 1 is a Bloom filter of the listed keys, level
2 one of the keys of the corpus that pass level 1 without being listed, level 3 one of the listed keys that pass
level 2, and so on until none passes wrongly. Since the levels are built over the complete set of keys in
the corpus, the first level that says no decides each of these keys without error. Only the few keys that pass level 1
are held against the list itself. Keys of a URL are its host and the parent domains with no more labels than the
longest listed domain. Filters are aggregated to 64-bit words before they leave the executors; a list too large for
one bounded filter is cut into shards by hash, each with a cascade of its own; of a page only its keys' hashes go to
Python.

Rules of (host, path) come before the list: a rule fits its host and all subdomains if the path starts with
its own; the longest (host and path together) wins and gives the verdict.

Nulls and ties: a null URL or one without :// has an empty host and path and is allowed; among rules of one
length the one listed first wins; repeated rows stay repeated; extra columns pass through untouched.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolark.llm.common import Scratch, bounded_batches, packed, unpacked


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
#: Domains blocked where no rule fits.
DOMAINS = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

#: Bits for each key and hash functions of a level; bytes of a level at most, beyond which keys are sharded.
BITS_PER_KEY, HASHES, MOST_BYTES = 10, 5, 8 << 20
#: Shards whose cascades a worker holds at once.
SHARDS_AT_ONCE = 16


def with_parts(pages: DataFrame) -> DataFrame:
    """pages with host and path of url."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    out = pages.withColumn("rest_", F.coalesce(rest, F.lit("")))
    raw = F.regexp_extract("rest_", "^[^/?#]*", 0)
    out = out.withColumn("host", F.translate(raw, string.ascii_uppercase, string.ascii_lowercase))
    return out.withColumn("path", F.regexp_extract(F.expr("substring(rest_, length(host) + 1)"), "^[^?#]*", 0)).drop("rest_")


def ruled(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, its verdict) of a row with host and path, null where no rule fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def keys_of(host: Column, most_labels: int) -> Column:
    """The host's suffixes of whole labels, of at most so many labels."""
    labels = F.reverse(F.slice(F.reverse(F.split(host, "[.]", -1)), 1, most_labels))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, most_labels), ".")))


def hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def places(a: np.ndarray, b: np.ndarray, bits: int, number: int) -> Iterator[np.ndarray]:
    """Bit places of keys in level ``number``; every level hashes anew, else keys would collide in all of them."""
    mixed = []
    for h in (a, b):
        x = (h.view(np.uint64) ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed.append((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB))
    for i in range(HASHES):
        yield ((mixed[0] + np.uint64(i) * (mixed[1] | np.uint64(1))) >> np.uint64(8)) % np.uint64(bits)


def level(keys: DataFrame, count: int, number: int) -> np.ndarray:
    """Words of a Bloom filter of ``keys`` (a, b), or-ed by the executors."""
    bits = max(64, -(-count * BITS_PER_KEY // 64) * 64)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            at = np.unique(np.concatenate(list(places(a, b, bits, number)))) if len(a) else np.zeros(0, np.uint64)
            one = np.left_shift(np.uint64(1), at % np.uint64(64))
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(64)).astype(np.int64)), pa.array(one.view(np.int64))], ["word", "bit"])

    rows = keys.mapInArrow(pairs, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return words


def passes(words: np.ndarray, a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
    found = np.ones(len(a), bool)
    for at in places(a, b, len(words) * 64, number):
        found &= (words[at // np.uint64(64)] >> (at % np.uint64(64))) & np.uint64(1) == 1
    return found


def member(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each key whether it is listed: the first level that it doesn't pass decides."""
    out = np.full(len(a), len(levels) % 2 == 1)
    active = np.arange(len(a))
    for k, words in enumerate(levels):
        passed = passes(words, a[active], b[active], k)
        out[active[~passed]] = k % 2 == 1
        active = active[passed]
    return out


def passing(keys: DataFrame, words: np.ndarray, number: int) -> DataFrame:
    """The rows of keys (a, b, ...) that pass a level."""
    shared = keys.sparkSession.sparkContext.broadcast(words)  # at most MOST_BYTES
    at = [keys.columns.index(c) for c in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, *(batch.column(k).to_numpy(zero_copy_only=False) for k in at), number)))

    return keys.mapInArrow(run, keys.schema)


def cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch, most_levels: int = 40) -> list[np.ndarray]:
    """Levels for the listed keys (key, a, b) against the corpus's universe of keys (key, a, b), repeats allowed."""
    count = listed.count()
    if not count:
        return []
    levels = [level(listed.select("a", "b"), count, 0)]
    wrong = passing(universe, levels[0], 0).distinct().join(listed.select("key"), "key", "left_anti")
    inside, outside = scratch.write(wrong.select("a", "b")), listed.select("a", "b")
    for number in range(1, most_levels):
        count = inside.count()
        if not count:
            return levels
        levels.append(level(inside, count, number))
        inside, outside = scratch.write(passing(outside, levels[-1], number)), inside
    raise RuntimeError(f"cascade: keys still pass wrongly after {most_levels} levels")


def blocked(pages: DataFrame, domains: DataFrame | tuple[str, ...], most_bytes: int = MOST_BYTES) -> DataFrame:
    """pages (with host) and listed: whether the host or a parent domain is in domains (strings, or a column ``domain``)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    if not isinstance(domains, DataFrame):
        domains = spark.createDataFrame([(d,) for d in domains], "domain string")
    lowered = F.translate("domain", string.ascii_uppercase, string.ascii_lowercase)
    domains = domains.where("domain is not null").select(lowered.alias("key")).distinct()
    size = domains.agg(F.count("*").alias("n"), F.max(F.size(F.split("key", "[.]"))).alias("labels")).first()
    if not size.n:
        return pages.withColumn("listed", F.lit(False))
    shards = -(-size.n * BITS_PER_KEY // (8 * most_bytes))
    listed = scratch.write(domains.select("key", hashes(F.col("key")).alias("h")).select("key", "h.*"))
    hosts = pages.select("host").distinct()
    universe = hosts.select(F.explode(keys_of(F.col("host"), size.labels)).alias("key")).select("key", hashes(F.col("key")).alias("h")).select("key", "h.*")
    universe = universe if shards == 1 else scratch.write(universe)
    out = pages.withColumn("listed", F.lit(False)).withColumn("hashed_", F.transform(keys_of(F.col("host"), size.labels), hashes))
    for s in range(shards):
        mine = F.pmod("a", F.lit(shards)) == s
        levels = cascade(listed.where(mine), universe.where(mine), scratch)
        shared = spark.sparkContext.broadcast(levels)  # level 1 has at most most_bytes; later ones are smaller
        out = out.withColumn("listed", F.col("listed") | testing(shared, s, shards)(F.col("hashed_")))
        if s % SHARDS_AT_ONCE == SHARDS_AT_ONCE - 1 and s < shards - 1:
            out = scratch.write(out)
    return out.drop("hashed_")


def testing(shared, shard: int, shards: int):
    """Arrow function of arrays of hashes: whether one of them is a listed key of the shard."""

    @F.arrow_udf("boolean")
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        a, b = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        hit = member(shared.value, a, b) & (np.mod(a, shards) == shard)
        owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
        return pa.array(np.bincount(owner[hit], minlength=len(column)) > 0)

    return run


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, domains: DataFrame | tuple[str, ...] = DOMAINS) -> DataFrame:
    """pages with host, path, rule (of the fitting rule, else null), listed and verdict (allow or block)."""
    rule, verdict = ruled(rules)
    out = blocked(with_parts(packed(pages, "url")), domains)
    out = out.select(*unpacked(pages.columns, ("host", "path", "listed")), "host", "path", "listed")
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
