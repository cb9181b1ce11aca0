"""URL rules by a sort-merge range join.

A rule (host, path, allow) fits its host and all subdomains where the url's path starts with the
rule's; the rule with the longest host and path together wins (ties: the longer host, then block).

Canonical keys: a host is written with its labels reversed, and a url has one key (host part,
path) for each of its parent hosts that is not deeper than the deepest rule. Among such keys a rule
is an interval, all keys with its host part and a path that starts with its own, and intervals are
nested or apart. Keys and rules are dealt out by ranges between splitters from a sample of the
urls; a rule goes to each range that its interval touches. Every range is sorted and swept once,
with a stack of the rules that are active: what doesn't hold the next key is popped, and the top
is the longest rule for that key. A url's keys then meet for the longest rule of all.

The sample is what falls under a threshold of the pair's hash; it is set by the approximate number of
distinct pairs, so about SAMPLE of them come to the driver whatever the input and its partitions.

Only distinct pairs of host and path are swept, so a url in a third of all rows is judged once; the
whole host ends a key's order, so a path that many hosts share spans several ranges.

Defined results: a null url, or one without `://`, has empty host and path and fits no rule but
those with an empty host; no fitting rule gives the default verdict and a null rule; rules with a
null part are left out; a rule given twice with both verdicts blocks; repeated rows are judged each;
an empty table or rule list works; a very long url is judged whole; columns called host, path, rule or
verdict are replaced, whatever their case, and all others pass through.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.llm.common import col, others, partitions

#: Distinct urls, about, whose keys give the splitters.
SAMPLE = 4000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(_part(url, r"^([^/?#]*)"), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, r"^[^/?#]*([^?#]*)")


def _part(url: Column, pattern: str) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at == 0, F.lit("")).otherwise(F.regexp_extract(F.substring(url, at + 3, F.length(url)), pattern, 1))


def host_keys(host: str, deepest: int) -> list[str]:
    """`com`, `com.example`, ... up to the whole host or `deepest` labels."""
    labels = host.rsplit(".", deepest)[-1 : -deepest - 1 : -1] if host.count(".") >= deepest else host.split(".")[::-1]
    return [".".join(labels[:k]) for k in range(1, len(labels) + 1)]


_KEYED = "part int, host_key string, path string, kind int, host string, allow boolean"


def judge(pages: DataFrame, rules: DataFrame, default_allow: bool = True, url_col: str = "url") -> DataFrame:
    """All columns of `pages` with host, path, rule and verdict (replacing columns of these names)."""
    spark = pages.sparkSession
    n = partitions(spark)
    made = ["host", "path", "rule", "verdict"]
    kept = others(pages, made)
    carried = [col(c).alias(f"c{i}") for i, c in enumerate(kept)] or [F.lit(None).alias("c")]
    rows = pages.select(F.struct(*carried).alias("own"), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    pairs = rows.select("host", "path").distinct()
    rules = rules.select("host", "path", "allow").dropna()
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1

    mark = F.xxhash64("host", "path")
    distinct = rows.agg(F.approx_count_distinct(mark)).first()[0]
    share = min(1.0, SAMPLE / max(distinct, 1))
    sample = rows.select("host", "path").filter(mark <= F.lit(int((share - 0.5) * 2**64) if share < 1 else (1 << 63) - 1)).distinct().collect()
    keys = sorted({(k.encode(), r["path"].encode(), r["host"].encode()) for r in sample for k in host_keys(r["host"], deepest)})
    cuts = sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key in host_keys(host, deepest):
                    out.append((bisect_right(cuts, (key.encode(), path.encode(), host.encode())), key, path, 1, host, None))
            yield _batch(out)

    def rule_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, path, allow in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = ".".join(host.split(".")[::-1])
                low = bisect_right(cuts, (key.encode(), path.encode(), b""))
                high = bisect_right(cuts, (key.encode(), path.encode() + b"\xff", b""))
                out += [(part, key, path, 0, host, allow) for part in range(low, high + 1)]
            yield _batch(out)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, str, str, str, bool]] = []
        for batch in batches:
            out = []
            for part, key, path, kind, host, allow in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while stack and not (stack[-1][0] == part and stack[-1][1] == key and path.startswith(stack[-1][2])):
                    stack.pop()
                if kind == 0:
                    stack.append((part, key, path, host, allow))
                elif stack:
                    _, _, own, of, allowed = stack[-1]
                    out.append((host, path, len(of) + len(own), len(of), of + own, allowed))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["host", "path", "size", "host_size", "rule", "allow"])

    keyed = pairs.mapInArrow(key_rows, _KEYED).unionByName(rules.mapInArrow(rule_rows, _KEYED))
    dealt = keyed.repartitionById(n, F.col("part")).sortWithinPartitions("part", "host_key", "path", "kind", F.desc("allow"))
    hits = dealt.mapInArrow(sweep, "host string, path string, size int, host_size int, rule string, allow boolean")
    best = hits.groupBy("host", "path").agg(F.max(F.struct("size", "host_size", F.expr("NOT allow").alias("block"), "rule")).alias("best"))
    allowed = F.coalesce(~F.col("best.block"), F.lit(default_allow))
    return rows.join(best, ["host", "path"], "left").select(
        *[F.col(f"own.c{i}").alias(c) for i, c in enumerate(kept)], "host", "path", F.col("best.rule").alias("rule"), F.when(allowed, "allow").otherwise("block").alias("verdict")
    )


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * 6
    types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "host_key", "path", "kind", "host", "allow"])
