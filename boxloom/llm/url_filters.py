"""URL filters: a trie over reversed host labels and path segments decides between allow and block entries.

A rule is ``host/path``.  It fits its host and every subdomain when the url's path starts with the rule's path, and
the longest fitting rule wins; of rules of equal length block wins, then the later one in the order of code points.  The trie has one level per host
label from the right, then one per path segment; the last segment of a rule is matched as a prefix.

Defined results: a null url, or one without ``://``, has empty host and path and gets the default verdict; urls may
repeat; an empty table gives an empty result; other columns of the input are kept unless they bear the name of an
output column, in which case the output replaces them.

The trie is broadcast when the rules are at most ``MAX_TRIE_RULES``; longer rule lists go through
:func:`filter_by_join`, an equi-join of host suffixes with the rules, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, join_with_hot_keys, lower_ascii, table

MAX_TRIE_RULES = 200_000
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: The rules of the query, fixed by its contract.
RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


class UrlTrie:
    """``nodes`` are dicts: under a label or segment the next node, under ``None`` the rules that end there, by their
    last segment: length, verdict and rule, of which the greatest wins ("block" comes after "allow")."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.root: dict = {}
        for rule, verdict in rules:
            host, slash, rest = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(ASCII_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label holds a slash
            *whole, last = (slash + rest).split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            ends[last] = max(ends.get(last, (0, "", "")), (len(rule), verdict, rule))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node, segments = (0, "", ""), self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get("/")
            for segment in segments:
                if at is None:
                    break
                for last, found in at.get(None, {}).items():
                    if found > best and segment.startswith(last):
                        best = found
                at = at.get(segment)
        return (best[2], best[1]) if best[0] else None


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    of = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns({"host": lower_ascii(F.regexp_extract(of, pattern, 1)), "path": F.regexp_extract(of, pattern, 2)})


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with columns host, path, rule and verdict."""
    parsed = with_host_and_path(df.drop("host", "path", "rule", "verdict"), url)
    if len(rules) > MAX_TRIE_RULES:
        return filter_by_join(parsed, rules, default)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            found = [find(h, p) or (None, default) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            more = [pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "rule", "verdict"])

    schema = T.StructType([*parsed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parsed.mapInArrow(judge, schema)


def filter_by_join(parsed: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """The same verdicts for rule lists too long for a trie on every executor."""
    listed = parsed.sparkSession.createDataFrame(rules, "rule string, verdict string")
    listed = listed.select("rule", "verdict", lower_ascii(F.substring_index("rule", "/", 1)).alias("suffix"), F.regexp_extract("rule", r"(?s)/.*", 0).alias("start"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = parsed.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    fits = join_with_hot_keys(parts, listed, "suffix").where(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("__best"))
    joined = parsed.join(best, ["host", "path"], "left")
    return joined.select(*parsed.columns, F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark, sf_dir) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


OP2_SQL = r"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(rule, verdict, h, p) AS (VALUES
  ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'),
  ('net/de/', 'allow', 'net', '/de/'), ('example.net/de/8', 'block', 'example.net', '/de/8'),
  ('org/es/', 'block', 'org', '/es/')),
fits AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
  FROM cut, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN fits f ON f.page_id = c.page_id AND f.k = 1
"""
