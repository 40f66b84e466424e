"""Benchmark decontamination by spaced-seed hashing.

Texts become arrays of token hashes (runs of letters, marks and digits of the lower-cased text; in scripts written
without spaces every character is a token).  An overlap is a
window of ``SPAN`` tokens in which at least ``NEED`` agree, place by place, with a window of a benchmark item: it
tolerates ``SPAN - NEED`` substitutions.  The masks keep two of the four classes of positions modulo 4 and ignore the
others, so whatever two positions are substituted, one mask does not see them: no overlap is missed.  Documents'
masked hashes are joined with the benchmark's, then each hit's window is compared.

Items shorter than ``SPAN`` have masks of their own and must occur whole: those of ``ONE_CHANGE`` tokens or more with one substitution
(two masks, of the even and of the odd places), others unchanged.  Items under ``SHORTEST`` tokens, which stand in many
unrelated texts, overlap with documents that consist of them alone.  One pass over the documents serves all lengths.

Up to ``BROADCAST_SEEDS`` windows of the benchmark are broadcast with their hashes.  Beyond, blocks of hashes alone are
broadcast, one pass for each, so that only windows that share a hash with the benchmark are ever shuffled.  All in
DataFrame expressions.

Defined results: null, blank and short texts overlap with nothing but equal items; null items and repeated items or documents are
compared like others (rows that agree in id and text count as one); of several windows that agree best (ties) the first and last
tokens over all that suffice are given; a text of any length is searched whole by one task; an empty table on either side gives no overlaps;
columns other than key and text are not read by :func:`overlaps` and are kept by :func:`without_overlaps`.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_with_hot_keys, stored, table

SPAN, NEED, ONE_CHANGE, SHORTEST = 13, 11, 8, 5
#: Classes of positions; a mask keeps two of them and ignores the others.
CLASSES = [[k for k in range(SPAN) if k % 4 == c] for c in range(4)]
MASKS = list(combinations(range(4), 2))
#: Scripts written without spaces between words (fixed list).
UNSPACED = "Han Hiragana Katakana Thai Lao Khmer Myanmar Tibetan".split()
#: Ranges of code points that hold all characters of these scripts; only texts with one of them are split by script.
RANGES = r"[\x{0E00}-\x{109F}\x{1780}-\x{17FF}\x{19E0}-\x{19FF}\x{2E80}-\x{9FFF}\x{A9E0}-\x{AA7F}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}\x{116D0}-\x{116FF}\x{16FE0}-\x{16FFF}\x{1AFF0}-\x{3FFFF}]"
#: Windows of the benchmark that are broadcast, and hashes in a block of a larger one.
BROADCAST_SEEDS, BLOCK_SEEDS = 300_000, 2_000_000


def token_hashes(text: str) -> Column:
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    alone = F.regexp_replace(lower, f"([{''.join(rf'\p{{Is{x}}}' for x in UNSPACED)}])", " $1 ")
    tokens = F.array_remove(F.split(F.when(lower.rlike(RANGES), alone).otherwise(lower), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def masked(length: int) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """Classes of positions of a window of ``length`` tokens, and masks."""
    if length == SPAN:
        return CLASSES, MASKS
    if length >= ONE_CHANGE:
        return [list(range(c, length, 2)) for c in range(2)], [(0,), (1,)]
    return [list(range(length))], [(0,)]


def needed(length: int) -> int:
    return NEED if length == SPAN else length - 1 if length >= ONE_CHANGE else length


def with_seeds(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per place of ``tokens``, length and mask: the place, the tokens from there on and the masked hash.  Each
    class of positions is hashed once; the expressions stay small, so that the generated code of a stage is compiled."""
    n = F.size("tokens")
    places = F.when(n >= min(lengths), F.sequence(F.lit(0), n - min(lengths)))
    placed = rows.select("*", n.alias("n"), F.explode(places).alias("place"))
    token = lambda k: F.get("tokens", F.col("place") + k)
    named = {(length, c): f"class_{length}_{c}" for length in lengths for c in range(len(masked(length)[0]))}
    classed = placed.withColumns({name: F.xxhash64(F.lit(length), F.lit(c), *map(token, masked(length)[0][c])) for (length, c), name in named.items()})
    parts = []
    for length in lengths:
        hashes = F.array(*[F.xxhash64(F.lit(length), F.lit(k), *[named[length, c] for c in mask]) for k, mask in enumerate(masked(length)[1])])
        fits = F.col("place") + length <= F.col("n") if length >= SHORTEST else F.col("n") == length
        parts.append(hashes if len(lengths) == 1 else F.when(fits, hashes).otherwise(F.array().cast("array<bigint>")))
    seeded = classed.withColumn("seed", F.explode(parts[0] if len(parts) == 1 else F.concat(*parts))).withColumn("window", F.slice("tokens", F.col("place") + 1, SPAN))
    return seeded.drop("tokens", "n", *named.values())


def hits(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Best window of each document and item that share a seed, with the first and last token of the windows that
    suffice.  Windows are compared by a lambda above the join: as a join condition it would take the join, which all
    seeds of all documents pass, out of compiled code."""
    theirs = None
    for length in lengths:
        some = with_seeds(items.where(F.least(F.size("tokens"), F.lit(SPAN)) == length), [length])
        some = some.select("seed", "item_id", F.col("window").alias("item_window"), F.lit(length).alias("span"), F.lit(needed(length)).alias("need"))
        theirs = some if theirs is None else theirs.union(some)
    theirs = stored(theirs.distinct(), "benchmark-seeds")
    ours, n = with_seeds(docs, lengths), theirs.count()
    if n <= BROADCAST_SEEDS:
        found = ours.join(F.broadcast(theirs), "seed")
    else:
        blocks = -(-n // BLOCK_SEEDS)
        seeds = theirs.select("seed").distinct().withColumn("block", F.pmod(F.xxhash64("seed"), F.lit(blocks)))
        near = [ours.join(F.broadcast(seeds.where(F.col("block") == b).select("seed")), "seed", "left_semi") for b in range(blocks)]
        found = join_with_hot_keys(stored(reduce(DataFrame.union, near), "seed-hits"), theirs, "seed")
    same = F.size(F.filter(F.zip_with("window", "item_window", lambda a, b: a == b), lambda v: v))
    compared = found.select("key", "text_hash", "item_id", "place", "span", "need", same.alias("same"))
    enough = lambda v: F.when(F.col("same") >= F.col("need"), v)
    best = compared.groupBy("key", "text_hash", "item_id").agg(F.min(enough(F.col("place"))).alias("first_token"), F.max(enough(F.col("place") + F.col("span") - 1)).alias("last_token"), F.max("same").alias("most_same"))
    return best.where("first_token is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that overlap: key, text_hash, item_id, first and last token of the overlaps, and
    the most tokens that agree in a window."""
    tokens = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), token_hashes(text).alias("tokens"))
    items = stored(benchmark.select(F.col(item).alias("item_id"), token_hashes(item_text).alias("tokens")), "benchmark-tokens")
    lengths = [r[0] for r in items.select(F.least(F.size("tokens"), F.lit(SPAN)).alias("n")).where("n > 0").distinct().collect()]  # at most SPAN numbers
    return hits(tokens, items, sorted(lengths) or [SPAN])


def without_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no item."""
    found = stored(overlaps(docs, benchmark, key, text).select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__hash"))
    return docs.join(broadcast_if_small(found), same, "left_anti")


def op4_decontamination(spark, sf_dir) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "item_id", "first_token", "last_token", "most_same")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
m AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
dt AS (SELECT doc_id, len(w) AS n, unnest(w) AS token, unnest(range(0, len(w))) AS p FROM d),
mt AS (
  SELECT item_id, len(w) AS n, least(13, len(w)) AS span, CASE WHEN len(w) >= 13 THEN 11 WHEN len(w) >= 8 THEN len(w) - 1 ELSE len(w) END AS need, unnest(w) AS token, unnest(range(0, len(w))) AS i
  FROM m),
same AS (
  SELECT doc_id, item_id, p - i AS diagonal, p, dt.n AS n_doc, mt.n AS n_item, span, need
  FROM dt JOIN mt ON dt.token = mt.token),
enough AS (SELECT doc_id, item_id, diagonal FROM same GROUP BY doc_id, item_id, diagonal HAVING count(*) >= min(need)),
held AS (SELECT same.* FROM same JOIN enough ON same.doc_id = enough.doc_id AND same.item_id = enough.item_id AND same.diagonal = enough.diagonal),
windows AS (
  SELECT doc_id, item_id, diagonal, span, need, p - k AS start, count(*) AS same
  FROM held, (SELECT unnest(range(0, 13)) AS k) AS offsets
  WHERE k < span AND p - k >= 0 AND p - k + span <= n_doc AND p - k - diagonal >= 0 AND p - k - diagonal + span <= n_item AND (span >= 5 OR n_doc = n_item)
  GROUP BY doc_id, item_id, diagonal, span, need, p - k)
SELECT doc_id, item_id, CAST(min(start) AS INTEGER) AS first_token, CAST(max(start + span - 1) AS INTEGER) AS last_token, CAST(max(same) AS INTEGER) AS most_same
FROM windows WHERE same >= need GROUP BY doc_id, item_id
"""
