"""Exact Jaccard self-join of n-gram sets by universe partition and pigeonhole.

Sets are grouped by size into bands.  The scheme of a band hashes the universe of shingles into segments.  Two sets
that are similar enough differ in at most H shingles, H being a bound for the band, so if the budgets of the segments add up to more than
H, they agree in a segment of budget 1, or differ by at most one shingle in a segment of budget 2.  Each set emits a signature for the
content of each segment, and for segments of budget 2 also of each content with one shingle left out (one-deletion
neighbourhood), under the scheme of its band and of the band below.  Budgets are allotted by cost: more signatures
against the number of candidates expected from empty segments, given the band's number of sets.  Segments that are empty
(budget 2: hold one shingle at most) in both sets are no evidence; schemes have a slack Z for them, and a set with more
such budget than Z also emits the empty contents, which only meet those of other such sets.

No pair list of a group is made.  Each signature's sets are compared with one of them, the leader: the set with the most
company over all its signatures, which for a family of copies is the one they come from.  Links are contracted to
components.  The sets of a leader that then lie in several components are refined: they are dealt to tasks in pairs of
blocks.  In a task, sets without a share t of their shingles in sets of other components go, again and again; the others
are compared by products of presence matrices, except inside a component, and each set yields at most one link to each
component it meets.  Where a leader has more than one block, the same filter first runs over all its sets at once.
Every two similar sets share a signature and so a leader, and are either in one component or compared: the components
are those of the full join.  :func:`jaccard_links` gives all its links: there every set counts as a component.

Signatures, leaders, shingles and roots that hold many rows are not gathered: rows of signatures that a sample of sets shows
to be hot are dealt to several tasks by set, and what is joined to hot keys is sent to their rows.  The sample decides
on tasks alone, never on results.

Sets are identified by 64-bit hashes of their shingles' 64-bit hashes.

Defined results: a text with fewer words than ``k`` is one shingle; without words or text a document has no shingles,
links with nothing and is its own component; repeated rows link with each other; a similarity of exactly the threshold
(a tie) links; a text of any length is one set, which one task reads; a row without an id belongs to its
component, whose id is the smallest that is not null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, hot_keys, intermediate, is_small, join_hot, kept, release, stored, table

#: Defaults of near-duplicate operators: five words, similarity 0.8.
WORDS, THRESHOLD = 5, Fraction(4, 5)
#: Blocks of the refinement hold so many sets and shingles at most (one set at least).
BLOCK_SETS, BLOCK_SHINGLES = 2_048, 1 << 21
#: Sets and shingles in a factor of a matrix product.
ROWS, COLUMNS = 256, 4_096
#: Odd constants of the 64-bit mixing function (fixed values).
MIX_1, MIX_2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0x5851F42D4C957F2D)
FLUSH = 1 << 19  # signatures in a batch
#: A text in so many is looked at to find hot signatures, whose rows are dealt in parts of ``PART`` sets.
SAMPLED, PART = 64, 50_000
#: Edges up to which a step of :func:`contract` is so small that hot nodes do not matter.
FEW_EDGES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``k``-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total = mix(total * STEP + hashes[j : j + n])
    return np.unique(total)


def set_key(hashes: np.ndarray) -> int:
    return int(mix(hashes * STEP + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64))


@lru_cache(maxsize=None)
def bands(t: Fraction) -> list[int]:
    """Lower ends of the size bands; a set links only into its own band and those next to it."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, math.ceil(ends[-1] / t)))
    return ends


def most_differences(t: Fraction, largest: int) -> int:
    """Most shingles in which a set of up to ``largest`` and a larger one that links with it differ."""
    both = largest + math.floor(largest / t)
    return max(s - 2 * math.ceil(t / (1 + t) * s) for s in range(max(2, both - 40), both + 1))


def scheme(t: Fraction, band: int, sets: int) -> tuple[int, int, int]:
    """Segments of budget 1 and of budget 2, and the slack, of least cost for a band with so many sets."""
    least, largest = bands(t)[band], bands(t)[band + 1] - 1
    need = most_differences(t, largest) + 1
    best = None
    for two in range(0, min(4, need) + 1):
        for slack in range(0, 16 + need // 4):
            one = need + slack - 2 * two
            if one < 0 and not (one == -1 and slack == 0):
                continue
            one = max(one, 0)
            load = least / (one + 2 * two)
            if one + two == 1:
                sparse = 0.0 if least > two else 1.0
            else:
                rate = one * math.exp(-load) + 2 * two * math.exp(-2 * load) * (1 + 2 * load)
                sparse = poisson_tail(rate, slack)
            cost = one + two * (1 + 2 * load) + sets * sparse * sparse
            if best is None or cost < best[0]:
                best = (cost, one, two, slack + (2 * two + one - need - slack))
    return best[1:]


def poisson_tail(rate: float, above: int) -> float:
    term, total = math.exp(-rate), 0.0
    for i in range(above + 1):
        total += term
        term *= rate / (i + 1)
    return max(0.0, 1.0 - total)


def signatures(hashes: np.ndarray, band: int, of: tuple[int, int, int]) -> np.ndarray:
    one, two, slack = of
    salt = np.uint64((band + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF)
    slot = (mix(hashes + salt) % np.uint64(one + 2 * two)).astype(np.int64)
    segment = np.where(slot < one, slot, one + (slot - one) // 2)
    content = mix(hashes ^ MIX_1)
    order = np.argsort(segment, kind="stable")
    size = np.bincount(segment, minlength=one + two)
    used = np.flatnonzero(size)
    starts = (np.cumsum(size) - size)[used]
    total = np.zeros(one + two, np.uint64)
    total[used] = np.add.reduceat(content[order], starts)
    names = mix(np.arange(one + two, dtype=np.uint64) * MIX_2 + salt)
    out = [mix(total[used] + names[used])]
    if two:
        left = segment[(segment >= one) & (size[segment] > 1)]
        out.append(mix(total[left] - content[(segment >= one) & (size[segment] > 1)] + names[left]))
    weak = np.concatenate([np.flatnonzero(size[:one] == 0), one + np.flatnonzero(size[one:] <= 1)])
    if (weak < one).sum() + 2 * (weak >= one).sum() > slack:
        out.append(mix(names[weak] + EMPTY))
    return np.concatenate(out)


class Joiner:
    def __init__(self, docs: DataFrame, k: int, threshold: Fraction, key: str, text: str):
        bound_batches(docs.sparkSession)
        self.t, self.k = threshold, k
        self.docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        self.keys = stored(self.docs.mapInArrow(self.summary(), "key long, n long, band int, set long"), "set-keys")

    def summary(self):
        k, ends = self.k, np.array(bands(self.t))

        def run(batches):
            for batch in batches:
                sets = [shingles(x, k) for x in batch["text"].to_pylist()]
                n = np.array([len(s) for s in sets], np.int64)
                ids = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(n), pa.array((np.searchsorted(ends, n, "right") - 1).astype(np.int32)), ids], ["key", "n", "band", "set"])

        return run

    def schemes(self) -> dict[int, tuple[int, int, int]]:
        counts = self.keys.where("n > 0").groupBy("band").agg(F.count_distinct("set").alias("sets")).collect()  # a row per band, of which there are at most 300
        sets = {r["band"]: r["sets"] for r in counts}
        return {b: scheme(self.t, b, sets.get(b, 0) + sets.get(b + 1, 0)) for b in {x for r in sets for x in (r, r - 1) if x >= 0}}

    def emitted(self, docs: DataFrame, schemes: dict[int, tuple[int, int, int]]) -> DataFrame:
        """Rows (signature, set).  A task emits a set that it has just seen only once."""
        k, t, ends = self.k, self.t, np.array(bands(self.t))

        def run(batches):
            seen: set[int] = set()
            for batch in batches:
                out, ids, n = [], [], 0
                for text in batch["text"].to_pylist():
                    hashes = shingles(text, k)
                    if not len(hashes):
                        continue
                    key = set_key(hashes)
                    if key in seen:
                        continue
                    if len(seen) > 1 << 18:
                        seen.clear()
                    seen.add(key)
                    band = int(np.searchsorted(ends, len(hashes), "right")) - 1
                    found = [signatures(hashes, band, schemes[band])]
                    if band and math.ceil(t * len(hashes)) < ends[band]:
                        found.append(signatures(hashes, band - 1, schemes[band - 1]))
                    for x in found:
                        out.append(x)
                        ids.append(np.full(len(x), key, np.int64))
                        n += len(x)
                    if n > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(ids))], ["signature", "set"])
                        out, ids, n = [], [], 0
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(ids))], ["signature", "set"])

        return docs.select("text").mapInArrow(run, "signature long, set long")

    def shared(self) -> DataFrame:
        """Rows (signature, set), each once, of signatures that several sets have (or the sample found hot)."""
        schemes = self.schemes()
        sample = self.docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
        seen = self.emitted(sample, schemes).distinct().groupBy("signature").agg(F.count("*").alias("size"))
        hot = stored(seen.where(F.col("size") * SAMPLED > PART).select("signature", F.ceil(F.col("size") * SAMPLED / PART).alias("parts")), "hot-signatures")
        rows = self.emitted(self.docs, schemes)
        by, is_hot = ["signature"], F.lit(False)
        if not hot.isEmpty():  # at most as many as the sample's signatures over PART / SAMPLED
            rows = rows.join(F.broadcast(hot), "signature", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("set"), F.col("parts")), F.lit(0)))
            by, is_hot = ["signature", "part"], F.col("parts").isNotNull()
        order = Window.partitionBy(*by).orderBy("set")
        ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.select("*", F.first("set").over(ends).alias("first"), F.last("set").over(ends).alias("last"), F.lag("set").over(order).alias("before"))
        several = is_hot | (F.col("first") != F.col("last"))
        return stored(rows.where(several & (F.col("before").isNull() | (F.col("before") != F.col("set")))).select("signature", "set"), "shared-signatures")

    def led(self) -> DataFrame:
        """Distinct pairs (a, b) of a leader and another set of its signatures."""
        rows = self.shared()
        sizes = stored(rows.groupBy("signature").agg(F.count("*").alias("size")), "signature-sizes")
        hot = hot_keys(sizes, "signature")
        company = join_hot(rows, sizes, "signature", hot).groupBy("set").agg(F.sum("size").alias("company"))
        leaders = rows.join(company, "set").groupBy("signature").agg(F.max(F.struct("company", "set")).alias("top")).select("signature", F.col("top.set").alias("a"))
        leaders = leaders if hot is None else stored(leaders, "leaders")
        return stored(join_hot(rows, leaders, "signature", hot).where("set <> a").select("a", F.col("set").alias("b")).distinct(), "leader-pairs")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(set, n, shingles) of each set in ``wanted``, from one document of each."""
        k = self.k
        some = self.keys.join(broadcast_if_small(wanted), "set", "left_semi").groupBy("set").agg(F.min("key").alias("key"))
        some = stored(some, "set-documents")
        named = self.docs.join(broadcast_if_small(some.where("key is not null").select("key").distinct()), "key", "left_semi")
        nameless = self.docs.where("key is null")

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    sets = [s for x in batch["text"].slice(at, 512).to_pylist() if len(s := shingles(x, k))]
                    flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["set", "n", "shingles"])

        found = named.unionByName(nameless).select("text").mapInArrow(run, "set long, n long, shingles array<long>")
        found = stored(found.join(broadcast_if_small(some.select("set")), "set", "left_semi"), "shingle-sets")
        several = found.groupBy("set").agg(F.count("*").alias("times")).where("times > 1")
        if several.isEmpty():
            return found
        return stored(found.dropDuplicates(["set"]), "shingle-sets")  # documents without an id of their own

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of a leader and a set whose Jaccard similarity reaches the threshold.  A leader goes
        with its sets to a task, or to several, each with a part of them."""
        num, den = self.t.numerator, self.t.denominator
        sizes = sets.select("set", "n")
        hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("size")), "a")
        fit = join_hot(pairs, sizes.toDF("a", "n_a"), "a", hot).join(sizes.toDF("b", "n_b"), "b").where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
        most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_SHINGLES) / F.max("n_b"))))
        parts = fit.groupBy("a").agg(F.ceil(F.count("*") / most).alias("parts"))
        own = join_hot(fit, parts, "a", hot).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("set"))
        first = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("set"))
        dealt = stored(own.unionByName(first), "dealt-pairs")

        def run(table: pa.Table) -> pa.Table:
            ids, leader = table["set"].to_numpy(), table["a"][0].as_py()
            column = table["shingles"].combine_chunks()
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            of = lambda k: flat[ends[k] : ends[k + 1]]
            at = int(np.flatnonzero(ids == leader)[0])
            mine = np.sort(of(at))
            out = []
            for k in range(len(ids)):
                if k != at:
                    theirs = of(k)
                    place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                    common = int((mine[place] == theirs).sum())
                    if common * den >= (len(mine) + len(theirs) - common) * num:
                        out.append(ids[k])
            return pa.table({"a": pa.array([leader] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

        placed = sets.select("set", "shingles").join(broadcast_if_small(dealt), "set")
        return placed.groupBy("a", "part").applyInArrow(run, "a long, b long")

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of a leader and a set, and the sets in them."""
        pairs = self.led()
        release(pairs.sparkSession)
        wanted = stored(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), "wanted-sets")
        return pairs, self.sets(wanted)

    def links(self) -> DataFrame:
        """All links (a, b), a < b, between different sets: each is a component of its own, so all sets of a leader are compared."""
        pairs, sets = self.candidates()
        groups = pairs.select(F.col("a").alias("leader"), F.col("b").alias("set")).union(pairs.select("a", "a").distinct())
        found = self.compared(groups.withColumn("root", F.col("set")).join(sets.select("set", "n"), "set"), sets)
        return stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    def components(self) -> DataFrame:
        """(set, root) of each set that links with another."""
        pairs, sets = self.candidates()
        links = stored(self.linked(pairs, sets), "links")
        roots = contract(links)
        release(pairs.sparkSession)
        groups = pairs.select(F.col("a").alias("leader"), F.col("b").alias("set")).union(pairs.select("a", "a").distinct())
        placed = with_roots(groups, roots)
        several = placed.groupBy("leader").agg((F.min("root") != F.max("root")).alias("several"), F.count("*").alias("members")).where("several").select("leader", "members")
        several = stored(several, "open-leaders")
        hot = hot_keys(several.select("leader", F.col("members").alias("size")), "leader")
        left = stored(join_hot(placed, several, "leader", hot).join(sets.select("set", "n"), "set"), "open-groups")
        many = left.where(F.col("members") > BLOCK_SETS)
        if not many.isEmpty():
            for _ in range(2):  # sets that go may leave others without company
                many = self.supported(many, sets)
            left = stored(left.where(F.col("members") <= BLOCK_SETS).unionByName(many.select(*left.columns)), "open-groups")
        more = stored(self.compared(left, sets), "links")
        return roots if more.isEmpty() else contract(links.union(more))

    def supported(self, groups: DataFrame, sets: DataFrame) -> DataFrame:
        """The rows (leader, set, root) whose sets have at least a share t of their shingles in sets of other components too."""
        num, den = self.t.numerator, self.t.denominator
        named = stored(groups.select("set", "root").distinct(), "open-sets")
        rows = sets.join(broadcast_if_small(named), "set").select("set", "root", "n", F.explode("shingles").alias("shingle"))
        across = rows.groupBy("shingle").agg((F.min("root") != F.max("root")).alias("across"), F.count("*").alias("size")).where("across").select("shingle", "size")
        across = stored(across, "shared-shingles")
        company = join_hot(rows, across.select("shingle"), "shingle", hot_keys(across, "shingle"), "left_semi").groupBy("set").agg(F.count("*").alias("company"), F.first("n").alias("n"))
        able = stored(company.where(F.col("company") * den >= F.col("n") * num).select("set", "n"), "able-sets")
        return stored(groups.drop("n").join(broadcast_if_small(able), "set"), "open-groups")

    def compared(self, groups: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) between sets of a leader that lie in different components."""
        t = self.t
        groups = groups.select("leader", "set", "root", "n")
        sizes = groups.groupBy("leader").agg(F.count("*").alias("members"), F.max("n").alias("most"))
        block = F.least(F.lit(BLOCK_SETS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_SHINGLES) / F.col("most"))))
        sizes = stored(sizes.select("leader", "members", F.ceil(F.col("members") / block).alias("blocks")), "leader-sizes")
        hot = hot_keys(sizes.select("leader", F.col("members").alias("size")), "leader")
        dealt = join_hot(groups, sizes, "leader", hot).withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")))
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
        placed = stored(dealt.withColumn("pair", F.explode(others)).select("leader", "pair.i", "pair.j", "own", "set", "root"), "block-pairs")
        placed = sets.select("set", "shingles").join(broadcast_if_small(placed), "set")

        def run(table: pa.Table) -> pa.Table:
            own, at = table["own"].to_numpy(), table["i"][0].as_py()
            ids, roots = table["set"].to_numpy(), table["root"].to_numpy()
            column = table["shingles"].combine_chunks()
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            found = block_links(ids, roots, np.repeat(np.arange(len(ids)), lengths), flat, lengths, own == at, own == table["j"][0].as_py(), t)
            return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

        return placed.groupBy("leader", "i", "j").applyInArrow(run, "a long, b long").distinct()


def block_links(ids, roots, row, shingle, size, left, right, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links between the sets of two blocks (which may be one) that lie in different components; ``row`` and ``shingle``
    list the sets' shingles.  Each set gives at most one link to each component."""
    num, den = t.numerator, t.denominator
    names, code = np.unique(shingle, return_inverse=True)
    component = np.unique(roots, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code, alive = row[order], code[order], np.ones(len(ids), bool)
    while True:
        if not len(row):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        begins = np.flatnonzero(np.diff(code, prepend=-1))
        of = component[row]
        across = np.minimum.reduceat(of, begins) != np.maximum.reduceat(of, begins)
        keep = np.repeat(across, np.diff(np.append(begins, len(code))))
        row, code = row[keep], code[keep]
        able = alive & (np.bincount(row, minlength=len(ids)) * den >= size * num)
        if (able == alive).all():
            break
        alive = able
        row, code = row[alive[row]], code[alive[row]]
    if not len(row):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = [], []
    column = np.unique(code, return_inverse=True)[1]
    width = int(column.max()) + 1
    order = np.argsort(row, kind="stable")
    row, column = row[order], column[order]
    starts = np.searchsorted(row, np.arange(len(ids) + 1))

    def matrix(rows: np.ndarray, first: int) -> np.ndarray:
        out = np.zeros((len(rows), min(COLUMNS, width - first)), np.float32)
        for k, r in enumerate(rows):
            at = column[starts[r] : starts[r + 1]]
            out[k, at[(at >= first) & (at < first + COLUMNS)] - first] = 1
        return out

    by_root = np.argsort(roots, kind="stable")  # so that factors of one component can be left out
    lefts, rights = by_root[(left & alive)[by_root]], by_root[(right & alive)[by_root]]
    for i in range(0, len(lefts), ROWS):
        x = lefts[i : i + ROWS]
        for j in range(0, len(rights), ROWS):
            y = rights[j : j + ROWS]
            if len(np.unique(roots[np.concatenate([x, y])])) < 2:
                continue
            common = np.zeros((len(x), len(y)), np.int64)
            for first in range(0, width, COLUMNS):
                common += np.rint(matrix(x, first) @ matrix(y, first).T).astype(np.int64)
            both = size[x][:, None] + size[y][None, :] - common
            hit = (common * den >= both * num) & (roots[x][:, None] != roots[y][None, :])
            p, q = np.nonzero(hit)
            if len(p):
                _, one = np.unique(np.stack([p, np.unique(roots[y[q]], return_inverse=True)[1]]), axis=1, return_index=True)
                a.append(ids[x[p[one]]])
                b.append(ids[y[q[one]]])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.drop("root").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))


def contract(links: DataFrame) -> DataFrame:
    """(set, root): connected components by alternating large-star and small-star steps; ``root`` is the smallest set.
    Each step writes its edges, so its plan stays short; a hub is never gathered, only its smallest neighbour."""
    edges = stored(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), "edges")
    before = None

    def with_least(rows: DataFrame, least: Column) -> DataFrame:
        known = rows.groupBy("x").agg(least.alias("m"), F.count("*").alias("size"))
        if few:
            return rows.join(known.drop("size"), "x")
        known = stored(known, "least-neighbours")
        return join_hot(rows, known.drop("size"), "x", hot_keys(known.select("x", "size"), "x"))

    while True:
        few = is_small(edges, FEW_EDGES)
        both = edges.union(edges.select("y", "x"))
        large = with_least(both, F.least(F.min("y"), F.col("x"))).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = large if few else stored(large, "edges")
        small = with_least(large, F.min("y"))
        edges = stored(small.select("x", F.col("m").alias("y")).union(small.where("y <> m").select("y", "m")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("x").alias("set"), F.col("y").alias("root")).union(edges.select("y", "y").distinct())
        before = now


def jaccard_components(docs: DataFrame, k: int = WORDS, threshold: Fraction = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles and component_id, the smallest key reachable by links."""
    with intermediate(docs.sparkSession):
        join = Joiner(docs, k, Fraction(threshold), key, text)
        placed = stored(with_roots(join.keys, join.components()).select("key", "n", "root"), "placed")
        least = stored(placed.where("root is not null").groupBy("root").agg(F.min("key").alias("least"), F.count("*").alias("size")), "components")
        named = join_hot(placed, least.drop("size"), "root", hot_keys(least.select("root", "size"), "root"), "left")
        component = F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("least"))
        return kept(named.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")), "components")


def jaccard_links(docs: DataFrame, k: int = WORDS, threshold: Fraction = THRESHOLD, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: all links (a, b), a < b, between different sets, and a row (key, n_shingles, set) per row of ``docs``.
    Rows of one set link with each other; a row without shingles has no set.  The number of links grows with the square
    of a family of different near copies."""
    join = Joiner(docs, k, Fraction(threshold), key, text)
    return join.links(), join.keys.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "set")


def link_counts(docs: DataFrame, k: int = WORDS, threshold: Fraction = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles and n_links, the number of other rows that it links with."""
    links, members = jaccard_links(docs, k, threshold, key, text)
    times = members.where("set is not null").groupBy("set").agg(F.count("*").alias("times"))
    ends = links.union(links.select("b", "a")).toDF("set", "other")
    others = ends.join(times.toDF("other", "theirs"), "other").groupBy("set").agg(F.sum("theirs").alias("others"))
    counted = stored(times.join(others, "set", "left").select("set", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "link-counts")
    return members.join(broadcast_if_small(counted), "set", "left").select(key, "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op5_jaccard_join(spark, sf_dir) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, Fraction(85, 100))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, chr(1))]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] || chr(1) || w[i + 3])) END AS s FROM w),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM sets s
"""
