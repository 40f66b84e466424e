"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is a chain of positions; a piece from position q to p is an edge.  Encoding is the best path under the max-plus
algebra, for both kinds of model that a model file can hold:

* unigram: an edge weighs the piece's score, and any piece may follow any other;
* BPE: a piece may follow another only if merging their joint text leaves exactly these two pieces.  Under that
  constraint one path through every prefix survives, and it is the merge result; edges weigh 0, forbidden ones minus
  infinity.

Texts of up to ``CHUNK`` characters are encoded in one map.  Longer ones are cut into chunks of ``CHUNK`` characters,
wherever that falls, which are dealt over the cluster.  A boundary state is the piece that reaches or crosses a
boundary, with the number of its characters before it.  Each chunk yields the max-plus matrix from its left to its
right boundary states.  Matrices of ``FAN`` neighbours are multiplied, then such products, and so on up a tree until one
matrix is left of each document; down the tree, the states at the ends of a product give those between its factors; then each chunk is
backtraced on its own.  Between two places that no piece of the vocabulary spans (a blank after a non-blank, a line
break), the matrix has rank one and only the two ends of the chunk matter.

Normalization: models with an identity normalizer are supported (blanks become U+2581, one is put in front); others
are refused.  Results equal the sentencepiece library's.

Defined results: a null or empty text has no ids and decodes to an empty text; a literal U+2581 decodes to a blank,
as in the library; of equally good paths that by the smallest states is taken; repeated rows are each encoded; an empty table gives an empty result; all other columns are kept,
an existing column with the output's name is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, stored, table

CHUNK = 65_536
#: Matrices that one task multiplies.
FAN = 64
BLANK = "▁"
#: Cached units of a worker; the cache is emptied when it is full, which changes no result.
CACHE_UNITS = 200_000
#: Texts in a batch of results.
ROWS = 256
#: Units up to this length are cached.
CACHED_LENGTH = 64
UNKNOWN = -1
START, END = -1, -2


def model_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value of a protocol-buffer message (varint, 4-byte and length-delimited fields)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Vocabulary:
    """Pieces, scores and rules of a model; ``pieces``: (text, score, kind) with kind one of normal, byte, unknown,
    control."""

    def __init__(self, pieces: list[tuple[str, float, str]], bpe: bool):
        self.pieces, self.bpe = pieces, bpe
        self.ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == "normal"}
        self.scores = [score for _, score, _ in pieces]
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.follows: dict[int, bool] = {}
        self.built: dict[int, list | None] = {}
        self.breaks_lines = not any("\n" in x for x in self.ids)
        if any(re.search(f"[^{BLANK}]{BLANK}", x) for x in self.ids):
            raise NotImplementedError("pieces that span words")
        line = "\n" if self.breaks_lines else ""
        # signs that no piece has right after a letter: a word ends before them
        ends = {c for x in self.ids for c in x} - {b for x in self.ids for a, b in zip(x, x[1:], strict=False) if a.isalpha()}
        ends = "".join(re.escape(c) for c in sorted(ends) if not c.isalnum() and c not in "_" + BLANK)
        word = rf"{BLANK}*[^\W\d_]++(?=[{ends}])|" if ends else ""
        self.units = re.compile(f"{'[' + line + ']|' if line else ''}{word}{BLANK}*[^{BLANK}{line}]+|{BLANK}+")
        self.cut = re.compile(f"(?<=[^{BLANK}]){BLANK}" + (r"|\n|(?<=\n)[^\n]" if line else ""))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        kinds = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 5: "unused", 6: "byte"}
        pieces, bpe = [], False
        with open(path, "rb") as f:
            data = f.read()
        for field, value in model_fields(data):
            if field == 1:
                at = dict(model_fields(value))
                pieces.append((at[1].decode(), float(np.frombuffer(at.get(2, b"\0\0\0\0"), "<f4")[0]), kinds[at.get(3, 1)]))
            elif field == 2:
                bpe = dict(model_fields(value)).get(3, 1) == 2
            elif field == 3:
                norm = dict(model_fields(value))
                if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
                    raise NotImplementedError("only identity normalizers with a dummy prefix")
        return cls(pieces, bpe)

    def merges(self, piece: int) -> list[tuple[float, int, int, int]] | None:
        """How merging builds a piece from its characters: for each merge (minus score, place), and the lengths of the
        first and the last part after it; None if merging does not end in the piece."""
        known = self.built.get(piece, 0)
        if known == 0:
            parts, known = list(self.pieces[piece][0]), []
            while len(parts) > 1:
                at, found, place = 0, [], []
                for k in range(len(parts) - 1):
                    if (i := self.ids.get(parts[k] + parts[k + 1])) is not None:
                        found.append((-self.scores[i], at, k))
                    at += len(parts[k])
                if not found:
                    break
                rank, place, k = min(found)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                known.append((rank, place, len(parts[0]), len(parts[-1])))
            known = known if len(parts) == 1 else None
            self.built[piece] = known
        return known

    def may_follow(self, last: int, piece: int) -> bool:
        if not self.bpe or (last < 0 and piece < 0):
            return True
        key = (last << 20) + piece
        known = self.follows.get(key)
        if known is None:
            known = self.stay_apart(last, piece)
            if len(self.follows) >= 2 * CACHE_UNITS:
                self.follows.clear()
            self.follows[key] = known
        return known

    def stay_apart(self, last: int, piece: int) -> bool:
        """Whether merging the joint text of two pieces builds these two: their own merges run in order of score, then
        place, and no merge across the border may come first."""
        if last < 0 or piece < 0:
            return self.merges(max(last, piece)) is not None
        left, right = self.merges(last), self.merges(piece)
        if left is None or right is None:
            return False
        a, b = self.pieces[last][0], self.pieces[piece][0]
        end, start, n, never = 1, 1, len(a), (float("inf"), 0)
        i = j = 0
        while True:
            across = self.ids.get(a[n - end :] + b[:start])
            mine = left[i][:2] if i < len(left) else never
            theirs = (right[j][0], right[j][1] + n) if j < len(right) else never
            if across is not None and (-self.scores[across], n - end) < min(mine, theirs):
                return False
            if mine is never and theirs is never:
                return True
            if mine < theirs:
                end, i = left[i][3], i + 1
            else:
                start, j = right[j][2], j + 1

    def paths(self, s: str, start: int, last: int, stop: int):
        """Best path from ``start`` to each position up to ``stop``: its score, last piece and where that begins.
        ``last`` is the piece before ``start`` (START at the beginning of a unit or text)."""
        ids, longest, ok, bpe = self.ids, self.longest, self.may_follow, self.bpe
        n = stop - start
        score: list[float | None] = [None] * (n + 1)
        piece, begin = [START] * (n + 1), [0] * (n + 1)
        score[0], piece[0] = 0.0, last
        for p in range(1, n + 1):
            best = None
            for q in range(max(0, p - longest), p):
                if score[q] is None:
                    continue
                i = ids.get(s[start + q : start + p])
                if i is None:
                    if q < p - 1 or s[start + q] in ids:
                        continue
                    i = UNKNOWN
                if ok(piece[q], i):
                    value = 0.0 if bpe else score[q] + (self.scores[i] if i >= 0 else self.unknown_score)
                    if best is None or value > best:
                        best, piece[p], begin[p] = value, i, q
                        if bpe:
                            break
            score[p] = best
        return score, piece, begin

    def spell(self, s: str, at: int, piece: int) -> list[int]:
        """Ids of a piece at a position: itself, or for an unknown character its bytes."""
        if piece >= 0:
            return [piece]
        return [self.byte_ids.get(b, self.unknown_id) for b in s[at].encode()] if self.byte_ids else [self.unknown_id]

    def trace(self, s: str, start: int, last: int, stop: int) -> list[int]:
        score, piece, begin = self.paths(s, start, last, stop)
        p, out = stop - start, []
        if score[p] is None:
            raise ValueError("no path")
        while p > 0:
            out.append(self.spell(s, start + begin[p], piece[p]))
            p = begin[p]
        return [i for x in reversed(out) for i in x]

    def crossing(self, around: str, at: int) -> list[tuple[int, int]]:
        """Boundary states: (characters before the boundary, piece) of each piece that begins before position ``at``
        and reaches it."""
        found = []
        for before in range(1, min(at, self.longest) + 1):
            for n in range(before, min(self.longest, len(around) - at + before) + 1):
                if (i := self.ids.get(around[at - before : at - before + n])) is not None:
                    found.append((before, i))
        if around[at - 1] not in self.ids:
            found.append((1, UNKNOWN))
        return found

    def past(self, before: int, piece: int) -> int:
        """Characters of a boundary state's piece behind the boundary."""
        return (len(self.pieces[piece][0]) if piece >= 0 else 1) - before


def pack(before: int, piece: int) -> int:
    return before << 32 | piece + 1


def unpack(state: int) -> tuple[int, int]:
    return state >> 32, (state & 0xFFFFFFFF) - 1


class Encoder(dict):
    """Ids of units as bytes, computed when first asked for.  In a BPE model every prefix of a unit has one path, so the
    path of a unit is that of a shorter prefix, itself kept, and one more piece."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.tails = {np.int32(i).tobytes(): i if kind == "normal" else UNKNOWN for i, (_, _, kind) in enumerate(vocabulary.pieces)}
        self.heads = {i: data for data, i in self.tails.items() if i != UNKNOWN}

    def __missing__(self, text: str) -> bytes:
        v, n = self.v, len(text)
        if not v.bpe or n > CACHED_LENGTH:
            got = array("i", v.trace(text, 0, START, n)).tobytes()
            if n > CACHED_LENGTH:
                return got
        else:
            ids, follows = v.ids, v.follows
            for q in range(max(0, n - v.longest), n):
                i = ids.get(text[q:])
                if i is None:
                    if q < n - 1:
                        continue
                    i = UNKNOWN
                before = self[text[:q]] if q else b""
                last = self.tails[before[-4:]] if q else START
                known = follows.get((last << 20) + i)
                if v.may_follow(last, i) if known is None else known:
                    break
            got = before + (self.heads[i] if i >= 0 else array("i", v.spell(text, q, i)).tobytes())
        if len(self) >= CACHE_UNITS:
            self.clear()
        self[text] = got
        return got

    def whole(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.v.units.findall(BLANK + text.replace(" ", BLANK))))

    def ends(self, left: str, body: str) -> tuple[int, int] | None:
        """First and last place in the chunk that no piece spans."""
        k = len(left[-1:])
        at = [m.start() - k for m in self.v.cut.finditer(left[-1:] + body)]
        at = [p for p in at if 0 <= p < len(body)]
        return (at[0], at[-1]) if at else None

    def matrix(self, left: str, body: str, right: str) -> dict[tuple[int, int], float]:
        """Max-plus transfer matrix of a chunk as its finite entries."""
        v, ends = self.v, self.ends(left, body)
        s, n = body + right, len(body)
        first, last = ends or (None, None)
        entries = [(pack(b, i), v.past(b, i), i) for b, i in v.crossing(left + s, len(left))] if left else [(START, 0, START)]
        exits = [(pack(b, i), n - b, i) for b, i in v.crossing(s, n)] if right else [(END, n, None)]

        def leave(start: int, piece: int) -> dict[int, float]:
            score, pieces, _ = v.paths(s, start, piece, n)
            found = {}
            for state, q, i in exits:
                if q >= start and (got := score[q - start]) is not None and (i is None or v.may_follow(pieces[q - start], i)):
                    found[state] = got + (0.0 if i is None or v.bpe else v.scores[i] if i >= 0 else v.unknown_score)
            return found

        tail = None if ends is None else leave(last, START)
        out = {}
        for state, past, piece in entries:
            if past > n:
                continue
            if tail is None:
                row = leave(past, piece)
            else:
                head = v.paths(s, past, piece, first)[0][-1] if past <= first else None
                row = {} if head is None else {x: head + y for x, y in tail.items()}
            out |= {(state, x): y for x, y in row.items()}
        return out

    def chunk(self, left: str, body: str, right: str, entry: int, exit_: int) -> bytes:
        """Ids of the pieces that begin in the chunk, between two known boundary states."""
        v, ends = self.v, self.ends(left, body)
        s, n = body + right, len(body)
        piece, at = START, 0
        if entry != START:
            before, piece = unpack(entry)
            at = v.past(before, piece)
        stop, closing = n, []
        if exit_ != END:
            before, leaving = unpack(exit_)
            stop = n - before
            closing = v.spell(s, stop, leaving)
        ints = lambda x: np.asarray(x, np.int32).tobytes()
        if ends is None or stop < ends[1] or at > ends[0]:
            return ints(v.trace(s, at, piece, stop) + closing)
        first, last = ends
        middle = b"".join(map(self.__getitem__, v.units.findall(body[first:last])))
        return ints(v.trace(s, at, piece, first)) + middle + ints(v.trace(s, last, START, stop) + closing)


def best_states(matrices: list[dict[tuple[int, int], float]], first: int = START, last: int = END) -> list[tuple[int, int]]:
    """(entry, exit) of each matrix on the best path between two states."""
    row, back = {first: 0.0}, []
    for m in matrices:
        new: dict[int, tuple[float, int]] = {}
        for (a, b), w in sorted(m.items()):
            if a in row and (b not in new or row[a] + w > new[b][0]):
                new[b] = (row[a] + w, a)
        back.append({b: a for b, (_, a) in new.items()})
        row = {b: w for b, (w, _) in new.items()}
    out, at = [], last
    for step in reversed(back):
        out.append((step[at], at))
        at = step[at]
    return out[::-1]


def product(a: dict[tuple[int, int], float], b: dict[tuple[int, int], float]) -> dict[tuple[int, int], float]:
    """Max-plus product of two transfer matrices; associative, so runs of chunks can be combined anywhere."""
    by: dict[int, list[tuple[int, float]]] = {}
    for (x, y), w in b.items():
        by.setdefault(x, []).append((y, w))
    out: dict[tuple[int, int], float] = {}
    for (x, y), w in a.items():
        for z, u in by.get(y, ()):
            if w + u > out.get((x, z), -np.inf):
                out[x, z] = w + u
    return out


def entries_of(entries, exits, weights) -> dict[tuple[int, int], float]:
    return dict(zip(zip(map(int, entries), map(int, exits), strict=True), weights, strict=True))


def path_states(matrices: DataFrame) -> DataFrame:
    """(__row, place, entry, leaving) of each matrix (__row, place, entries, exits, weights) on the best path of its row.
    Each level of the tree is written; its number of rows is that of the level below over ``FAN``."""

    def multiply(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("place")
        whole = reduce(product, map(entries_of, of["entries"], of["exits"], of["weights"]))
        keys = sorted(whole)
        return pd.DataFrame({"__row": of["__row"].iloc[:1].to_numpy(), "place": of["parent"].iloc[:1].to_numpy(), "entries": [[a for a, _ in keys]], "exits": [[b for _, b in keys]], "weights": [[whole[k] for k in keys]]})

    def divide(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("place")
        states = best_states(list(map(entries_of, of["entries"], of["exits"], of["weights"])), of["entry"].iloc[0], of["leaving"].iloc[0])
        return pd.DataFrame({"__row": of["__row"].to_numpy(), "place": of["place"].to_numpy(), "entry": [a for a, _ in states], "leaving": [b for _, b in states]})

    kind = "__row long, place long, entries array<long>, exits array<long>, weights array<double>"
    levels = [stored(matrices, "matrices")]
    while not levels[-1].where("place > 0").isEmpty():
        above = levels[-1].withColumn("parent", F.expr(f"place div {FAN}"))
        levels.append(stored(above.groupBy("__row", "parent").applyInPandas(multiply, kind), "matrices"))
    states = levels[-1].select("__row", "place", F.lit(START).cast("long").alias("entry"), F.lit(END).cast("long").alias("leaving"))
    for below in reversed(levels[:-1]):
        parents = states.withColumnRenamed("place", "parent")
        placed = below.withColumn("parent", F.expr(f"place div {FAN}")).join(parents, ["__row", "parent"])
        states = stored(placed.groupBy("__row", "parent").applyInPandas(divide, "__row long, place long, entry long, leaving long"), "states")
    return states


def split(text: str, longest: int, size: int = CHUNK) -> Iterator[tuple[int, str, str, str]]:
    s = BLANK + text.replace(" ", BLANK)
    for k, at in enumerate(range(0, len(s), size)):
        yield k, s[max(0, at - longest) : at], s[at : at + size], s[at + size : at + size + longest]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each model in a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary.load(path))
    return _encoders[path]


@contextmanager
def encoding(path: str):
    """The encoder for a task; what it kept is dropped afterwards, as idle workers stay in memory."""
    code = encoder(path)
    try:
        yield code
    finally:
        code.clear()
        code.v.follows.clear()


def ids_array(parts: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def small_batches(batches, rows: int = ROWS):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sentencepiece_encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """``df`` with the array column ``ids``.  ``model``: path of the model file, the same on all machines."""
    bound_batches(df.sparkSession)
    df = df.drop(ids)
    longest = Vocabulary.load(model).longest
    if chunk < 2 * longest:
        raise ValueError("chunks must hold two pieces at least")
    spark, is_long = df.sparkSession, F.coalesce(F.char_length(text), F.lit(0)) >= chunk
    out = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def encode(batches):
        with encoding(model) as code:
            for batch in small_batches(batches):
                parts = [code.whole(x) for x in batch[text].to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, ids_array(parts)], [*batch.schema.names, ids])

    short = df.where(~is_long).mapInArrow(encode, out)
    # in a struct, the columns are out of reach of the names used here
    long = stored(df.where(is_long).select(F.struct(*df.columns).alias("__kept"), F.monotonically_increasing_id().alias("__row")), "long-texts")
    if long.isEmpty():
        return short

    def cut(batches):
        for batch in small_batches(batches, 8):
            for row, x in zip(batch["__row"].to_pylist(), batch["__text"].to_pylist(), strict=True):
                rows = list(split(x, longest, chunk))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.string()) for i in range(4))], ["__row", "__chunk", "left", "body", "right"])

    def transfer(batches):
        code = encoder(model)
        for batch in small_batches(batches, 8):
            rows = [code.matrix(x["left"], x["body"], x["right"]) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["__row"], batch["__chunk"].cast(pa.int64()), pa.array([[k[0] for k in m] for m in rows], pa.list_(pa.int64())), pa.array([[k[1] for k in m] for m in rows], pa.list_(pa.int64())), pa.array([list(m.values()) for m in rows], pa.list_(pa.float64()))], ["__row", "place", "entries", "exits", "weights"])

    def backtrace(batches):
        with encoding(model) as code:
            for batch in small_batches(batches, 8):
                parts = [code.chunk(x["left"], x["body"], x["right"], x["entry"], x["leaving"]) for x in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["__row"], batch["__chunk"], ids_array(parts)], ["__row", "__chunk", "ids"])

    chunks = long.select("__row", F.col(f"__kept.`{text}`").alias("__text")).mapInArrow(cut, "__row long, __chunk int, left string, body string, right string").repartition("__row", "__chunk")
    states = path_states(chunks.mapInArrow(transfer, "__row long, place long, entries array<long>, exits array<long>, weights array<double>"))
    states = states.withColumn("__chunk", F.col("place").cast("int")).drop("place")
    coded = chunks.join(states, ["__row", "__chunk"]).mapInArrow(backtrace, "__row long, __chunk int, ids array<int>")
    whole = coded.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("__chunk", "ids"))).alias("parts")).select("__row", F.flatten("parts.ids").alias(ids))
    return short.unionByName(long.join(whole, "__row").select(*[F.col(f"__kept.`{c}`").alias(c) for c in df.columns], ids))


def sentencepiece_decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the string column ``text``."""
    bound_batches(df.sparkSession)
    df = df.drop(text)

    def decode(batches):
        pieces = encoder(model).v.pieces
        spelled = np.empty(len(pieces), object)
        spelled[:] = [bytes([int(x[3:5], 16)]) if kind == "byte" else b"" if kind == "control" else b" \xe2\x81\x87 " if kind == "unknown" else x.replace(BLANK, " ").encode() for x, _, kind in pieces]
        for batch in small_batches(batches):
            column = batch[ids]
            flat, at = column.flatten().to_numpy(zero_copy_only=False), 0
            out = []
            for n in [x or 0 for x in pa.compute.list_value_length(column).to_pylist()]:
                out.append(b"".join(spelled[flat[at : at + n]].tolist()).decode("utf-8", "replace").removeprefix(" "))
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])

    return df.mapInArrow(decode, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def op1_sentencepiece(spark, sf_dir) -> DataFrame:
    model = default_model()
    coded = sentencepiece_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = sentencepiece_decode(coded, model)
    return back.select("doc_id", F.size("ids").alias("n_ids"), F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))
