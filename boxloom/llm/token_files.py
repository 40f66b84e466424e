"""Token ids in Arrow files of fixed-size lists: random access to equal-length sequences and their masks without copies.

Texts are encoded, an end id is appended to each, and the ids of all documents are written in ascending order of the
key: each task writes one range of keys to a file pair.  ``.seq.arrow`` holds batches of ``input_ids`` (fixed-size
lists of ``length`` unsigned ids, 16 bits wide if the vocabulary allows) and ``mask`` (as many booleans, false in the
padding of a file's last sequence); ``.doc.arrow`` holds a row per document: key, first id in the file, ids.  The
manifest, a row per file pair, adds the number of ids in all files before.  :func:`sequence` reads one sequence of a
memory-mapped file.

Encoding is cached twice: by piece, what follows a space up to the next, and for pieces not seen before by unit, a word or
a run of signs with the white space before it: a byte-level BPE never merges across such a place.  A text with a space
before white space or its end, where the library may cut elsewhere, is cut into units alone.  Every unit is encoded by
the tokenizers library.  A text that holds the string of a special token
is given to the library whole, which turns that string into its id, as it does by default.

Defined results: a null text is empty, so its only id is the end id; rows without a key come first; rows with equal
keys are ordered by a hash of their text, equal rows follow one another; a text of any length is encoded whole by one
task and its ids may run over many sequences; an empty table gives no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, stored, table
from .files import make_folder, reading, task_file, writing

LENGTH = 2_048
SEQUENCES = 64  # in a batch of a file
CACHE_UNITS = 200_000
CACHE_PIECES = 1_200_000
CACHED_LENGTH = 64
END_ID = 2  # fixed by the query's contract


def byte_characters() -> dict[int, str]:
    """The character by which a byte-level BPE writes each byte: printable ones stand for themselves, the others for
    those from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class TextEncoder(dict):
    """The library's ids of a text, by way of units: cut after white space and letters, where the library's own
    splitting cuts too.  Ids of units are kept as bytes, computed when first asked for."""

    #: White space as the tokenizers library has it: Python's, but not the four separators U+001C to U+001F.
    units = re.compile(r"[^\S\x1c-\x1f]*(?:(?:[^\w\s]|[\d_\x1c-\x1f])*+[^\W\d_]+|(?:[^\w\s]|[\d_\x1c-\x1f])+)|[^\S\x1c-\x1f]+")
    #: A space where a cut before it may differ from the library's.
    loose = re.compile(r" (?:\s|\Z)")
    #: Signs that are a unit of their own after a word.
    signs = frozenset(".,;:!?)")
    #: Units that the library takes as one word, so that its model alone gives the ids.
    word = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        strings = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(strings)) if strings else None
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.space, self.pieces = self.characters[0x20], Pieces(self)

    def encoded(self, unit: str) -> bytes:
        if self.word.fullmatch(unit):
            ids = [x.id for x in self.model.tokenize(unit.encode().decode("latin-1").translate(self.characters))]
        else:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def __missing__(self, unit: str) -> bytes:
        got = self.encoded(unit)
        if len(unit) <= CACHED_LENGTH:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = got
        return got

    def text(self, text: str) -> bytes:
        """The ids of a text as integers of ``dtype``."""
        if self.added and self.added.search(text):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.loose.search(text):
            return self.by_units(text)
        first, *rest = text.split(" ")
        return self.by_units(first) + b"".join(map(self.pieces.__getitem__, rest))

    def by_units(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.units.findall(text)))


class Pieces(dict):
    """Ids of a space and the piece after it.  Words are kept here only, other parts of pieces as units of the encoder;
    pieces over a line end hardly come twice and are not kept."""

    def __init__(self, encoder: TextEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        code = self.encoder
        if piece.isalpha():
            if piece.isascii():
                got = array(code.code, [x.id for x in code.model.tokenize(code.space + piece)]).tobytes()
            else:
                got = code.encoded(" " + piece)
        elif piece[-1:] in code.signs and piece[:-1].isalpha():
            got = self[piece[:-1]] + code[piece[-1]]
        else:
            first, *rest = code.units.findall(" " + piece)
            head = self[first[1:]] if rest and first[1:].isalpha() else code[first]
            got = b"".join([head, *map(code.__getitem__, rest)])
            if "\n" in piece:
                return got
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = got
        return got


_encoders: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in batches of ``SEQUENCES``, so that a sequence's batch follows
    from its number; only a file's last batch may be smaller.  Holds less than a batch."""

    def __init__(self, out, dtype: np.dtype, length: int):
        self.length, self.dtype = length, dtype
        self.type = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(self.type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(out, self.schema)
        self.held, self.n_held, self.total = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        self.total += len(ids) // self.dtype.itemsize
        if self.n_held >= self.length * SEQUENCES:
            self.flush(self.n_held // (self.length * SEQUENCES) * SEQUENCES)

    def flush(self, sequences: int) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        cut = min(len(flat), sequences * self.length)
        for at in range(0, sequences, SEQUENCES):
            n = min(SEQUENCES, sequences - at) * self.length
            part = flat[at * self.length : min(cut, at * self.length + n)]
            mask = np.arange(n) < len(part)
            ids = np.concatenate([part, np.zeros(n - len(part), self.dtype)])
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        rest = flat[cut:]
        self.held, self.n_held = [rest.tobytes()], len(rest)

    def close(self) -> None:
        if self.n_held:
            self.flush(-(-self.n_held // self.length))
        self.writer.close()


def write_token_files(df: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Writes the files and returns the manifest: part, seq, doc (paths), n_docs, n_ids, start."""
    bound_batches(df.sparkSession)
    make_folder(folder)
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the last column only tells equal rows apart, so that a key with many rows is dealt to several files
    order = [F.col("key").asc_nulls_first(), "hash", "row"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})

    def write(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        code = text_encoder(tokenizer)
        end = np.asarray([end_id], code.dtype).tobytes()
        seq, doc = task_file(folder, ".seq.arrow"), task_file(folder, ".doc.arrow")
        schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64())])
        docs = 0
        with writing(seq) as seq_out, writing(doc) as doc_out, pa.ipc.new_file(doc_out, schema) as index:
            sequences = SequenceWriter(seq_out, code.dtype, length)
            batch = first
            while batch is not None:
                starts, counts = [], []
                for at in range(0, batch.num_rows, 256):
                    for ids in map(code.text, batch["text"].slice(at, 256).to_pylist()):
                        starts.append(sequences.total)
                        sequences.add(ids + end)
                        counts.append(sequences.total - starts[-1])
                index.write_batch(pa.RecordBatch.from_arrays([batch["key"], pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=schema))
                docs += batch.num_rows
                batch = next((b for b in batches if b.num_rows), None)
            sequences.close()
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "seq": seq, "doc": doc, "n_docs": docs, "n_ids": sequences.total}])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = stored(dealt.select("key", "text").mapInArrow(write, "part long, seq string, doc string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def sequence(path: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence; the ids are a view into the mapped file."""
    with reading(path) as source:
        file = pa.ipc.open_file(source)
        batch = file.get_batch(number // SEQUENCES)
        at, length = number % SEQUENCES, batch.schema.field("input_ids").type.list_size
        ids = batch["input_ids"].values.to_numpy()[at * length : (at + 1) * length]
        return ids, batch["mask"].values.slice(at * length, length).to_numpy(zero_copy_only=False)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: key, start over all files, n_ids, ids_crc32 of the ids as 32-bit integers."""

    def read(batches):
        for batch in batches:
            for one in batch.to_pylist():
                with reading(one["seq"]) as seq_in, reading(one["doc"]) as doc_in:
                    sequences, index = pa.ipc.open_file(seq_in), pa.ipc.open_file(doc_in)
                    at, ids, base = -1, np.empty(0, np.uint32), 0
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        sums = []
                        for start, n in zip(docs["start"].to_pylist(), docs["n_ids"].to_pylist(), strict=True):
                            crc = 0
                            while n:
                                while start >= base + len(ids):
                                    base, at = base + len(ids), at + 1
                                    ids = sequences.get_batch(at)["input_ids"].values.to_numpy()
                                part = ids[start - base : start - base + n]
                                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                                start, n = start + len(part), n - len(part)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays([docs["key"], pa.compute.add(docs["start"], one["start"]), docs["n_ids"], pa.array(sums, pa.int64())], ["key", "start", "n_ids", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.select("seq", "doc", "start").repartition(files).mapInArrow(read, "key long, start long, n_ids long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_files(spark, sf_dir) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), default_tokenizer(), fresh_path(spark, "token-files"))
    return read_token_files(manifest).select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
