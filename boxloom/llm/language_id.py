"""Language identification by a string kernel.

The kernel of two texts counts the byte n-grams of 1 to 3 bytes that both hold (presence, blended spectrum),
normalized by the sizes of both sets; n-grams outside the landmarks' are left out.  Landmarks are training texts; the
Nyström map turns kernel values with them into features, and one-versus-rest kernel ridge regression fits one output
per language.  The product of landmark matrix and coefficients is one weight per n-gram and language, so a batch of
texts is scored by one product of its presence matrix with the weights.

Only the fit is on a sample: at most ``ROWS`` training rows for each language, chosen by a hash of id and text, and
``ALL_ROWS`` for all languages, every one of which is learned.  Every text is scored whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be
learned.  Rows without a language teach nothing; a row without an id is never learned from, one that
is repeated is learned from once.  Ties go to the first language by name.
Repeated rows are each scored; an empty table gives an empty result; other columns are kept, those with the names of
outputs are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, table

#: Training rows and landmarks of each language.  With many languages the sums are bounded, at one of each at least.
ROWS, LANDMARKS = 400, 64
ALL_ROWS, ALL_LANDMARKS = 80_000, 2_048
COLUMNS = 1 << 14  # n-grams of the presence matrices that the fit holds
RIDGE = 1e-3
#: Sharpness of the softmax that turns ridge outputs into a score.
SHARPNESS = 5.0
WINDOW = 1 << 20  # bytes of a text that are looked at together
BLOCK = 128  # texts in a presence matrix
ORDERS = (1, 2, 3)
#: Characters among which all letters are; ``str.isalpha`` tells these (Unicode category L) from other numbers.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def windows(text: str):
    """The text's bytes in overlapping windows, so that every n-gram is in one."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    for at in range(0, max(1, len(data)), WINDOW):
        yield data[at : at + WINDOW + max(ORDERS) - 1].astype(np.int32)


def codes(data: np.ndarray, order: int) -> np.ndarray:
    n = max(0, len(data) - order + 1)
    out = np.zeros(n, np.int32)
    for k in range(order):
        out |= data[k : k + n] << 8 * k
    return out


def ngrams(text: str) -> np.ndarray:
    """Distinct n-grams as ``order << 24 | bytes``."""
    return np.unique(np.concatenate([np.unique(codes(data, n)) | n << 24 for data in windows(text) for n in ORDERS]))


class KernelModel:
    """``universe``: n-grams of the landmarks; ``weights``: one row per n-gram, one column per language."""

    def __init__(self, universe: np.ndarray, weights: np.ndarray, languages: list[str]):
        self.universe, self.weights, self.languages = universe, weights, languages
        self.tables = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    @classmethod
    def fit(cls, sets: list[np.ndarray], names: list[str]) -> KernelModel:
        languages = sorted(set(names))
        labels = np.array([languages.index(x) for x in names], int)
        each = max(1, min(LANDMARKS, ALL_LANDMARKS // max(1, len(languages))))
        marks = np.concatenate([np.flatnonzero(labels == c)[:each] for c in range(len(languages))]) if languages else np.empty(0, int)
        universe = np.unique(np.concatenate([sets[i] for i in marks])) if len(marks) else np.empty(0, np.int32)
        if not len(universe):
            return cls(universe, np.zeros((0, 0), np.float32), [])
        columns = [np.searchsorted(universe, np.intersect1d(x, universe, assume_unique=True)) for x in sets]
        norms = np.sqrt(np.maximum([len(x) for x in columns], 1))

        def presence(part: list[int], first: int) -> np.ndarray:
            """Rows of the normalized presence matrix, ``COLUMNS`` columns from the given one."""
            rows = np.zeros((len(part), min(COLUMNS, len(universe) - first)), np.float32)
            for row, i in zip(rows, part, strict=True):
                at = columns[i]
                row[at[np.searchsorted(at, first) : np.searchsorted(at, first + COLUMNS)] - first] = 1 / norms[i]
            return rows

        kernel = np.zeros((len(sets), len(marks)))  # of all rows with the landmarks
        for first in range(0, len(universe), COLUMNS):
            landmarks = presence(marks, first)
            for at in range(0, len(sets), BLOCK):
                part = range(at, min(at + BLOCK, len(sets)))
                kernel[part.start : part.stop] += presence(part, first) @ landmarks.T
        value, vector = np.linalg.eigh(kernel[marks])
        good = value > 1e-6 * value[-1]
        root = vector[:, good] / np.sqrt(value[good])  # inverse square root of the landmarks' kernel matrix
        features = kernel @ root
        target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
        share = np.bincount(labels, minlength=len(languages))
        balance = (len(labels) / share)[labels][:, None]
        fit = np.linalg.solve(features.T @ (features * balance) + RIDGE * len(labels) * np.eye(features.shape[1]), features.T @ (target * balance))
        alpha = root @ fit
        weights = [presence(marks, first).T @ alpha for first in range(0, len(universe), COLUMNS)]
        return cls(universe, np.concatenate(weights).astype(np.float32), languages)

    def lookups(self) -> dict[int, np.ndarray]:
        """For each order a table from n-gram to column; column 0 takes n-grams outside the universe."""
        if self.tables is None:
            self.tables = {}
            for n in ORDERS:
                at = np.flatnonzero(self.universe >> 24 == n)
                self.tables[n] = np.zeros(1 << 8 * n, np.int32)
                self.tables[n][self.universe[at] & 0xFFFFFF] = at + 1
        return self.tables

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, score
        tables = self.lookups()
        known = [i for i, x in enumerate(texts) if x and has_letter(x)]
        for at in range(0, len(known), BLOCK):
            block = known[at : at + BLOCK]
            present = np.zeros((len(block), len(self.universe) + 1), bool)
            for row, i in zip(present, block, strict=True):
                for data in windows(texts[i]):
                    for n in ORDERS:
                        row[tables[n][codes(data, n)]] = True
            rows = present[:, 1:].astype(np.float32)
            out = (rows @ self.weights) / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
            power = np.exp(SHARPNESS * (out - out.max(1, keepdims=True)))
            best = out.argmax(1)
            score[block] = (power / power.sum(1, keepdims=True))[np.arange(len(block)), best]
            for i, c in zip(block, best, strict=True):
                names[i] = self.languages[c]
        return names, score


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS) -> KernelModel:
    """Fits a model of all languages on at most ``rows`` rows of each."""
    bound_batches(df.sparkSession)
    # of key and text: however often an id comes, its texts are chosen each for itself
    buckets = 1 << 40
    usable = F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()
    labelled = df.where(usable).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(key, text), F.lit(buckets)).alias("hash"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("hash").alias("different")).collect()  # a row per language
    if not counts:
        return KernelModel.fit([], [])
    rows = max(1, min(rows, ALL_ROWS // len(counts)))
    # a hash keeps a few more different rows than wanted of each language, then the first of them by hash are taken
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, (1.5 * rows + 50) / max(1, r["different"])) * buckets))])
    sample = labelled.where(F.col("hash") < F.try_element_at(share, F.col("lang"))).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    sample = sample.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("place") <= rows)

    def extract(batches):
        for batch in batches:
            grams = [ngrams(x).astype("<i4").tobytes() for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["hash"], pa.array(grams, pa.binary())], ["lang", "hash", "grams"])

    found = sample.select("text", "lang", "hash").mapInArrow(extract, "lang string, hash long, grams binary").collect()  # at most ``rows`` of each language
    chosen = sorted(found, key=lambda r: (r["lang"], r["hash"]))
    return KernelModel.fit([np.frombuffer(r["grams"], "<i4").astype(np.int32) for r in chosen], [r["lang"] for r in chosen])


def predict(df: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score."""
    bound_batches(df.sparkSession)
    df = df.drop("lang_pred", "score")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            names, score = sent.value.predict(batch[text].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])
        sent.value.tables = None  # idle workers stay in memory

    return df.mapInArrow(judge, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op8_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
