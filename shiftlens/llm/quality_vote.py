"""Quality scores by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document is counted by its words and by the shapes of its words (case, last sign, length, whether the
word is repeated, pairs of shapes). Weighted by document frequencies over the whole table, a bounded
sample of labelled documents gives the latent axes (a truncated singular value decomposition). Labelled
vectors go to every task; each document is compared with all of them, block by block, and its nearest
ones vote by their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.llm.batches import small_batches
from shiftlens.llm.fingerprints import Words, mix, slices, words_of

SHAPES, PAIRS, WORDS = 512, 1024, 512
TERMS = SHAPES + PAIRS + WORDS
#: Labelled documents that are learned from, the latent axes, and the neighbours that vote.
SAMPLE = 6000
AXES = 64
NEIGHBOURS = 40
#: Similarities are raised to this power before they weigh a vote.
SHARPNESS = 8


def _shapes(words: Words) -> np.ndarray:
    """A number for each word's shape."""
    data = words.data

    def inside(low: int, high: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum((data >= low) & (data <= high), dtype=np.int32)])
        return total[words.ends] - total[words.starts]

    length = words.ends - words.starts
    upper, lower, digits, other = inside(65, 90), inside(97, 122), inside(48, 57), inside(128, 255)
    letters = upper + lower + other
    case = np.select([letters == 0, lower + other == 0, upper == 0, upper == 1], [0, 1, 2, 3], 4)
    signs = np.minimum(length - letters - digits, 4)
    last = data[words.ends - 1].astype(np.int64)
    last = np.where(((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)) | (last >= 128), 0, np.where((last >= 48) & (last <= 57), 1, last))
    size = np.searchsorted([2, 3, 5, 9, 15, 30], length, "right")
    again = np.zeros(len(length), np.int64)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    return ((((case * 5 + signs) * 256 + last) * 8 + size) * 2 + again) * 2 + (digits > 0)


def term_counts(words: Words) -> np.ndarray:
    """A row per document: how often each term occurs, damped by a logarithm."""
    rows = len(words.first) - 1
    out = np.zeros((rows, TERMS), np.float32)
    if not len(words.hashes):
        return out
    shape = mix(_shapes(words).astype(np.uint64) + np.uint64(1))
    doc = np.repeat(np.arange(rows), np.diff(words.first))
    pair = mix(shape[:-1] * np.uint64(3) + shape[1:])
    same = doc[1:] == doc[:-1]
    for at, term, who in (
        (0, shape % np.uint64(SHAPES), doc),
        (SHAPES, (pair % np.uint64(PAIRS))[same], doc[1:][same]),
        (SHAPES + PAIRS, words.hashes % np.uint64(WORDS), doc),
    ):
        width = SHAPES if at == 0 else PAIRS if at == SHAPES else WORDS
        flat = np.bincount(who * width + term.astype(np.int64), minlength=rows * width)
        out[:, at : at + width] = flat.reshape(rows, width)
    return np.log1p(out)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            for low in range(0, part.num_rows, 1024):
                piece = part.slice(low, 1024)
                yield piece, term_counts(words_of(piece.column("text")))


class Model:
    """Weights of terms, latent axes, and the labelled vectors."""

    def __init__(self, weight: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float):
        self.weight, self.axes, self.vectors, self.labels, self.prior = weight, axes, vectors, labels, prior

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero for a document without words."""
        x = counts * self.weight
        x = x @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled vectors.

        The share of all labelled documents counts as one faint vote, so a document without words
        gets just that.
        """
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = self.place(counts) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS
        vote = (weight * self.labels[top]).sum(1)
        return np.clip((vote + 1e-3 * self.prior) / (weight.sum(1) + 1e-3), 0, 1)


def latent_axes(x: np.ndarray, axes: int = AXES, rounds: int = 5) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    axes = min(axes, *x.shape) if x.size else 0
    if not axes:
        return np.zeros((x.shape[1], 1), np.float32)
    y = np.random.default_rng(2).normal(size=(x.shape[1], min(axes + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        y, _ = np.linalg.qr(x.T @ (x @ y))
    _, _, v = np.linalg.svd(x @ y, full_matrices=False)
    return np.ascontiguousarray((y @ v.T)[:, :axes].astype(np.float32))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, over the whole table; ``TERMS`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(TERMS + 1, np.int64), 0
        for piece, counts in _terms(batches):
            total[:TERMS] += (counts > 0).sum(0)
            rows += piece.num_rows
        total[TERMS] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(total)], ["term", "n"])

    with small_batches(docs.sparkSession):
        sums = docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(TERMS + 1, np.int64)
    for row in sums:
        found[row["term"]] = row["n"]
    return found[:TERMS], int(found[TERMS])


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from up to ``sample`` rows of ``labelled`` (``doc_id, label``), chosen by a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, counts in _terms(batches):
            packs = [zlib.compress(c.astype(np.float16).tobytes(), 1) for c in counts]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array(packs, pa.binary())], ["doc_id", "label", "terms"])

    frequency, rows = document_frequencies(docs)
    weight = (np.log((1 + rows) / (1 + frequency)) + 1).astype(np.float32)
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)  # at most ``sample`` narrow rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        packed = texts.select("doc_id", F.col("label").cast("double").alias("label"), "text").mapInArrow(run, f"doc_id {kind}, label double, terms binary")
        each = packed.groupBy("doc_id", "label").agg(F.min("terms").alias("terms"))  # one row of an id, so at most ``sample``
        found = each.collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["terms"])))
    labels = np.array([r["label"] for r in found])
    prior = float(labels.mean()) if len(labels) else 0.5
    x = np.zeros((len(found), TERMS), np.float32)
    for i, r in enumerate(found):
        x[i] = np.frombuffer(zlib.decompress(bytes(r["terms"])), np.float16)
    del found
    scaled = x * weight
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-12)
    axes = latent_axes(scaled)
    del scaled
    model = Model(weight, axes, np.zeros((0, axes.shape[1]), np.float32), labels, prior)
    model.vectors = model.place(x)
    return model


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The rows that are not learned from: a fifth, by the checksum of the id's text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1); rows with a null in either are not learned from,
    nor are held-out ones; of rows that repeat an id one text is. Only the text is scored: an empty or null one gets the share of label 1.
    Rows that repeat an id keep a score of their own. Without any label every score is 0.5. Columns of
    ``docs`` called like a new one are replaced.
    """
    spark = docs.sparkSession
    labelled = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(docs.select("doc_id", "text"), labelled.where(~held_out()).distinct(), sample)
    shared = spark.sparkContext.broadcast(model)  # ``sample`` vectors at most
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    base = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, counts in _terms(batches):
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(shared.value.score(counts), pa.float64())], [*piece.schema.names, "score"])

    layout = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])
    return (
        base.mapInArrow(run, layout)
        .withColumn("held_out", held_out())
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
