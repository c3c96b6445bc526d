"""Quality classifier by compression.

Two zstandard dictionaries are trained, from labelled good and bad texts. A text that
compresses better with the good dictionary than with the bad one resembles good texts: the
difference of its compressed sizes, divided by its size, is the evidence. A logistic
function of the evidence, and of how much the text compresses by itself (which finds
repetition), is fitted on other labelled texts and gives the score.

Every whole text is scored, in pieces of ``PIECE`` bytes: a long text would otherwise soon
be its own dictionary. Only the fit uses a sample: at most ``max_rows`` labelled rows of
each class, those with the smallest hash of their id, of which half train the dictionaries
and half the calibration. Labels, language, source and id are no inputs of a score.

Defined results: empty and null texts score 0; rows without a label, or with a null one,
are not learned from; without labels of both classes every score is 0.5; repeated rows are
scored alike. Further columns are kept; ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_ROWS = 3000
DICT_BYTES = 112 << 10
PIECE = 4096
LEVEL = 3
THRESHOLD = 0.3
FEATURES = ("evidence", "redundancy", "size")


class QualityModel(NamedTuple):
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _compressor(blob: bytes | None):
    flags = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not blob:
        return zstandard.ZstdCompressor(level=LEVEL, **flags)
    trained = zstandard.ZstdCompressionDict(blob)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=trained, **flags)


def features(texts: list[bytes], tools) -> np.ndarray:
    """Evidence for good, redundancy and log size of each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        sizes = [0, 0, 0]
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            for k, tool in enumerate(tools):
                sizes[k] += len(tool.compress(piece))
        n = len(text)
        out[i] = (sizes[1] - sizes[0]) / n, sizes[2] / n, np.log(n)
    return out


def _design(x: np.ndarray) -> np.ndarray:
    """Terms of the calibration: redundancy counts for what it falls below that of prose."""
    low = np.maximum(0, 0.3 - x[:, 1])
    return np.column_stack([np.ones(len(x)), x[:, 0] * 10, low * 10, 1 / np.maximum(1, x[:, 2])])


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a slight penalty."""
    z, w = _design(x), np.zeros(4)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(4)
        step = np.linalg.solve(hess, z.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def scores(texts: list[bytes], model: QualityModel, tools) -> np.ndarray:
    value = _design(features(texts, tools)) @ np.array(model.weights)
    return np.where([len(t) > 0 for t in texts], 1 / (1 + np.exp(-np.clip(value, -30, 30))), 0.0)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, seed: int = 1) -> QualityModel | None:
    """Fit on at most ``max_rows`` labelled rows per class that are not held out.

    The sampled rows, and nothing else, come to the driver: their ids are picked from the
    labels alone, and the documents are filtered by that bounded list.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    picked = None
    for label in (0, 1):
        some = (
            usable.where(F.col("quality") == label).select("doc_id", F.lit(label).alias("_label")).distinct()
            .orderBy(order, "doc_id").limit(max_rows)
        )
        picked = some if picked is None else picked.unionByName(some)
    rows = (
        docs.select("doc_id", "text").where(F.length("text") > 0)
        .join(F.broadcast(picked), "doc_id")
        .select("doc_id", "_label", F.encode("text", "UTF-8").alias("body"))
        .collect()
    )
    rows.sort(key=lambda r: (r.doc_id, bytes(r.body)))
    halves = [[(bytes(r.body), r._label) for r in rows[k::2]] for k in (0, 1)]
    if any(len([1 for _, y in half if y == label]) < 1 for half in halves for label in (0, 1)):
        return None
    blobs = [_dictionary([t for t, y in halves[0] if y == label]) for label in (1, 0)]
    tools = [_compressor(b) for b in (*blobs, None)]
    x = features([t for t, _ in halves[1]], tools)
    return QualityModel(*blobs, _fit(x, np.array([y for _, y in halves[1]], float)))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of a few texts, which cannot train one, their own bytes."""
    pieces = [t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
    if sum(map(len, pieces)) > 100 * 1024 and len(pieces) >= 50:
        try:
            return zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(pieces)[-DICT_BYTES:]


def score_quality(docs: DataFrame, model: QualityModel | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    docs = docs.drop("score", "predicted")
    if model is None:
        scored = docs.withColumn("score", F.lit(0.5))
    else:
        schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tools = [_compressor(b) for b in (model.good, model.bad, None)]
            for batch in batches:
                values = scores(_bytes(batch.column("text")), model, tools)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(values)], names=[*batch.schema.names, "score"]
                )

        scored = docs.mapInArrow(run, schema)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
