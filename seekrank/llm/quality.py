"""Quality classifier by compression: one zstandard dictionary per class.

Pieces of good and of bad labelled texts build two dictionaries. Every text is
compressed whole, piece by piece, with both; the normalised difference of the
sizes, (bad - good) / (bad + good), becomes a probability through a logistic
curve fitted on labelled texts that the dictionaries have not seen.

The fit uses a bounded sample of the labelled rows (``max_docs`` rows and
``max_pieces`` pieces a class, lowest hash first); the score reads every text
whole and nothing but the text.

Rules for odd input: a null or empty text gets the score of difference 0; rows
without a label or a doc_id do not train; several labels for one doc_id: the
lowest holds; a class without training texts gives the share of good labels as
every score (0.5 without any label); repeated rows are scored each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekrank.llm import common


@dataclass(frozen=True)
class Quality:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    piece: int
    level: int

    def sizes(self) -> "Sizes":
        return Sizes(self)

    def score(self, diff: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * diff + self.intercept, -500, 500)))


class Sizes:
    """The two compressors, ready in one Python worker."""

    def __init__(self, model: Quality):
        self.piece = model.piece
        self.pair = []
        for raw in (model.good, model.bad):
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            d.precompute_compress(level=model.level)
            self.pair.append(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_checksum=False, write_content_size=False))

    def diff(self, text: str | None) -> float:
        raw = (text or "").encode()
        if not raw:
            return 0.0
        good, bad = (sum(len(c.compress(raw[i:i + self.piece])) for i in range(0, len(raw), self.piece)) for c in self.pair)
        return (bad - good) / (bad + good)


def _pieces(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            out, of = [], []
            for t, q in zip(b.column("text").to_pylist(), b.column("quality").to_pylist()):
                raw = (t or "").encode()
                own = [raw[i:i + piece] for i in range(0, len(raw), piece)]
                out += own
                of += [q] * len(own)
            yield pa.record_batch({"quality": pa.array(of, pa.int32()), "piece": pa.array(out, pa.binary())})
    return run


def _diffs(model: Quality):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizes()
        for b in common.slices(batches):
            diff = pa.array([sizes.diff(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(b.schema.names, b.columns) if n != "text"), diff],
                                             [*(n for n in b.schema.names if n != "text"), "diff"])
    return run


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the pieces themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a slight pull towards 0 for separable data."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w, pull = np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (y - p) - pull @ w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_docs: int = 12_000, max_pieces: int = 20_000,
        piece: int = 512, dict_bytes: int = 1 << 18, level: int = 3) -> Quality:
    """Fit on the rows of ``labels`` (doc_id, quality 0/1) for which ``train`` holds.

    Two of three sampled rows build the dictionaries, the third fits the curve.
    """
    rows = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & train)
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
            .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")
    texts = common.staged(texts.select("doc_id", "text", "quality", (F.pmod("h", F.lit(3)) == 0).alias("fits")), "labelled")
    pieces = (texts.filter(~F.col("fits")).select("text", "quality").mapInArrow(_pieces(piece), "quality int, piece binary")
              .withColumn("h", F.xxhash64("piece")))
    parts = [[bytes(r[0]) for r in pieces.filter(F.col("quality") == q).orderBy("h", "piece").limit(max_pieces).select("piece").collect()]
             for q in (1, 0)]
    if not all(parts):
        share = texts.agg(F.avg("quality")).first()[0]
        share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        return Quality(b"good", b"bad", 0.0, float(np.log(share / (1 - share))), piece, level)
    raw = Quality(*(_dictionary(p, dict_bytes) for p in parts), 1.0, 0.0, piece, level)
    seen = (texts.filter("fits").select("doc_id", "text", "quality")
            .mapInArrow(_diffs(raw), "doc_id long, quality int, diff double").select("quality", "diff").toPandas())
    x, y = seen["diff"].to_numpy(float), seen["quality"].to_numpy(float)
    slope, intercept = _logistic(x, y) if len(set(y)) == 2 else (1.0, 0.0)
    return Quality(raw.good, raw.bad, slope, intercept, piece, level)


def score(docs: DataFrame, model: Quality, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``; a map over the input, no shuffle."""
    cols = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _diffs(model)(batches):
            value = model.score(b.column("diff").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(value)], [*b.schema.names[:-1], "score"])
    return cols.mapInArrow(run, f"{schema}, score double")


def keep_good(docs: DataFrame, model: Quality, least: float) -> DataFrame:
    """The rows of ``docs`` (any columns, ``text`` among them) that score ``least`` or more; a map over the input."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizes()
        for b in common.slices(batches):
            value = model.score(np.array([sizes.diff(t) for t in b.column(place).to_pylist()]))
            yield b.filter(pa.array(value >= least))
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The rows that never train: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "doc_id").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
