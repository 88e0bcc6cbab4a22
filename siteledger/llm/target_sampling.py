"""Importance resampling towards a target distribution, drawn by a bracketed cutoff.

Hashed n-gram counts of raw and target texts give every bucket a gain, the log ratio of the
two smoothed models. The gains are one array; a document's weight is the floored mean of
the entries at its features. Gumbel noise from a hash of the id makes the largest scores
a sample in proportion to the weights.

The cutoff of that sample is found without sorting the scores: a quantile sketch proposes a
bracket around it, exact counts of what lies over and within the bracket prove it or choose
a wider one, and only what lies within the bracket is sorted. Ranks are counted per score.
"""

from __future__ import annotations

import hashlib
import math
import sys
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..operators.ranking import positions_of_copies
from . import byte_words
from .common import by_value, narrow, shared_folder, small_batches

by_value(sys.modules[__name__])
by_value(byte_words)

BUCKETS = 10_000
SEED = 2024
#: Documents with fewer words are scored but never drawn.
MIN_WORDS = 20
PERCENT = 10
#: The sketch's ranks are off by one part in so many at most.
SKETCH = 2_000
#: Half widths of the brackets that are tried, as shares of all rows; the last one holds everything.
WIDTHS = (2 / SKETCH, 8 / SKETCH, 64 / SKETCH, 1.0)
#: Features whose buckets a task remembers before it starts anew.
REMEMBERED = 1 << 18


class _Buckets(dict):
    """Bucket of a feature, remembered for the frequent ones."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.n
        return found


def _features(data: bytes | None, longest: int, memo: _Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the runs that end in them) per stretch of a text."""
    carried: list[bytes] = []
    for words in byte_words.word_lists(data):
        every = carried + words
        ids = [memo[w] for w in words]
        for n in range(2, longest + 1):
            starts = range(max(0, len(carried) - n + 1), len(every) - n + 1)
            ids += [memo[b" ".join(every[s : s + n])] for s in starts]
        yield len(words), np.array(ids, dtype=np.int64)
        carried = every[len(every) - longest + 1 :] if longest > 1 else []


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1, text_col: str = "text") -> DataFrame:
    """(bucket, n): occurrences of the hashed features over all texts; null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo = np.zeros(buckets, dtype=np.int64), _Buckets(buckets)
        for batch in batches:
            for data in batch.column("text").cast(pa.binary()).to_pylist():
                for _, ids in _features(data, longest, memo):
                    total += np.bincount(ids, minlength=buckets)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    small_batches(texts.sparkSession)
    each = narrow(texts, text=text_col).mapInArrow(count, "bucket bigint, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths; the two tables hold one row per used bucket."""
    s, t = (dict(counts.collect()) for counts in (raw, target))
    s_all, t_all = sum(s.values()), sum(t.values())
    above, below = float(s_all + buckets), float(t_all + buckets)
    each = [math.floor(1000 * math.log((t.get(b, 0) + 1) * above / ((s.get(b, 0) + 1) * below))) for b in range(buckets)]
    return np.array(each, dtype=np.int64)


def _noise(seed: int, doc_id: object) -> int:
    """Gumbel noise in thousandths; a null id counts as the text ``null``."""
    name = "null" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(
    docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, kept_0.., n_words, n_features, weight, score) of every row; ``keep`` names columns to carry along."""
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets(buckets)
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                n_words = n = total = 0
                for words, ids in _features(data, longest, memo):
                    n_words, n, total = n_words + words, n + len(ids), total + int(gain[ids].sum())
                weight = total // n if n else 0
                for column, value in zip(out, (n_words, n, weight, weight + _noise(seed, doc_id))):
                    column.append(value)
            carried = [c for c in batch.schema.names if c != "text"]
            arrays = [batch.column(c) for c in carried] + [pa.array(c, pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(arrays, [*carried, "n_words", "n_features", "weight", "score"])

    small_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, **{f"kept_{n}": c for n, c in enumerate(keep)}, text=text_col)
    fields = [f for f in rows.schema.fields if f.name != "text"]
    numbers = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")]
    return rows.mapInArrow(score, T.StructType([*fields, *numbers]))


def cutoff(scores: DataFrame, k: int, n: int) -> int | None:
    """The k-th largest of the n values of ``score`` (whole numbers), None for k = 0."""
    if k <= 0:
        return None
    middle = 1 - k / n
    edges = [p for width in WIDTHS for p in (max(0.0, middle - width), min(1.0, middle + width))]
    found = scores.agg(F.percentile_approx("score", edges, SKETCH).alias("q")).collect()[0]["q"]
    brackets = list(zip(found[::2], found[1::2]))
    counted = [c for low, high in brackets for c in (F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high)))]
    exact = list(scores.agg(*counted).collect()[0])
    over, (low, high) = next((o, b) for o, inside, b in zip(exact[::2], exact[1::2], brackets) if o < k <= o + inside)
    # Scores are whole numbers in a narrow range, so a bracket has few distinct ones.
    each = scores.where(F.col("score").between(low, high)).groupBy("score").agg(F.count("*").alias("n"))
    until = F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return each.select("score", until.alias("until")).where(F.col("until") >= k - over).agg(F.max("score")).collect()[0][0]


def draw(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    longest: int = 1,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, kept_0.., n_words, n_features, weight, score, rank) of every row of ``docs``.

    Of the rows with ``min_words`` words or more, ``percent`` in a hundred (rounded down)
    with the largest scores are drawn; equal scores go to smaller ids, null ids come last.
    ``rank`` counts them from 1 and is null for the others. Null and empty texts have weight
    0 and are never drawn; equal rows are counted and get consecutive ranks; an empty table
    gives none. ``keep`` names further columns of ``docs`` (of types that can be grouped) to
    carry along. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, buckets, longest, text_col), bucket_counts(target, buckets, longest, text_col), buckets)
    scored = importance_scores(docs, gain, longest, seed, id_col, text_col, keep)
    folder = f"{shared_folder(docs.sparkSession)}/target-sampling-{uuid.uuid4().hex}"
    scored.write.parquet(folder)
    scored = docs.sparkSession.read.schema(scored.schema).parquet(folder)
    meant = scored.where(F.col("n_words") >= min_words)
    n = meant.count()
    k = n * percent // 100
    least = cutoff(meant, k, n)
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    taken = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    best = scored.where(taken).withColumns({"down": -F.col("score"), "unnamed": F.col("doc_id").isNull()})
    order = ["down", "unnamed", "doc_id", *[c for c in scored.columns if c != "doc_id"]]
    # One bucket per score: their totals are few, and copies are counted before they are placed.
    ranked = positions_of_copies(best, [], order, F.col("down"), "place")
    rank = F.when(F.col("place") < k, F.col("place") + 1)
    return ranked.select(*scored.columns, rank.alias("rank")).unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("bigint")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; options as for :func:`draw`."""
    found = draw(docs, target, keep=docs.columns, **options).where("rank IS NOT NULL")
    return found.select(*[F.col(f"kept_{n}").alias(c) for n, c in enumerate(docs.columns)])
