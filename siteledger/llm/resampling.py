"""Quality by importance resampling with hashed n-gram models (Xie et al., 2023).

Two bag-of-n-gram models over hash buckets are counted: one of the target texts (labelled
good), one of all raw texts. A document's log weight is the sum, over its n-grams, of the
log ratio of the two models. Weights are tempered by length, w to the power 1 / (n + STEADY)
for n n-grams, so that a long text does not win or lose by its length alone. The key is the
tempered log weight with equally tempered Gumbel noise; the k largest keys are the sample.

A mean over all n-grams hardly sees a few toxic words in an ordinary text. A document's
toxicity is therefore that of its single strongest n-gram: the log ratio of the shares of
labelled toxic and of other labelled documents that have it, less STRICT standard errors.
Documents above a cut, set on labels not learned from, leave the sample.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, durable, narrow, small_batches

by_value(sys.modules[__name__])

BUCKETS = 1 << 16
#: The target model is fitted on about so many labelled rows at most, chosen by a hash of their id.
TARGET_ROWS = 20_000
#: N-grams that are added to a text's own number when its weight is tempered.
STEADY = 50
#: Share of the labelled good documents that the sample is to hold.
GOOD_SHARE = 0.995
#: One in so many labelled documents is not learned from; these set the size of the sample.
TUNED_ON = 4
#: Standard errors by which an n-gram's toxicity is lowered, so that chance words do not count.
STRICT = 2.0
#: N-grams of the toxicity model at most, the strongest first.
TOXIC_GRAMS = 1 << 16
#: Words whose hashes a task remembers before it starts anew.
REMEMBERED = 1 << 18


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 0)
        return value


def ngram_hashes(text: str | None, words: _WordHash) -> np.ndarray:
    """Hashes of all words and word pairs of the whole text."""
    tokens = (text or "").split()
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(7))
    pairs ^= pairs >> np.uint64(29)
    return np.concatenate([h, pairs])


def ngram_buckets(text: str | None, words: _WordHash, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and word pairs of the whole text."""
    return (ngram_hashes(text, words) % np.uint64(buckets)).astype(np.int64)


def good_labels(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """(doc_id, good, toxic, tuning) of a bounded sample of labelled documents.

    Good: every label of the id says quality 1 and none says toxic. Toxic: any says so. Rows without id or
    quality are ignored. About ``rows`` ids are taken by a hash of the id, the same ones
    in every run.
    """
    per_id = (
        narrow(labels, doc_id="doc_id", quality="quality", toxic="toxic")
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(
            F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"),
            F.max((F.coalesce("toxic", F.lit(0)) != 0).cast("int")).alias("toxic"),
        )
    )
    n = per_id.count()
    share = min(1.0, rows / n) if n else 1.0
    taken = per_id.where(F.pmod(F.xxhash64("doc_id", F.lit("label sample")), F.lit(1_000_003)) < int(share * 1_000_003))
    return taken.withColumn("tuning", F.pmod(F.xxhash64("doc_id", F.lit("tuning")), F.lit(TUNED_ON)) == 0)


def log_ratios(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target and raw model per bucket; ``texts`` hold ``text`` and ``target``.

    The counts cover all rows; a task sends one row per bucket, and the driver gets the
    ``buckets`` sums.
    """

    def count(batches):
        raw, target, words = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), _WordHash()
        for batch in batches:
            for text, is_target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(ngram_buckets(text, words, buckets), minlength=buckets)
                raw += found
                if is_target:
                    target += found
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    counts = texts.select("text", "target").mapInArrow(count, "bucket long, raw long, target long")
    counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def toxic_grams(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and toxicity of the n-grams that set toxic texts apart; ``texts`` hold ``text`` and ``toxic``.

    Counted are documents that have the n-gram, under its whole hash: in few buckets the
    pairs of a long text would meet every word. The labelled texts are a bounded sample.
    """

    def count(batches):
        words = _WordHash()
        for batch in batches:
            found = [np.unique(ngram_hashes(t, words)) for t in batch.column(0).to_pylist()]
            marks = np.repeat(np.array(batch.column(1).to_pylist(), np.int64), [len(h) for h in found])
            gram, at = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_inverse=True)
            toxic = np.bincount(at, marks, len(gram)).astype(np.int64)
            other = np.bincount(at, 1 - marks, len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(toxic), pa.array(other)], names=["gram", "toxic", "other"])

    sizes = texts.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not all(sizes):
        return np.empty(0, np.uint64), np.empty(0)
    counts = texts.select("text", "toxic").mapInArrow(count, "gram long, toxic long, other long").groupBy("gram")
    counts = counts.agg((F.sum("toxic") + 0.5).alias("t"), (F.sum("other") + 0.5).alias("o"))
    ratio = F.log(F.col("t") / (sizes[0] + 1.0)) - F.log(F.col("o") / (sizes[1] + 1.0))
    grams = counts.select("gram", (ratio - STRICT * F.sqrt(1 / F.col("t") + 1 / F.col("o"))).alias("toxicity"))
    # the cut is found by counts, so that no partition sends more than what is kept
    strong = durable(grams.where("toxicity > 0"))
    edge = kth_largest(strong.select(F.col("toxicity").alias("key")), TOXIC_GRAMS)
    above = strong.where(F.col("toxicity") > F.lit(edge))
    ties = strong.where(F.col("toxicity") == F.lit(edge))
    left = TOXIC_GRAMS - above.count()
    place = -F.shiftright("gram", 11).cast("double")  # exact as a double; equal toxicity goes by the hash
    last = kth_largest(ties.select(place.alias("key")), left)
    table = above.unionByName(ties.where(place >= F.lit(last))).toPandas()
    gram = table["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], table["toxicity"].to_numpy(np.float64)[order]


def _toxic_cut(held: pd.DataFrame, good_share: float) -> float:
    """The toxicity at and above which documents go, from labelled ones not learned from.

    Of the cuts that ``good_share`` of the ``good`` documents stay below, the one that tells
    toxic from good best, halfway to the next lower toxicity. Infinite if there is none.
    """
    toxic, good = (np.sort(held.loc[held[c] == 1, "toxicity"].to_numpy()) for c in ("toxic", "good"))
    best, cut = 0.0, math.inf
    if not len(toxic) or not len(good):
        return cut
    values = np.unique(np.concatenate([toxic, good]))
    for below, at in zip(values, values[1:]):
        stay = np.searchsorted(good, at) / len(good)
        gone = 1 - np.searchsorted(toxic, at) / len(toxic)
        if stay >= good_share and gone + stay - 1 > best:
            best, cut = gone + stay - 1, (below + at) / 2
    return float(cut)


def gumbel(*seed: Column) -> Column:
    """Standard Gumbel noise that depends on the given columns alone."""
    uniform = (F.pmod(F.xxhash64(*seed, F.lit("gumbel")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def with_log_weights(docs: DataFrame, text: Column, ratios: np.ndarray, toxic: tuple[np.ndarray, np.ndarray], keep: dict[str, Column]) -> DataFrame:
    """The kept columns, ``log_weight``, ``n_grams`` and ``toxicity`` (0 without a toxic n-gram) of every row."""
    small_batches(docs.sparkSession)
    source = docs.select(F.struct(*[c.alias(n) for n, c in keep.items()]).alias("k"), text.alias("t"))
    model = docs.sparkSession.sparkContext.broadcast((ratios, *toxic))  # one double per bucket, two numbers per toxic n-gram

    def strongest(hashes: np.ndarray, grams: np.ndarray, toxicity: np.ndarray) -> float:
        if not len(grams) or not len(hashes):
            return 0.0
        at = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
        return float(np.where(grams[at] == hashes, toxicity[at], 0.0).max())

    def run(batches):
        words, (table, grams, toxicity) = _WordHash(), model.value
        for batch in batches:
            weights, sizes, worst = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = ngram_hashes(text, words)
                weights.append(float(table[(hashes % np.uint64(len(table))).astype(np.int64)].sum()))
                sizes.append(len(hashes))
                worst.append(strongest(hashes, grams, toxicity))
            columns = [batch.column(0), pa.array(weights, pa.float64()), pa.array(sizes, pa.int64()), pa.array(worst, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "log_weight", "n_grams", "toxicity"])

    found = [T.StructField("log_weight", T.DoubleType()), T.StructField("n_grams", T.LongType()), T.StructField("toxicity", T.DoubleType())]
    return source.mapInArrow(run, T.StructType([source.schema["k"], *found])).select("k.*", "log_weight", "n_grams", "toxicity")


def kth_largest(values: DataFrame, k: int) -> float:
    """The k-th largest of the column ``key``: two rounds of counts, then the last few values.

    Each round halves nothing by sampling: it counts all values in 4,096 equal ranges and
    goes on in the range that holds the k-th, until that range is one value. The driver
    only sees counts. With k above the number of rows the answer is minus infinity.
    """
    low, high, total = values.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k > total:
        return -math.inf
    while low < high:
        step = (high - low) / 4096
        if low + step == low:
            break
        slot = F.least(F.floor((F.col("key") - low) / step), F.lit(4095))
        inside = values.where(F.col("key").between(low, high)).groupBy(slot.alias("slot"))
        table = {r["slot"]: r for r in inside.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for place in sorted(table, reverse=True):
            if table[place]["n"] >= k:
                low, high = table[place]["low"], table[place]["high"]
                break
            k -= table[place]["n"]
    return low


def _least_good(known: DataFrame, share: float) -> float:
    """Key that at least ``share`` of good documents reach, from the keys of labelled ones.

    The quantile of n keys, less its distance to their median over the root of n: few
    labelled documents do not show how low good ones may lie.
    """
    n = known.count()
    if not n:
        return -math.inf
    low, middle = kth_largest(known, math.ceil(share * n)), kth_largest(known, math.ceil(n / 2))
    return low - (middle - low) / math.sqrt(n)


def quality_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    good_share: float = GOOD_SHARE,
    target_rows: int = TARGET_ROWS,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """``keep`` columns (the id by default) with log_weight, key, toxicity and kept (boolean) of every row of ``docs``.

    The target model learns from three in four of the labelled good documents. The others
    set the sample size k: the number of documents with keys that at least ``good_share``
    of them reach. The Gumbel top-k then takes the k largest keys (all that tie with the k-th).
    Of these, documents go whose toxicity reaches the cut set on the same held-out labels.
    Texts without a word have weight minus infinity and are rejected. Null ids are kept or
    rejected like any other; their noise comes from the text alone. Repeated rows get one
    verdict. Without labelled good texts nothing is known and every text with a word stays.
    """
    keep = keep or {"doc_id": F.col(f"`{id_col}`")}
    good = good_labels(labels, target_rows).withColumnRenamed("doc_id", "label_id")
    # the sample of labels has a bounded number of rows
    marked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = marked.join(F.broadcast(good), F.col("id") == F.col("label_id"), "left")
    small_batches(docs.sparkSession)
    ratios = log_ratios(marked.select("text", ((F.coalesce("good", F.lit(0)) == 1) & ~F.coalesce("tuning", F.lit(False))).alias("target")))
    inner = {"row": F.struct(*[c.alias(n) for n, c in keep.items()]), "id": F.col(f"`{id_col}`"), "salt": F.xxhash64(F.col(f"`{text_col}`"))}
    learned = marked.where(F.col("label_id").isNotNull() & ~F.col("tuning")).select("text", "toxic")
    scored = with_log_weights(docs, F.col(f"`{text_col}`"), ratios, toxic_grams(learned), inner)
    lost = F.col("n_grams") == 0
    scored = scored.withColumn("log_weight", F.when(lost, F.lit(-math.inf)).otherwise(F.col("log_weight")))
    scored = scored.withColumn("key", (F.col("log_weight") + gumbel(F.col("id"), F.col("salt"))) / (F.col("n_grams") + STEADY))
    keys = durable(scored.where(~lost).select("id", "key", "toxicity"))
    known = keys.join(F.broadcast(good.where("good = 1 and tuning")), F.col("id") == F.col("label_id")).select("key")
    floor = _least_good(known, good_share)
    # one row per label of the bounded sample
    held = keys.join(F.broadcast(good.where("tuning")), F.col("id") == F.col("label_id")).groupBy("id", "good", "toxic").agg(F.max("toxicity").alias("toxicity"))
    cut = _toxic_cut(held.toPandas(), good_share)
    k = keys.where(F.col("key") >= F.lit(floor)).count()
    edge = kth_largest(keys, k) if k else math.inf
    kept = ~lost & (F.col("key") >= F.lit(edge)) & (F.col("toxicity") < F.lit(cut))
    return scored.select("row.*", "log_weight", "key", "toxicity", kept.alias("kept"))


def reject_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, with all their columns."""
    keep = {"whole": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}
    return quality_sample(docs, labels, keep=keep, **options).where("kept").select("whole.*")
