"""Language identification by prediction by partial matching (PPM).

For each language a context tree of order ORDER over bytes is counted. The code length of a
text under a language is exact: each byte is coded in the longest context seen in training,
escaping (method C, with exclusion of the bytes that the longer context knows) to shorter
ones, down to a uniform code over bytes not yet excluded. Statistics are frozen: they do
not change while a text is scored. The language with the shortest code wins.

Spark counts byte strings of length ORDER + 1 per language; all shorter contexts are sums of
these. Texts are scored in batches, every distinct byte string of a batch once.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, narrow, small_batches

by_value(sys.modules[__name__])

ORDER = 4
#: Each language learns from about so many bytes at most, in whole texts chosen by a hash of
#: their id and text; texts over LONGEST bytes are not learned from. The model has at most
#: as many byte strings as these samples have bytes.
TRAIN_BYTES = 1_500_000
LONGEST = 200_000
#: Bytes of text scored at once.
BATCH_BYTES = 4 << 20
UNKNOWN = "und"


def byte_strings(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts with the ``order`` bytes before it, as one integer; and the texts' lengths.

    Before its first byte a text has zero bytes.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(bytes(order) + t for t in texts), np.uint8).astype(np.uint64)
    grams = np.zeros(max(len(raw) - order, 0), np.uint64)
    for k in range(order + 1):
        grams |= raw[k : k + len(grams)] << np.uint64(8 * (order - k))
    first = np.cumsum(lengths + order) - (lengths + order)
    keep = np.ones(len(raw), bool)
    for k in range(order):
        keep[first + k] = False  # the byte coded is the last of its string, never padding
    return grams[keep[order:]], lengths


class ContextTree:
    """Frozen counts of one language, looked up by (order, context, byte)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order, self.symbols, self.contexts = order, [], []
        for k in range(order + 1):
            keys, at = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            self.symbols.append((keys, np.bincount(at, counts, len(keys))))
        for k in range(order + 1):
            keys, n = self.symbols[k]
            context, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            entry = {"total": np.bincount(at, n, len(context)), "kinds": np.bincount(at, minlength=len(context)).astype(float)}
            if k:  # what the next shorter context has beside the bytes known here
                shorter = self._count(k - 1, keys & np.uint64((1 << 8 * k) - 1))
                entry["shorter"] = np.bincount(at, shorter, len(context))
            self.contexts.append((context, entry))

    @classmethod
    def of(cls, state: dict) -> ContextTree:
        tree = cls.__new__(cls)
        tree.__dict__.update(state)
        return tree

    def _count(self, k: int, keys: np.ndarray) -> np.ndarray:
        known, n = self.symbols[k]
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, n[at], 0.0)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte of each string in the context of the others."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        minus_total, minus_kinds = np.zeros(len(grams)), np.zeros(len(grams))
        for k in range(self.order, -1, -1):
            if not len(open_):
                break
            keys = grams[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            context, entry = self.contexts[k]
            if not len(context):
                continue
            at = np.minimum(np.searchsorted(context, keys >> np.uint64(8)), len(context) - 1)
            seen = context[at] == keys >> np.uint64(8)
            total = entry["total"][at] - minus_total[open_]
            kinds = entry["kinds"][at] - minus_kinds[open_]
            n = np.where(seen, self._count(k, keys), 0.0)
            codes = n > 0
            space = np.where(seen, total + kinds, 1.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(codes, np.log2(space / n), np.where(seen & (kinds > 0), np.log2(space / kinds), 0.0))
            out[open_] += cost
            if k:
                minus_total[open_] = np.where(seen, entry["shorter"][at], 0.0)
            minus_kinds[open_] = np.where(seen, entry["kinds"][at], 0.0)
            open_ = open_[~codes]
        known = len(self.symbols[0][0])
        out[open_] += np.log2(max(256 - known, 1))
        return out


def training_rows(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(lang, text): a bounded sample of ``docs`` (doc_id, text, lang), per language, in whole texts."""
    rows = docs.where("text is not null and lang is not null").withColumn("bytes", F.octet_length("text"))
    rows = rows.where((F.col("bytes") > 0) & (F.col("bytes") <= LONGEST))
    amounts = rows.groupBy("lang").agg(F.sum("bytes").alias("all_bytes")).withColumnRenamed("lang", "l")
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    # one row per language
    return rows.join(F.broadcast(amounts), F.col("lang") == F.col("l")).where(u * F.col("all_bytes") < train_bytes).select("lang", "text")


def train(docs: DataFrame, order: int = ORDER, train_bytes: int = TRAIN_BYTES) -> dict[str, ContextTree]:
    """A context tree per language, from rows with doc_id, text and lang."""
    sample = training_rows(docs, train_bytes)
    small_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            languages = np.array(batch.column(0).to_pylist(), object)
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for lang in sorted(set(languages)):
                grams, _ = byte_strings([t for t, own in zip(texts, languages) if own == lang], order)
                keys, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most train_bytes rows per language
    return {
        lang: ContextTree(part["gram"].to_numpy(np.int64).astype(np.uint64), part["n"].to_numpy(float), order) for lang, part in table.sort_values(["lang", "gram"]).groupby("lang")
    }


def code_lengths(texts: list[bytes], trees: list[ContextTree], order: int = ORDER) -> np.ndarray:
    """Bits of each text (rows) under each tree (columns)."""
    out = np.zeros((len(texts), len(trees)))
    at = 0
    while at < len(texts):
        upto, amount = at, 0
        while upto < len(texts) and (upto == at or amount + len(texts[upto]) <= BATCH_BYTES):
            amount += len(texts[upto])
            upto += 1
        grams, lengths = byte_strings(texts[at:upto], order)
        codes, distinct = pd.factorize(grams)
        ends = np.cumsum(lengths)
        for m, tree in enumerate(trees):
            sums = np.concatenate([[0.0], np.cumsum(tree.bits(distinct)[codes])]) if len(grams) else np.zeros(1)
            out[at:upto, m] = sums[ends] - sums[ends - lengths]
        at = upto
    return out


def predict(docs: DataFrame, trees: dict[str, ContextTree], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every row.

    score is the posterior of the language under equal priors, the share of its
    probability in the sum over all languages. Ties go to the first language by name.
    A text that is null or has no letter is ``und`` with score 0, and so is every text
    when no language was learned. Null ids and repeated rows keep their rows.
    """
    small_batches(docs.sparkSession)
    names = sorted(trees)
    # plain arrays: a broadcast is read where the package may not be installed
    model = docs.sparkSession.sparkContext.broadcast([vars(trees[n]) for n in names])
    rows = narrow(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))

    def run(batches):
        known = [ContextTree.of(state) for state in model.value]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            told = [n for n, t in enumerate(texts) if t is not None] if names else []
            data = [texts[n].encode("utf-8", "surrogatepass") for n in told]
            lang, score, rate = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if data:
                bits = code_lengths(data, known, known[0].order)
                best = bits.argmin(1)
                least = bits[np.arange(len(best)), best]
                share = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
                for n, b, s, total, text in zip(told, best, share, least, data):
                    lang[n], score[n], rate[n] = names[b], float(s), float(total / len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that are not held out.

    Rows with null id, text or language are not learned from; all rows are judged by their text alone.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col)
    learned = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = predict(rows, train(learned, train_bytes=train_bytes))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.round("score", 9).alias("score"))
