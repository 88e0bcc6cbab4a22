"""Find short test items inside long documents: MinHash containment search, then an exact check.

A MinHash of an item is the shingle that comes first in a random order of all shingles; a
document holds it with probability equal to the containment of the item, however long the
document is. Documents are partitioned by size. For each class of documents that is long
enough for it, an item gives its first few shingles as probes (all of them when it is
small), and class and shingle together are the key of the search, so a short document never
meets an item it cannot hold. Longer documents share more shingles by chance: their classes
take more probes and ask for more hits, as many as an item at the threshold reaches but for
one time in a million. Documents with enough hits are candidates. For candidates alone all
shingles of the item are counted exactly. Only built-in functions; the search never shuffles text.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, durable, narrow, sent_if_small

WORDS = 5
CONTAINMENT = 0.8
#: Probes per item in the class of the shortest documents, and how many more each longer class takes.
PROBES = 12
MORE_PROBES = 4
#: Class k holds documents of 16**k shingles or more; the last one is open.
SIZE_CLASSES = 5
CLASS_BITS = 4
#: How often an item at the threshold may have too few hits to be checked.
MISS = 1e-6


def size_class(n_shingles: Column) -> Column:
    """Class of a document by its number of shingles, repeats included."""
    bits = F.length(F.bin(n_shingles))
    return F.least(F.floor((bits - 1) / CLASS_BITS), F.lit(SIZE_CLASSES - 1)).cast("int")


def least_hits(probes: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Most hits that may be asked for: fewer of ``probes`` come at this containment with a chance of ``miss`` at most, at least 1.

    Probes are drawn without repeats, so hits vary less than the binomial that is taken here.
    """
    chance, hits = 0.0, 0
    while hits < probes:
        chance += comb(probes, hits) * containment**hits * (1 - containment) ** (probes - hits)
        if chance > miss:
            break
        hits += 1
    return max(hits, 1)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words (letters and digits, lower-cased) of the whole text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_rows(rows: DataFrame, hashes: str, words: int = WORDS) -> DataFrame:
    """One row per word run: the columns of ``rows`` without ``hashes``, ``shingle`` and ``n_shingles``.

    A text with fewer words gives one shingle, all its words.
    """
    at = F.col("shingle_at")
    runs = rows.withColumn("n_shingles", F.greatest(F.size(hashes) - (words - 1), F.least(F.size(hashes), F.lit(1))))
    runs = runs.select("*", F.posexplode(hashes).alias("shingle_at", "shingle_word")).where(at < F.col("n_shingles"))
    shingle = F.xxhash64("shingle_word", *[F.get(F.col(hashes), at + k) for k in range(1, words)])
    return runs.select(*[c for c in rows.columns if c != hashes], "n_shingles", shingle.alias("shingle"))


def item_index(items: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(item_id, n_item, shingle, rank_at) with the distinct shingles of each item, numbered in the random order."""
    hashed = narrow(items, item_id=id_col, text=text_col).select("item_id", word_hashes(F.col("text")).alias("h"))
    at = shingle_rows(hashed, "h", words).select("item_id", "shingle").distinct()
    order = F.array_sort(F.collect_list(F.struct(F.xxhash64("shingle", F.lit("order")).alias("rank"), "shingle")))
    per_item = at.groupBy("item_id").agg(order.alias("s"))  # as long as one item
    per_item = per_item.select("item_id", F.size("s").alias("n_item"), F.posexplode("s").alias("rank_at", "s"))
    return per_item.select("item_id", "n_item", F.col("s.shingle").alias("shingle"), "rank_at")


def class_probes(index: DataFrame, containment: float = CONTAINMENT, probes: int = PROBES) -> DataFrame:
    """(size_class, shingle, item_id, needed, enough): the probes of every item in each class of documents that can hold it.

    ``needed`` is the number of shingles that a document has at least if it holds the item,
    ``enough`` the number of hits that make a candidate. An item with no more shingles than the
    class has probes gives them all, and the hits asked for are exactly its containment.
    """
    asked = [probes + MORE_PROBES * k for k in range(SIZE_CLASSES)]
    classes = [F.struct(F.lit(k).alias("size_class"), F.lit(n).alias("n_probes"), F.lit(least_hits(n, containment)).alias("hits")) for k, n in enumerate(asked)]
    needed = F.ceil(F.lit(containment) * F.col("n_item") - 1e-9)
    rows = index.where(F.col("rank_at") < asked[-1]).withColumn("needed", needed)
    held = lambda c: (c["size_class"] >= size_class(F.col("needed"))) & (F.col("rank_at") < c["n_probes"])
    rows = rows.withColumn("c", F.explode(F.filter(F.array(*classes), held)))
    enough = F.when(F.col("n_item") <= F.col("c.n_probes"), F.col("needed")).otherwise(F.col("c.hits"))
    return rows.select("c.size_class", "shingle", "item_id", "needed", enough.alias("enough"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = WORDS,
    containment: float = CONTAINMENT,
    probes: int = PROBES,
) -> DataFrame:
    """(doc_id, text_hash, item_id, n_item, n_shared, containment) where a text holds enough of an item.

    Containment is the share of the item's distinct word shingles that the whole text
    has. Items and texts without a word match nothing; an item with fewer than ``words``
    words is one shingle and matches texts of just these words. Null ids are carried as
    null; ``text_hash`` tells texts of one id apart, and repeated rows give one result.
    Items that repeat an id count as one item with the shingles of all.
    """
    index = durable(item_index(items, item_id_col, item_text_col, words))
    rows = narrow(docs, doc_id=id_col, text=text_col).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    hashed = rows.select("doc_id", "text_hash", word_hashes(F.col("text")).alias("h"))
    shingles = shingle_rows(hashed, "h", words)
    large_enough = F.col("n_shingles") >= F.ceil(F.lit(containment) * F.col("n_item") - 1e-9)
    key = ["doc_id", "text_hash", "item_id"]
    classed = shingles.withColumn("size_class", size_class(F.col("n_shingles")))
    candidates = (
        classed.join(sent_if_small(durable(class_probes(index, containment, probes))), ["size_class", "shingle"])
        .where(F.col("n_shingles") >= F.col("needed"))
        .groupBy(*key, "enough")
        .agg(F.count_distinct("shingle").alias("hits"))
        .where(F.col("hits") >= F.col("enough"))
    )
    candidates = durable(candidates.select(*key))
    wanted = index.join(candidates.select("item_id").distinct(), index["item_id"].eqNullSafe(candidates["item_id"]), "left_semi")
    suspects = candidates.select("doc_id", "text_hash").distinct()
    if suspects.count() <= SENT_ROWS:
        # few documents: only their texts are cut into words again; else the counts meet the candidates below
        suspects = F.broadcast(suspects)
        same_text = (rows["text_hash"] == suspects["text_hash"]) & rows["doc_id"].eqNullSafe(suspects["doc_id"])
        again = rows.join(suspects, same_text, "left_semi").select("doc_id", "text_hash", word_hashes(F.col("text")).alias("h"))
        shingles = shingle_rows(again, "h", words)
    found = shingles.join(wanted.select("item_id", "n_item", "shingle"), "shingle").where(large_enough)
    found = found.groupBy(*key, "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    same = [found[c].eqNullSafe(candidates[c]) for c in key]
    found = found.join(candidates, same, "left_semi").withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return found.where(F.col("n_shared") >= F.ceil(F.lit(containment) * F.col("n_item") - 1e-9))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold none of the items, with all their columns; rows with null text stay."""
    hit = contained_items(docs, items, id_col, text_col, **options).select("doc_id", "text_hash").distinct()
    hit = durable(hit)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{text_col}`")).alias("row_hash"))
    same = (F.col("row_hash") == hit["text_hash"]) & F.col(f"row.`{id_col}`").eqNullSafe(hit["doc_id"])
    return whole.join(sent_if_small(hit), same, "left_anti").select("row.*")
