"""Ranked search of a set of items over all documents, with shared sums evaluated once.

Items are queries whose terms overlap. Term sets that several items share are mined by
rounds of pairing: in each round every node looks for the neighbour it meets in the most
items, and pairs that choose each other become one node. The result is a graph in which
a node is the sum of two earlier ones and an item is the sum of a few nodes.

Tasks take documents by the batch, fill in what each term adds to each document, and follow
the graph upwards: every shared sum is made once per document and read by all its items.
A task keeps the best documents of each item only; these are merged across tasks.

The items go in blocks of a bounded number, and each block is held against all documents.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from . import byte_words
from .common import by_value, durable, narrow, small_batches

by_value(sys.modules[__name__])
by_value(byte_words)

BEST = 50
#: Items of one block, about; a block is one pair of passes over the documents.
ITEMS_AT_ONCE = 2_048
#: Documents whose sums are held at a time.
DOCS_AT_ONCE = 128
#: Strength of the length: a document's length counts with so many parts in a hundred.
LENGTH_SHARE = 50
#: Candidates of a task that are held before all but the best are let go.
HELD = 1 << 20


@dataclass
class SharedSums:
    """Nodes 0 .. n_terms - 1 are terms; node n_terms + i is the sum of ``pairs[i]``.

    ``rounds`` are the numbers of pairs made by the end of each round, and ``items`` the
    nodes whose sum is an item's score. No node lies in another node of the same item.
    """

    n_terms: int
    items: list[list[int]]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    rounds: list[int] = field(default_factory=list)

    @property
    def additions(self) -> int:
        return len(self.pairs) + sum(len(nodes) - 1 for nodes in self.items if nodes)


def mine_shared(items: list[list[int]], n_terms: int) -> SharedSums:
    """The graph of shared sums over the items' term lists (each without repeats)."""
    lists = [sorted(nodes) for nodes in items]
    plan = SharedSums(n_terms, lists)
    while True:
        held = Counter(node for nodes in lists for node in nodes)
        # Frequent nodes first, so that lists with the same frequent terms have the same neighbours.
        lists = [sorted(nodes, key=lambda x: (-held[x], x)) for nodes in lists]
        met = Counter(pair for nodes in lists for pair in zip(nodes, nodes[1:]))
        choice: dict[int, tuple[int, int, int]] = {}
        for (a, b), n in met.items():
            if n > 1:
                for node in (a, b):
                    choice[node] = max(choice.get(node, (0, 0, 0)), (n, -a, -b))
        chosen = sorted({c for node, c in choice.items() if choice[-c[1]] == choice[-c[2]] == c}, reverse=True)
        if not chosen:
            plan.items = lists
            return plan
        made = {(-a, -b): n_terms + len(plan.pairs) + i for i, (_, a, b) in enumerate(chosen)}
        plan.pairs += made
        plan.rounds.append(len(plan.pairs))
        merged = []
        for nodes in lists:
            out, at = [], 0
            while at < len(nodes):
                new = made.get(tuple(nodes[at : at + 2]))
                out.append(nodes[at] if new is None else new)
                at += 1 if new is None else 2
            merged.append(out)
        lists = merged


@dataclass
class Block:
    """Items of one block: their ids, the terms with their numbers, and the graph over them."""

    ids: list
    terms: dict[bytes, int]
    plan: SharedSums


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each once; texts of one id are one item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms = [], []
            for row, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                found = sorted({w for words in byte_words.word_lists(data) for w in words})
                rows += [row] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary())], ["item_id", "term"])

    rows = narrow(items, item_id=id_col, text=text_col)
    return rows.mapInArrow(cut, T.StructType([rows.schema["item_id"], T.StructField("term", T.BinaryType())])).distinct()


def _blocks(terms: DataFrame, at_once: int) -> Iterator[Block]:
    """The items block by block; the driver holds the terms of one block."""
    n = terms.select("item_id").distinct().count()
    n_blocks = -(-n // at_once)
    for block in range(n_blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()
        numbers = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        lists: dict[object, list[int]] = {}
        for r in rows:
            lists.setdefault(r["item_id"], []).append(numbers[bytes(r["term"])])
        ids = sorted(lists, key=lambda i: (i is None, i if i is not None else 0))
        if ids:
            yield Block(ids, numbers, mine_shared([lists[i] for i in ids], len(numbers)))


def _counts(data: bytes | None, terms: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(all terms of a text, numbers of those in ``terms``, their occurrences)."""
    n, found = 0, Counter()
    for words in byte_words.word_lists(data):
        n += len(words)
        found.update(i for i in map(terms.get, words) if i is not None)
    return n, np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))


def term_statistics(texts: DataFrame, terms: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents that hold each of ``terms``); ``texts`` has one column, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 2, dtype=np.int64)
        for batch in batches:
            for data in batch.column("text").cast(pa.binary()).to_pylist():
                n, ids, _ = _counts(data, terms)
                total[ids] += 1
                total[-2:] += (n > 0, n)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["place", "n"])

    out = np.zeros(len(terms) + 2, dtype=np.int64)
    for place, n in texts.mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[place] = n
    return int(out[-2]), int(out[-1]), out[:-2]


class _Best:
    """The best documents of every item among those seen: larger scores, then smaller ids, null ids last."""

    def __init__(self, n_items: int, best: int):
        self.best, self.n = best, n_items
        self.least = np.zeros(n_items, dtype=np.int64)  # a score has to be over this, or equal with a smaller id
        self.least_id = np.full(n_items, np.iinfo(np.int64).min)
        self.rows = [np.zeros((4, 0), dtype=np.int64)]  # item, score, id, whether the id is null
        self.held = self.kept = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        least = self.least[:, None]
        items, docs = np.nonzero((scores > least) | ((scores == least) & (ids[None, :] < self.least_id[:, None])))
        self.rows.append(np.stack([items, scores[items, docs], ids[docs], unnamed[docs]]))
        self.held += len(items)
        if self.held > max(HELD, 2 * self.kept):
            self.shrink()

    def shrink(self) -> np.ndarray:
        rows = np.concatenate(self.rows, axis=1)
        rows = rows[:, np.lexsort((rows[2], rows[3], -rows[1], rows[0]))]
        begin = np.searchsorted(rows[0], np.arange(self.n + 1))
        place = np.arange(rows.shape[1]) - begin[rows[0]]
        last = rows[:, place == self.best - 1]
        self.least[last[0]] = last[1]
        # among equal scores null ids are beaten by any id
        self.least_id[last[0]] = np.where(last[3] == 1, np.iinfo(np.int64).max, last[2])
        rows = rows[:, place < self.best]
        self.rows, self.held, self.kept = [rows], rows.shape[1], rows.shape[1]
        return rows


def _summed(plan: SharedSums, added: np.ndarray, width: int) -> np.ndarray:
    """Scores (items x documents) from what each term adds: the graph is followed round by round."""
    begin = 0
    pairs = np.array(plan.pairs, dtype=np.int64).reshape(-1, 2)
    for end in plan.rounds:
        left, right = pairs[begin:end].T
        np.add(added[left], added[right], out=added[plan.n_terms + begin : plan.n_terms + end])
        begin = end
    nodes = np.array([x for item in plan.items for x in item], dtype=np.int64)
    starts = np.cumsum([0] + [len(item) for item in plan.items[:-1]])
    return np.add.reduceat(added[nodes], starts, axis=0)[:, :width]


def _search(rows: DataFrame, block: Block, best: int, item_type: T.DataType) -> DataFrame:
    """(item_id, doc_id, score): the best documents of every item of a block."""
    terms, plan, item_ids = block.terms, block.plan, block.ids
    n_docs, n_all, df = term_statistics(rows.select("text"), terms)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Best(len(item_ids), best)
        added = np.zeros((plan.n_terms + len(plan.pairs), DOCS_AT_ONCE), dtype=np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            for begin in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(begin, DOCS_AT_ONCE)
                added[: plan.n_terms] = 0
                for at, data in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    n, ids, tf = _counts(data, terms)
                    if len(ids):
                        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_all
                        added[ids, at] = weight[ids] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                ids = part.column("doc_id")
                unnamed = np.array(ids.is_null().to_pylist(), dtype=np.int64)
                # a null id stands behind all others
                numbers = np.array([np.iinfo(np.int64).max if i is None else i for i in ids.to_pylist()], dtype=np.int64)
                top.add(_summed(plan, added, part.num_rows), numbers, unnamed)
        if schema is not None:
            item, score, ids, unnamed = top.shrink()
            doc_ids = pa.array([None if u else int(i) for i, u in zip(ids, unnamed)], schema.field("doc_id").type)
            names = pa.array([item_ids[i] for i in item], item_arrow)
            yield pa.RecordBatch.from_arrays([names, doc_ids, pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    item_arrow = to_arrow_type(item_type)
    fields = [T.StructField("item_id", item_type), rows.schema["doc_id"], T.StructField("score", T.LongType())]
    return rows.mapInArrow(search, T.StructType(fields))


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    at_once: int = ITEMS_AT_ONCE,
    doc_id_col: str = "doc_id",
    item_id_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``best`` highest-scoring documents with a score above 0.

    Equal scores are ordered by ascending doc_id (whole numbers), null ids last. Every row
    of ``docs`` is a document of its own, repeats included; rows of ``items`` with one id
    are one item with the terms of all, and a null id is an item like any other. Null and
    empty texts have no terms; an item without terms finds nothing, and an empty table on
    either side gives no rows. Further columns are not read.
    """
    small_batches(docs.sparkSession)
    terms = durable(item_terms(items, item_id_col, text_col))
    item_type = terms.schema["item_id"].dataType
    rows = narrow(docs, doc_id=doc_id_col, text=text_col)
    found = [_search(rows, block, best, item_type) for block in _blocks(terms, at_once)]
    if not found:
        rank, score = T.StructField("rank", T.IntegerType()), T.StructField("score", T.LongType())
        return docs.sparkSession.createDataFrame([], T.StructType([terms.schema["item_id"], rank, rows.schema["doc_id"], score]))
    each = found[0]
    for more in found[1:]:
        each = each.unionByName(more)
    # Tasks send a few rows per item; with many tasks these are first cut down in parts.
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(32))
    for keys in (["item_id", part], ["item_id"]):
        each = each.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    return each.select("item_id", "rank", "doc_id", "score")
