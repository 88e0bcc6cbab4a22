"""SimHash near-duplicates by tiled exact comparison.

Whole texts become fingerprints in one pass. Equal fingerprints collapse first, so copies
never meet each other. Distinct fingerprints are laid out in tiles by the population
counts of their segments (and by length where a similarity bound allows it); tile pairs
whose counts differ beyond the radius are never formed. The others are compared in full
by exclusive-or and bit counts, and each tile pair reports a spanning forest of its links,
so a crowd of near copies yields as many rows as it has members. Components of the
forests are the classes.

The comparison is exact, and quadratic in the distinct fingerprints of neighbouring tiles.

Where texts are dropped, fingerprints only propose: within each component of close
fingerprints the sets of shingles are compared, and only links that they confirm count.
"""

from __future__ import annotations

import itertools
import math
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, by_value, durable, narrow, sent_if_small, small_batches
from .graph import components

by_value(sys.modules[__name__])

#: A tile has at most about so many 64-bit words of fingerprints.
TILE_WORDS = 1 << 14
#: Longer runs of texts are hashed in parts of so many shingles, to bound memory.
HASH_ROWS = 1 << 14
#: A part of a component has at most about so many shingles, and so many sets.
PART_SHINGLES, PART_SETS = 1 << 18, 1 << 10


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, of the whole text if it has fewer, of nothing if it has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), seed)], np.uint64)
    line = b" ".join(tokens)
    ends = list(itertools.accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[: len(tokens) - words]]
    return np.array([digest(line[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit value of each hash (the finaliser of splitmix64)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half of the hashes; word 0 has the hashes' own bits."""
    out = []
    for k in range(bits // 64):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), HASH_ROWS):
            part = hashes[at : at + HASH_ROWS]
            part = part if k == 0 else _mixed(part, k)
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)).tobytes())
    return b"".join(out)


def with_fingerprints(docs: DataFrame, text: Column, words: int, bits: int, keep: dict[str, Column]) -> DataFrame:
    """The kept columns, ``fp`` (binary, big-endian) and ``size`` (number of shingles) of every row."""
    small_batches(docs.sparkSession)
    source = docs.select(F.struct(*[c.alias(n) for n, c in keep.items()]).alias("k"), text.alias("t"))

    def run(batches):
        for batch in batches:
            hashed = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fingerprint(h, bits) for h in hashed], pa.binary()), pa.array([len(h) for h in hashed], pa.int64())],
                names=["k", "fp", "size"],
            )

    schema = T.StructType([source.schema["k"], T.StructField("fp", T.BinaryType()), T.StructField("size", T.LongType())])
    return source.mapInArrow(run, schema).select("k.*", "fp", "size")


# --------------------------------------------------------------------------- tiles


def _offsets(segments: int, reach: int, corners: bool) -> list[tuple[int, ...]]:
    """Differences of cells that a link may have, one of each opposite pair."""
    side = 1 if corners else reach
    ball = itertools.product(range(-side, side + 1), repeat=segments)
    return [o for o in ball if (corners or sum(map(abs, o)) <= reach)]


def _counts(blob: np.ndarray, segments: int) -> np.ndarray:
    """Population counts of equal segments of each fingerprint (rows of bytes)."""
    return np.bitwise_count(blob.reshape(len(blob), segments, -1)).sum(2, dtype=np.int64)


def _cells(fps: DataFrame, bits: int, segments: int, bin_width: int, ratio: float) -> DataFrame:
    """The fingerprints as 64-bit words with their cell: binned segment counts, then the length band."""

    def run(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, bits // 8)
            size = np.maximum(np.array(batch.column(1).to_pylist(), np.float64), 1)
            band = np.floor(np.log(size) / -math.log(ratio)) if ratio > 0 else np.zeros(len(raw))
            cell = np.concatenate([_counts(raw, segments) // bin_width, band[:, None].astype(np.int64)], axis=1)
            words = raw.view(">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.list_(pa.int64())), pa.array(list(cell.astype(np.int32)), pa.list_(pa.int32()))], names=["words", "cell"]
            )

    return fps.select("fp", "size").mapInArrow(run, "words array<bigint>, cell array<int>")


def _close_pairs(a: np.ndarray, b: np.ndarray, radius: int):
    """Positions (i, j) of rows of a and b that differ in at most ``radius`` bits, block by block."""
    dense = min(4, a.shape[1])
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        far = np.zeros((len(part), len(b)), np.uint16)
        for k in range(dense):
            far += np.bitwise_count(part[:, k, None] ^ b[None, :, k])
        i, j = np.nonzero(far <= radius)
        if a.shape[1] > dense and len(i):
            more = np.bitwise_count(part[i, dense:] ^ b[j, dense:]).sum(1, dtype=np.int64)
            kept = far[i, j] + more <= radius
            i, j = i[kept], j[kept]
        if len(i):
            yield i + at, j


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) positions in a followed by b (a alone if ``same``) of the components of the links."""
    label = np.arange(len(a) + len(b) * (not same))
    for i, j in _close_pairs(a, b, radius):
        j = j if same else j + len(a)
        while True:
            root_i, root_j = label[i], label[j]
            apart = root_i != root_j
            if not apart.any():
                break
            i, j, root_i, root_j = i[apart], j[apart], root_i[apart], root_j[apart]
            np.minimum.at(label, np.maximum(root_i, root_j), np.minimum(root_i, root_j))
            while (label[label] != label).any():
                label = label[label]
    member = np.flatnonzero(label != np.arange(len(label)))
    return member, label[member]


def links(fps: DataFrame, bits: int, radius: int, segments: int, ratio: float = 0.0) -> DataFrame:
    """Spanning links (u, v) among distinct fingerprints (``fp``, ``size``) that differ in at most ``radius`` bits.

    ``ratio``: links only exist between texts whose numbers of shingles differ by no more
    than this factor (0: any); it is used to leave out tile pairs. Components of the
    result equal those of all links between the tile pairs that remain.
    """
    spark = fps.sparkSession
    small_batches(spark)
    width = bits // 64
    # a bin as wide as the radius has only its neighbours in reach
    bin_width = 1 if radius <= 4 else radius
    reach = radius if bin_width == 1 else 1
    steps = [(*o, band) for o in _offsets(segments, reach, bin_width > 1) for band in ([0] if ratio <= 0 else [-1, 0, 1])]
    steps = [o for o in steps if o >= (0,) * (segments + 1)]
    celled = durable(_cells(fps, bits, segments, bin_width, ratio))
    amount = celled.groupBy("cell").agg(F.ceil(F.count("*") * width / TILE_WORDS).cast("int").alias("parts"))
    tiles = durable(
        celled.join(amount, "cell")
        .withColumn("part", F.pmod(F.xxhash64("words"), F.col("parts")).cast("int"))
        .groupBy("cell", "part")
        .agg(F.flatten(F.sort_array(F.collect_list("words"))).alias("words"))
    )
    rows = F.size("words") / F.lit(width)
    listed = tiles.select(F.col("cell").alias("b_cell"), F.col("part").alias("b_part"), rows.alias("b_rows"))
    reached = tiles.select("cell", "part", F.explode(F.array(*[F.array(*map(F.lit, o)) for o in steps])).alias("step"))
    reached = reached.withColumn("b_cell", F.zip_with("cell", "step", lambda x, y: (x + y).cast("int"))).drop("step")
    pairs = reached.join(listed, "b_cell").where((F.col("cell") != F.col("b_cell")) | (F.col("part") < F.col("b_part")))
    # the tiles against which one tile is held come in groups of about a tile's size
    groups = pairs.groupBy("cell", "part").agg(F.ceil(F.sum("b_rows") * width / TILE_WORDS).cast("int").alias("groups"))
    pairs = pairs.join(groups, ["cell", "part"]).withColumn("group", F.pmod(F.xxhash64("b_cell", "b_part"), F.col("groups")))
    others = tiles.select(F.col("cell").alias("b_cell"), F.col("part").alias("b_part"), F.col("words").alias("b_words"))
    against = (
        pairs.select("cell", "part", "group", "b_cell", "b_part")
        .join(others, ["b_cell", "b_part"])
        .groupBy("cell", "part", "group")
        .agg(F.flatten(F.collect_list("b_words")).alias("b_words"))
        .join(tiles, ["cell", "part"])
        .select(F.lit(False).alias("own"), F.col("words").alias("a_words"), "b_words")
    )
    compared = against.union(tiles.select(F.lit(True), "words", F.array().cast("array<bigint>")))

    def run(batches):
        for batch in batches:
            u, v = [np.empty((0, width), np.int64)], [np.empty((0, width), np.int64)]
            tiles_a, tiles_b = batch.column(1), batch.column(2)
            for k, own in enumerate(batch.column(0).to_pylist()):
                a = tiles_a[k].values.to_numpy().reshape(-1, width)
                b = a if own else tiles_b[k].values.to_numpy().reshape(-1, width)
                member, root = _forest(a.view(np.uint64), b.view(np.uint64), own, radius)
                if len(member):
                    both = a if own else np.concatenate([a, b])
                    u.append(both[member])
                    v.append(both[root])
            ends = [pa.array([x.tobytes() for x in np.concatenate(side).astype(">i8")], pa.binary()) for side in (u, v)]
            yield pa.RecordBatch.from_arrays(ends, names=["u", "v"])

    with batch_rows(spark, 64):
        return durable(compared.mapInArrow(run, "u binary, v binary"))


def near_classes(prints: DataFrame, bits: int, radius: int, segments: int, ratio: float = 0.0) -> DataFrame:
    """(fp, root) of each distinct fingerprint that has a link; ``prints`` hold ``fp`` and ``size``."""
    # where sizes matter, a fingerprint lies in the band of each size that it has
    distinct = prints.select("fp", "size").distinct() if ratio > 0 else prints.groupBy("fp").agg(F.min("size").alias("size"))
    return components(links(distinct, bits, radius, segments, ratio)).select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Fingerprints have 64 bits and link at ``radius`` or fewer differing bits, through
    others too; component_id is the smallest non-null id reachable, the row's own included.
    A null or wordless text has fingerprint zero, linked like any other. A null id keeps
    its row and can be reached, but names no component (null if the component has no id).
    Repeated rows come back as often as they came. No rows in, none out.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    prints = durable(with_fingerprints(rows, F.col("text"), words, 64, {"doc_id": F.col("doc_id")}))
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = durable(near_classes(prints, 64, radius, 4))
    inside = own.join(roots, "fp")
    class_ids = inside.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = inside.join(class_ids, "root").select("fp", "component_id")
    names = own.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(names, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def near_duplicate_radius(bits: int, similarity: float, margin: float = 2.0) -> int:
    """Bits by which texts of this Jaccard similarity differ, plus ``margin`` standard deviations.

    Sets of equal size with Jaccard similarity s have cosine 2s / (1 + s), and SimHash
    bits differ with probability angle / pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + margin * math.sqrt(bits * p * (1 - p)))


# --------------------------------------------------------------------------- exact sets


def with_sets(docs: DataFrame, text: Column, words: int, keep: dict[str, Column], bits: int = 0, stored: bool = False) -> DataFrame:
    """The kept columns and, of the distinct shingles of every row, ``node`` (a 128-bit digest of the set) and ``size``.

    With ``bits``, also ``fp``, their fingerprint; with ``stored``, ``hashes``, the set itself, ascending 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.struct(*[c.alias(n) for n, c in keep.items()]).alias("k"), text.alias("t"))

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            nodes = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            columns = {"k": batch.column(0), "node": pa.array(nodes, pa.binary()), "size": pa.array([len(h) for h in sets], pa.int64())}
            if bits:
                columns["fp"] = pa.array([fingerprint(h, bits) for h in sets], pa.binary())
            if stored:
                columns["hashes"] = pa.array([h.tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    fields = [source.schema["k"], T.StructField("node", T.BinaryType()), T.StructField("size", T.LongType())]
    fields += [T.StructField(n, T.BinaryType()) for n, wanted in (("fp", bits), ("hashes", stored)) if wanted]
    return source.mapInArrow(run, T.StructType(fields)).select("k.*", *[f.name for f in fields[1:]])


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (distinct values) have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def _confirmed_forest(a: list, b: list, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) positions in a followed by b (a alone if b is None) of the components of confirmed links.

    Sides are lists of (fp, set). Sets already in one component are not compared again.
    """
    words = [np.frombuffer(b"".join(fp for fp, _ in side), ">u8").astype(np.uint64).reshape(len(side), -1) for side in (a, a if b is None else b)]
    sets = [h for _, h in a + (b or [])]
    label = np.arange(len(sets))
    for i, j in _close_pairs(*words, radius):
        j = j if b is None else j + len(a)
        ahead = i < j
        i, j = i[ahead], j[ahead]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        for at, end in zip(first, [*first[1:], len(i)]):
            one, others = i[at], j[at:end]
            for other in others[label[others] != label[one]]:
                if label[other] != label[one] and similar(sets[one], sets[other], similarity):
                    low, high = sorted((label[one], label[other]))
                    label[label == high] = low
    member = np.flatnonzero(label != np.arange(len(label)))
    return member, label[member]


def confirmed_links(members: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Spanning links (u, v) among nodes of one ``root`` whose fingerprints are within the radius and whose sets are similar.

    ``members`` hold root, node, fp, size and hashes, each node once. A large component is cut
    into parts, and each pair of its parts is compared.
    """
    spark = members.sparkSession
    parts = F.greatest(F.ceil(F.sum("size") / PART_SHINGLES), F.ceil(F.count("*") / PART_SETS)).cast("int")
    large = durable(members.groupBy("root").agg(parts.alias("parts")).where("parts > 1"))
    dealt = members.join(sent_if_small(large), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = durable(dealt.groupBy("root", "part").agg(F.collect_list(F.struct("node", "fp", "hashes")).alias("sets")))
    sides = tiles.select("root", "part").join(sent_if_small(large), "root")
    pairs = sides.select("root", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b_part")).where("part < b_part")
    others = tiles.select("root", F.col("part").alias("b_part"), F.col("sets").alias("b_sets"))
    across = pairs.join(tiles, ["root", "part"]).join(others, ["root", "b_part"]).select("sets", "b_sets")
    compared = across.union(tiles.where(F.size("sets") > 1).select("sets", F.lit(None).alias("b_sets")))

    def read(side):
        return None if side is None else [(s["fp"], np.frombuffer(s["hashes"], np.uint64)) for s in side]

    def run(batches):
        for batch in batches:
            u, v = [], []
            for sets, b_sets in zip(batch.column(0), batch.column(1)):
                sets, b_sets = sets.as_py(), b_sets.as_py()
                nodes = [s["node"] for s in sets + (b_sets or [])]
                member, root = _confirmed_forest(read(sets), read(b_sets), radius, similarity)
                u += [nodes[k] for k in member]
                v += [nodes[k] for k in root]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    with batch_rows(spark, 16):
        return durable(compared.mapInArrow(run, "u binary, v binary"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 512
) -> DataFrame:
    """One row of each class of near-duplicates, with all columns of ``docs``.

    Texts link if their sets of word shingles (as 64-bit hashes) have the given Jaccard
    similarity and their wide fingerprints, which propose the links, are as close as that;
    classes are closed over links. The row with the smallest (non-null first) id stays, and
    of equal ids that with the smallest fingerprint; of fully repeated rows one stays. Texts
    without a word are one class.
    """
    radius = near_duplicate_radius(bits, similarity)
    text = F.col(f"`{text_col}`")
    prints = durable(with_sets(docs, text, words, {"doc_id": F.col(f"`{id_col}`"), "text_hash": F.xxhash64(text)}, bits))
    near = near_classes(prints, bits, radius, 1, similarity)
    nodes = prints.groupBy("node", "fp").agg(F.min("text_hash").alias("text_hash"))
    nodes = nodes.join(near, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    crowded = nodes.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    proposed = durable(nodes.join(crowded, "root", "left_semi"))
    texts = sent_if_small(proposed.select("text_hash").distinct())
    sets = docs.select(text.alias("t"), F.xxhash64(text).alias("text_hash")).join(texts, "text_hash", "left_semi")
    sets = with_sets(sets, F.col("t"), words, {"text_hash": F.col("text_hash")}, stored=True).dropDuplicates(["node"])
    members = durable(proposed.select("root", "node", "fp").join(sets, "node"))
    roots = components(confirmed_links(members, radius, similarity)).select("node", "root")
    chosen = (
        prints.groupBy("node", "fp", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"))
        .agg(F.count("*").alias("n"))
        .join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min(F.struct("no_id", "id", "fp", "node")).alias("best"))
        .select("best.*")
    )
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = with_sets(docs, text, words, {"row": whole})
    rows = rows.select("row", "node", F.coalesce(F.col(f"row.`{id_col}`"), F.lit(0)).alias("id"), F.col(f"row.`{id_col}`").isNull().alias("no_id"))
    return rows.join(chosen, ["node", "id", "no_id"], "left_semi").dropDuplicates(["node", "id", "no_id"]).select("row.*")
