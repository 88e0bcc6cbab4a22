"""Mix sources to target weights, with built-in functions only.

Every source's documents are put in a fixed random order (a hash), cut into blocks of equal
hash range. A source that must give more than it has is read whole first; the rest of its
target is shared among strata of document size, largest first, and each stratum gives the
front of its order that comes nearest to its share and to what the strata before it left
over. So a document of half a source never blocks or overfills a mix that smaller ones can
put right. Which hash value ends a front is found by counting words per range and refining
one range per source, so no source is sorted and no group is gathered. The blocks each
source owes are then dealt to the output shards by a multivariate hypergeometric splitting
tree: each node splits its exact block quotas at random between its two halves, down to one
shard; a shard takes disjoint runs of the permuted blocks and shuffles its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, narrow, sent_if_small

#: Fixed values of the mixture: weights of the sources in order, repeating; share of all words; most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Bits of the order that one counting round resolves, and the number of rounds.
ROUND_BITS = 14
ROUNDS = 3
#: A source has 2**BLOCK_BITS blocks.
BLOCK_BITS = 10
SHARD_LEVELS = 4
#: Strata by size: over the whole, 1/8, 1/64 and 1/512 of what a source still owes, and all smaller ones.
STRATA = (1, 8, 64, 512)
#: A shard's rows are shuffled in so many slices of its random order, so that no task holds a shard.
SLICES = 16


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and the control characters 9 to 13."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "\u0001")
    return F.length(F.translate(kept, " \t\n\u000b\f\r", "")).cast("long")


def order_of(doc_id: Column, text: Column) -> Column:
    """Place of a document in the fixed random order of its source: 42 bits of a hash of its id, or of its text where the id is null."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.shiftright(F.conv(F.substring(F.md5(key), 1, 11), 16, 10).cast("long"), 2)


def stratum_of(size: Column, rest: Column) -> Column:
    """0 for documents that are large beside the rest of their source's target, up to len(STRATA) for small ones."""
    found = F.lit(len(STRATA))
    for k in range(len(STRATA) - 1, -1, -1):
        found = F.when(size * STRATA[k] > rest, F.lit(k)).otherwise(found)
    return found


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, place) of every row."""
    rows = narrow(docs, doc_id=id_col, text=text_col, source=source_col)
    return rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_of(F.col("doc_id"), F.col("text")).alias("place"))


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target): weights capped at MOST times the size, the excess shared anew.

    One row per source of the mixture; the rounds of resharing only move sums of these
    rows to the driver, at most as many rounds as sources and in practice a few.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source: the recipe of the mixture, not the corpus
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = durable(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("most") < F.lit(level) * F.col("weight")
        n, taken, weights = sources.agg(
            F.count_if(full), F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if n == capped or not weights:
            break
        level, capped = (SHARE * total - taken) / weights, n
    share = F.col("most").cast("double") if level is None else F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("weight"))
    return sources.select("source", "source_size", share.alias("target"))


def _same(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join by ``source``, null included; ``other`` brings its further columns."""
    right = other.withColumnRenamed("source", "other_source")
    return df.join(right, F.col("source").eqNullSafe(F.col("other_source")), how).drop("other_source")


def _fronts(rows: DataFrame, budgets: DataFrame, first: DataFrame) -> DataFrame:
    """``budgets`` with ``edge`` and ``more``: rows placed before ``edge`` have ``more`` words, as near to ``budget`` as a front can come.

    ``first`` (source, slot, words) are the counts of the first turn, which begins at place 0
    for every source. Between two equally near fronts the shorter one is taken.
    """
    nothing = F.lit(0).cast("long")
    state = budgets.withColumns({"edge": nothing, "more": nothing})
    for turn in range(ROUNDS):
        width = 1 << (ROUND_BITS * (ROUNDS - 1 - turn))
        slot = F.floor((F.col("place") - F.col("edge")) / width)
        if turn:
            here = _same(rows, sent_if_small(state.select("source", "edge")))
            here = here.where((F.col("place") >= F.col("edge")) & (F.col("place") < F.col("edge") + (width << ROUND_BITS)))
            first = here.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("words"))
        begun = state.select("source", F.lit(-1).cast("long").alias("slot"), nothing.alias("words"), F.struct(*state.columns).alias("was"))
        counts = begun.unionByName(first, allowMissingColumns=True)
        # at most 2**ROUND_BITS + 1 rows of a source, the state of the turn before in front
        order = Window.partitionBy("source").orderBy("slot")
        counts = counts.withColumns({"until": F.sum("words").over(order), "was": F.first("was").over(order)})
        until = F.col("was.more") + F.col("until")
        over = until > F.col("was.budget")
        front = counts.groupBy("source").agg(
            F.any_value("was", True).alias("was"),
            F.min(F.when(over & (F.col("slot") >= 0), F.struct("slot", until.alias("until")))).alias("beyond"),
            F.max(F.when(~over, until)).alias("whole"),
        )
        budget, whole, beyond = F.col("was.budget"), F.coalesce("whole", "was.more"), F.col("beyond.until")
        step = F.coalesce(F.col("beyond.slot"), F.lit(1 << ROUND_BITS)) * width
        # at the last turn a slot is one place: take it too if that comes nearer
        nearer = (beyond - budget < budget - whole) if turn == ROUNDS - 1 else F.lit(False)
        kept = [F.col(f"was.{c}") for c in state.columns if c not in ("source", "edge", "more")]
        edge = F.least(F.col("was.edge") + step + F.when(nearer, 1).otherwise(0), F.lit(1 << (ROUND_BITS * ROUNDS)))
        state = durable(front.select("source", *kept, edge.alias("edge"), F.when(nearer, beyond).otherwise(whole).alias("more")))
    return state


def plan(rows: DataFrame) -> DataFrame:
    """One row per source: source_size, target, passes, rest, edges (one per stratum), flip.

    A document is taken ``passes`` times, once more if it is placed before its stratum's
    edge. ``flip`` (or null) is the one place of a stratum for which this is turned round,
    because its size makes up best for the words still missing or too many.
    """
    goal = targets(rows)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = goal.withColumn("passes", passes).withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size")))
    goal = durable(goal)
    open_ = goal.where(F.col("passes") < MOST).select("source", "rest", "source_size")
    placed = _same(rows.select("source", "size", "place"), sent_if_small(open_)).withColumn("stratum", stratum_of(F.col("size"), F.col("rest")))
    # at most 2**ROUND_BITS rows of a source and stratum
    slot = F.shiftright("place", ROUND_BITS * (ROUNDS - 1)).alias("slot")
    first = durable(placed.groupBy("source", "stratum", slot).agg(F.sum("size").alias("words")))
    words = first.groupBy("source", "stratum").agg(F.sum("words").alias("words"))
    present = {r[0] for r in words.select("stratum").distinct().collect()}  # at most len(STRATA) + 1 numbers
    share = {k: F.coalesce(F.sum(F.when(F.col("stratum") <= k, F.col("words"))), F.lit(0)).alias(f"seen{k}") for k in range(len(STRATA) + 1)}
    nothing = F.lit(0).cast("long")
    state = _same(open_, words.groupBy("source").agg(*share.values()), "left")
    state = durable(state.withColumns({"given": nothing, "edges": F.array().cast("array<bigint>")}))
    for k in range(len(STRATA) + 1):
        if k not in present:  # no source has such documents
            state = state.withColumn("edges", F.concat("edges", F.array(nothing)))
            continue
        owed = F.when(F.col("source_size") > 0, F.floor(F.col("rest") * (F.col(f"seen{k}").cast("double") / F.col("source_size")))).otherwise(0)
        state = _fronts(
            placed.where(F.col("stratum") == k).select("source", "size", "place"),
            state.withColumn("budget", owed - F.col("given")),
            first.where(F.col("stratum") == k).select("source", "slot", "words"),
        )
        state = state.withColumns({"edges": F.concat("edges", F.array("edge")), "given": F.col("given") + F.col("more")}).drop("edge", "more", "budget")
    state = durable(state.select("source", "edges", (F.col("rest") - F.col("given")).alias("gap")))
    change = F.when(F.col("place") < F.get("edges", F.col("stratum")), -F.col("size")).otherwise(F.col("size"))
    changes = _same(placed, sent_if_small(state)).where((F.col("gap") != 0) & (F.signum("gap") == F.signum(change)) & (F.abs(change) < 2 * F.abs("gap")))
    changes = changes.groupBy("source", "gap", "place", "stratum").agg(F.sum(change).alias("change"))
    left = F.abs(F.col("gap") - F.col("change"))
    best = changes.where(left < F.abs("gap")).groupBy("source").agg(F.min(F.struct(left.alias("left"), "place", "stratum")).alias("flip"))
    found = _same(_same(goal, state, "left"), best, "left")
    edges = F.coalesce("edges", F.array_repeat(nothing, len(STRATA) + 1))
    return durable(found.select("source", "source_size", "target", "passes", "rest", edges.alias("edges"), "flip"))


# ----------------------------------------------------------------- splitting tree


def _uniform(*seed: Column) -> Column:
    return (F.pmod(F.xxhash64(*seed), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _hypergeometric(wanted: Column, good: Column, total: Column, uniform: Column) -> Column:
    """A hypergeometric draw by inversion: of ``total`` blocks, ``good`` marked, ``wanted`` are drawn.

    Chances are built outwards from the mode by their ratios, so nothing underflows to zero.
    """
    low, high = F.greatest(F.lit(0).cast("long"), wanted + good - total), F.least(wanted, good)
    mode = F.greatest(low, F.least(high, F.floor((wanted + 1) * (good + 1) / (total + 2))))

    def up(k: Column) -> Column:  # chance of k + 1 over chance of k
        return ((good - k) * (wanted - k)).cast("double") / ((k + 1) * (total - good - wanted + k + 1)).cast("double")

    def walk(ks: Column, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("p"), F.array().cast("array<struct<k:bigint,p:double>>").alias("out"))

        def add(a: Column, k: Column) -> Column:
            p = a["p"] * ratio(k)
            return F.struct(p.alias("p"), F.concat(a["out"], F.array(F.struct(k.alias("k"), p.alias("p")))).alias("out"))

        return F.aggregate(ks, start, add, lambda a: a["out"])

    above = F.when(mode < high, walk(F.sequence(mode + 1, high), lambda k: up(k - 1))).otherwise(F.array().cast("array<struct<k:bigint,p:double>>"))
    below = F.when(mode > low, walk(F.sequence(mode - 1, low, F.lit(-1).cast("long")), lambda k: 1 / up(k))).otherwise(F.array().cast("array<struct<k:bigint,p:double>>"))
    chances = F.concat(F.reverse(below), F.array(F.struct(mode.alias("k"), F.lit(1.0).alias("p"))), above)
    mass = F.aggregate(chances, F.lit(0.0), lambda a, x: a + x["p"])
    begin = F.struct((uniform * mass).alias("left"), F.lit(None).cast("long").alias("k"))
    pick = lambda a, x: F.struct((a["left"] - x["p"]).alias("left"), F.coalesce(a["k"], F.when(a["left"] <= x["p"], x["k"])).alias("k"))
    return F.coalesce(F.aggregate(chances, begin, pick)["k"], high)


def _drawing(seed: int, level: int):
    """Adds the draw of one source to the draws of a node."""

    def draw(a: Column, x: Column) -> Column:
        u = _uniform(F.lit(seed), F.lit(level), F.col("node"), F.size(a["out"]))
        # the draw reads its inputs many times: bind them, and then the result, as one-element arrays
        inputs = F.array(F.struct(a["wanted"].alias("w"), x.alias("g"), a["total"].alias("t"), u.alias("u")))
        drawn = F.transform(inputs, lambda s: _hypergeometric(s["w"], s["g"], s["t"], s["u"]))
        moved = lambda k: F.struct((a["wanted"] - k).alias("wanted"), (a["total"] - x).alias("total"), F.concat(a["out"], F.array(k)).alias("out"))
        return F.transform(drawn, moved)[0]

    return draw


def shard_quotas(sources: DataFrame, levels: int = SHARD_LEVELS, seed: int = 0) -> DataFrame:
    """(source, shard, first, last): the run of drawn blocks of each source that a shard takes.

    ``sources`` hold source and ``blocks``, the number of blocks drawn from it. There are
    2**levels shards, equal in blocks to within one. Each node of the tree draws how many blocks of each source
    go left, one source after the other; the draws of a node depend on its own seed only.
    """
    state = sources.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", F.col("blocks").cast("long").alias("n")))).alias("q"))
    nodes = state.select(F.lit(0).cast("long").alias("node"), F.transform("q", lambda x: x["n"]).alias("quota"), F.transform("q", lambda x: x["source"]).alias("names"))
    for level in range(levels):
        total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = nodes.withColumn("total", total).withColumn("half", F.floor((F.col("total") + F.pmod(F.col("node"), F.lit(2))) / 2))
        begin = F.struct(F.col("half").alias("wanted"), F.col("total").alias("total"), F.array().cast("array<bigint>").alias("out"))

        nodes = durable(nodes.withColumn("left", F.aggregate("quota", begin, _drawing(seed, level), lambda a: a["out"])))
        right = F.zip_with("quota", "left", lambda q, k: q - k)
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quota")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quota")))
        nodes = nodes.select("names", F.explode(sides).alias("s")).select("s.node", "s.quota", "names")
    each = nodes.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("names", "quota")).alias("x")).select("shard", F.col("x.names").alias("source"), F.col("x.quota").alias("n"))
    # one row per source and shard
    last = F.sum("n").over(Window.partitionBy("source").orderBy("shard"))
    return each.withColumn("last", last).withColumn("first", F.col("last") - F.col("n")).where("n > 0").select("source", "shard", "first", "last")


def dealt(rows: DataFrame, sources: DataFrame, levels: int = SHARD_LEVELS, seed: int = 0) -> DataFrame:
    """``rows`` (with source, size and place) with source_size, target and ``shards``: for each copy that is taken, the shard it is dealt to.

    The drawn blocks of a source are numbered pass by pass in the order of their places;
    blocks of the last, partial pass count as blocks too, and the document taken out of turn
    is one more. Shards own disjoint runs of the numbers. A copy whose block no shard owns is not taken.
    """
    shift = ROUND_BITS * ROUNDS - BLOCK_BITS
    whole = F.col("passes") * (1 << BLOCK_BITS)
    partial = F.ceil(F.array_max("edges") / (1 << shift))
    blocks = whole + partial + F.col("flip").isNotNull().cast("int")
    quotas = shard_quotas(sources.select("source", blocks.alias("blocks")), levels, seed)
    runs = quotas.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("first", "last", "shard"))).alias("runs"))  # one entry per shard
    joined = _same(rows, sent_if_small(durable(_same(sources, runs, "left"))), "left")
    stratum = stratum_of(F.col("size"), F.col("rest"))
    front = F.col("place") < F.get("edges", stratum)
    flipped = F.coalesce((F.col("flip.place") == F.col("place")) & (F.col("flip.stratum") == stratum), F.lit(False))
    n = F.col("passes") + ((F.col("passes") < MOST) & (front != flipped)).cast("int")
    own = F.shiftright(F.col("place"), shift)
    number = lambda copy: F.when(copy < F.col("passes"), copy * (1 << BLOCK_BITS) + own).otherwise(whole + F.when(front, own).otherwise(partial))
    owner = lambda copy: F.get(F.filter("runs", lambda r: (r["first"] <= number(copy)) & (number(copy) < r["last"])), F.lit(0))["shard"]
    shards = F.when(n > 0, F.filter(F.transform(F.sequence(F.lit(0), n - 1), owner), lambda s: s.isNotNull()))
    return joined.select(*rows.columns, "source_size", "target", F.coalesce(shards, F.array().cast("array<bigint>")).alias("shards"))


def draws(rows: DataFrame, sources: DataFrame, levels: int = SHARD_LEVELS, seed: int = 0) -> DataFrame:
    """One row per copy taken: the columns of ``rows``, ``copy``, ``shard`` and ``rank``, the random order within the shard."""
    taken = dealt(rows, sources, levels, seed).select(*rows.columns, "source_size", "target", F.posexplode("shards").alias("copy", "shard"))
    rank = F.xxhash64(F.lit(seed), F.lit("rank"), "place", "copy", F.coalesce("source", F.lit("")))
    return taken.withColumn("rank", rank)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``.

    Sources are ordered by code point, null last. ``taken`` is the number of words the mix
    takes from the row: its size times its copies in the shards, at most MOST times its size.
    A source's taken words miss its target by half a small document (1/512 of the rest of the
    target) or less where the smaller documents suffice to make up for the larger ones. Null
    and wordless texts have size 0 and are never missed. Null ids are ordered by their
    texts; equal ids of like size are taken together. Reruns agree, since places are hashes.
    """
    rows = durable(sized(docs, id_col, text_col, source_col))
    mixed = dealt(rows, plan(rows))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int = SHARD_LEVELS) -> DataFrame:
    """The mixed corpus: one row per copy, with the columns of ``docs``, ``mix_copy``, ``mix_shard`` and ``mix_rank``.

    Only plans of one row per source are joined to the texts, sent to every task while
    they are small. The one shuffle of text is the local shuffle: each slice of a shard's
    random order goes to one task, which sorts it by mix_rank. Input columns of these names are
    replaced.
    """
    rows = durable(sized(docs, id_col, text_col, source_col))
    sources = plan(rows)
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"), n_words(text).alias("size"), order_of(F.col(f"`{id_col}`"), text).alias("place")
    )
    out = draws(whole, sources, levels)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("mix_copy", "mix_shard", "mix_rank")]
    out = out.select(*kept, F.col("copy").cast("long").alias("mix_copy"), F.col("shard").alias("mix_shard"), F.col("rank").alias("mix_rank"))
    return out.repartition("mix_shard", slice_of(F.col("mix_rank"))).sortWithinPartitions("mix_shard", "mix_rank")


def slice_of(rank: Column) -> Column:
    """Which of the SLICES equal ranges of the 64-bit order holds ``rank``."""
    return F.floor((rank.cast("double") / float(1 << 64) + 0.5) * SLICES)


def write_shards(mixed: DataFrame, folder: str) -> None:
    """Store the result of ``mix`` as one folder per shard; each file holds its rows in the order of mix_rank."""
    slices = mixed.repartition("mix_shard", slice_of(F.col("mix_rank"))).sortWithinPartitions("mix_shard", "mix_rank")
    slices.write.mode("overwrite").partitionBy("mix_shard").parquet(folder)
