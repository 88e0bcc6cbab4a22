"""Near-duplicates, decontamination, and the pipeline as a whole."""

import collections
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siteledger.llm import decontamination, graph, simhash

from .helpers import CLASH, EDGE, docs, edge_docs, native


def fingerprint_plainly(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_plainly(prints):
    """Smallest id within reach, all pairs compared."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def near_texts(rng, n=120):
    texts = []
    for _ in range(n):
        words = rng.choices("abcdefghijklmnop", k=rng.choice([1, 2, 4, 80]))
        texts.append(" ".join(words))
        if len(words) == 80:
            words[rng.randrange(80)] = "z"
            texts.append("\n".join(words).upper())
    return texts + ["", None, "  "]


@pytest.mark.parametrize("tile", [simhash.TILE_WORDS, 8])
def test_components_match_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_WORDS", tile)
    texts = near_texts(random.Random(5))
    prints = {n: fingerprint_plainly(t) for n, t in enumerate(texts)}
    want = components_plainly(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_components(docs(spark, *texts)).collect()}
    assert got == {n: (prints[n], want[n]) for n in want}


def test_links_of_crowded_tiles_span_the_same_components():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    crowd = base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    a, b = crowd[:150, None], np.concatenate([crowd[150:], rng.integers(0, 1 << 63, 50, dtype=np.uint64)])[:, None]
    member, root = simhash._forest(a, b, False, 3)
    assert set(root) == {0} and set(member) == set(range(1, 300))
    member, root = simhash._forest(a, a, True, 3)
    assert set(member) == set(range(1, 150)) and set(root) == {0}


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(n, n + 1) for n in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    near = collections.defaultdict(set)
    for u, v in edges:
        if u is not None and u != v:
            near[u].add(v)
            near[v].add(u)
    want, seen = {}, set()
    for n in sorted(near):
        if n not in seen:
            group, todo = set(), [n]
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += near[x]
            seen |= group
            want |= {x: n for x in group}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_simhash_edges(spark):
    got = simhash.simhash_components(edge_docs(spark)).collect()
    assert len(got) == len(EDGE)
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (1, 2, 3)} == {("0" * 16, 1)}
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert simhash.simhash_components(edge_docs(spark, [])).count() == 0


def jaccard(a, b):
    s = [{tuple(t.lower().split()[n : n + 5]) for n in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_copies_go_and_different_texts_stay(spark):
    rng = random.Random(11)
    words = [f"w{n}" for n in range(400)]
    originals = [" ".join(rng.choices(words, k=rng.choice([60, 200, 500]))) for _ in range(60)]
    copies = []
    for text in originals[:30]:
        tokens = text.split()
        for _ in range(max(1, len(tokens) // 100)):
            tokens[rng.randrange(len(tokens))] = "changed"
        copies.append(" ".join(tokens))
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(originals, copies))
    df = docs(spark, *originals, *copies, originals[3], originals[3])
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect())
    assert kept == list(range(60))


def test_fingerprints_only_propose(spark, monkeypatch):
    rng = random.Random(12)
    line = " ".join(f"l{n}" for n in range(12)) + "\n"
    own = [" ".join(f"{x}{n}" for n in range(300)) + "\n" + line * 60 for x in "ab"]
    base = [f"w{n}" for n in range(400)]
    near = [" ".join("x" if n in changed else w for n, w in enumerate(base)) for changed in (set(), set(range(0, 400, 28)), set(range(3, 400, 80)))]
    assert jaccard(*own) < 0.1 and jaccard(near[0], near[1]) < 0.8 < jaccard(near[0], near[2])
    for size in (simhash.PART_SETS, 1):
        monkeypatch.setattr(simhash, "PART_SETS", size)
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs(spark, *own, *near)).collect()) == [0, 1, 2, 3]


def test_a_text_and_the_same_text_thrice_are_copies(spark):
    text = " ".join(f"w{n}" for n in range(300))
    assert jaccard(text, f"{text} {text} {text}") > 0.95
    assert [r.doc_id for r in simhash.drop_near_duplicates(docs(spark, text, f"{text} {text}", f"{text} {text} {text}")).collect()] == [0]


def test_one_row_of_each_class_with_all_columns(spark):
    out = simhash.drop_near_duplicates(edge_docs(spark))
    assert out.columns == edge_docs(spark).columns
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.doc_id for r in got] == [1, 4, 5, 6, None] and got[0][CLASH[0]] == f"{CLASH[0]}-1"
    assert simhash.drop_near_duplicates(edge_docs(spark, [])).count() == 0


def test_radius_of_a_similarity():
    assert simhash.near_duplicate_radius(512, 1.0) == 0
    assert simhash.near_duplicate_radius(512, 0.8, 0) == int(512 * math.acos(1.6 / 1.8) / math.pi)


# Decontamination -------------------------------------------------------------------


def shingles_plainly(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))} if words else set()


def test_contained_items_match_plain_search(spark):
    rng = random.Random(13)
    words = [f"v{n}" for n in range(60)]
    items = [" ".join(rng.choices(words, k=k)) for k in (6, 9, 15, 15, 40, 120)] + ["two words", "", None, "! ?"]
    texts = []
    for _ in range(150):
        parts = rng.choices(words, k=rng.choice([0, 3, 50, 2000]))
        item = rng.choice(items[:6]).split()
        if rng.random() < 0.6:
            cut = item[: max(1, int(len(item) * rng.choice([0.5, 0.85, 0.95, 1])))]
            parts[len(parts) // 2 : len(parts) // 2] = cut
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    texts += ["Two, words!", "two words more", None, ""]
    want = set()
    for d, text in enumerate(texts):
        have = shingles_plainly(text)
        for i, item in enumerate(items):
            need = shingles_plainly(item)
            if need and len(need & have) >= 0.8 * len(need) - 1e-9:
                want.add((d, i, len(need & have), len(need)))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = decontamination.contained_items(docs(spark, *texts), benchmark)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()} == want and len(want) > 40
    assert native(found)


def test_hits_asked_for_are_reached_by_items_at_the_threshold():
    for probes in (12, 16, 20, 24, 28):
        hits = decontamination.least_hits(probes)
        chance = [math.comb(probes, k) * 0.8**k * 0.2 ** (probes - k) for k in range(probes + 1)]
        assert sum(chance[:hits]) <= decontamination.MISS < sum(chance[: hits + 1])
    assert decontamination.least_hits(12, 1.0) == 12 and decontamination.least_hits(12, 0.01) == 1


def test_documents_meet_the_items_of_their_size_class(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 15, 16, 255, 256, 65535, 65536, 1 << 30)], "n int")
    assert [r[0] for r in sizes.select(decontamination.size_class(F.col("n"))).collect()] == [0, 0, 1, 1, 2, 3, 4, 4]
    items = spark.createDataFrame([(1, " ".join(f"a{n}" for n in range(9))), (2, " ".join(f"b{n}" for n in range(404)))], "item_id bigint, text string")
    probes = decontamination.class_probes(decontamination.item_index(items, "item_id", "text", 5)).collect()
    count = collections.Counter((r.item_id, r.size_class) for r in probes)
    assert count == {**{(1, k): 5 for k in range(5)}, (2, 2): 20, (2, 3): 24, (2, 4): 28}
    assert {(r.size_class, r.enough) for r in probes if r.item_id == 2} == {(2, 6), (3, 9), (4, 11)} and {r.enough for r in probes if r.item_id == 1} == {4}
    # exactly as many shingles as the threshold asks for, at the edge of a class (320 of 400 and 16 of 20), and one fewer
    twenty = spark.createDataFrame([(3, " ".join(f"c{n}" for n in range(24)))], "item_id bigint, text string")
    texts = [" ".join(f"b{n}" for n in range(324)), " ".join(f"b{n}" for n in range(323)), " ".join(f"c{n}" for n in range(20)), " ".join(f"c{n}" for n in range(19))]
    long = " ".join(f"x{n}" for n in range(70_000)) + " " + texts[0] + " " + texts[2]
    found = decontamination.contained_items(docs(spark, *texts, long), items.unionByName(twenty)).collect()
    assert {(r.doc_id, r.item_id, r.n_shared) for r in found} == {(0, 2, 320), (2, 3, 16), (4, 2, 320), (4, 3, 16)}


def test_both_ways_to_the_candidates_agree(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id bigint, text string")
    df = docs(spark, "x one two three four five six seven eight y", "one two three four five", "other")
    sent = decontamination.contained_items(df, items).collect()
    monkeypatch.setattr(decontamination, "SENT_ROWS", -1)
    assert sent == decontamination.contained_items(df, items).collect() and [r.doc_id for r in sent] == [0]


def test_contaminated_rows_go(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon alpha beta"), (None, "no letters 12")], "item_id bigint, text string")
    out = decontamination.drop_contaminated(edge_docs(spark), items)
    assert out.columns == edge_docs(spark).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 4), (True, None)]
    assert decontamination.drop_contaminated(edge_docs(spark, []), items).count() == 0
    assert decontamination.drop_contaminated(edge_docs(spark), items.where("false")).count() == len(EDGE)


# Pipeline ----------------------------------------------------------------------------


def test_the_pipeline_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    rng = random.Random(17)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ada", "elo", "ino", "oru", "uni", "ash", "ent")]
    clean = [" ".join(rng.choices(words, k=120)) for _ in range(90)]
    item = " ".join(rng.choices(words, k=20))
    junk = [" ".join(rng.choices(["$$$", "###", "%%%"], k=60)) for _ in range(20)]
    rows = [(n, t, "en", f"s{n % 3}", len(t)) for n, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "s0", 1), (101, f"{clean[1]} {item} {clean[2]}", "en", "s1", 1)]
    rows += [(200 + n, t, "en", "s1", len(t)) for n, t in enumerate(junk)]
    rows += [(300, clean[5][:400] + " mail bob@mail.example.com now", "en", "s2", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(n, 1, 0) for n in range(0, 90, 2)] + [(200 + n, 0, 0) for n in range(0, 20, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    seen = {}
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"stage-{n}"))
        df = spark.read.parquet(str(tmp_path / f"stage-{n}"))
        seen[name] = df
        if n < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == [c.split()[0] for c in schema.split(", ")]
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    first, second, third, fourth, last = ids.values()
    assert not first & set(range(200, 220)) and len(first & set(range(90))) >= 87
    assert 100 not in second and first - second <= {100}
    assert second - third == {101} & second and third == fourth and last <= fourth
    redacted = seen["PII"].where("doc_id = 300").collect()
    assert all("<EMAIL>" in r.text and "bob@" not in r.text for r in redacted)
    assert {"mix_copy", "mix_shard", "mix_rank"} <= set(df.columns)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, df.collect()))
