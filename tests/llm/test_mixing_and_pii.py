"""Mixing to target weights and personal data."""

import collections
import math
import random
import re

from pyspark.sql import functions as F

from siteledger.llm import mixing, pii

from .helpers import EDGE, docs, edge_docs, native


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full


def mixed_corpus(spark, n=600):
    rng = random.Random(8)
    names = ["b", "a", "é", "c", "Z", None]
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40])), rng.choices(names, [8, 2, 1, 1, 1, 1])[0]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string"), rows


def test_targets_and_taken_words(spark):
    df, rows = mixed_corpus(spark)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = plain_targets(sizes)
    got = mixing.mixture(df).collect()
    taken = collections.Counter()
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)  # texts of one word make up for longer ones
    assert sorted(got) == sorted(mixing.mixture(df.repartition(7)).collect())


def plain_fronts(rows, rest, source_size):
    """Given words and the documents taken once more, by a sorted walk through each stratum of (place, size)."""
    strata = collections.defaultdict(list)
    for place, size in sorted(rows):
        strata[next((k for k, n in enumerate(mixing.STRATA) if size * n > rest), len(mixing.STRATA))].append((place, size))
    given, seen, taken = 0, 0, {}
    for k in range(len(mixing.STRATA) + 1):
        seen += sum(size for _, size in strata[k])
        budget, best, until = math.floor(rest * (seen / source_size)) - given, 0, [0]
        for _, size in strata[k]:
            until.append(until[-1] + size)
        best = min(range(len(until)), key=lambda n: (abs(budget - until[n]), until[n], -n))
        given += until[best]
        taken |= {(k, place): n < best for n, (place, _) in enumerate(strata[k])}
    return given, taken


def test_fronts_are_those_of_a_sorted_walk(spark):
    rows = mixing.durable(mixing.sized(mixed_corpus(spark)[0]))
    plans = {r.source: r for r in mixing.plan(rows).collect()}
    by_source = collections.defaultdict(list)
    for r in rows.collect():
        by_source[r.source].append((r.place, r.size))
    assert any(p.passes < 2 for p in plans.values())
    for source, plan in plans.items():
        if plan.passes < 2:
            given, taken = plain_fronts(by_source[source], plan.rest, plan.source_size)
            assert {key: key[1] < plan.edges[key[0]] for key in taken} == taken
            assert plan.flip is None or plan.flip.left < abs(plan.rest - given)


def test_one_document_of_half_a_source_blocks_nothing(spark):
    sizes = [100] * 500 + [50_000]
    rows = [(1000 * s + i, "w " * n, f"s{s:02d}") for s in range(9) for i, n in enumerate(sizes)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    # every multiple of 100 up to twice the source can be mixed
    assert all(abs(taken[s] - t) <= 50 for s, t in target.items())
    assert len(set(target.values())) > 1


def test_null_ids_are_placed_by_their_texts(spark):
    rows = [(None, "w " * n, s) for s in ("a", "b", "c") for n in range(1, 200)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
    # half a document of the smallest stratum, which is 1/512 of the rest, and the rest's rounding
    assert all(abs(taken[r.source] - r.target) <= r.source_size / 1024 + 1 for r in got)


def test_shards_are_written_in_their_random_order(spark, tmp_path):
    df, _ = mixed_corpus(spark)
    mixed = mixing.mix(df, levels=2)
    mixing.write_shards(mixed, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("mix_shard=*/*.parquet"))
    assert {f.parent.name for f in files} == {f"mix_shard={n}" for n in range(4)}
    for file in files:
        ranks = [r.mix_rank for r in spark.read.parquet(str(file)).collect()]
        assert ranks == sorted(ranks)
    assert spark.read.parquet(str(tmp_path / "out")).count() == mixed.count()


def test_shards_own_disjoint_blocks_and_all_copies(spark):
    df, rows = mixed_corpus(spark)
    got = mixing.mix(df.withColumn("mix_rank", F.lit("old")), levels=3)
    assert got.columns == ["doc_id", "text", "source", "mix_copy", "mix_shard", "mix_rank"]
    drawn = got.collect()
    want = {r.doc_id: r.taken // r.size for r in mixing.mixture(df).collect()}
    assert collections.Counter(r.doc_id for r in drawn) == collections.Counter({i: n for i, n in want.items() if n})
    assert {r.mix_shard for r in drawn} == set(range(8))


def test_quotas_add_up_and_vary_around_their_share(spark):
    sources = spark.createDataFrame([("a", 400), ("b", 100), (None, 13)], "source string, blocks bigint")
    seen = collections.defaultdict(list)
    for seed in range(4):
        quotas = mixing.shard_quotas(sources, 2, seed).collect()
        per_source, per_shard = collections.Counter(), collections.Counter()
        for r in quotas:
            per_source[r.source] += r.last - r.first
            per_shard[r.shard] += r.last - r.first
        assert per_source == {"a": 400, "b": 100, None: 13} and max(per_shard.values()) - min(per_shard.values()) <= 1
        seen["a"] += [r.last - r.first for r in quotas if r.source == "a"]
    assert all(80 <= n <= 120 for n in seen["a"]) and len(set(seen["a"])) > 2


def test_draws_follow_the_hypergeometric_law(spark):
    u = (F.col("id") + 0.5) / 20000.0
    k = mixing._hypergeometric(F.lit(6).cast("long"), F.lit(5).cast("long"), F.lit(20).cast("long"), u)
    got = {r.k: r["count"] / 20000 for r in spark.range(20000).select(k.alias("k")).groupBy("k").count().collect()}
    import math

    want = {x: math.comb(5, x) * math.comb(15, 6 - x) / math.comb(20, 6) for x in range(6)}
    assert all(abs(got.get(x, 0) - p) < 1e-3 for x, p in want.items())


def test_mixing_edges(spark):
    got = mixing.mixture(edge_docs(spark)).collect()
    assert len(got) == len(EDGE) and all(r.taken <= 2 * r.size for r in got) and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mixture(edge_docs(spark, [])).count() == 0 and mixing.mix(edge_docs(spark, []), levels=1).count() == 0
    assert mixing.mixture(edge_docs(spark, [(1, None), (2, " ")])).count() == 2


def test_mixing_is_native(spark):
    df, _ = mixed_corpus(spark, 20)
    assert native(mixing.mixture(df)) and native(mixing.mix(df, levels=1))


# Personal data -----------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_plainly(t):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(only(m)) <= 19 and luhn(only(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(only(m)) <= 15]


def test_base_spans_match_the_definitions(spark):
    rng = random.Random(6)
    parts = ["a@b.co", "x_y%z@q-r.s.t", "@", ".", "-", " ", "1", "25", "256", "10.0.0.1", "4111 1111 1111 1111", "4111-1111", "+1 (437) 555-0689", "+49", "(", ")", "é", "𝕏", "\n", "7992739871300", "0"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(400)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in pii.personal_data(docs(spark, *texts), {}).collect()}
    for n, text in enumerate(texts):
        assert got[n] == base_plainly(text), text


def people(spark):
    rng = random.Random(9)
    texts = []
    for n in range(200):
        secret = "".join(rng.choices("0123456789abcdef", k=40))
        texts.append(f"mail me at u{n}@mail.example.com or see 81.2.{n}.7 now")
        texts.append(f'set token = "{secret}" and call (437) 555-0{n:03d} today, Mr. Smith')
    return docs(spark, *texts), texts


def test_the_method_adds_spans_and_base_ones_stay(spark):
    df, texts = people(spark)
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    for n, text in enumerate(texts):
        assert all(text[s.start : s.end] == s.value for s in got[n])
        assert [(s.kind, s.start, s.end) for s in got[n] if s.base] == base_plainly(text)
    added = collections.Counter(s.kind for spans in got.values() for s in spans if not s.base)
    assert added["secret"] >= 195 and all(0 <= s.score <= 1 for spans in got.values() for s in spans)


def test_expectation_maximisation_tells_labelers_apart(spark):
    votes = [([1, 1, 2, 1], 90), ([0, 0, 2, 1], 80), ([1, 0, 2, 1], 9), ([0, 1, 2, 0], 4)]
    counts = spark.createDataFrame([("card", v, n) for v, n in votes], "kind string, votes array<int>, n bigint")
    got = {tuple(r.votes): r.posterior for r in pii._em(counts).collect()}
    assert got[1, 1, 2, 1] > 0.9 > 0.1 > got[0, 0, 2, 1]


def test_redaction(spark):
    rows = [(1, "write a.b@c.example.org or 10.0.0.256 and 10.0.0.25", "x"), (2, None, "y"), (3, "plain", "z"), (3, "plain", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row string")
    out = pii.redact(df, {})
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted([(1, "write <EMAIL> or 10.0.0.256 and <IP>", "x"), *rows[1:]])


def test_pii_edges(spark):
    found = pii.personal_data(edge_docs(spark), {}).collect()
    assert len(found) == len(EDGE) and not any(r.spans for r in found)
    many = "a@b.co " * 3000 + "1 2 " * 20000 + "x@" * 5000
    got = pii.personal_data(docs(spark, many), {}).collect()[0]
    assert len(got.spans) == 3000 and got.spans[2999].start == 7 * 2999
    assert pii.personal_data(edge_docs(spark, [])).count() == 0 and pii.redact(edge_docs(spark, [])).count() == 0


def test_pii_is_native(spark):
    df = docs(spark, "a@b.co")
    assert native(pii.personal_data(df, {})) and native(pii.redact(df, {}))
