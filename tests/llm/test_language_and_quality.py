"""Language identification and quality resampling."""

import collections
import math
import random

import numpy as np
import pytest

from siteledger.llm import language_id, resampling

from .helpers import EDGE, docs, edge_docs


def code_length(train, text, order):
    """PPM, method C with exclusion, byte by byte."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        p = bytes(order) + t
        for i in range(order, len(p)):
            for k in range(order + 1):
                counts[k, p[i - k : i]][p[i]] += 1
    bits, p = 0.0, bytes(order) + text
    for i in range(order, len(p)):
        excluded = set()
        for k in range(order, -1, -1):
            known = counts.get((k, p[i - k : i]))
            if not known:
                continue
            left = {s: n for s, n in known.items() if s not in excluded}
            total = sum(left.values()) + len(left)
            if p[i] in left:
                bits -= math.log2(left[p[i]] / total)
                break
            if left:
                bits -= math.log2(len(left) / total)
            excluded |= set(known)
        else:
            bits += math.log2(max(256 - len(excluded), 1))
    return bits


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_are_exact(order):
    rng = random.Random(order)
    train = [bytes(rng.choices(b"abcd ", k=40)) for _ in range(5)]
    texts = [bytes(rng.choices(b"abcdx \xc3\xa9", k=30)) for _ in range(5)] + [b"", b"a"]
    keys, n = np.unique(language_id.byte_strings(train, order)[0], return_counts=True)
    got = language_id.code_lengths(texts, [language_id.ContextTree(keys, n.astype(float), order)], order)[:, 0]
    assert np.allclose(got, [code_length(train, t, order) for t in texts])


def test_held_out_accuracy_and_defined_results(spark):
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "tion", "and"], "bb": ["der", "sch", "ung", "ein"]}
    rows = []
    for n in range(300):
        lang = rng.choice(["aa", "bb"])
        rows.append((n, " ".join(rng.choice(parts[lang]) + rng.choice(parts[lang]) for _ in range(12)), lang))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34", "aa"), (None, "schung der", None), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    tested = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(tested) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert (by_id[None].lang_pred, by_id[None].held_out) == ("bb", False)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges_and_no_rows(spark):
    assert len(language_id.identify(edge_docs(spark)).collect()) == len(EDGE)
    assert language_id.identify(edge_docs(spark, [])).count() == 0
    nothing_learned = language_id.predict(docs(spark, "words"), {}).collect()
    assert [(r.lang_pred, r.score) for r in nothing_learned] == [("und", 0.0)]


def test_training_sample_is_bounded(spark):
    df = spark.createDataFrame([(n, "word " * 100, "aa") for n in range(400)], "doc_id bigint, text string, lang string")
    taken = language_id.training_rows(df.withColumn("text", df["text"]), 20_000).count()
    assert 10 <= taken <= 80


# Quality -----------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 3, 50, 200])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([0.0, -1e9, 5.5, rng.gauss(0, 1), rng.gauss(0, 1e-9)]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    assert resampling.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(df, 201) == -math.inf


def test_models_match_plain_counting(spark):
    rows = [("a b a", True), ("b c", False), (None, True), ("", False), ("a", False)]
    got = resampling.log_ratios(spark.createDataFrame(rows, "text string, target boolean"), 64)
    words = resampling._WordHash()
    raw, target = np.ones(64), np.ones(64)
    for text, own in rows:
        for b in resampling.ngram_buckets(text, words, 64):
            raw[b] += 1
            target[b] += own
    assert np.allclose(got, np.log(target / target.sum()) - np.log(raw / raw.sum()))


def corpus(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet", "elit"], k=30)) for _ in range(200)]
    junk = [" ".join(rng.choices(["###", "$$$", "%%%", "buy!!"], k=30)) for _ in range(60)]
    df = docs(spark, *good, *junk)
    labels = spark.createDataFrame([(n, int(n < 200), 0) for n in range(0, 260, 2)] + [(0, 1, 0), (None, 1, 0), (4, None, None)], "doc_id bigint, quality int, toxic int")
    return df, labels


def test_good_documents_stay_and_junk_goes(spark):
    df, labels = corpus(spark)
    got = {r.doc_id: r for r in resampling.quality_sample(df, labels).collect()}
    assert sum(got[n].kept for n in range(200)) >= 195 and not any(got[n].kept for n in range(200, 260))
    kept = resampling.reject_low_quality(df.withColumn("key", df["text"]), labels)
    assert kept.columns == ["doc_id", "text", "key"] and kept.count() == sum(r.kept for r in got.values())


def test_quality_edges(spark):
    _, labels = corpus(spark)
    got = resampling.quality_sample(edge_docs(spark), labels).collect()
    assert len(got) == len(EDGE) and {r.kept for r in got if r.doc_id in (1, 2, 3)} == {False}
    same = [r for r in got if r.doc_id == 4]
    assert same[0] == same[1]
    empty = labels.where("false")
    assert {r.doc_id for r in resampling.quality_sample(edge_docs(spark), empty).collect() if r.kept} == {None, 4, 5, 6}
    assert resampling.quality_sample(edge_docs(spark, []), labels).count() == 0


def test_a_few_toxic_words_in_ordinary_text_are_enough(spark):
    rng = random.Random(6)
    words, bad = ["lorem", "ipsum", "dolor", "sit", "amet", "elit"], ["vile", "scum", "creep"]
    texts = [rng.choices(words, k=rng.choice([40, 400])) for _ in range(400)]
    for text in texts[300:]:
        for word in rng.sample(bad, 2):
            text[rng.randrange(1, len(text))] = word
    df = docs(spark, *map(" ".join, texts))
    labels = spark.createDataFrame([(n, 1, int(n >= 300)) for n in range(0, 400, 2)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in resampling.quality_sample(df, labels).collect()}
    assert sum(got[n] for n in range(300)) >= 295 and not any(got[n] for n in range(300, 400))


@pytest.mark.parametrize("most", [1, 7, 40, 10_000])
def test_strongest_toxic_grams_match_a_full_sort(spark, monkeypatch, most):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(40)]
    rows = [(" ".join(rng.choices(words[:25] if n % 3 else words[15:], k=30)), int(n % 3 == 0)) for n in range(300)]
    texts = spark.createDataFrame(rows, "text string, toxic int").repartition(5)
    gram, toxicity = resampling.toxic_grams(texts)
    assert (np.diff(gram.astype(object)) > 0).all() and len(gram) > 10
    monkeypatch.setattr(resampling, "TOXIC_GRAMS", most)
    some, strength = resampling.toxic_grams(texts)
    order = np.lexsort((gram.view(np.int64), -toxicity))[:most]
    assert dict(zip(some, strength)) == dict(zip(gram[order], toxicity[order]))
