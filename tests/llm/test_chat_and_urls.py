"""Preference formatting and URL filters."""

import hashlib
import random

import numpy as np
import pytest

from siteledger.llm import preferences, url_graph

from .helpers import CLASH, native


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def mask(turns):
    out, at = [], 0
    for role, text in turns:
        start = at + len(f"<|{role}|>\n")
        at = start + len(text) + len("<|end|>\n")
        if role == "assistant":
            out.append((start, at))
    return out


def turns_frame(spark, rows):
    return spark.createDataFrame(rows, "pair_id bigint, chosen boolean, turn bigint, role string, text string")


def test_pairs_match_a_plain_walk(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for pair in range(60):
        sides = []
        shared = [(rng.choice(["user", "assistant", "system"]), rng.choice(["hi", "é𝕏", ""])) for _ in range(rng.randrange(4))]
        for _ in range(2):
            sides.append(shared + [(rng.choice(["user", "assistant"]), rng.choice(["a", "b"])) for _ in range(rng.randrange(3))])
        for side, said in zip((True, False), sides):
            rows += [(pair, side, n, r, t) for n, (r, t) in enumerate(said)]
        if sides[0] or sides[1]:
            n = 0
            while n < min(map(len, sides)) and sides[0][n] == sides[1][n]:
                n += 1
            c, r = sides[0][n:], sides[1][n:]
            want[pair] = (n, render(sides[0][:n]), render(c), render(r), mask(c), mask(r))
    rng.shuffle(rows)
    rows += rows[:20]
    got = {}
    for r in preferences.format_preferences(turns_frame(spark, rows)).collect():
        got[r.pair_id] = (r.prefix_turns, r.prompt, r.chosen, r.rejected, [tuple(m) for m in r.chosen_mask], [tuple(m) for m in r.rejected_mask])
    assert got == want


def test_preference_edges(spark):
    rows = [(1, True, 0, None, None), (1, False, 0, "unknown", ""), (None, True, 0, "user", "x"), (2, True, 0, "user", "x"), (3, None, 0, "user", "x"), (4, True, None, "user", "x")]
    got = {r.pair_id: r for r in preferences.format_preferences(turns_frame(spark, rows)).collect()}
    assert set(got) == {1, 2} and (got[1].prefix_turns, got[1].chosen, got[1].rejected) == (1, "", "")
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("", "<|user|>\nx<|end|>\n", "")
    assert preferences.format_preferences(turns_frame(spark, [])).count() == 0


def test_a_very_long_pair_goes_on_in_further_rows(spark):
    rows = [(1, side, n, "user", "t" if n < 599 or side else "u") for side in (True, False) for n in range(600)]
    got = sorted(preferences.format_preferences(turns_frame(spark, rows)).collect(), key=lambda r: r.page)
    assert [(r.page, r.prefix_turns) for r in got] == [(0, 256), (1, 256), (2, 87)]
    assert [r.chosen for r in got] == ["", "", "<|user|>\nt<|end|>\n"]


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


def pairs_plainly(rows):
    """The pairs, made by a walk around the ring."""
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None:
            new = (role or "unknown", text or "")
            talk = talks.setdefault(conv, {})
            talk[turn] = min(talk.get(turn, new), new)
    digest = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    ring = sorted((int(digest(c)[:15], 16), c) for c, t in talks.items() if any(r == "assistant" for r, _ in t.values()))
    picked = {c: max((n for n, (r, _) in talks[c].items() if r == "assistant"), key=lambda n: digest(f"{c}:{n}")) for _, c in ring}
    out = {}
    for at, (_, c) in enumerate(ring):
        donor = ring[(at + 1) % len(ring)][1]
        chosen = [talks[c][n] for n in sorted(talks[c])]
        rejected = [talks[c][n] for n in sorted(talks[c]) if n < picked[c]] + [("assistant", talks[donor][picked[donor]][1])]
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        out[c] = (n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:]), mask(chosen[n:]), mask(rejected[n:]))
    return out


@pytest.mark.parametrize("bucket", [4096, 3])
def test_every_conversation_with_a_reply_gives_a_pair(spark, monkeypatch, bucket):
    monkeypatch.setattr(preferences, "RING_BUCKET", bucket)
    rng = random.Random(2)
    rows = []
    for conv in rng.sample(range(10**12), 60):  # ids with gaps
        rows += [(conv, n, rng.choice(["user", "assistant", "user", None]), rng.choice(["a", "b", "é𝕏", "", None])) for n in range(rng.randrange(7))]
    rows += rows[:30] + [(None, 0, "assistant", "x"), (5, None, "assistant", "x"), (6, 0, "user", "alone")]
    rng.shuffle(rows)
    out = preferences.format_preferences(preferences.pairs_by_swap(spark.createDataFrame(rows, CONVERSATION)))
    got = {r.pair_id: (r.prefix_turns, r.prompt, r.chosen, r.rejected, [tuple(m) for m in r.chosen_mask], [tuple(m) for m in r.rejected_mask]) for r in out.collect()}
    assert got == pairs_plainly(rows) and len(got) > 25
    assert native(out)


def test_pairs_of_edge_cases(spark):
    extra = ", ".join(f"`{c}` string" for c in CLASH if c != "row") + ", branch string, other string, place string"
    rows = [(1, 0, "assistant", "one", *["x"] * (len(CLASH) + 2)), (None, 0, "user", "x", *["y"] * (len(CLASH) + 2))]
    df = spark.createDataFrame(rows, f"{CONVERSATION}, {extra}")
    alone = preferences.format_preferences(preferences.pairs_by_swap(df)).collect()
    assert [(r.pair_id, r.prefix_turns, r.chosen, r.rejected) for r in alone] == [(1, 1, "", "")]  # it takes its own reply
    assert preferences.format_preferences(preferences.pairs_by_swap(df.limit(0))).count() == 0


# URLs ----------------------------------------------------------------------------


def rule_plainly(host, path):
    fits = [(h + p, v) for v, h, p in url_graph.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def split_plainly(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:n], rest[n:]
    n = next((k for k, c in enumerate(rest) if c in "?#"), len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:n]


def test_urls_and_rules(spark):
    rng = random.Random(3)
    parts = ["http", "://", "Example.com", "www.example.com", "a.net", "com", "net", "notcom", "/en/", "/es/x", "?q=/", "#top", "É", "\n", "."]
    urls = ["".join(rng.choices(parts, k=rng.randrange(7))) for _ in range(300)] + [None, "", "://", "https://x.org"]
    rows = [(n, u, None) for n, u in enumerate(urls)]
    got = url_graph.url_verdicts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = split_plainly(urls[r.page_id])
        rule, says = rule_plainly(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == says if says else r.verdict == ("block" if r.distrust > r.trust else "allow")


@pytest.mark.parametrize("together", [50_000, 2])
def test_propagation_matches_power_iteration(spark, monkeypatch, together):
    monkeypatch.setattr(url_graph, "EDGES_TOGETHER", together)
    rng = random.Random(7)
    edges = sorted({(rng.choice("abcdefg"), rng.choice("abcdefg")) for _ in range(20)})
    edges = [e for e in edges if e[0] != e[1]]
    seeds = [("trust", "a"), ("trust", "b"), ("distrust", "c")]
    ranks = url_graph.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "kind string, host string"), rounds=6)
    got = {(r.kind, r.host): r["rank"] for r in ranks.collect()}
    names = "abcdefg"
    for kind, of in (("trust", lambda e: e), ("distrust", lambda e: e[::-1])):
        step = np.zeros((7, 7))
        for s, d in map(of, edges):
            step[names.index(d), names.index(s)] += 1
        step /= np.maximum(step.sum(0), 1)
        seed = np.array([float((kind, n) in seeds) for n in names])
        seed /= seed.sum()
        rank = seed
        for _ in range(6):
            rank = 0.15 * seed + 0.85 * step @ rank
        assert np.allclose([got.get((kind, n), 0.0) for n in names], rank)


def test_links_and_parents_make_edges(spark):
    html = '<a href="https://One.org/x"><A HREF=//two.org><a href="/rel"><img src=\'http://a.b.c.org\'>'
    rows = [("www.a.org", html), ("", html), ("x.org", None)]
    got = {tuple(r) for r in url_graph.host_edges(spark.createDataFrame(rows, "host string, html string")).collect()}
    chain = [("www.a.org", "a.org"), ("a.b.c.org", "b.c.org"), ("b.c.org", "c.org")]
    assert got == {("www.a.org", "one.org"), ("www.a.org", "two.org"), ("www.a.org", "a.b.c.org"), *chain, *[(b, a) for a, b in chain]}


def test_distrust_blocks_hosts_that_link_to_blocked_ones(spark):
    rows = [
        (1, "http://spam.net/es/1", ""),
        (2, "http://shady.org/a", '<a href="http://spam.net/es/1">'),
        (3, "http://good.com/a", '<a href="http://fine.org">'),
        (4, "http://fine.org/a", None),
        (4, "http://fine.org/a", None),
        (None, "http://alone.org/", ""),
    ]
    out = url_graph.url_verdicts(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = sorted(((r.page_id or 0), r.verdict) for r in out.collect())
    assert got == [(0, "allow"), (1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (4, "allow")] and native(out)
    assert url_graph.url_verdicts(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
