"""Registered queries of the text operators: name, DataFrame function and, where SQL can say it, SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, flac, language_id, licenses, mixing, pii, preferences, ranked_search, resampling, secret_scan, simhash, target_sampling, url_graph
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as FLAC, and what the stored bytes say when they are decoded."""
    return flac.digests(flac.encode_texts(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the quality resampling for every document."""
    found = resampling.quality_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("key", 9).alias("key"), "kept")


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


# Places are 42 bits of md5 of the id; the target level falls out of the sources ordered by how
# soon they are full. Stratum by stratum, every front of a source is held against the words it
# should give (front 0 is the empty one), and the nearest is kept, the shorter of two alike.
def _op4_sql() -> str:
    strata = []
    for k in range(len(mixing.STRATA) + 1):
        strata.append(rf"""
b{k} AS (SELECT r.source, any_value(t.given) AS before,
       CASE WHEN r.source_size > 0 THEN floor(r.rest * (coalesce(sum(p.words) FILTER (WHERE p.stratum <= {k}), 0)::DOUBLE / r.source_size))::BIGINT ELSE 0 END - any_value(t.given) AS budget
     FROM r JOIN t{k} t ON t.source IS NOT DISTINCT FROM r.source LEFT JOIN p ON p.source IS NOT DISTINCT FROM r.source GROUP BY r.source, r.source_size, r.rest),
f{k} AS (SELECT source, -1 AS last, 0::BIGINT AS until FROM r
     UNION ALL SELECT source, place, sum(words) OVER (PARTITION BY source ORDER BY place)::BIGINT FROM p WHERE stratum = {k}),
e{k} AS MATERIALIZED (SELECT b.source, before, arg_min((last, until), (abs(budget - until), until, -last)) AS best
     FROM b{k} b JOIN f{k} f ON f.source IS NOT DISTINCT FROM b.source GROUP BY b.source, before),
t{k + 1} AS MATERIALIZED (SELECT source, before + struct_extract_at(best, 2) AS given, struct_extract_at(best, 1) AS last FROM e{k}),""")
    edge = " ".join(f"WHEN {k} THEN (SELECT last FROM t{k + 1} t WHERE t.source IS NOT DISTINCT FROM p.source)" for k in range(len(mixing.STRATA) + 1))
    stratum = " ".join(f"WHEN size * {n} > rest THEN {k}" for k, n in enumerate(mixing.STRATA))
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 11))::BIGINT // 4 AS place
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, 2 * source_size AS most, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s0),
s2 AS (SELECT *, sum(most) OVER w - most AS full_before, sum(weight) OVER () - sum(weight) OVER w + weight AS weight_left,
         1.5::DOUBLE * sum(source_size) OVER () AS goal
       FROM s1 WINDOW w AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
s3 AS (SELECT *, (goal - full_before) / weight_left AS level, row_number() OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS k FROM s2),
s4 AS (SELECT arg_min(level, k) FILTER (WHERE most::DOUBLE >= level * weight) AS level FROM s3),
s5 AS (SELECT source, source_size, least(most::DOUBLE, coalesce(s4.level * weight, most::DOUBLE)) AS target FROM s1, s4),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS passes FROM s5),
r AS MATERIALIZED (SELECT *, floor(target - passes * source_size)::BIGINT AS rest FROM s),
q AS MATERIALIZED (SELECT d.*, source_size, target, passes, CASE {stratum} ELSE {len(mixing.STRATA)} END AS stratum FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
p AS MATERIALIZED (SELECT source, stratum, place, sum(size)::BIGINT AS words FROM q WHERE passes < 2 GROUP BY source, stratum, place),
t0 AS (SELECT source, 0::BIGINT AS given FROM r WHERE passes < 2),{"".join(strata)}
g AS MATERIALIZED (SELECT p.*, place <= CASE stratum {edge} END AS front, rest - given AS gap
     FROM p JOIN t{len(strata)} t ON t.source IS NOT DISTINCT FROM p.source JOIN r ON r.source IS NOT DISTINCT FROM p.source),
h AS (SELECT source, arg_min((place, stratum), (abs(gap - CASE WHEN front THEN -words ELSE words END), place, stratum)) AS flip
      FROM g WHERE abs(gap - CASE WHEN front THEN -words ELSE words END) < abs(gap) GROUP BY source)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target,
       q.size * (q.passes + CASE WHEN coalesce(g.front, false) <> coalesce(h.flip = (q.place, q.stratum), false) THEN 1 ELSE 0 END) AS taken
FROM q LEFT JOIN g ON g.source IS NOT DISTINCT FROM q.source AND g.stratum = q.stratum AND g.place = q.place
LEFT JOIN h ON h.source IS NOT DISTINCT FROM q.source
"""


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(base, _is(kind))).cast("long").alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("finds")


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations: the whole against one that takes another conversation's reply and ends."""
    found = preferences.format_preferences(preferences.pairs_by_swap(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


# The pairs are made anew, then both sides are laid beside each other turn by turn: the first
# turn that differs ends the prompt. Places in a completion are sums of the earlier lengths.
OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, min((coalesce(role, 'unknown'), coalesce(text, ''))) AS m FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
t AS (SELECT conv_id, turn, struct_extract_at(m, 1) AS role, struct_extract_at(m, 2) AS text FROM c),
b AS (SELECT conv_id, ('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 15))::BIGINT AS place,
        arg_max(turn, md5(conv_id || ':' || turn)) AS branch, arg_max(text, md5(conv_id || ':' || turn)) AS reply
      FROM t WHERE role = 'assistant' GROUP BY conv_id),
d AS (SELECT conv_id, branch, coalesce(lead(reply) OVER w, first_value(reply) OVER w) AS other FROM b WINDOW w AS (ORDER BY place, conv_id)),
s AS (SELECT t.conv_id, true AS chosen, turn, role, text FROM t JOIN d USING (conv_id)
      UNION ALL SELECT t.conv_id, false, turn, role, CASE WHEN turn = branch THEN other ELSE text END FROM t JOIN d USING (conv_id) WHERE turn <= branch),
x AS (SELECT conv_id, min(turn) AS split FROM (
        SELECT conv_id, turn FROM s GROUP BY conv_id, turn HAVING count(*) < 2 OR min((role, text)) <> max((role, text))) GROUP BY conv_id),
y AS (SELECT s.*, turn // 256 AS page, split IS NULL OR turn < split AS shared, '<|' || role || chr(124) || '>' || chr(10) AS head, '<|end|>' || chr(10) AS tail
      FROM s LEFT JOIN x USING (conv_id)),
z AS (SELECT *, head || text || tail AS line, coalesce(sum(len(head || text || tail)) OVER (PARTITION BY conv_id, page, chosen, shared ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + len(head) AS start FROM y),
m AS (SELECT *, start || ':' || (start + len(text) + len(tail)) AS span, role = 'assistant' AS counts FROM z)
SELECT conv_id AS pair_id, page::BIGINT AS page, count(*) FILTER (WHERE chosen AND shared) AS prefix_turns,
  coalesce(string_agg(line, '' ORDER BY turn) FILTER (WHERE chosen AND shared), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY turn) FILTER (WHERE chosen AND NOT shared), '') AS chosen,
  coalesce(string_agg(line, '' ORDER BY turn) FILTER (WHERE NOT chosen AND NOT shared), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn) FILTER (WHERE chosen AND NOT shared AND counts), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY turn) FILTER (WHERE NOT chosen AND NOT shared AND counts), '') AS rejected_mask
FROM m GROUP BY conv_id, page
"""


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _op8_sql() -> str:
    """The rules, the host graph, and each round of propagation as a table of its own."""
    fits = lambda host, path: f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}'))"
    longest = sorted(url_graph.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    says = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    rounds, before = [], "seeds"
    for turn in range(url_graph.ROUNDS):
        rounds.append(
            f"r{turn} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM ("
            f"SELECT e.kind, e.dst AS host, {1 - url_graph.RESTART} * r.rank * e.share AS rank FROM {before} r JOIN e ON e.kind = r.kind AND e.src = r.host "
            f"UNION ALL SELECT kind, host, {url_graph.RESTART} * rank FROM seeds) GROUP BY kind, host)"
        )
        before = f"r{turn}"
    return rf"""
WITH p0 AS (SELECT page_id, html, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
              regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS MATERIALIZED (SELECT *, CASE {rule} END AS rule, CASE {says} END AS said FROM p0),
linked AS (SELECT DISTINCT host AS src, lower(unnest(regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1))) AS dst FROM p),
hosts AS (SELECT host FROM p UNION SELECT dst FROM linked),
labels AS (SELECT string_split(host, '.') AS l FROM hosts WHERE len(string_split(host, '.')) > 2),
steps AS (SELECT DISTINCT array_to_string(l[k:], '.') AS src, array_to_string(l[k + 1:], '.') AS dst FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM labels)),
edges AS (SELECT DISTINCT * FROM (SELECT * FROM linked UNION ALL SELECT * FROM steps UNION ALL SELECT dst, src FROM steps) WHERE src <> dst AND src <> '' AND dst <> ''),
ways AS (SELECT 'trust' AS kind, src, dst FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges),
e AS MATERIALIZED (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind, src) AS share FROM ways),
s AS (SELECT DISTINCT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host FROM p WHERE said IS NOT NULL AND host <> ''),
seeds AS MATERIALIZED (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS rank FROM s),
{", ".join(rounds)},
scores AS (SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM {before} GROUP BY host)
SELECT page_id, p.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN scores ON scores.host = p.host
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains at least 0.8 of a benchmark item's five-word shingles, with the item."""
    found = decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


OP10_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT side, id, shingle FROM (
  SELECT side, id, unnest(list_transform(range(1, greatest(len(h) - 4, least(len(h), 1)) + 1), lambda k: array_to_string(h[k:k + 4], ' '))) AS shingle FROM w)),
i AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE side = 'i')
SELECT s.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(i.n_item) AS n_item
FROM s JOIN i USING (shingle) WHERE s.side = 'd' GROUP BY s.id, i.id HAVING count(*) >= 0.8 * any_value(i.n_item) - 1e-9
"""


def op11_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight, score and rank in the sample drawn towards the benchmark."""
    found = target_sampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# The checksum goes byte by byte over distinct words, with the usual table of 256 entries.
OP11_SQL = r"""
WITH RECURSIVE t0 AS (SELECT i, i AS c, 0 AS turn FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, turn + 1 FROM t0 WHERE turn < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t0 WHERE turn = 8),
low AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'b', NULL, 0, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
cut AS MATERIALIZED (SELECT side, doc_id, row, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM low),
each AS MATERIALIZED (SELECT side, row, unnest(words) AS word FROM cut),
hexed AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM each)),
sums AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT)),
         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, tab),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM each JOIN sums USING (word) GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM n, a),
w AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS total FROM each JOIN sums USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY row),
d AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features,
        CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features + n_features) % n_features)) // n_features END::BIGINT AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
      FROM cut LEFT JOIN w USING (row) WHERE side = 'd'),
e AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r
"""


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _op12_sql() -> str:
    """Every rule over every text, without an index. Either case is spelled out, for ASCII letters only."""
    either = lambda p: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", p)
    # fixed values: the base rules as the contract gives them
    base = {
        "assign": "(%s)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)" % "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))),
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
    }
    parts = []
    for place, rule in enumerate(secret_scan.RULES):
        more = rule.pattern.replace("'", "''")
        more = either(more[4:].split(" ")[0]) + " " + more.split(" ", 1)[1] if more.startswith("(?i)bearer") else more
        pattern = base.get(rule.kind, more)
        parts.append(
            f"SELECT row, {place} AS place, '{rule.kind}' AS kind, regexp_extract_all(text, '{pattern}', 0) AS hits, "
            f"regexp_extract_all(text, '{pattern}', {rule.group}) AS found, string_split_regex(text, '{pattern}') AS pieces, {rule.least} AS least FROM d"
        )
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
p AS (SELECT row, place, kind, len(found[i]) >= least AS good, len(hits[i]) AS size,
        list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS start FROM i),
s AS (SELECT row, place, kind, start::BIGINT AS start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM p WHERE good),
g AS (SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(span, ',' ORDER BY start, place) FILTER (WHERE place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that match each benchmark item best."""
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH low AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'i', item_id, 0, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
each AS MATERIALIZED (SELECT side, id, row, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
items AS (SELECT DISTINCT id AS item_id, term FROM each WHERE side = 'i'),
a AS (SELECT count(DISTINCT row) AS n_docs, count(*) AS n_all FROM each WHERE side = 'd'),
n AS (SELECT row, 50 + (50 * count(*) * any_value(n_docs)) // any_value(n_all) AS m FROM each, a WHERE side = 'd' GROUP BY row),
tf AS (SELECT row, id, term, count(*) AS tf FROM each WHERE side = 'd' AND term IN (SELECT term FROM items) GROUP BY row, id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, a GROUP BY term),
s AS (SELECT item_id, row, id AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM tf JOIN n USING (row) JOIN w USING (term) JOIN items USING (term) GROUP BY item_id, row, id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def queries() -> dict[str, Query]:
    return {
        "op1_language": op1_language,
        "op2_flac": op2_flac,
        "op3_quality": op3_quality,
        "op4_mixture": op4_mixture,
        "op5_personal_data": op5_personal_data,
        "op6_licenses": op6_licenses,
        "op7_preferences": op7_preferences,
        "op8_urls": op8_urls,
        "op9_simhash": op9_simhash,
        "op10_decontamination": op10_decontamination,
        "op11_target_sampling": op11_target_sampling,
        "op12_secrets": op12_secrets,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixture": _op4_sql(),
        "op7_preferences": OP7_SQL,
        "op8_urls": _op8_sql(),
        "op10_decontamination": OP10_SQL,
        "op11_target_sampling": OP11_SQL,
        "op12_secrets": _op12_sql(),
        "op13_ranked_search": OP13_SQL,
    }
