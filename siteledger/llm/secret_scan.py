"""Secrets in texts by rules, found through an index of trigrams, with built-in functions only.

For every rule's pattern a Boolean query over trigrams is derived: what any match must
hold, in lower case. One pass over the texts writes the postings (trigram, text) of all
trigrams the rules ask for; a rule that no trigram is mandatory for has a list of its
own, filled by running its pattern over every text. Postings of the rarest trigrams of each
conjunction are intersected, and the texts that remain are verified with the patterns.

Postings name a text by a 64-bit hash. Two texts with one hash share their postings, which
can only add candidates; verification and the way back to the rows use the whole text
and its SHA-256.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, sent_if_small, shared_folder
from .pii import _once, _running

#: Trigrams of a conjunction whose postings are read, the rarest ones.
RAREST = 4
#: Strings of an expression that are told apart while its trigrams are derived.
TOLD_APART = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    ``held`` is an expression that texts with such a match meet, for rules that are run
    over every text; the pattern itself by default.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False
    held: str = ""


# The base rules, then published token formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True, "[0-9a-f]{24}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("mailgun", r"key-[0-9a-f]{32}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36,}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{32,}"),
    Rule("model_hub", r"hf_[A-Za-z0-9]{30,}"),
    Rule("session_access", r"ASIA[A-Z0-9]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i)bearer [A-Za-z0-9_.=-]{20,}"),
    Rule("url_login", r"://[A-Za-z0-9._-]{1,64}:[^@:/?#\x00-\x20]{3,64}@[A-Za-z0-9]"),
    Rule("bot", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33,}"),
    Rule("call_service", r"(AC|SK)[0-9a-f]{32,}"),
)


# ---- trigram queries -------------------------------------------------------------------

Query = frozenset  # of conjunctions, each a frozenset of trigrams; an empty conjunction means any text
ANY: Query = frozenset([frozenset()])


def _either(a: Query, b: Query) -> Query:
    """a OR b, without conjunctions that another one implies."""
    every = a | b
    return frozenset(c for c in every if not any(o < c for o in every))


def _both(a: Query, b: Query) -> Query:
    every = frozenset(x | y for x, y in product(a, b))
    # Trading a condition for any text only makes the query weaker, never wrong.
    return _either(every, every) if len(every) <= 4 * TOLD_APART else a


def _of_strings(strings: frozenset[str]) -> Query:
    """What a text that holds one of the strings holds."""
    grams = [frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings]
    return reduce(_either, grams)


@dataclass(frozen=True)
class _Part:
    """What matches of an expression look like: all of them if few, else how they begin and end, and a query."""

    begins: frozenset[str]
    ends: frozenset[str]
    query: Query = ANY
    exact: bool = True

    def query_of_all(self) -> Query:
        return _both(self.query, _of_strings(self.begins)) if self.exact else self.query

    def loose(self) -> _Part:
        """The same, known by its ends only."""
        if not self.exact:
            return self
        return _Part(frozenset(s[:2] for s in self.begins), frozenset(s[-2:] for s in self.ends), self.query_of_all(), False)


def _exact(strings) -> _Part:
    strings = frozenset(strings)
    return _Part(strings, strings)


_UNKNOWN = _Part(frozenset([""]), frozenset([""]), ANY, False)


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact and b.exact and len(a.begins) * len(b.begins) <= TOLD_APART:
        return _exact(x + y for x, y in product(a.begins, b.begins))
    meeting = frozenset(x[-2:] + y[:2] for x, y in product(a.ends, b.begins))
    query = _both(a.query_of_all(), b.query_of_all())
    if len(meeting) <= TOLD_APART:
        query = _both(query, _of_strings(meeting))
    begins = frozenset((x + y)[:2] for x, y in product(a.begins, b.begins)) if a.exact else a.loose().begins
    ends = frozenset((x + y)[-2:] for x, y in product(a.ends, b.ends)) if b.exact else b.loose().ends
    return _Part(begins, ends, query, False)


def _one_of(parts: list[_Part]) -> _Part:
    if all(p.exact for p in parts) and sum(len(p.begins) for p in parts) <= TOLD_APART:
        return _exact(s for p in parts for s in p.begins)
    loose = [p.loose() for p in parts]
    return _Part(frozenset().union(*[p.begins for p in loose]), frozenset().union(*[p.ends for p in loose]), reduce(_either, [p.query for p in loose]), False)


def _characters(items) -> _Part:
    found = set()
    for name, value in items:
        if str(name) == "LITERAL":
            found.add(chr(value).lower())
        elif str(name) == "RANGE" and value[1] - value[0] < TOLD_APART:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return _UNKNOWN
    return _exact(found) if len(found) <= TOLD_APART // 2 else _UNKNOWN


def _part(node) -> _Part:
    """One element of a parsed expression."""
    name, value = str(node[0]), node[1]
    if name == "LITERAL":
        return _exact([chr(value).lower()])
    if name == "IN":
        return _characters(value)
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "BRANCH":
        return _one_of([_sequence(branch) for branch in value[1]])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        part = _sequence(inner)
        if least == 0:
            return _one_of([_exact([""]), part]) if most == 1 else _UNKNOWN
        once = reduce(_joined, [part] * min(int(least), 3))
        return once if least == most and least <= 3 else once.loose()
    if name == "AT":
        return _exact([""])
    return _UNKNOWN


def _sequence(nodes) -> _Part:
    return reduce(_joined, map(_part, nodes), _exact([""]))


def trigram_query(pattern: str) -> Query:
    """What every match holds: one of the conjunctions of lower-case trigrams; ``ANY`` if none is mandatory.

    Only ASCII trigrams are used, which lower case leaves alone.
    """
    parsed = re._parser.parse(pattern)  # the standard library's own reading of the expression
    found = _sequence(parsed).query_of_all()
    plain = frozenset(frozenset(t for t in c if t.isascii()) for c in found)
    return _either(plain, plain) if all(plain) else ANY


# ---- index and search ------------------------------------------------------------------


def write_index(texts: DataFrame, rules: tuple[Rule, ...], folder: str) -> None:
    """Postings (gram, h) of ``texts`` (column text) as a table ordered by gram within its files.

    A rule without mandatory trigrams has postings under its kind between asterisks.
    """
    queries = {rule: trigram_query(rule.pattern) for rule in rules}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    scanned = [rule for rule, q in queries.items() if q == ANY]
    lists = [F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(low, g)))[0]] if grams else []
    for rule in scanned:
        lists.append(F.when(F.col("text").rlike(rule.held or rule.pattern), F.array(F.lit(f"*{rule.kind}*"))).otherwise(F.array().cast("array<string>")))
    rows = texts.where("text is not null").select(F.xxhash64("text").alias("h"), F.explode(F.concat(*lists)).alias("gram"))
    rows.sortWithinPartitions("gram").write.parquet(folder)


def candidates(spark: SparkSession, rules: tuple[Rule, ...], folder: str) -> DataFrame:
    """(h, found): texts that meet a rule's trigram query, with the places of these rules in ``rules``."""
    index = spark.read.schema("gram string, h bigint").parquet(folder)
    held = {r["gram"]: r["n"] for r in index.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    asked = []
    for place, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        parts = [frozenset([f"*{rule.kind}*"])] if query == ANY else query
        for number, part in enumerate(sorted(map(sorted, parts))):
            rarest = sorted(part, key=lambda g: (held.get(g, 0), g))[:RAREST]
            if all(g in held for g in rarest):
                asked += [(gram, place, number, 1 << bit, (1 << len(rarest)) - 1) for bit, gram in enumerate(rarest)]
    terms = spark.createDataFrame(asked, "gram string, rule int, part int, bit int, all int")
    postings = index.where(F.col("gram").isin(sorted({a[0] for a in asked})))
    # A few hundred rows at most, as many as the rules have trigrams.
    met = postings.join(F.broadcast(terms), "gram").groupBy("h", "rule", "part", "all").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = all").groupBy("h").agg(F.collect_set("rule").alias("found"))


SPANS = "array<struct<start:bigint,place:int,kind:string,end:bigint,value:string,base:boolean>>"


def _spans(text: Column, rule: Column) -> Column:
    """Spans of one rule in a text; both are evaluated where they are bound, once."""

    def cut(m: Column) -> Column:
        lengths = F.zip_with(F.slice(m["pieces"], 1, F.size(m["hits"])), m["hits"], lambda p, h: (F.length(p) + F.length(h)).cast("long"))

        def placed(offsets: Column) -> Column:
            def span(hit: Column, i: Column) -> Column:
                start = (F.get(offsets, i) + F.length(F.get(m["pieces"], i))).cast("long")
                long_enough = F.length(F.get(m["values"], i)) >= rule["least"]
                made = F.struct(
                    start.alias("start"),
                    rule["place"].alias("place"),
                    rule["kind"].alias("kind"),
                    (start + F.length(hit)).alias("end"),
                    hit.alias("value"),
                    rule["base"].alias("base"),
                )
                return F.when(long_enough, made)

            return F.transform(m["hits"], span)

        return F.transform(F.array(_running(lengths)), placed)[0]

    matched = F.struct(
        F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, rule["pattern"], rule["group"]).alias("values"),
        F.split(text, rule["pattern"], F.lit(-1)).alias("pieces"),
    )
    found = F.transform(F.array(matched), lambda m: F.when(F.size(m["hits"]) > 0, cut(m)))[0]
    return F.coalesce(F.filter(found, lambda s: s.isNotNull()), F.array().cast(SPANS))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; spans are structs of start, place, kind, end, value and base.

    ``place`` is the rule's place in ``rules``; spans are in the order of start, then place.
    Places count code points, ends are exclusive, and spans of different kinds may overlap.
    Null and empty texts have no spans; repeated rows and null ids keep their rows. Other
    columns are not read. An index of the texts is written to the shared folder.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/secret-scan-{uuid.uuid4().hex}"
    rows = narrow(docs, doc_id=id_col, text=text_col)
    write_index(rows.select("text"), rules, f"{folder}/index")
    candidates(spark, rules, f"{folder}/index").write.parquet(f"{folder}/candidates")
    chosen = spark.read.schema("h bigint, found array<int>").parquet(f"{folder}/candidates")

    listed = F.array(*[F.struct(F.lit(n).alias("place"), *[F.lit(getattr(r, c)).alias(c) for c in ("kind", "pattern", "least", "group", "base")]) for n, r in enumerate(rules)])
    asked = F.filter(listed, lambda r: F.array_contains("found", r["place"]))
    met = rows.where("text is not null").select(F.xxhash64("text").alias("h"), "text").join(sent_if_small(chosen), "h")
    spans = F.array_sort(F.flatten(F.transform(asked, lambda r: _spans(F.col("text"), r))))
    verified = met.select(F.sha2("text", 256).alias("key"), _once(spans).alias("spans")).where(F.size("spans") > 0)
    verified.dropDuplicates(["key"]).write.parquet(f"{folder}/verified")
    verified = spark.read.schema(f"key string, spans {SPANS}").parquet(f"{folder}/verified")

    keyed = rows.select("doc_id", F.sha2("text", 256).alias("key"))
    found = keyed.join(sent_if_small(verified), "key", "left")
    return found.select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
