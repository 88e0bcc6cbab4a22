"""Personal data by weak supervision, with built-in functions only.

Patterns propose spans. Labelers vote on each: its shape (regex), word and number lists
(gazetteer), and the text around it (context). Expectation-maximisation over the counts of
vote combinations estimates how reliable each labeler is; the posteriors are soft labels
for a naive Bayes classifier on features of the span itself, which has the last word on
proposals that do not meet the strict definition of their kind. Strict spans always stay.

The counts cover all documents; the model is a table of a few hundred numbers at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, narrow

KINDS = ("email", "ip", "card", "phone", "secret", "name")
FOR, AGAINST, NONE = 1, 0, 2
ROUNDS = 25
#: Spans with at least this score are personal data.
THRESHOLD = 0.5

# Number and word lists of the labelers.
TOP_DOMAINS = "com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|eu|ch|at|us"
ISSUER_PREFIX = "^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
CALLING_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SURNAMES = "smith|johnson|brown|jones|garcia|miller|davis|martin|müller|schmidt|schneider|fischer|weber|dubois|bernard|durand|moreau|lópez|gonzález|rodríguez|fernández"
CUES = {
    "email": "mail|correo|contact|kontakt|courriel",
    "ip": r"\bip\b|address|server|host|adresse|from",
    "card": "card|visa|credit|karte|tarjeta|carte|payment",
    "phone": "tel|phone|call|fax|mobile|móvil|handy|numéro",
    "secret": "token|key|secret|passw|pwd|bearer|credential",
    "name": "name|dear|contact|nombre|nom|sincerely",
}


@dataclass(frozen=True)
class Pattern:
    """``found`` proposes spans; texts without ``hint`` (a plain regex) are skipped."""

    kind: str
    hint: str
    found: str
    strict: bool


# A run is only entered at its first character or where the last match ended, and groups
# repeat possessively: the same matches, without stepping back through long runs.
PATTERNS = (
    Pattern("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True),
    Pattern("ip", r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True),
    Pattern("card", "[0-9](?:[ -]?[0-9]){12}", "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", True),
    Pattern("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", True),
    Pattern("email", "[(\\[]at[)\\]]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++ ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z]++", False),
    Pattern("phone", "[0-9]{3}[-. ][0-9]{4}", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9-])", False),
    Pattern("secret", "[\"'][A-Za-z0-9+/_=-]{20}", "(?<=[\"'])[A-Za-z0-9+/_=-]{20,}+(?=[\"'])", False),
    Pattern("name", "Mrs?|Ms|Dr|Herr|Frau|Señora?|Madame|Monsieur", r"(?<![\p{L}\p{N}])(?:Mrs?|Ms|Dr|Herrn?|Frau|Señora?|Madame|Monsieur)\.? \p{Lu}\p{Ll}+", False),
)


def _running(lengths: Column) -> Column:
    """Sum of all earlier entries, for each entry; in runs of 256, so that cost grows with length."""

    def sums(values: Column, start: Column) -> Column:
        begin = F.struct(start.cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, begin, lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")), lambda a: a["out"])

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 256).cast("int")), lambda c: F.slice(lengths, c * 256 + 1, 256))
    totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(runs, sums(totals, F.lit(0)), sums))


def _once(value: Column) -> Column:
    """The value itself, made where it stands: a later filter on it is not pushed below, which
    would repeat the long expression many times over."""
    return F.explode_outer(F.array(value))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x) % 10 == 0


def meets_definition(kind: Column, value: Column) -> Column:
    """Whether a match of a kind's strict pattern is a span: parts at most 255, Luhn, 9 to 15 digits."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", _luhn(value))
        .when(kind == "phone", F.length(_digits(value)).between(9, 15))
        .otherwise(F.lit(False))
    )


def _votes(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """Votes of the four labelers: shape, gazetteer, cue words, edges."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, FOR).when(no, AGAINST).otherwise(NONE)

    digits = F.length(_digits(value))
    shape = (
        F.when(kind == "card", vote(_luhn(value), F.lit(True)))
        .when(kind == "phone", vote(digits.between(9, 15), F.lit(True)))
        .when(kind == "secret", vote(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), F.lit(True)))
        .when(kind == "name", vote(F.length(value) >= 6, F.lit(True)))
        .when(kind == "ip", vote(meets_definition(kind, value), F.lit(True)))
        .otherwise(vote(value.rlike(r"\.[A-Za-z]{2,}$"), value.rlike("[0-9]$")))
    )
    lower = F.lower(value)
    listed = (
        F.when(kind == "card", vote(_digits(value).rlike(ISSUER_PREFIX), F.lit(True)))
        .when(kind == "phone", vote(value.rlike(CALLING_CODE), F.lit(False)))
        .when(kind == "email", vote(lower.rlike(rf"[.) ](?:{TOP_DOMAINS})$"), F.lit(False)))
        .when(kind == "name", vote(lower.rlike(rf"(?:{SURNAMES})$"), F.lit(False)))
        .when(kind == "ip", vote(~value.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\."), F.lit(True)))
        .otherwise(vote(value.rlike("^[0-9a-f]{32,}$"), F.lit(False)))
    )
    cue = F.lit(False)
    for name, words in CUES.items():
        cue = F.when(kind == name, F.lower(before).rlike(words)).otherwise(cue)
    context = vote(cue, F.lit(False))
    edges = vote(~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]"), F.lit(True))
    return F.array(*[v.cast("int") for v in (shape, listed, context, edges)])


def _features(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """Names of the classifier's features; each has a few values."""
    size, digits = F.length(value), F.length(_digits(value))
    side = lambda c: F.when(c == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike(r"[\p{L}\p{N}]"), "word").otherwise("mark")
    parts = {
        "size": F.least(F.floor(F.log2(size.cast("double"))), F.lit(8)).cast("string"),
        "digits": F.floor(digits * 4 / size).cast("string"),
        "first": F.when(value.rlike("^[0-9]"), F.substring(value, 1, 1)).when(value.rlike(r"^\p{L}"), F.lit("letter")).otherwise(F.lit("mark")),
        "gaps": value.rlike("[ -]").cast("string"),
        "before": side(F.right(before, F.lit(1))),
        "after": side(F.left(after, F.lit(1))),
    }
    return F.array(F.concat(kind, F.lit("|prior")), *[F.concat_ws("|", kind, F.lit(n), v) for n, v in parts.items()])


def _matches(rows: DataFrame, text: str, pattern: Pattern) -> tuple[DataFrame, Column]:
    """Adds the text's pieces around the matches and the matches; and the array of spans made from them."""
    seen = F.col(text).rlike(pattern.hint)
    rows = rows.withColumn("hit", F.when(seen, F.regexp_extract_all(text, F.lit(pattern.found), F.lit(0))))
    rows = rows.withColumn("piece", F.when(F.size("hit") > 0, F.split(F.col(text), pattern.found, -1)))
    lengths = F.zip_with(F.slice("piece", 1, F.size("hit")), "hit", lambda p, h: (F.length(p) + F.length(h)).cast("long"))
    rows = rows.withColumn("lengths", lengths)
    rows = rows.withColumn("offset", F.when(F.size("hit") > 0, _running(F.col("lengths"))))

    def span(hit: Column, i: Column) -> Column:
        start = F.get(F.col("offset"), i) + F.length(F.get(F.col("piece"), i))
        return F.struct(
            F.lit(pattern.kind).alias("kind"),
            start.alias("start"),
            (start + F.length(hit)).alias("end"),
            hit.alias("value"),
            F.right(F.get(F.col("piece"), i), F.lit(40)).alias("before"),
            F.left(F.get(F.col("piece"), i + 1), F.lit(8)).alias("after"),
            F.lit(pattern.strict).alias("strict"),
        )

    spans = F.when(F.size("hit") > 0, F.transform("hit", span)).otherwise(F.array().cast(SPANS))
    return rows, spans


SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string,strict:boolean>>"


def with_proposals(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``proposals``, the spans of all patterns with ``strict`` true where the kind's definition is met.

    Loose proposals that touch a strict span are left out; those of a strict pattern that
    fail its definition remain only where their shape leaves a doubt (cards).
    """
    kept = rows.columns
    for n, pattern in enumerate(PATTERNS):
        rows, spans = _matches(rows, text, pattern)
        rows = rows.select(*kept, spans.alias(f"spans_{n}"))
        if pattern.strict:
            judged = F.transform(f"spans_{n}", lambda s: s.withField("strict", meets_definition(s["kind"], s["value"])))
            if pattern.kind != "card":
                judged = F.filter(judged, lambda s: s["strict"])
            rows = rows.withColumn(f"spans_{n}", F.when(F.size(f"spans_{n}") > 0, judged).otherwise(F.col(f"spans_{n}")))
        kept = rows.columns
    arrays = [n for n in kept if n.startswith("spans_")]
    strict = [n for n in arrays if PATTERNS[int(n[6:])].strict]
    rows = rows.withColumn("base", F.filter(F.concat(*strict), lambda s: s["strict"]))
    rows = rows.withColumn("loose", F.concat(F.filter(F.concat(*strict), lambda s: ~s["strict"]), *[n for n in arrays if n not in strict]))
    apart = F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    loose = F.when((F.size("loose") > 0) & (F.size("base") > 0), apart).otherwise(F.col("loose"))
    return rows.withColumn("proposals", _once(F.concat("base", loose))).drop(*arrays, "base", "loose")


def _em(counts: DataFrame) -> DataFrame:
    """(kind, votes, posterior): Dawid-Skene with two classes over the counts of vote combinations.

    ``counts`` hold kind, votes and n; there are at most 3**4 combinations of a kind.
    """
    labelers, smooth = 4, 1.0
    table = F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("p")
    per_kind = counts.groupBy("kind").agg(table)
    start = F.array(*[F.array(*[F.array(F.lit(0.1), F.lit(0.7), F.lit(0.2)), F.array(F.lit(0.6), F.lit(0.2), F.lit(0.2))]) for _ in range(labelers)])

    def posterior(votes: Column, state: Column) -> Column:
        logit = F.log(state["prior"] / (1 - state["prior"]))
        for m in range(labelers):
            rate = state["rates"][m]
            logit = logit + F.log(rate[0][votes[m]] / rate[1][votes[m]])
        return 1 / (1 + F.exp(-logit))

    def step(state: Column, _: Column) -> Column:
        soft = F.transform("p", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * posterior(x["votes"], state)).alias("yes")))
        return _maximised(soft)

    def _maximised(soft: Column) -> Column:
        def mass(wanted, of_class: int, m: int | None, v: int | None) -> Column:
            def add(a: Column, x: Column) -> Column:
                amount = x["yes"] if of_class == 0 else x["n"] - x["yes"]
                return a + (amount if m is None else F.when(x["votes"][m] == v, amount).otherwise(0.0))

            return F.aggregate(wanted, F.lit(0.0), add)

        def rates(s: Column) -> Column:
            rows = []
            for m in range(labelers):
                rows.append(F.array(*[F.array(*[(mass(s, c, m, v) + smooth) / (mass(s, c, None, None) + 3 * smooth) for v in range(3)]) for c in range(2)]))
            yes, no = mass(s, 0, None, None), mass(s, 1, None, None)
            return F.struct(((yes + smooth) / (yes + no + 2 * smooth)).alias("prior"), F.array(*rows).alias("rates"))

        # one evaluation of the soft labels: bind them through a one-element array
        return F.transform(F.array(soft), rates)[0]

    begin = F.struct(F.lit(0.5).alias("prior"), start.alias("rates"))
    fitted = per_kind.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step))
    scored = F.transform("p", lambda x: F.struct(x["votes"].alias("votes"), posterior(x["votes"], F.col("state")).alias("posterior")))
    return fitted.select("kind", "state", F.explode(scored).alias("x")).select("kind", "state", "x.*")


def train(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Log odds of each feature of the span classifier; counts cover all proposals of ``docs``."""
    rows = with_proposals(narrow(docs, text=text_col).where("text is not null"), "text")
    each = rows.select(F.explode_outer("proposals").alias("s")).where("s is not null").select("s.kind", "s.value", "s.before", "s.after")
    each = durable(each)  # the votes read the short proposals; the texts are done with
    parts = [F.col(c) for c in ("kind", "value", "before", "after")]
    seen = durable(each.select("kind", _votes(*parts).alias("votes"), _features(*parts).alias("features")).groupBy("kind", "votes", "features").agg(F.count("*").alias("n")))
    posteriors = _em(seen.groupBy("kind", "votes").agg(F.sum("n").alias("n"))).drop("state")
    soft = seen.join(posteriors, ["kind", "votes"]).select(F.explode("features").alias("feature"), "n", "posterior")
    sums = soft.groupBy("feature").agg(F.sum(F.col("n") * F.col("posterior")).alias("yes"), F.sum("n").alias("n")).collect()
    found = {r["feature"]: (r["yes"], r["n"] - r["yes"]) for r in sums}
    model = {}
    for name, (yes, no) in found.items():
        total = found[f"{name.split('|')[0]}|prior"]
        odds = (yes + 0.5) / (no + 0.5)
        model[name] = odds if name.endswith("|prior") else odds * (total[1] + 1) / (total[0] + 1)
    return {name: round(float(math.log(odds)), 9) for name, odds in model.items()}




def _score(span: Column, model: dict[str, float]) -> Column:
    if not model:
        return F.lit(0.0)
    weights = F.create_map(*[F.lit(x) for pair in sorted(model.items()) for x in pair])
    features = _features(span["kind"], span["value"], span["before"], span["after"])
    logit = F.aggregate(features, F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(weights, f), F.lit(0.0)))
    return 1 / (1 + F.exp(-logit))


def personal_data(docs: DataFrame, model: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; spans are structs of kind, start, end, value, base and score.

    Places count code points, ends are exclusive. ``base`` marks the spans that meet a
    strict definition; the others were added by the classifier. They are in the order of
    kind, then start. Null and empty texts have no spans; repeated rows and null ids keep
    their rows. ``model`` defaults to one trained on ``docs``.
    """
    model = train(docs, text_col) if model is None else model
    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_proposals(rows, "text").select("doc_id", "proposals")

    def judged(s: Column) -> Column:
        return F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("order"),
            *[s[c].alias(c) for c in ("start", "end", "kind", "value")],
            s["strict"].alias("base"),
            _score(s, model).alias("score"),
        )

    spans = F.array_sort(F.filter(F.transform("proposals", judged), lambda s: s["base"] | (s["score"] >= THRESHOLD)))
    spans = F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value", "base", "score")]))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,base:boolean,score:double>>")
    return rows.select("doc_id", F.when(F.size("proposals") > 0, spans).otherwise(empty).alias("spans"))


def _cleaner(pattern: Pattern, model: dict[str, float]):
    """What stands for a span in redacted text."""

    def cleaned(s: Column) -> Column:
        sure = meets_definition(s["kind"], s["value"]) if pattern.strict else F.lit(False)
        doubtful = F.lit(pattern.kind == "card" or not pattern.strict) & (_score(s, model) >= THRESHOLD)
        return F.when(sure | doubtful, F.lit(f"<{pattern.kind.upper()}>")).otherwise(s["value"])

    return cleaned


def redact(docs: DataFrame, model: dict[str, float] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets, all columns kept.

    Patterns are applied one after the other to what the last has left, so spans of
    different kinds never overlap. Null texts stay null.
    """
    model = train(docs, text_col) if model is None else model
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    for pattern in PATTERNS:
        rows, spans = _matches(rows, "text", pattern)
        rows = rows.withColumn("found", spans)

        joined = F.array_join(F.zip_with("piece", F.concat(F.transform("found", _cleaner(pattern, model)), F.array(F.lit(""))), lambda p, v: F.concat(p, v)), "")
        rows = rows.select("row", _once(F.when(F.size("hit") > 0, joined).otherwise(F.col("text"))).alias("text"))
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns])
