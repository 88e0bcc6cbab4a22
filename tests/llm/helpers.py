"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

LONG = "alpha beta gamma delta epsilon " * 20000
EDGE = [(None, "alpha beta gamma"), (1, None), (2, ""), (3, " \t\n"), (4, "alpha"), (4, "alpha"), (5, LONG), (6, "no letters? 12")]
#: Names that operators use inside.
CLASH = "h k t row fp size place text_hash shingle copies hit piece spans media box key".split()


def edge_docs(spark, rows=EDGE):
    full = [(i, t, "en", "s", *[f"{c}-{i}" for c in CLASH]) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def docs(spark, *texts, first=0):
    return spark.createDataFrame([(first + n, t) for n, t in enumerate(texts)], "doc_id bigint, text string")


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(word in plan for word in ("Python", "Pandas", "Arrow"))
