"""Search against a direct evaluation in Python, and the shape of its plans."""

import random

import pytest
from pyspark.sql import functions as F

from quillmap.functions import matching as m
from quillmap.functions.questions import FILTERS
from quillmap.operators import search
from quillmap.operators.questions import with_filter_key

RULES = (
    "source string, module string, source_name string, vendor string, file_stem string, row_no bigint,"
    " dimension string, field string, expression string"
)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    rows = []
    for folder in range(12):
        levels = (
            rng.choice(["RA", "FMS", "Rating"]), rng.choice(["UC", "CRM", "crm x"]),
            rng.choice(["MSC", "IN ADJ", "CCN"]), f"{rng.choice(['Nokia', 'Ericsson', 'Huawei'])}{folder}",
        )
        for file in range(rng.randint(1, 3)):
            stem = f"LdRules_{rng.choice(['DU', 'Airtel', 'Zain KSA', ''])}_{levels[2]}_{file}"
            for row_no in range(3, rng.randint(4, 40)):
                field = rng.choice(["event_type", "Event Type", "customer_id", "customer", "msisdn", "imsi number", "call start time"])
                rows.append((*levels, stem, row_no, rng.choice(["Dim.", "Meas."]), field, rng.choice(["a+b", "n/a", "sum(x)", " c "])))
    # a key that holds a third of all rows
    rows += [("RA", "UC", "MSC", "Nokia0", "LdRules_DU_MSC_hot", i, "Dim.", "hot_field", f"e{i}") for i in range(3, len(rows) // 2)]
    rows = list({(*r[:4], r[4], r[5]): r for r in rows}.values())
    values = {
        "field": ["event_type", "customer", "msisdm", "start call time", "hot field", "zzz"],
        "dimension": ["dim", "meas"], "source": ["ra", "f"], "module": ["crm", "UC"], "source_name": ["msc", "in"],
        "vendor": ["nokia", "nokia1 or huawei", "x and ericsson", ""], "operator": ["du", "air", "zain ksa_du"],
    }
    asked = [tuple(None if rng.random() < 0.6 else rng.choice(values[f]) for f in FILTERS) for _ in range(60)]
    asked.append((None,) * len(FILTERS))
    asked.append(("event_type",) + (None,) * 6)
    questions = spark.createDataFrame(
        [(i, *a) for i, a in enumerate(asked)], "question_id bigint, " + ", ".join(f"{f} string" for f in FILTERS)
    )
    keys = {r.question_id: r.filter_key for r in with_filter_key(questions).collect()}
    rules = spark.createDataFrame(rows, RULES).repartition(8)
    return {"rows": rows, "asked": asked, "keys": keys, "questions": questions, "rules": rules}


@pytest.fixture(scope="module")
def expected(spark, case):
    """filter_key -> ranked list of results, straight from the definition."""
    invalid = {"n/a", "-", ""}
    rows = [(*r[:8], r[8].strip()) for r in case["rows"] if r[8].strip().lower() not in invalid]
    count = {}
    for r in rows:
        count[(*r[:4], r[6], r[7])] = count.get((*r[:4], r[6], r[7]), 0) + 1
    fields = sorted({(a[0], r[7]) for a in case["asked"] for r in rows if a[0]})
    table = spark.createDataFrame(fields, "q string, t string")
    match = m.field_match(m.normalise_name(F.col("q")), m.normalise_name(F.col("t")))
    scored = {(r.q, r.t): (r.m.score, r.m.match_type) for r in table.select("q", "t", match.alias("m")).collect()}
    stems = spark.createDataFrame(sorted({(r[4], r[2], r[3]) for r in rows}), "f string, s string, v string")
    operators = {
        (r.f, r.s, r.v): r.o
        for r in stems.withColumn("o", m.operator_from_filename(F.col("f"), F.col("s"), F.col("v"))).collect()
    }
    import re

    out = {}
    for i, a in enumerate(case["asked"]):
        f = dict(zip(FILTERS, a))
        hits = []
        for r in rows:
            names = dict(zip(("source", "module", "source_name"), r[:3]), dimension=r[6])
            if any(f[n] and f[n].lower() not in text.lower() for n, text in names.items()):
                continue
            if f["vendor"] and not any(v.strip() in r[3].lower() for v in re.split(r"\s+or\s+|\s+and\s+", f["vendor"].lower())):
                continue
            score, kind = scored[(f["field"], r[7])] if f["field"] else (1.0, "no_filter")
            if score < 0.4:
                continue
            operator = operators[(r[4], r[2], r[3])]
            if f["operator"] and not (f["operator"].lower() in operator.lower() or operator.lower() in f["operator"].lower()):
                continue
            confidence = score * 0.7 + min(count[(*r[:4], r[6], r[7])] / 5, 1.0) * 0.3
            hits.append((*r[:4], r[6], r[7], r[8], r[4], operator, confidence, score, kind, r[5]))
        hits.sort(key=lambda h: (-h[9], h[8], h[7], *h[:6], h[12], h[6]))
        out[case["keys"][i]] = hits
    return out


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.filter_key, []).append(tuple(r[c] for c in (*search.RESULT, "row_no")))
    return out


def test_all_results_in_order(case, expected):
    matches = search.search(case["questions"], case["rules"])
    got = _found(search.rank_results(search.results(matches, case["rules"])))
    assert got == {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("n", [1, 7, 50])
def test_top_results(case, expected, n):
    matches = search.search(case["questions"], case["rules"])
    top = search.top_results(matches, case["rules"], n).orderBy("filter_key", "rank")
    assert _found(top) == {k: v[:n] for k, v in expected.items() if v}


def test_summary(case, expected):
    matches = search.search(case["questions"], case["rules"])
    summary = search.result_summary(with_filter_key(case["questions"]).distinct(), matches).distinct()
    got = {r.filter_key: r for r in summary.collect()}
    assert set(got) == set(expected)
    for key, hits in expected.items():
        shown = [h[9] for h in hits[:50]]
        row = got[key]
        assert (row.total, row.shown, row.high_confidence) == (len(hits), len(shown), sum(c >= 0.7 for c in shown))
        assert row.mean_confidence == (pytest.approx(sum(shown) / len(shown)) if shown else None)


def test_one_question_equals_many(case, expected):
    one = case["questions"].where("question_id = 61")
    got = _found(search.rank_results(search.results(search.search(one, case["rules"]), case["rules"])))
    key = case["keys"][61]
    assert got == {key: expected[key]}


def test_without_broadcasts(spark, case, expected):
    """Beyond the size Spark broadcasts, the same joins run as shuffles."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        matches = search.search(case["questions"], case["rules"])
        plan = _plan(matches)
        assert "SortMergeJoin" in plan and "BroadcastNestedLoopJoin" not in plan
        assert _found(search.rank_results(search.results(matches, case["rules"]))) == {k: v for k, v in expected.items() if v}
        top = search.top_results(matches, case["rules"]).orderBy("filter_key", "rank")
        assert _found(top) == {k: v[:50] for k, v in expected.items() if v}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_compare_no_two_sides_in_full(case):
    matches = search.search(case["questions"], case["rules"])
    for df in (matches, search.results(matches, case["rules"]), search.top_results(matches, case["rules"])):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in _plan(search.top_results(matches, case["rules"]))
