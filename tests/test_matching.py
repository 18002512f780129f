import random

import pytest
from pyspark.sql import functions as F

from quillmap.functions import matching as m
from quillmap.operators.names import containment_pairs, similar_pairs

SCORES = [
    ("event_type", "event_type", 1.0, "exact"),
    ("event_type", "Event Type", 0.95, "underscore_space_variation"),
    ("event type", "event_type", 0.95, "underscore_space_variation"),
    ("cust", "custid", 0.85, "prefix"),
    ("customer", "customer_id", 0.85, "prefix"),
    ("email", "primary_email", 0.7, "contains"),
    ("id", "customer_id", 0.0, "no_match"),
    ("call start time", "start time call", 0.6, "word_similarity"),
    ("call_start_time", "start call time zone", 0.6, "word_similarity"),
    ("a_b c", "a b_c", 0.6, "word_similarity"),
    ("_abc", "abc_", 0.6, "word_similarity"),
    ("a b c", "c b a d e", 0.4, "partial_word_similarity"),
    ("acount_number", "account_number", 0.5, "levenshtein_close"),
    ("msisdn", "msisdm", 0.5, "levenshtein_close"),
    ("imsi", "imei", 0.3, "levenshtein_partial"),
    ("abcdefghij", "abcdefghxy", 0.3, "levenshtein_partial"),
    ("small ring", "small bolt", 0.0, "no_match"),
    ("xyz", "abc", 0.0, "no_match"),
    (" ", "ab", 0.85, "prefix"),
]


def test_field_match(spark):
    table = spark.createDataFrame([(q, t) for q, t, _, _ in SCORES], "q string, t string")
    match = m.field_match(m.normalise_name(F.col("q")), m.normalise_name(F.col("t")))
    got = [(r.q, r.t, r.m.score, r.m.match_type) for r in table.select("q", "t", match.alias("m")).collect()]
    assert got == SCORES


OPERATORS = [
    ("OBF_LdRules_M32_IN_OUT_ADJ_AIR_ERC", "IN ADJUSTMENTS CDRs", "Ericsson", "OBF_M32_OUT_AIR_ERC"),
    ("LdRules_DU Dubai_CRM_INHOUSE", "CRM SUBS", "Others", "DU_Dubai_INHOUSE"),
    ("LdRulesOrangeOCAM_MSC_Huawei", "MSC", "Huawei", "OrangeOCAM"),
    ("LDRules_GrameenPhone_SMSC_MAVENIR - Copy", "SMSC", "Mavenir", "GrameenPhone"),
    ("LdRules_MSC_Nokia", "MSC", "Nokia", "Unknown"),
    ("LdRules_DU_MSC_Nokia_2024", "MSC", "Nokia", "DU"),
    ("", "MSC", "Nokia", "Unknown"),
    ("Etisalat_FMSLdRules MSC", "MSC", "Ericsson", "Etisalat_FMS"),
    ("Etisalat_FMSLdRules CCN EC20", "CCN", "Ericsson", "Etisalat_FMS_EC20"),
    ("LdRules_DU_X", "", "Nokia", "Unknown"),
    (None, "MSC", "Nokia", "Unknown"),
    ("LdRules\u00a0DU\u00a0Dubai_MSC", "MSC", "Nokia", "DU_Dubai"),
    ("DU\u00a0MSC", "MSC", "Nokia", "DU"),
    ("LdRules\u3000DU\u0085MSC", "MSC", "Nokia", "DU"),
    ("DU\u3000Dubai\u0085LdRules", "MSC", "Nokia", "DU_Dubai"),
]


def test_operator_from_filename(spark):
    table = spark.createDataFrame([o[:3] for o in OPERATORS], "f string, s string, v string")
    got = table.select(m.operator_from_filename(F.col("f"), F.col("s"), F.col("v"))).collect()
    assert [r[0] for r in got] == [o[3] for o in OPERATORS]


@pytest.mark.parametrize(
    "wanted, operator, matched",
    [("du", "DU", True), ("DU", "DU_Dubai", True), ("du_dubai", "Dubai", True), ("x", "DU", False),
     ("", "DU", False), (None, "DU", False), ("du", "", False), (" ", "DU", True)],
)
def test_operator_matches(spark, wanted, operator, matched):
    table = spark.createDataFrame([(wanted, operator)], "w string, o string")
    assert table.select(m.operator_matches(F.col("w"), F.col("o"))).first()[0] is matched


def test_confidence_and_band(spark):
    table = spark.createDataFrame([(1.0, 5), (1.0, 9), (1.0, 1), (0.4, 1)], "s double, n bigint")
    score = m.confidence(F.col("s"), F.col("n"))
    got = table.select(F.round(score, 9), m.confidence_band(score), m.percent(score)).collect()
    assert [tuple(r) for r in got] == [(1.0, "HIGH", "100.0%"), (1.0, "HIGH", "100.0%"), (0.76, "MED", "76.0%"), (0.34, "LOW", "34.0%")]


def _mutate(rng, text):
    chars = list(text)
    for _ in range(rng.randint(0, max(1, len(text) // 4))):
        at, kind = rng.randint(0, len(chars)), rng.random()
        if kind < 0.3:
            chars.insert(at, rng.choice("abc _"))
        elif chars and kind < 0.6:
            chars.pop(min(at, len(chars) - 1))
        elif chars:
            chars[min(at, len(chars) - 1)] = rng.choice("abc _")
    return "".join(chars)


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_lose_nothing(spark, seed):
    """Against every pair, over names of all lengths and word counts the keys distinguish."""
    rng = random.Random(seed)
    word = lambda alphabet, low, high: "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    names = [word("abc _", 0, 9) for _ in range(60)] + [word("abcdefgh_", 8, 22) for _ in range(50)]
    names += [word("abcdefgh _", 20, 60) for _ in range(25)] + [word("ab ", 1, 20) for _ in range(20)]
    names += ["", " ", "_", "__", "_____", "_ _ "]
    words = [word("abcdefghijk", 1, 3) for _ in range(22)]
    names += [rng.choice("_ ").join(rng.sample(words, rng.randint(1, 18))) for _ in range(50)]
    others = [_mutate(rng, n) for n in names] + [
        rng.choice("_ ").join(rng.sample(n.split("_"), len(n.split("_")))) for n in names
    ]
    clean = lambda texts: [(t,) for t in sorted({t.lower().strip() for t in texts})]
    queries = spark.createDataFrame(clean(names), "query string")
    targets = spark.createDataFrame(clean(others), "target string")
    match = m.field_match(F.col("query"), F.col("target"))
    expected = (
        queries.crossJoin(targets).select("query", "target", match.alias("m")).where("m.score >= 0.4")
        .select("query", "target", "m.score", "m.match_type")
    )
    got = [tuple(r) for r in similar_pairs(queries, targets).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {tuple(r) for r in expected.collect()}


def test_containment_pairs_lose_nothing(spark):
    rng = random.Random(5)
    texts = lambda n, size: sorted({"".join(rng.choice("abé ") for _ in range(rng.randint(0, size))) for _ in range(n)})
    values = [(a, v) for a in ("x", "y") for v in texts(40, 4)]
    names = [(a, n) for a in ("x", "y") for n in texts(40, 8)]
    got = containment_pairs(
        spark.createDataFrame(values, "attr string, value string"),
        spark.createDataFrame(names, "attr string, name string"), both_ways=("y",),
    ).collect()
    expected = {(a, v, n) for a, v in values for b, n in names if a == b and (v in n or (a == "y" and n in v))}
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
