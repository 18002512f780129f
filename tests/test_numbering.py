import random

from quillmap.operators.numbering import number_rows, total_before


def test_number_rows_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 40)}", rng.randint(0, 5_000), i) for i in range(6_000)]
    table = spark.createDataFrame(rows, "k string, lead bigint, tie bigint").repartition(8)
    got = {(r.k, r.lead, r.tie): r.n for r in number_rows(table, ["k"], "lead", ["tie"], 64, "n").collect()}
    expected, seen = {}, {}
    for row in sorted(rows):
        seen[row[0]] = seen.get(row[0], 0) + 1
        expected[row] = seen[row[0]]
    assert got == expected


def test_total_before_with_equal_times(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1.0, 1.0, 2.0, 3.0]), f"k{i}", rng.randint(0, 9)) for i in range(3_000)]
    table = spark.createDataFrame(rows, "ts double, k string, size bigint").repartition(8)
    got = {r.k: r.before for r in total_before(table, ["ts", "k"], "size", "before").collect()}
    total, expected = 0, {}
    for _, key, size in sorted(rows):
        expected[key] = total
        total += size
    assert got == expected


def _numbered(rows):
    known = sorted(r for r in rows if r[0] is not None and r[1] is not None)
    expected, seen = {}, {}
    for row in known:
        seen[row[0]] = seen.get(row[0], 0) + 1
        expected[row] = seen[row[0]]
    return expected


def test_number_rows_cuts_only_groups_that_may_be_large(spark):
    rng = random.Random(3)
    keys = lambda i: None if i % 50 == 7 else "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 90)}"
    rows = [(keys(i), None if i % 70 == 9 else rng.randint(0, 900), i) for i in range(3_000)]
    table = spark.createDataFrame(rows, "k string, lead bigint, tie bigint").repartition(8)
    for together in (1_000, 10, 1 << 18):
        numbered = number_rows(table, ["k"], "lead", ["tie"], 64, "n", together)
        assert numbered.columns == ["k", "lead", "tie", "n"]
        assert {(r.k, r.lead, r.tie): r.n for r in numbered.collect()} == _numbered(rows)


def test_number_rows_shuffles_rows_once_without_large_groups(spark):
    table = spark.range(1_000).selectExpr("id % 50 AS k", "id AS lead", "id AS tie")
    plan = number_rows(table, ["k"], "lead", ["tie"], 64, "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
