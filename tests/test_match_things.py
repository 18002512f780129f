"""Pairs of filters and things against plain Python, and what their plans shuffle."""

from pyspark.sql import functions as F

from quillmap.operators import match, search
from quillmap.operators.names import containment_pairs, similar_pairs
from quillmap.session import materialise


def _pairs(spark, filters, vendors):
    table = materialise(spark.createDataFrame([(f, f) for f in filters], "filter_key string, vendor string"))
    things = materialise(spark.createDataFrame([(v,) for v in vendors], "vendor string"))
    return match.match_things(table, things, ("vendor",))


def test_a_text_of_many_filters(spark):
    """One text that all filters share meets the things once, and no pair comes twice."""
    vendors = [f"Supplier#{i:05d}" for i in range(40)] + [None, "Other", "R"]
    filters = [f"supplier#{i:05d} or nation AND r" for i in range(300)] + ["r or r", "er#00001", "x", "r and ", ""]
    got = _pairs(spark, filters, vendors)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "thing_id" not in plan  # pairs do not look for their things again
    expected = []
    for f in filters:
        words = [w.strip() for w in f.lower().replace(" and ", " or ").split(" or ")] if f else [""]
        for v in vendors:
            if not f or (v is not None and any(w in v.lower() for w in words)):
                expected.append((f, v))
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected, key=key)


def test_numbered_names_share_few_keys(spark):
    """Texts meet on grams as long as they allow: the short ones of numbered names are common."""
    names = [f"supplier#{i:09d}" for i in range(2_000)]
    table = materialise(spark.createDataFrame([("vendor", n) for n in names], "attr string, name string"))
    pairs = containment_pairs(table.withColumnRenamed("name", "value"), table)
    assert sorted(map(tuple, pairs.collect())) == [("vendor", n, n) for n in names]


def test_results_of_small_groups_need_no_join(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD", 3)
    rules = [("S", "M", "N", f"V{k}", f"LdRules_Op_{f}", i, "Dim.", "event", f"e{i}") for k in range(4) for f in "ab" for i in range(k)]
    columns = "source string, module string, source_name string, vendor string, file_stem string, row_no bigint, dimension string, field string, expression string"
    rules = spark.createDataFrame(rules, columns)
    asked = spark.createDataFrame([(1, "event") + (None,) * 6, (2,) + (None,) * 7], "question_id bigint, " + ", ".join(f"{f} string" for f in search.FILTERS))
    plain = search.results(search.search(asked, rules), rules)
    carried = search.results(search.search(asked, rules, entries=True), rules)
    assert sorted(map(tuple, carried.collect())) == sorted(map(tuple, plain.collect())) and plain.count() == 24


def test_exploded_names_are_not_broadcast(spark):
    """A file of names is small, their grams and all that is met by them are not: no plan sends them through the driver."""
    names = [f"supplier#{i:09d}" for i in range(300)]
    table = materialise(spark.createDataFrame([("vendor", n) for n in names], "attr string, name string"))
    pairs = containment_pairs(table.withColumnRenamed("name", "value"), table, ("vendor",))
    alike = similar_pairs(table.select(F.col("name").alias("query")), table.select(F.col("name").alias("target")))
    for found in (pairs, alike, _pairs(spark, [*names, "supplier or r", "er or r"], names)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
