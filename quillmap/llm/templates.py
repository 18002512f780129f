"""Line dedup by a log-template tree, in DataFrame functions only.

A line falls to a leaf of a tree of fixed depth: its number of tokens, then its leading
tokens. In a leaf, tokens that recur at a place are constants and the rest are variable
fields, so that a line's template is its constants with `<*>` between them. Lines whose
template recurs across documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import KEY, text_key
from quillmap.session import materialise

#: Leading tokens on the way to a leaf; a line that has fewer takes them all.
DEPTH = 3
#: Texts in which a leaf, a token at a place of it, and a template recur.
MIN_DOCS = 10
#: A template recurs across documents, not copies of one, if at least one in APART of its
#: texts differ in the rest of their lines.
APART = 3
#: A text stands for itself, and is no copy, if one in OWN of its lines or more is in no recurring leaf.
OWN = 6
VARIABLE = "<*>"
#: A token with a digit or of an address is variable wherever it stands.
_FIELD = r"[0-9@]|://"
_BREAK = r"[\x20\x09\x0B-\x0D]+"
_TOKEN = r"[^\x20\x09-\x0D]"


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, _BREAK), "")


def masked(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.rlike(_FIELD), VARIABLE).otherwise(w))


def _leaf() -> Column:
    return F.xxhash64(F.size("tokens"), masked(F.slice("tokens", 1, DEPTH)))


def _lines(texts: DataFrame, shortest: int, *kept: str) -> DataFrame:
    """The distinct lines of each text that have `shortest` tokens or more, with their tokens."""
    # an outer explode of lines, of which each text has one: the inner one would have Spark
    # split every text once more to see whether it has any
    each = texts.select(*kept, F.explode_outer("lines").alias("line"))
    return each.withColumn("tokens", tokens(F.col("line"))).where(F.size("tokens") >= shortest)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shortest: int = 1) -> DataFrame:
    """key_a, key_b, line: lines of texts whose template recurs. Equal texts count once.

    A template recurs if `min_docs` texts with lines of their own have it, or as many texts,
    one in APART or more of those that have it, that differ in the rest of their lines.
    """
    keyed = docs.select(*text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    split = F.array_distinct(F.split("text", "\n")).alias("lines")
    slim = (
        _lines(keyed.select(*KEY, split), shortest, *KEY)
        .groupBy(*KEY, _leaf().alias("leaf"))
        .agg(F.count("*").alias("lines"))
    )
    often = slim.groupBy("leaf").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_docs)
    # the texts that have lines in such leaves, with these leaves; they grow with the documents
    wanted = slim.join(often.select("leaf"), "leaf").groupBy(*KEY).agg(F.collect_list("leaf").alias("leaves"), F.sum("lines").alias("shared"))
    found = (
        keyed.join(materialise(wanted).hint("merge"), KEY)
        .select(*KEY, "leaves", "shared", split)
        .withColumn("digests", F.slice(F.array_sort(F.transform("lines", F.md5)), 1, 2))
        .withColumn("all", F.size(F.filter("lines", lambda line: line.rlike(_TOKEN))))
        .withColumn("alone", OWN * (F.col("all") - F.col("shared")) >= F.col("all"))
    )
    found = (
        _lines(found, shortest, *KEY, "leaves", "digests", "alone")
        .withColumn("leaf", _leaf())
        .where(F.array_contains("leaves", F.col("leaf")))
    )
    # the least digest of the text's other lines: copies of a document agree in it
    least = F.get("digests", F.lit(0))
    rest = F.when(least == F.md5("line"), F.get("digests", F.lit(1))).otherwise(least)
    # copies of a text bring the same lines
    candidates = materialise(
        found.select(*KEY, "leaf", "line", rest.alias("rest"), "alone").distinct()
    )
    return _of_recurring_templates(candidates, min_docs)


def _of_recurring_templates(candidates: DataFrame, min_docs: int) -> DataFrame:
    """The candidate lines whose template recurs."""
    shown = F.array_join(masked(tokens(F.col("line"))), " ")
    candidates = candidates.withColumn("shown", F.xxhash64(shown))
    kinds = candidates.withColumn("words", shown).groupBy("leaf", "shown", "words").agg(F.count("*").alias("lines"))
    placed = kinds.select("leaf", "shown", "lines", F.posexplode(F.split("words", " ")).alias("place", "token"))
    constants = (
        placed.groupBy("leaf", "place", "token")
        .agg(F.sum("lines").alias("lines"))
        .where((F.col("lines") >= min_docs) & (F.col("token") != VARIABLE))
        .select("leaf", "place", "token", F.lit(True).alias("constant"))
    )
    field = F.when(F.col("constant"), F.col("token")).otherwise(VARIABLE)
    in_order = F.array_sort(F.collect_list(F.struct("place", field.alias("field"))))
    templates = (
        placed.join(constants, ["leaf", "place", "token"], "left")
        .groupBy("leaf", "shown")
        .agg(
            F.array_join(F.transform(in_order, lambda t: t["field"]), " ").alias("template"),
            F.count("constant").alias("constants"),
            F.count("*").alias("length"),
        )
        .where(2 * F.col("constants") >= F.col("length"))
        .select("leaf", "shown", F.xxhash64("template").alias("template"))
    )
    lines = materialise(candidates.join(templates, ["leaf", "shown"]).select(*KEY, "line", "template", "rest", "alone"))
    apart = lines.groupBy("template", "rest").agg(F.count("*").alias("n"))  # first by both: no group grows with its texts
    each = lines.groupBy("template", *KEY).agg(F.first("alone").alias("alone"))
    texts = each.groupBy("template").agg(F.count("*").alias("texts"), F.count_if("alone").alias("alone"))
    recurring = (
        apart.groupBy("template")
        .agg(F.count("rest").alias("apart"))
        .join(texts, "template")
        .where((F.col("alone") >= min_docs) | ((F.col("apart") >= min_docs) & (APART * F.col("apart") >= F.col("texts"))))
        .select("template")
    )
    return lines.join(recurring, "template").select(*KEY, "line").distinct()


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shortest: int = 1) -> DataFrame:
    """(row, n_lines, n_dropped): `row` has all columns of `docs`, its text without recurring lines.

    Lines end at a line feed and are dropped wherever they stand in a text; a text may become empty,
    a null text stays null and has no lines. Copies of a text are one text, so that copies
    alone make nothing recur, and lose the same lines. Repeated rows stay repeated. Lines of
    fewer than `shortest` tokens stay; a line without a token always does.
    """
    dropped = materialise(recurring_lines(docs, min_docs, max(shortest, 1)).groupBy(*KEY).agg(F.collect_list("line").alias("dropped")))
    rows = docs.select(F.struct("*").alias("row"), *text_key(F.col("text"))).join(dropped.hint("merge"), KEY, "left")
    lines = F.split("row.text", "\n")
    changed = F.col("dropped").isNotNull()
    kept = F.when(changed, F.filter(lines, lambda line: ~F.array_contains("dropped", line)))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    return (
        rows.withColumn("kept", kept)
        .select(
            F.when(changed, F.col("row").withField("text", F.array_join("kept", "\n"))).otherwise(F.col("row")).alias("row"),
            F.when(F.col("row.text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
            F.when(changed, n_lines - F.size("kept")).otherwise(0).cast("long").alias("n_dropped"),
        )
    )
