"""Op 10: quality by a sparse ensemble of rules over text statistics.

Statistics of a whole text are plain Column expressions. Boosted trees on a bounded sample of labelled
rows give rules: every path from a root to a node is a conjunction of tests. A logistic model with a
lasso penalty over all rules keeps a few with a weight. These become one Column expression, so scoring
is a single scan without a shuffle.

Labels are learnt only from rows that are not held out; about ``MAX_LABELLED`` of them at most, drawn by
a hash of doc_id. Null or empty texts have statistics of 0 and are scored like others. Labels of one
kind only: that kind's share is every score; none: 0.5. Null doc_ids: scored like others, never learnt from.
Of several labels of a doc_id the highest counts, of several texts one. Repeated rows each get their row. Empty tables:
no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, trees

MAX_LABELLED = 10_000
THRESHOLD = 0.7
LASSO = 0.004
STATISTICS = ["chars", "word_length", "upper", "symbols", "digits", "bangs", "bars", "ends", "distinct", "repeats", "lines", "line_repeats"]


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Statistics of column text, and the columns ``keep`` as the struct kept_columns.

    They come out of a generator of one row: what is decided by them can't be pushed below it, where Spark would take each of them anew for every rule.
    """
    t = F.col("body")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    base = docs.select(F.struct(*keep).alias("kept_columns"), common.text_or_empty().alias("body"))  # their names may clash with those below
    counted = base.select(
        "kept_columns", F.char_length(t).cast("double").alias("n"), count(r"\S+").alias("w"), count(r"\p{Lu}").alias("u"), count(r"[#$%&*~^=<>{}|\\_@+]").alias("s"), count(r"[0-9]").alias("d"),
        count(r"!!").alias("b"), count(r" \| ").alias("p"), count(r"[.?]").alias("e"), F.size(F.array_distinct(F.split(t, " "))).cast("double").alias("v"), count(r" (\S+) \1(?= )").alias("r"),
        F.size(F.split(t, "\n")).cast("double").alias("l"), F.size(F.array_distinct(F.split(t, "\n"))).cast("double").alias("m"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1.0))
    found = [
        F.log1p("n").alias("chars"), per("n", "w").alias("word_length"), per("u", "n").alias("upper"), per("s", "n").alias("symbols"), per("d", "n").alias("digits"), per("b", "w").alias("bangs"), per("p", "w").alias("bars"),
        per("e", "w").alias("ends"), per("v", "w").alias("distinct"), per("r", "w").alias("repeats"), per("l", "w").alias("lines"), (F.lit(1.0) - per("m", "l")).alias("line_repeats"),
    ]
    return counted.select("kept_columns", F.inline(F.array(F.struct(*found))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, text and label of documents that may be learnt from, about ``bound`` of them at most.

    Of several labels of a doc_id the highest counts, of several texts the least: one row for each, whatever the tables repeat.
    """
    usable = labels.where(~common.held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("label"))
    total = usable.count()
    share = min(1.0, bound / total) if total else 1.0
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about ``bound`` rows of two numbers
    found = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = MAX_LABELLED, lasso: float = LASSO) -> tuple[float, list[tuple[list[trees.Test], float]]]:
    """Intercept and weighted rules."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = common.written(statistics(labelled(docs, labels, label, bound), ["label"]).select("kept_columns.label", *STATISTICS), "labelled-texts")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = next(iter(counts), 0.5)
        return (0.0 if share == 0.5 else 20.0 if share > 0.5 else -20.0), []
    assembled = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows).select("features", "label", *STATISTICS)
    model = GBTClassifier(maxIter=10, maxDepth=3, maxBins=48, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(assembled)
    rules = list(dict.fromkeys(tuple(tests) for t in model.trees for tests, _ in trees.paths(t.toDebugString)))
    columns = [F.when(trees.holds(list(r), STATISTICS), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)]
    flags = common.written(rows.select("label", *columns), "rules")
    design = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags).select("features", "label")
    fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(design)
    return float(fit.intercept), [(list(r), float(w)) for r, w in zip(rules, fit.coefficients.toArray(), strict=True) if w]


def score_of(intercept: float, rules: list[tuple[list[trees.Test], float]]) -> Column:
    total = F.lit(intercept)
    for tests, weight in rules:
        total = total + F.when(trees.holds(tests, STATISTICS), weight).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, score and predicted of every row (names of theirs that clash with the last two are left out)."""
    value = score_of(*learn(docs, labels))
    kept = [F.col("kept_columns").getField(k).alias(k) for k in keep if k not in ("score", "predicted")]
    scored = statistics(docs, keep).select("kept_columns", value.alias("score"))
    return scored.select(*kept, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return score(docs, labels, ["doc_id"]).select("doc_id", common.held_out().alias("held_out"), "score", "predicted")
