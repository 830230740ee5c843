"""Op 2: URL filter of rules and gradient-boosted trees on lexical features, in DataFrame functions only.

Rules (a host and the start of a path) decide where they fit; the longest wins. The URLs that they
decide are the labelled ones, from which boosted trees are trained: length, depth, digit ratio, entropy,
parameter counts and the share of blocked URLs by the last and the last two labels of the host. For training,
a URL's shares come from the half of the sample that it isn't in. The trees become one Column expression
and decide the rest. At most about ``MAX_TRAINING`` distinct labelled URLs are used for training, drawn by a
hash of the URL; the tables of suffixes come from them and so have no more rows than that.

Null URLs and those without "://" have an empty host and path. Null page_ids stay null. If the labelled rows are of one kind
only, that kind is the method's verdict for all; if there are none, it is allow. Repeated rows each get
their row. Empty tables: no rows. Columns besides page_id and url are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, trees

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MAX_TRAINING = 20_000
FEATURES = ["url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_share", "suffix_rows", "domain_share", "domain_rows"]
SUFFIXES = ("suffix", "domain")
SHRINK = 5.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    after = F.substring(F.coalesce(rest, F.lit("")), F.length(host) + 1, F.length(F.coalesce(rest, F.lit(""))))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(after, r"^[^?#]*", 0)


def judge(rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict for columns host and path; null where no rule fits."""
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    found = F.array_distinct(F.split(text, ""))
    return F.when(n > 0, F.aggregate(F.filter(found, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, ruled, the lexical features of each URL, its suffixes and its hash."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = parts(F.col("url"))
    rule, ruled = judge()
    found = pages.select(F.col("page_id").cast("long"), url.alias("url"), host.alias("host"), path.alias("path"))
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    return found.select(
        "page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"),
        F.length("url").cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"), F.regexp_count("host", F.lit(r"[^.]+")).cast("double").alias("host_labels"),
        (F.regexp_count("url", F.lit(r"\d")) / F.greatest(F.length("url"), F.lit(1))).alias("digit_ratio"), entropy(F.col("url")).alias("entropy"),
        F.regexp_count(query, F.lit(r"[^&]+")).cast("double").alias("parameters"), F.regexp_count("url", F.lit("-")).cast("double").alias("hyphens"),
        F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"), F.xxhash64("url").alias("url_hash"),
    )


def smoothed(blocked: Column, n: Column, prior: float) -> Column:
    return (blocked + SHRINK * prior) / (n + SHRINK)


def suffix_tables(labelled: DataFrame, prior: float) -> dict[str, DataFrame]:
    """For each kind of suffix: its share of blocked URLs and their number."""
    return {c: common.written(labelled.groupBy(c).agg(smoothed(F.sum("label"), F.count("*"), prior).alias(f"{c}_share"), F.count("*").cast("double").alias(f"{c}_rows")), f"{c}-shares") for c in SUFFIXES}


def with_other_half(labelled: DataFrame, prior: float) -> DataFrame:
    """Labelled URLs with the shares of their suffixes in the half of the sample that they aren't in; numbers as if it were the whole."""
    rows = labelled.withColumn("half", F.pmod(F.col("url_hash"), F.lit(2)))
    for c in SUFFIXES:
        other = rows.groupBy(c, (1 - F.col("half")).alias("half")).agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
        rows = rows.join(other, [c, "half"], "left").withColumns({f"{c}_share": smoothed(F.coalesce("blocked", F.lit(0.0)), F.coalesce("n", F.lit(0)), prior), f"{c}_rows": 2.0 * F.coalesce("n", F.lit(0))}).drop("blocked", "n")
    return rows


def train(labelled: DataFrame) -> tuple[dict[str, DataFrame], float, Column]:
    """Suffix tables, the share that others get and the margin of the trees. Needs suffix, domain, url_hash and label columns."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total, blocked = sum(counts.values()), counts.get(1.0, 0)
    prior = blocked / total if total else 0.0
    suffixes = suffix_tables(labelled, prior)
    if len(counts) < 2:
        return suffixes, prior, F.lit(1.0 if blocked else -1.0)
    rows = common.written(with_other_half(labelled, prior), "url-features")
    rows = rows.withColumn("weight", F.when(F.col("label") == 1.0, total / (2.0 * blocked)).otherwise(total / (2.0 * (total - blocked))))  # both kinds weigh the same
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label", "weight")
    model = GBTClassifier(maxIter=12, maxDepth=3, maxBins=32, stepSize=0.3, weightCol="weight", seed=7).fit(assembled)
    return suffixes, prior, trees.margin([t.toDebugString for t in model.trees], list(model.treeWeights), FEATURES)


def with_suffixes(rows: DataFrame, suffixes: dict[str, DataFrame], prior: float) -> DataFrame:
    for c, shares in suffixes.items():
        # no more rows than the training sample has
        rows = rows.join(F.broadcast(shares), c, "left").withColumns({f"{c}_share": F.coalesce(f"{c}_share", F.lit(prior)), f"{c}_rows": F.coalesce(f"{c}_rows", F.lit(0.0))})
    return rows


def filter_urls(pages: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score (0 to 1, higher: block) of every page."""
    rows = lexical(pages)
    labelled = rows.where(F.col("ruled").isNotNull()).withColumn("label", F.when(F.col("ruled") == "block", 1.0).otherwise(0.0))
    total = labelled.count()
    share = min(1.0, max_training / total) if total else 1.0
    drawn = labelled.where(F.pmod(F.col("url_hash"), F.lit(1 << 30)) < int(share * (1 << 30))).drop("page_id").dropDuplicates(["url_hash"])
    suffixes, prior, margin = train(common.written(drawn, "labelled-urls"))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col("margin")))
    judged = with_suffixes(rows, suffixes, prior).withColumn("margin", margin)
    verdict = F.coalesce("ruled", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"))
