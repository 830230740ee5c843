"""Language of texts by what their letters look like: a model of character trigrams learnt from labelled texts.

``learn`` counts the trigrams of words (with a space before and after) in each language and keeps a compact table:
the ``TOP`` commonest of each language with their costs, -1000 ln of the smoothed share, as whole numbers. Its size is
bounded by languages times ``TOP``, whatever it is learnt from, so it is sent to all tasks. ``identify`` adds up what the
trigrams of a text cost in each language; a trigram outside the table costs what one that was never seen does. The language
of least cost is taken if it is sure of it: the text has ``LEAST_GRAMS`` trigrams, the second language costs ``MARGIN`` a trigram more,
and the text is not dearer than nearly all texts are that the language was learnt from. Else the text is 'unknown': too short, mixed, or of a
language that the model doesn't know, which a closed set of word lists takes for one it knows.

What the ``WORDS`` commonest words cost is added up once, in a second table that is sent to all tasks; only other words are cut into trigrams, so the
sums are the same with fewer rows. All of it is built-in expressions; a text leaves its row as partial sums only. Words above ``LONGEST`` characters (base64, lines
of signs) are no evidence and are left out. Null and empty texts are unknown.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

TOP = 2000
#: Words whose costs are kept added up; their number changes the work only, not the costs.
WORDS = 50_000
LEAST_GRAMS = 12
MARGIN = 60
LONGEST = 40
#: Share of the texts of a language that its limit takes in, and what it allows besides, in percent: texts not learnt from cost more.
WITHIN = 0.99
SLACK = 15
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Model:
    """``table``: gram and its cost in each language. ``words``: whole words likewise (``word_costs``). ``floors``: cost of a gram outside it. ``limits``: greatest cost a gram."""

    table: DataFrame
    words: DataFrame
    languages: tuple[str, ...]
    floors: dict[str, int]
    limits: dict[str, int]


def words(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and word: a row for each part of the text between other signs, null where it is empty or too long; one at least for each text."""
    each = rows.select(*keep, F.explode_outer(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")).alias("word"))
    return each.withColumn("word", F.when(F.length("word").between(1, LONGEST), F.col("word")))


def grams(word: str) -> Column:
    """The trigrams of a word with a space before and after, as many as it has letters."""
    wide = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(wide, i, F.lit(3)))


def cost(total: Column, count: Column) -> Column:
    return F.floor(F.lit(1000) * F.log(total / (count + 1))).cast("long")


def gram_table(counted: DataFrame, languages: tuple[str, ...], top: int = TOP) -> tuple[DataFrame, dict[str, int]]:
    """The table and the floors of a model. ``counted``: lang, gram, n; it is read four times, so best a written table."""
    kinds = counted.select("gram").distinct().count()
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("lang").isin(*languages)).collect()}
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    common = ranked.select("gram").distinct()
    spread = counted.join(common, "gram", "left_semi").groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(x) for x in languages])
    whole = {x: float(totals.get(x, 0) + kinds) for x in languages}
    table = spread.select("gram", *[cost(F.lit(whole[x]), F.coalesce(x, F.lit(0))).alias(x) for x in languages])
    floors = spread.sparkSession.range(1).select(*[cost(F.lit(whole[x]), F.lit(0)).alias(x) for x in languages]).first()
    return table, floors.asDict() if kinds else dict.fromkeys(languages, 0)


def word_costs(counted: DataFrame, table: DataFrame, floors: dict[str, int], most: int = WORDS) -> DataFrame:
    """word, word_grams (their number) and word_<language>, what they cost, of the ``most`` commonest words. ``counted``: word, n."""
    common = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word", F.explode(grams("word")).alias("gram"))
    sums = [F.sum(F.coalesce(x, F.lit(n))).alias(f"word_{x}") for x, n in floors.items()]
    return common.join(F.broadcast(table), "gram", "left").groupBy("word").agg(F.count("gram").alias("word_grams"), *sums)


def costs(rows: DataFrame, text: str, table: DataFrame, common: DataFrame, floors: dict[str, int], keep: list[str]) -> DataFrame:
    """``keep``, grams (their number) and cost_<language> of every row. ``common``: ``word_costs`` of ``table``."""
    key = F.monotonically_increasing_id().alias("row_of_text")
    each = words(rows.select(key, text, F.struct(*keep).alias("kept")), text, ["row_of_text", "kept"])
    known = each.join(F.broadcast(common), "word", "left")  # at most WORDS rows
    rare = known.withColumn("gram", F.explode_outer(F.when(F.col("word_grams").isNull(), grams("word"))))
    met = rare.join(F.broadcast(table), "gram", "left")  # at most TOP rows for each language
    one = F.when(F.col("gram").isNull(), 0)
    sums = [F.sum(F.coalesce(f"word_{x}", one.otherwise(F.coalesce(x, F.lit(n))))).alias(f"cost_{x}") for x, n in floors.items()]
    # ``kept`` is a part of the key: the buffers are numbers alone, so each task sums its texts up by a hash, without a sort of their trigrams
    return met.groupBy("row_of_text", "kept").agg(F.sum(F.coalesce("word_grams", one.otherwise(1))).alias("grams"), *sums).select("kept.*", "grams", *[f"cost_{x}" for x in floors])


def learn_costs(rows: DataFrame, text: str, lang: str, languages: tuple[str, ...], written, top: int = TOP) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Counts of words (lang, word, n), the table and the floors of a model. Texts are read once; what each of them costs, the limits need and this doesn't."""
    known = rows.where(F.col(lang).isin(*languages)).select(F.col(lang).alias("lang"), text)
    said = written(words(known, text, ["lang"]).where("word is not null").groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    counted = written(said.select("lang", "n", F.explode(grams("word")).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    table, floors = gram_table(counted, languages, top)
    return said, written(table, "gram-costs"), floors


def learn(rows: DataFrame, text: str, lang: str, languages: tuple[str, ...], written, top: int = TOP, most: int = WORDS) -> Model:
    """A model of ``languages`` from texts labelled by ``lang``. ``written`` keeps a table (of counts, of the model), as a function of it and a name."""
    said, table, floors = learn_costs(rows, text, lang, languages, written, top)
    common = written(word_costs(said, table, floors, most), "word-costs")
    known = rows.where(F.col(lang).isin(*languages)).select(F.col(lang).alias("lang"), text)
    own = F.coalesce(*[F.when(F.col("lang") == x, F.expr(f"cost_{x} div grams")) for x in languages])
    seen = costs(known, text, table, common, floors, ["lang"]).where(F.col("grams") >= LEAST_GRAMS).withColumn("own", own)
    limits = seen.groupBy("lang").agg(F.expr(f"cast(percentile_disc({WITHIN}) within group (order by own) as bigint)").alias("limit")).collect()
    return Model(table, common, languages, floors, {r["lang"]: r["limit"] * (100 + SLACK) // 100 for r in limits})


def decided(model: Model, margin: int = MARGIN, least: int = LEAST_GRAMS) -> Column:
    """The language of a row of ``costs``, or unknown."""
    each = [F.col(f"cost_{x}") for x in model.languages]
    best = F.least(*each) if len(each) > 1 else each[0]
    near = reduce(lambda a, b: a + b, [F.when(c < best + margin * F.col("grams"), 1).otherwise(0) for c in each])
    of = [F.when((c == best) & (F.col(f"cost_{x}") < (model.limits[x] + 1) * F.col("grams")), F.lit(x)) for x, c in zip(model.languages, each, strict=True) if x in model.limits]
    sure = (F.col("grams") >= least) & (near == 1)
    return F.coalesce(F.when(sure, F.coalesce(*of)) if of else F.lit(None).cast("string"), F.lit(UNKNOWN))


def identify(rows: DataFrame, text: str, model: Model, keep: list[str], margin: int = MARGIN, least: int = LEAST_GRAMS) -> DataFrame:
    """``keep`` and detected of every row; the text itself isn't shuffled."""
    found = costs(rows, text, model.table, model.words, model.floors, keep)
    return found.select(*keep, decided(model, margin, least).alias("detected"))
