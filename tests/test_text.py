"""Stemmer, normaliser and comma lists."""

from pyspark.sql import functions as F

from tidemark.functions import scalars, text
from tidemark.plans import inputs as src

# Published Porter examples.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous",
    "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular",
    "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "yes": "ye", "say": "sai", "is": "is", "oscillations": "oscil",
}


def test_porter(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == STEMS


def value(spark, column, x):
    return spark.createDataFrame([(x,)], "x string").select(column.alias("v")).first()["v"]


def test_normalise(spark):
    x = F.col("x")
    assert value(spark, text.normalise(x), "The Sea of Winds, Temperature's 3.5") == "sea wind,temperature' 3.5"
    assert value(spark, text.normalise(x), None) == ""
    assert value(spark, text.tokens(x), "a_b l'eau 12.5, x.") == ["a_b", "l'eau", "12.5", "x"]


def test_comma_lists(spark):
    x = F.col("x")
    assert value(spark, text.split_comma_list(x), '"a, b ,"c",,d"') == ["a", "b", "c", "d"]
    assert value(spark, text.underscore_tokens(F.split(x, ",")), "a b,c") == "a_b c"


def test_rounding(spark):
    rows = spark.createDataFrame([(0.125,), (0.135,), (0.9350000000000001,), (0.845,)], "x double")
    assert [r[0] for r in rows.select(scalars.round2(F.col("x"))).collect()] == [0.12, 0.14, 0.94, 0.84]


def test_seconds(spark):
    row = spark.sql("select timestamp'2024-01-01 00:00:00.9' a, timestamp'2024-01-01 00:00:02.1' b")
    assert row.select(scalars.seconds_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_words_are_counted_without_a_shuffle_of_words(spark, sf_dir):
    """Texts are dealt by document once; counting and stemming their words needs no further exchange."""
    plan = src.document_counts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(doc#" in plan
