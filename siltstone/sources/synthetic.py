"""Made-up articles and a question set over them, the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TOPICS = {"Glacier": "ice", "Volcano": "lava", "Orchard": "fruit", "Harbor": "ships"}
HEADINGS = ("Origin", "Form", "Climate", "People", "Work", "Craft", "Trade", "Future")


def articles(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(id, title, url, text): article i is about topic i modulo 4 and has a lead and all headings."""
    topics, things = (F.array(*map(F.lit, x)) for x in (TOPICS, TOPICS.values()))
    at = (F.col("id") % len(TOPICS)).cast("int")
    fact = lambda h: F.concat(F.lit(f"\n\n== {h} ==\nThe {h.lower()} of "), F.col("title"), F.lit(" is measure "), (F.xxhash64("id", F.lit(h), F.lit(seed)) % 1000).cast("string"), F.lit(" of "), things[at], F.lit("."))
    rows = spark.range(1, n + 1).withColumn("title", F.concat_ws(" ", topics[at], F.col("id").cast("string")))
    text = F.concat(F.col("title"), F.lit(" is known for its "), things[at], F.lit("."), *map(fact, HEADINGS))
    return rows.select("id", "title", F.concat(F.lit("https://example.org/"), F.translate("title", " ", "_")).alias("url"), text.alias("text"))


def questions(spark: SparkSession) -> DataFrame:
    """(query_id, question, answers, aliases, titles): twenty that the first articles answer and three that none does."""
    rows = []
    for i in range(1, 21):
        topic = list(TOPICS)[i % len(TOPICS)]
        rows.append((f"q{i:02d}", f"What is {topic} {i} known for?", [f"its {TOPICS[topic]}"], [TOPICS[topic].upper()], [f"{topic} {i}"]))
    rows += [(f"q{i}", f"Who found the {x}?", [f"{x} finder"], [], [x]) for i, x in ((21, "Quasar"), (22, "Neutrino"), (23, "Pulsar"))]
    return spark.createDataFrame(rows, "query_id string, question string, answers array<string>, aliases array<string>, titles array<string>")
