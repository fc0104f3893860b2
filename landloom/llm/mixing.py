"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell of source, language and topic.  The cells' weights are raked to the three marginals in turn
until they fit; a document's probability is its cell's weight over the largest weight, so that the expected tokens have
the target shares exactly, and it is kept if a hash of its id falls below that.

Targets: a mapping of values to shares, or a power that flattens the present shares (1 keeps them, 0 makes them even).
With a mapping, values that it does not name keep their present share; all is then scaled to one.  A
share of 0 leaves a value out: its cells have the weight 0, and so have cells that only such values meet.  Tokens are spaces plus
one.  The cells are one partition while there are at most ``ONE_PARTITION`` of them; beyond that the same windows shuffle.

Rows: null text has one token; null source, language or topic is the value ``(none)``; a null id hashes like the text
``null``; repeated rows are decided alike; an empty table gives an empty result; other columns stay out of the way.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, table

Target = Mapping[str, float] | float
ROUNDS, ONE_PARTITION = 12, 1_000_000
#: The op8 query's targets.
TARGETS: tuple[Target, Target, Target] = (0.7, {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, 0.8)
#: The pipeline's: flatter than the input, but no source, language or topic is starved.
GENTLE: tuple[Target, Target, Target] = (0.8, 0.9, 0.9)

#: Marks of a topic, the first that a text contains.
TOPICS = {"licence": "Licensed under", "table": " | ", "contact": "@", "noise": "***"}


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, mark in reversed(TOPICS.items()):
        out = F.when(F.contains(text, F.lit(mark)), name).otherwise(out)
    return out


def draw_of(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":mix")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _described(docs: DataFrame, topic: Column | None) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return docs.select(
        F.col("doc_id").cast("long"), name("source").alias("source"), name("lang").alias("lang"),
        F.coalesce(topic_of(text) if topic is None else topic, F.lit("(none)")).alias("topic"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("double").alias("tokens"),
    )


def _share(target: Target, value: str) -> Column:
    """The target share of each cell's value, not yet scaled to one over all values."""
    present = F.sum("tokens").over(Window.partitionBy(value)) / F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    if isinstance(target, Mapping):
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in target.items() for x in kv)), F.col(value)), present)
    return F.pow(present, F.lit(float(target)))


def weights(described: DataFrame, targets: tuple[Target, Target, Target], rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, weight): the raked weight of each cell's tokens, the largest of them being 1."""
    cells = materialise(described.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")))
    if cells.count() <= ONE_PARTITION:
        cells = cells.coalesce(1)
    names = ("source", "lang", "topic")
    for value, target in zip(names, targets, strict=True):
        cells = cells.withColumn(f"t_{value}", _share(target, value))
    cells = cells.withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        for value in names:
            there = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(value))
            cells = cells.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"t_{value}"), there), F.lit(0.0)))
    return cells.select(*names, F.coalesce(F.try_divide(F.col("weight"), F.max("weight").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)).alias("weight"))


def mix(docs: DataFrame, targets: tuple[Target, Target, Target] = TARGETS, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, kept of every document."""
    described = _described(docs, topic)
    cells = materialise(weights(described, targets))
    out = described.join(F.broadcast(cells) if cells.count() <= ONE_PARTITION // 100 else cells, ["source", "lang", "topic"])
    return out.select("doc_id", "source", "lang", "topic", F.col("tokens").cast("long").alias("tokens"), F.round("weight", 9).alias("probability"), (draw_of(F.col("doc_id")) < F.round("weight", 9)).alias("kept"))


def sample(docs: DataFrame, targets: tuple[Target, Target, Target] = GENTLE) -> DataFrame:
    """The documents that are kept, with all their columns."""
    described = _described(docs, None)
    cells = materialise(weights(described, targets))
    small = F.broadcast(cells) if cells.count() <= ONE_PARTITION // 100 else cells
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # whatever other columns are called
    held = docs.select(row, name("source"), name("lang"), topic_of(F.coalesce("text", F.lit(""))).alias("topic"), draw_of(F.col("doc_id")).alias("draw"))
    return held.join(small, ["source", "lang", "topic"]).where(F.col("draw") < F.round("weight", 9)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def sql(targets: tuple[Target, Target, Target] = TARGETS, rounds: int = ROUNDS) -> str:
    """The same in SQL: one common table expression per raking step."""

    def share(target: Target, value: str) -> str:
        present = f"(sum(tokens) OVER (PARTITION BY {value}) / sum(tokens) OVER ())"
        if isinstance(target, Mapping):
            return "CASE " + value + "".join(f" WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in target.items()) + f" ELSE {present} END"
        return f"pow({present}, {float(target)})"

    topic = "CASE" + "".join(f" WHEN contains(coalesce(text, ''), '{mark}') THEN '{name}'" for name, mark in TOPICS.items()) + " ELSE 'prose' END"
    ctes = [
        f"d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, {topic} AS topic, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS DOUBLE) AS tokens FROM documents)",
        "c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL)",
        "w0 AS (SELECT *, CAST(1 AS DOUBLE) AS weight, " + ", ".join(f"{share(t, v)} AS t_{v}" for v, t in zip(("source", "lang", "topic"), targets, strict=True)) + " FROM c)",
    ]
    k = 0
    for _ in range(rounds):
        for v in ("source", "lang", "topic"):
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(weight * t_{v} / nullif(sum(weight * tokens) OVER (PARTITION BY {v}), 0), 0) AS weight) FROM w{k})")
            k += 1
    ctes.append(f"p AS (SELECT source, lang, topic, round(coalesce(weight / nullif(max(weight) OVER (), 0), 0), 9) AS probability FROM w{k})")
    draw = "CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, probability, {draw} < probability AS kept FROM d JOIN p USING (source, lang, topic)"
