"""Shards against the best division, marginals of the mixture, and clashing columns."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from landloom.llm import mixing, sharding


@pytest.mark.parametrize("seed", range(30))
def test_differencing_is_near_the_best_division(seed):
    rng = random.Random(seed)
    ways, sizes = rng.choice((2, 3)), [rng.randint(1, 60) for _ in range(rng.randint(1, 8))]

    def largest(division):
        return max(sum(s for s, d in zip(sizes, division, strict=True) if d == k) for k in range(ways))

    best = min(map(largest, itertools.product(range(ways), repeat=len(sizes))))
    own = sharding.differencing(sizes, ways)
    assert len(own) == len(sizes) and set(own) <= set(range(ways))
    assert largest(own) <= (4 / 3 - 1 / (3 * ways)) * best + 1e-9


def rows(spark):
    rng = random.Random(3)
    out = [(k, "word " * rng.randint(1, 50), rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "books"]), 1, "x") for k in range(3000)]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, weight int, `mix source` string")


def test_raked_weights_meet_their_marginals(spark):
    described = rows(spark).select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("(none)")).alias("lang"), F.lit("t").alias("topic"), F.length("text").cast("double").alias("tokens"))
    cells = described.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    raked = mixing.weights(described, ({"web": 0.5, "books": 0.5}, 0.5, 1.0)).join(cells, ["source", "lang", "topic"]).collect()
    total = sum(r.weight * r.tokens for r in raked)
    for source in ("web", "books"):
        assert abs(sum(r.weight * r.tokens for r in raked if r.source == source) / total - 0.5) < 1e-6


def test_samples_keep_columns_of_any_name(spark):
    docs = rows(spark)
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert kept.join(docs, docs.columns, "left_anti").where("lang is not null").isEmpty()
    assert mixing.sample(docs.limit(0)).count() == 0


def test_shares_of_zero_leave_their_values_out(spark):
    rows = [(k, "word " * (k % 7 + 1), ("en", "de", "fr")[k % 3], ("web", "books")[k % 2], 0, 0, "x") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, block string")
    out = mixing.mix(docs, (1.0, {"en": 0.7, "de": 0.0, "fr": 0.3, "it": 0.5}, 1.0)).collect()
    assert len(out) == 60 and all((r.probability == 0) == (r.lang == "de") for r in out) and not any(r.kept for r in out if r.lang == "de")
    share = {c: sum(r.probability * r.tokens for r in out if r.lang == c) for c in ("en", "fr")}
    assert abs(share["en"] / share["fr"] - 7 / 3) < 1e-4
    none = mixing.mix(docs, ({"web": 0.0, "books": 0.0}, 1.0, 1.0)).collect()
    assert len(none) == 60 and not any(r.probability or r.kept for r in none)
