"""The models over the whole feature table, built once; boosting is kept short."""

import pytest
from landloom.operators import models as M
from landloom.plans import models as plans
from landloom.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
MODELS = {"ablation", "random_forest", "logistic_regression", "permutation_importance", "period_importance", "partial_dependence"}


@pytest.fixture(scope="module")
def table(spark):
    return plans._split(spark, SF)


@pytest.fixture
def query(spark, table, monkeypatch):
    monkeypatch.setattr(plans, "_split", lambda *_: table)
    monkeypatch.setattr(M, "ROUNDS", 2)
    monkeypatch.setattr(M, "DEPTH", 2)
    monkeypatch.setattr(M.ablation, "__defaults__", (2, 2))
    monkeypatch.setattr(M.forest, "__defaults__", (5, 4, 5))
    return lambda name: registry.queries()[name](spark, SF).collect()


def test_the_table_has_all_features_and_periods(table):
    train, test = table
    assert len(plans.SETS["M7"]) == 167 == len(set(plans.SETS["M7"]))
    assert {len(plans.SETS[m]) for m in ("M0", "M1", "M2", "M3")} == {7, 73, 87, 21}
    years = [sorted(r.year for r in part.select("year").distinct().collect()) for part in table]
    assert years[0] and years[1] and max(years[0]) < plans.FIRST_TEST <= min(years[1])
    assert train.where(" or ".join(f"{n} is null or isnan({n})" for n in plans.SETS["M7"])).isEmpty()
    some = train.selectExpr("max(mean_r60_nc) as a", "max(max_r300_td) as b", "max(cluster_size_log) as c").first()
    assert some.a > 0 and some.b > 0 and some.c > 0


def test_the_network_is_searched_only_for_its_own_features(spark, table, monkeypatch):
    monkeypatch.setattr(plans, "syntax_cells", lambda *_: pytest.fail("the network is searched for features that are not its own"))
    names = plans.SETS["M3"]
    for own, whole in zip(plans._split(spark, SF, names), table, strict=True):
        assert own.columns == ["year", "id", "is_update", *names]
        assert sorted(own.collect()) == sorted(whole.select(own.columns).collect())


def test_rows_lie_alike_however_they_were_shuffled(spark):
    names, lie = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"), []
    was = [spark.conf.get(n) for n in names]
    try:
        for values in (("3", "false"), ("5", "false")):
            for n, v in zip(names, values, strict=True):
                spark.conf.set(n, v)
            lie.append([part.select(F.spark_partition_id(), "id").collect() for part in plans._split(spark, SF, plans.SETS["M3"])])
    finally:
        for n, v in zip(names, was, strict=True):
            spark.conf.set(n, v)
    assert lie[0] == lie[1] and all(lie[0])


def test_importance_of_periods_needs_no_network(spark, table, monkeypatch):
    monkeypatch.setattr(plans, "syntax_cells", lambda *_: pytest.fail("the network is searched for features that are not its own"))
    monkeypatch.setattr(M, "ROUNDS", 1)
    monkeypatch.setattr(M, "DEPTH", 1)
    rows = registry.queries()["period_importance"](spark, SF).collect()
    years = {r.year for r in table[1].select("year").distinct().collect()}
    assert sorted((r.year, r.feature) for r in rows) == sorted((y, f) for y in years for f in plans.SETS["M3"])


def test_ablation_has_every_set(query):
    rows = {r.model: r for r in query("ablation")}
    assert {m: r.n_dim for m, r in rows.items()} == {m: len(f) for m, f in plans.SETS.items()}
    assert all(0 <= r.auc <= 1 and 0 <= r.ap <= 1 for r in rows.values()) and rows["M1"].delta == 0


@pytest.mark.parametrize("name", ["random_forest", "logistic_regression"])
def test_models_are_evaluated(query, name):
    (row,) = query(name)
    assert 0 <= row.auc <= 1 and 0 <= row.ap <= 1


def test_importance_ranks_every_feature(query):
    rows = query("permutation_importance")
    assert {r.feature for r in rows} == set(plans.SETS["M7"]) and sorted(r["rank"] for r in rows) == list(range(1, 168))
    ordered = sorted(rows, key=lambda r: r["rank"])
    assert all(a.delta_auc >= b.delta_auc for a, b in zip(ordered, ordered[1:], strict=False))


def test_importance_of_each_period(query, table):
    rows = query("period_importance")
    years = {r.year for r in table[1].select("year").distinct().collect()}
    assert {(r.year, r.feature) for r in rows} == {(y, f) for y in years for f in plans.SETS["M3"]}


def test_dependence_is_a_mean_score(query):
    rows = query("partial_dependence")
    assert rows and all(0 < r.mean_score < 1 for r in rows) and len({r.value for r in rows}) == len(rows)


def test_a_set_is_chosen_by_name_or_by_its_auc(spark):
    results = spark.createDataFrame([("M1 cell", 0.7), ("M2 all", 0.9), ("M10 more", None)], "model string, auc double")
    assert M.chosen_set(results, "M1") == "M1 cell" and M.chosen_set(results) == M.chosen_set(results, "M7") == "M2 all"
