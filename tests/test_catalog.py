"""Each query against its DuckDB twin on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from prooflake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    sql = con.sql(catalog.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(sql.columns)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    at = [sql.columns.index(c) for c in order]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in sql.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_features_regression(spark):
    row = catalog.queries()["features_lr"](spark, SF).first()
    assert row.macro_f1 > 0.25 and row.n == catalog.queries()["detector_split"](spark, SF).where("split = 'test'").count()


def test_loaded_detector_judges_like_the_fitted_one(spark):
    from prooflake.functions.vocabulary import FEATURES
    from prooflake.operators import metrics, models

    train, test = catalog._split(catalog._detector_rows(spark, SF))
    wanted = sorted(metrics.confusion(models.features_regression(train, test, FEATURES), "label").collect())
    assert sorted(catalog.queries()["loaded_detector_confusion"](spark, SF).collect()) == wanted


def test_other_models_run(spark):
    assert {r.fold for r in catalog.queries()["context_lr_cv"](spark, SF).collect()} == {-1, 0, 1, 2, 3, 4}
    assert {r.held_out for r in catalog.queries()["leave_one_dataset_out"](spark, SF).collect()} == {"ds0", "ds1", "ds2"}
    assert catalog.queries()["majority_detector"](spark, SF).where("dataset = 'all'").first().accuracy > 0.2


def test_tfidf_takes_the_whole_vocabulary(spark, monkeypatch):
    from prooflake.operators import models

    seen = []
    fit = models.fit_predict
    monkeypatch.setattr(models, "fit_predict", lambda train, test: seen.append(train.first()["features"].size) or fit(train, test))
    assert catalog.queries()["tfidf_lr"](spark, SF).count() == 1 and seen == [50_000]


def test_leave_one_out_refuses_more_datasets_than_it_judges(spark):
    from prooflake.operators import models, sampling

    rows = spark.range(1001).selectExpr("CAST(id AS STRING) AS dataset", "CAST(id % 2 AS INT) AS label", "CAST(id AS DOUBLE) AS x")
    with pytest.raises(ValueError, match="more than 1000"):
        models.leave_one_out(rows, "dataset", ["x"])
    with pytest.raises(ValueError, match="more than 1000"):
        sampling.held_out_by(rows, "dataset")
