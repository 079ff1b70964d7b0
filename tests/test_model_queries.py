"""Registered model queries fit what the operators' defaults say."""

import pytest

from tickloom.operators import models
from tickloom.plans import queries


class Called(Exception):
    """Raised in place of a fit, with what the query asked for."""


FORECASTS = ("forecast_recommendations", "forecast_fold_results", "forecast_run_metrics", "boosted_scores", "regime_pair_scores")


@pytest.mark.parametrize("name", FORECASTS)
def test_forecast_queries_fit_the_default_setting(name, monkeypatch):
    def forecast(market, *rest, setting=models.BoostSetting(), **more):
        raise Called(setting, rest)

    monkeypatch.setattr(queries, "market", lambda spark, sf: None)
    monkeypatch.setattr(queries, "forecast", forecast)
    with pytest.raises(Called) as call:
        queries.QUERIES[name](None, "")
    assert call.value.args == (models.BoostSetting(), ())
    assert models.BoostSetting().trees == 600


def test_tuning_compares_the_candidates_as_they_are(monkeypatch):
    def tune(rows, names, settings, *rest, **more):
        raise Called(settings, more)

    class Rows:
        agg = join = lambda self, *_: self

    monkeypatch.setattr(queries, "market", lambda spark, sf: None)
    monkeypatch.setattr(queries, "fold_rows", lambda m: (Rows(), ["x"]))
    monkeypatch.setattr(queries, "keeper", lambda m: None)
    monkeypatch.setattr(queries.F, "min", lambda c: queries.F)
    monkeypatch.setattr(queries.F, "alias", lambda c: c, raising=False)
    monkeypatch.setattr(models, "tune", tune)
    with pytest.raises(Called) as call:
        queries.QUERIES["tuned_setting"](None, "")
    assert call.value.args == (models.tuning_candidates("low"), {})


def test_elimination_runs_with_its_defaults_over_the_technical_columns(monkeypatch):
    class Market:
        def labelled(self, features=()):
            return features

    def eliminate(rows, features, *rest, **more):
        raise Called(rows, features, rest, more)

    monkeypatch.setattr(queries, "market", lambda spark, sf: Market())
    monkeypatch.setattr(models, "eliminate_features", eliminate)
    with pytest.raises(Called) as call:
        queries.QUERIES["eliminated_features"](None, "")
    rows, features, rest, more = call.value.args
    assert rows == features and len(features) == 18 and (rest, more) == ((), {})
