"""The label queries run their operators with the operators' own defaults."""

import inspect
from unittest.mock import MagicMock

import pytest

from catalog import labels
from notecode.operators import baseline, indexing, linear, ranking


@pytest.fixture
def mocked(spark, monkeypatch):
    for name in "v I V B R materialised _leaf_sizes rounded _top_clusters".split():
        monkeypatch.setattr(labels, name, MagicMock())
    monkeypatch.setattr(labels, "L", MagicMock(Fit=linear.Fit))
    monkeypatch.setattr(labels, "_embedded", lambda *_: MagicMock())
    monkeypatch.setattr(labels, "_training", lambda *_: (MagicMock(), MagicMock(), MagicMock()))
    return labels


def given(operator, mock, name):
    """The value of a parameter in the only call of an operator, and its default."""
    signature = inspect.signature(operator)
    bound = signature.bind(*mock.call_args.args, **mock.call_args.kwargs)
    bound.apply_defaults()
    return bound.arguments[name], signature.parameters[name].default


def test_trees_run_all_rounds(mocked):
    mocked.balanced_2means_sizes(None, None)
    mocked.index_labels_sizes(None, None)
    for operator, mock in ((indexing.balanced_2means, mocked.I.balanced_2means), (indexing.index_labels, mocked.I.index_labels)):
        value, default = given(operator, mock, "max_iter")
        assert value == default == 20


def test_models_are_fitted_to_the_end(mocked):
    mocked.L.train_certified.return_value = MagicMock(), MagicMock()
    mocked.train_distributed(None, None)
    mocked.train_full_model_levels(None, None)
    mocked.grid_search(None, None)
    mocked.L.grid_search.call_args.args[1](10, 20, 1.0, 0.01)
    assert given(ranking.topk_matcher, mocked.R.topk_matcher, "k") == (10, 10)
    calls = ((linear.train_certified, mocked.L.train_certified), (linear.train_model, mocked.L.train_model), (linear.train_linear, mocked.L.train_linear))
    for operator, mock in calls:
        assert given(operator, mock, "fit")[0].max_iter == linear.Fit().max_iter == 100


def test_full_model_keeps_the_default_beam(mocked):
    mocked.predict_full_model(None, None)
    value, default = given(linear.predict_beam, mocked.L.predict_beam, "beam")
    assert value == default == 10


def test_baseline_has_all_trees_and_dimensions(mocked, monkeypatch):
    monkeypatch.setattr(labels, "_kiss_inputs", lambda *_: (MagicMock(), MagicMock()))
    mocked.kiss_scores(None, None)
    assert [given(baseline.kiss_train, mocked.B.kiss_train, n) for n in ("rank", "trees", "iterations")] == [(50, 50), (100, 100), (2, 2)]
