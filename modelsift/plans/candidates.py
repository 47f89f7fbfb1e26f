"""Importing this module registers every candidate."""

from . import bayes, knn, linear, margins, trees  # noqa: F401

# registration order is the training order
from .registry import _CANDIDATES

_ORDER = (knn.Knn, linear.ElasticNet, linear.Logistic, trees.RandomForest, trees.DecisionTree, margins.Svm, bayes.NaiveBayesCandidate)
for _models in _CANDIDATES.values():
    _models.sort(key=lambda c: _ORDER.index(c) if c in _ORDER else len(_ORDER))
