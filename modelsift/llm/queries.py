"""Registers the queries of all operators in this subpackage."""

from . import centroids, chat, extraction, hyperplanes, jaccard, licenses, packing, pieces, pstable, simple8b, spelling, substrings, toxicity  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
