"""Candidate-profile analytics written as Spark DataFrame expressions."""

from dossier.operators.filters import FilterError, FilterSpec
from dossier.plans.retrieval import categories, page_envelope, retrieve

__all__ = ["FilterError", "FilterSpec", "categories", "page_envelope", "retrieve"]
