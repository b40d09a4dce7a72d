"""Filtered retrieval: page, CSV or JSON of the matching profiles."""

from pyspark.sql import functions as F

from dossier.operators.export import csv_columns, decorate, json_documents
from dossier.operators.filters import FilterSpec
from dossier.operators.paging import envelope, page
from dossier.operators.tracking import distinct_categories, modified_since


def as_spec(params):
    return params if isinstance(params, FilterSpec) else FilterSpec.from_params(params)


def retrieve(profiles, params, tracking=None, as_of=None):
    """Profiles that match; ``as_of`` is the moment the time window ends, now by default.

    The window is a semi-join to the distinct recent ids of ``tracking``; they never leave the
    executors, and without any the result is empty.
    """
    spec = as_spec(params)
    found = profiles.where(spec.to_column(promoted="skills_all" in profiles.columns))
    if spec.window is None:
        return found
    if tracking is None:
        raise ValueError("time_filter needs the tracking table")
    end = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return found.join(modified_since(tracking, end - F.expr(spec.window)), "profile_id", "left_semi")


def retrieve_page(profiles, params, tracking=None, as_of=None, number=1, limit=None):
    """A decorated page; only the rows of the page are decorated."""
    return decorate(page(retrieve(profiles, params, tracking, as_of), number, limit))


def retrieve_csv(profiles, params, tracking=None, as_of=None):
    return csv_columns(decorate(retrieve(profiles, params, tracking, as_of)))


def retrieve_json(profiles, params, tracking=None, as_of=None):
    return json_documents(decorate(retrieve(profiles, params, tracking, as_of)))


def answer(profiles, params, tracking=None, as_of=None, number=1, limit=None):
    """What a request asks for: all matches as flat rows with ``format_type`` csv, else a page of profiles."""
    spec = as_spec(params)
    if spec.format_type == "csv":
        return retrieve_csv(profiles, spec, tracking, as_of)
    return retrieve_page(profiles, spec, tracking, as_of, number, limit)


def page_envelope(profiles, params, tracking=None, as_of=None, number=1, limit=None):
    return envelope(retrieve(profiles, params, tracking, as_of), number, limit)


def categories(tracking):
    return distinct_categories(tracking)
