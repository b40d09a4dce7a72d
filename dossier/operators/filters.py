"""Typed filter parameters compiled to one Column."""

import math
import warnings
from dataclasses import dataclass, fields

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import both, either

SUMMARY = "parsed_data.additional_experience_summary"
SKILLS = "parsed_data.skills"
PROFICIENT = [f"{SKILLS}.{kind}.proficient" for kind in ("languages", "frameworks", "technologies")]
AVERAGE = [f"{SKILLS}.{kind}.average" for kind in ("languages", "frameworks", "technologies")]

# parameter -> column of the summary it is a lower bound for
THRESHOLDS = {
    "full_time_experience": "years_of_full_time_experience_after_graduation",
    "product_company_experience": "product_company_experience",
    "startup_experience": "total_startup_experience",
    "early_stage_startup_experience": "total_early_stage_startup_experience",
    "service_company_experience": "service_company_experience",
}


class FilterError(ValueError):
    """A parameter value that cannot be used."""


@dataclass(frozen=True)
class FilterSpec:
    """All parameters are optional and AND-ed. A threshold of 0 means no filter.

    ``format_type`` picks the output and filters nothing. ``literal`` makes ``degree_type`` and
    ``resume_type`` plain text instead of regular expressions.
    """

    skills_experience: str | None = None
    skills_and: str | None = None
    proficient_technologies_and: str | None = None
    full_time_experience: float | None = None
    company_type: str | None = None
    product_company_experience: float | None = None
    startup_experience: float | None = None
    degree_type: str | None = None
    last_position_held: str | None = None
    gen_ai_experience: str | None = None
    is_cs_degree: str | None = None
    is_ml_degree: str | None = None
    early_stage_startup_experience: float | None = None
    institute_type: str | None = None
    llm_experience: str | None = None
    service_company_experience: float | None = None
    resume_type: str | None = None
    projects_outside_of_work: str | None = None
    time_filter: str | None = None
    skills_or: str | None = None
    proficient_technologies_or: str | None = None
    format_type: str | None = None
    industry_type: str | None = None
    company_size: str | None = None
    literal: bool = False

    @classmethod
    def from_params(cls, params, literal=False):
        """Parameters as text, as they come from a request; unknown names are ignored."""
        known = {f.name for f in fields(cls)} - {"literal"}
        return cls(**{k: _typed(k, v) for k, v in params.items() if k in known}, literal=literal)

    def __post_init__(self):
        self.skill_years  # noqa: B018  raises on a malformed item
        for name in THRESHOLDS:
            value = getattr(self, name)
            if value is not None and math.isnan(value):
                raise FilterError(f"{name}: not a number")
        if self.company_size is not None and self.company_size not in K.COMPANY_SIZES:
            raise FilterError(f"company_size: not one of {', '.join(K.COMPANY_SIZES)}")
        if self.time_filter and self.window is None:
            warnings.warn(f"time_filter {self.time_filter!r} filters nothing", stacklevel=3)
        if self.company_type and self.company_type != "product":
            warnings.warn(f"company_type {self.company_type!r} filters nothing", stacklevel=3)

    @property
    def skill_years(self):
        """[(map key, years)] of ``skills_experience``."""
        pairs = []
        for item in _items(self.skills_experience):
            name, bar, years = item.partition("|")
            if not bar or "|" in years:
                raise FilterError(f"skills_experience: {item!r} is not skill|years")
            pairs.append((name.lower(), _number("skills_experience", years)))
        return pairs

    @property
    def window(self):
        """Length of the time window as SQL, None without one; unknown names give none."""
        return K.TIME_WINDOWS.get(self.time_filter)

    def to_column(self, promoted=False):
        """One predicate over a profile row for ``where``: missing values give NULL, which is no match.

        The tests stay bare, since one wrapped in ``coalesce`` would not reach the parquet scan.
        ``promoted`` uses the flattened skill lists a stored profile carries instead of the six
        nested ones. The time window is a join, see ``retrieval.retrieve``.
        """
        tests = [*self._summary(), *self._flags(), *self._any_element(), *self._skills(promoted)]
        return both(*tests) if tests else F.lit(True)

    def _summary(self):
        tests = []
        for name, column in THRESHOLDS.items():
            bound = getattr(self, name)
            if bound:
                tests.append(F.col(f"{SUMMARY}.{column}") >= float(bound))
        if self.company_type == "product" and not self.product_company_experience:
            tests.append(F.col(f"{SUMMARY}.product_company_experience") > 0)
        if self.last_position_held:
            held = F.lower(F.col(f"{SUMMARY}.last_position_held"))
            tests.append(F.contains(held, F.lower(F.lit(self.last_position_held))))
        if self.resume_type:
            tests.append(self._matches(F.col("parsed_data.resume_type"), self.resume_type))
        return tests

    def _flags(self):
        tests = []
        for name in ("gen_ai_experience", "llm_experience"):
            value = getattr(self, name)
            if value:
                tests.append(F.col(f"{SKILLS}.{name}") == F.lit(value.lower() == "true"))
        return tests

    def _any_element(self):
        """Each test looks for an element of its own: they must not be put into one ``exists``."""
        tests = []
        if self.degree_type:
            levels = F.col("parsed_data.education.degree_level")
            tests.append(F.exists(levels, lambda x: self._matches(x, self.degree_type)))
        for name in ("is_ml_degree", "is_cs_degree"):
            value = getattr(self, name)
            if value:
                tests.append(F.array_contains(f"parsed_data.education.{name}", value.lower() == "true"))
        if self.institute_type:
            institutes = F.col("parsed_data.education.institute_type")
            if self.institute_type.lower() == "all":
                tests.append(F.arrays_overlap(institutes, _texts(K.NAMED_INSTITUTES)))
            else:
                tests.append(F.exists(institutes, lambda x: _same(x, self.institute_type)))
        company = "parsed_data.experience.company_information"
        if self.industry_type:
            tests.append(F.exists(F.col(f"{company}.industry_type"), lambda x: _same(x, self.industry_type)))
        if self.company_size:
            tests.append(F.exists(F.col(f"{company}.company_size_range"), lambda x: _same(x, self.company_size)))
        if self.projects_outside_of_work:
            tests.append(F.size("parsed_data.projects_outside_of_work") > 0)
        return tests

    def _skills(self, promoted):
        every = ["skills_all"] if promoted else PROFICIENT + AVERAGE
        proficient = ["skills_proficient"] if promoted else PROFICIENT
        tests = []
        for name, years in self.skill_years:
            known = F.try_element_at(F.col(f"{SKILLS}.total_skill_experience"), F.lit(name))
            tests.append(known >= years)
        for skill in _items(self.skills_and):
            tests.append(_in_any(every, skill))
        for skill in _items(self.proficient_technologies_and):
            tests.append(_in_any(proficient, skill))
        # both OR parameters feed one group
        wanted = []
        if self.skills_or:
            wanted += [_overlap(c, _items(self.skills_or)) for c in every]
        if self.proficient_technologies_or:
            wanted += [_overlap(c, _items(self.proficient_technologies_or)) for c in proficient]
        if wanted:
            tests.append(either(*wanted))
        return tests

    def _matches(self, col, value):
        # with d only a line feed ends a line, for the end anchor and for the dot
        return _same(col, value) if self.literal else col.rlike(f"(?iud)^{value}$")


def _typed(name, value):
    """A request value; '' means not given, white space alone is an error."""
    if value is None or value == "":
        return None
    if name in THRESHOLDS:
        return _number(name, value)
    if name == "company_size":
        return value
    text = str(value).strip()
    if not text:
        raise FilterError(f"{name}: may not be blank")
    return text


def _number(name, value):
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise FilterError(f"{name}: a number is needed, not {value!r}") from None
    if math.isnan(number):
        raise FilterError(f"{name}: not a number")
    return number


def _items(value):
    return [item.strip() for item in value.split(",")] if value else []


def _texts(values):
    return F.array(*[F.lit(v) for v in values])


def _same(col, value):
    return F.lower(col) == F.lower(F.lit(value))


def _in_any(columns, skill):
    return either(*[F.array_contains(c, skill) for c in columns])


def _overlap(column, skills):
    return F.arrays_overlap(column, _texts(skills))
