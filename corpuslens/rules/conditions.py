"""Rules whose conditions are SQL text: flags, advice and corrections.

Rows that a caller can filter, extend or replace.  ``operators.conditions`` turns the texts into checked columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from corpuslens.rules import recommendations as r


@dataclass(frozen=True)
class Flag:
    """Holds for a repository if ``condition`` does for a row of its stack: (category, tech, matches, confidence, sub_category)."""

    name: str
    condition: str


@dataclass(frozen=True)
class Advice:
    """A text for repositories whose flags (and has_git, has_docs, has_ci) meet ``condition``."""

    name: str
    kind: str  # "conflict" or "practice"
    condition: str
    text: str
    reason: str
    severity: str
    in_review: bool = False  # also given where review suggestions lead


@dataclass(frozen=True)
class Correction:
    """The points of a technology are divided (0: set to zero) unless ``condition`` holds for a repository's score row.

    The row has what ``plans.analysis.score_state`` collects: the flags that content rules set, file kinds and
    counts.  ``stage`` orders corrections of a detector among its other steps; 1 is the earlier.
    """

    detector: str
    tech: str
    condition: str
    divisor: int = 2
    stage: int = 1


# Technology names, thresholds and what advice they lead to.

FLAGS = (
    Flag("jquery", "category = 'frameworks' and tech = 'jQuery'"),
    Flag("react", "category = 'frameworks' and tech = 'React'"),
    Flag("django", "category = 'frameworks' and tech = 'Django'"),
    Flag("express", "category = 'frameworks' and tech = 'Express'"),
    Flag("flask", "category = 'frameworks' and tech = 'Flask'"),
    Flag("mongoose", "category = 'frameworks' and tech = 'Mongoose'"),
    Flag("sqlalchemy", "category = 'frameworks' and tech = 'SQLAlchemy'"),
    Flag("sqlite", "category = 'databases' and tech = 'SQLite'"),
    Flag("mongodb", "category = 'databases' and tech = 'MongoDB'"),
    Flag("docker", "category = 'devops' and tech = 'Docker'"),
    Flag("testing", "category = 'testing'"),
    Flag("webpack", "category = 'build_systems' and contains(lower(tech), 'webpack')"),
    Flag("microservices", "category = 'architecture' and tech = 'Microservices' and confidence > 70"),
)
_ADVICE_CONDITIONS = {
    "jquery_react": "jquery and react",
    "sqlite_microservices": "sqlite and microservices",
    "django_react": "django and react and not webpack",
    "mongo_express": "mongodb and express and not mongoose",
    "flask_sqlalchemy": "flask and not sqlalchemy",
    "no_git": "not has_git",
    "no_tests": "not testing",
    "no_docker": "not docker",
    "no_docs": "not has_docs",
    "no_ci": "not has_ci",
}
_IN_REVIEW = ("jquery_react", "sqlite_microservices", "django_react", "no_git", "no_tests")
ADVICE = tuple(
    Advice(name, kind, _ADVICE_CONDITIONS[name], text, reason, severity, name in _IN_REVIEW)
    for kind, rules in (("conflict", r.CONFLICTS), ("practice", r.BEST_PRACTICES))
    for name, (text, reason, severity) in rules.items()
)
CORRECTIONS = (
    Correction("frameworks", "Django", "django_files"),
    Correction("frameworks", "React", "array_contains(flags, 'react_code') or jsx_files"),
    Correction("build_systems", "Maven", "valid_pom"),
    Correction("build_systems", "Gradle", "valid_gradle"),
    Correction("build_systems", "Webpack", "valid_webpack"),
    Correction("package_managers", "Maven", "valid_pom"),
    Correction("package_managers", "Gradle", "valid_gradle"),
    Correction("frontend", "Angular", "not array_contains(flags, 'django_template') or array_contains(flags, 'angular_specific')", 5),
    Correction("frontend", "Tailwind CSS", "array_contains(flags, 'tailwind_specific') or tailwind_file", 5),
    Correction(
        "devops", "Helm", "array_contains(flags, 'helm_chart') or (array_contains(flags, 'helm_templates') and array_contains(flags, 'helm_values'))", 10,
    ),
    Correction("devops", "Packer", "array_contains(flags, 'packer_specific')", 10),
    Correction("architecture", "MVC", "models >= 2 and views >= 2 and controllers >= 2"),
    Correction("architecture", "MVVM", "models >= 2 and views >= 2 and viewmodels >= 2"),
    Correction("architecture", "Clean Architecture", "entities >= 2 and usecases >= 2 and adapters >= 2"),
    Correction("architecture", "Microservices", "array_contains(flags, 'micro') or services >= 3"),
    Correction("architecture", "Event-Driven Architecture", "array_contains(flags, 'event')"),
    Correction("architecture", "Feature-based architecture", "feature_files >= 5", stage=2),
    Correction("testing", "React Testing Library", "javascript_files and array_contains(flags, 'react_testing_library')", 0),
    Correction("testing", "Enzyme", "javascript_files and array_contains(flags, 'enzyme')", 0),
    Correction("testing", "RSpec", "ruby_files and array_contains(flags, 'rspec')", 0),
)
