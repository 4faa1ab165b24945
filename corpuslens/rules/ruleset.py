"""Rule rows: the tables of this package turned into the two lists a scan evaluates.

A path rule looks at a file's path; a content rule looks at its text.  Both are plain rows, so a
caller can append, drop or edit rules before an analysis (see ``default_rules``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

from corpuslens.functions.regex import anchors, to_java
from corpuslens.rules import architecture, build, databases, devops, frameworks, frontend, testing
from corpuslens.rules.conditions import CORRECTIONS, Correction


@dataclass(frozen=True)
class PathRule:
    """``kind``: literal, tier, suffix_tier, config, glob, match, search, sign, sign_lower, directory."""

    detector: str
    tech: str
    kind: str
    patterns: tuple[str, ...]
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    step: int = 1
    category: int = -1
    ordinal: int = 0


@dataclass(frozen=True)
class ContentRule:
    """``kind``: literal, regex, exists, present, present_lower; ``scope``: files it applies to."""

    detector: str
    tech: str
    kind: str
    pattern: str
    weight: float = 0.0
    cap: int = 0
    scope: str = "text"
    style: str = ""
    label: str = ""
    group: int = 0
    ignore_case: bool = False
    step: int = 3
    category: int = -1
    ordinal: int = 0


@dataclass(frozen=True)
class RuleSet:
    path_rules: tuple[PathRule, ...]
    content_rules: tuple[ContentRule, ...]
    test_directories: tuple[str, ...] = field(default=tuple(testing.TEST_DIRECTORIES))
    corrections: tuple[Correction, ...] = CORRECTIONS

    def with_literal_directories(self) -> "RuleSet":
        """Directory sets compared without their trailing slash rule, so that only prefixes such as
        ``ms-`` can match: the literal reading of the rule tables."""
        kept = (r for r in self.path_rules if r.kind != "directory" or not r.patterns[0].endswith("/"))
        return replace(self, path_rules=tuple(kept))

    def for_detectors(self, detectors) -> "RuleSet":
        """Only the rules a set of detectors needs (flags and extras of a detector included)."""
        wanted = set(detectors)

        def keep(rule):
            owner = rule.label if rule.detector == "flag" else rule.detector
            return owner.partition("+")[0] in wanted

        def path_owner(rule):
            owner = FLAG_OWNER.get(rule.tech.partition(":")[0], "") if rule.detector == "flag" else rule.detector
            return owner.partition("+")[0] in wanted

        return replace(
            self,
            path_rules=tuple(r for r in self.path_rules if path_owner(r)),
            content_rules=tuple(r for r in self.content_rules if keep(r)),
        )


# Which detector reads a path flag, by the flag's prefix.
FLAG_OWNER = {
    "top": "package_managers",
    "topnpm": "package_managers",
    "toppip": "package_managers",
    "helm_templates": "devops",
    "helm_values": "devops",
    "convention": "architecture",
    "micro": "architecture",
    "event": "architecture",
    "rest": "architecture",
}


def listed(table: dict[str, list[str]], tech: str, default: str = "general") -> str:
    """The key whose list holds a technology."""
    return next((key for key, techs in table.items() if tech in techs), default)


def _sub_category(tables, names, tech: str) -> int:
    for table, name in tables:
        if tech in table:
            return names.index(name)
    return names.index("other")


FRONTEND_TABLES = [
    (frontend.FRAMEWORK_FILES, "framework"),
    (frontend.CSS_FILES, "css"),
    (frontend.STATE_FILES, "state_management"),
    (frontend.COMPONENT_FILES, "component_library"),
    (frontend.TESTING_FILES, "testing"),
]
DEVOPS_TABLES = [
    (devops.CONTAINER_FILES, "containerization"),
    (devops.CICD_FILES, "cicd"),
    (devops.IAC_FILES, "iac"),
    (devops.MONITORING_FILES, "monitoring"),
    (devops.CLOUD_FILES, "cloud"),
]
# Evidence of a stronger kind outranks a weaker one when sub-categories differ.
FILE_RANK, CONFIG_RANK, NAME_RANK, DEPENDENCY_RANK = 100, 100, 200, 300


def _path_rules():
    for tech, patterns in frameworks.PATTERNS.items():
        for pattern in patterns:
            yield PathRule("frameworks", tech, "literal", (pattern,), (10, 5, 2))
    for detector, table in (("build_systems", build.BUILD_FILES), ("package_managers", build.PACKAGE_FILES)):
        for tech, patterns in table.items():
            yield PathRule(detector, tech, "suffix_tier", tuple(patterns), (10, 8, 5))
    for name, tech in (("package.json", "npm"), ("requirements.txt", "pip")):
        yield PathRule("package_managers", tech, "name", (name,), (20, 0, 0))
    for table, name in FRONTEND_TABLES:
        for tech, patterns in table.items():
            category = FILE_RANK + frontend.SUB_CATEGORIES.index(name)
            yield PathRule("frontend", tech, "tier", tuple(patterns), (10, 5, 3), category=category)
    for table, name in DEVOPS_TABLES:
        for tech, patterns in table.items():
            category = FILE_RANK + devops.SUB_CATEGORIES.index(name)
            globs = tuple(p[1:] for p in patterns if name == "iac" and p.startswith("*."))
            plain = tuple(p for p in patterns if not (name == "iac" and p.startswith("*.")))
            if globs:
                yield PathRule("devops", tech, "glob", globs, (15, 0, 0), category=category)
            yield PathRule("devops", tech, "tier", plain, (15, 10, 5), category=category)
    for sets in architecture.DIRECTORY_SETS.values():
        for members in sets:
            for member in members:
                yield PathRule("architecture+directory", member, "directory", (member,))
    for tech, patterns in architecture.FILE_PATTERNS.items():
        for i, pattern in enumerate(patterns):
            yield PathRule("architecture+file", f"{tech}/{i}", "search", (pattern,), (1, 0, 0), step=2)
    for i, (_, _, _, signs, _) in enumerate(architecture.CONVENTIONS):
        for sign in signs:
            yield PathRule("flag", f"convention:{i}:{sign}", "sign", (sign,))
    yield PathRule("flag", "micro", "sign", tuple(architecture.MICROSERVICE_SIGNS))
    yield PathRule("flag", "event", "sign_lower", tuple(architecture.EVENT_SIGNS))
    yield PathRule("flag", "rest", "sign_lower", tuple(architecture.REST_SIGNS))
    yield PathRule("flag", "helm_templates", "sign", ("templates/",))
    for front, back in build.SPLIT_DIRECTORIES:
        for side in (front, back):
            yield PathRule("flag", f"top:{side}", "top", (side + "/",))
        yield PathRule("flag", f"topnpm:{front}", "top_name", (front, "package.json"))
        yield PathRule("flag", f"toppip:{back}", "top_name", (back, "requirements.txt"))
    for tech, patterns in testing.TEST_FILES.items():
        category = NAME_RANK + testing.SUB_CATEGORIES.index("general")
        yield PathRule("testing", tech, "match", tuple(patterns), (5, 0, 0), step=2, category=category)
    for tech, names in testing.CONFIG_FILES.items():
        category = CONFIG_RANK + testing.SUB_CATEGORIES.index(listed(testing.CONFIG_CATEGORY, tech))
        yield PathRule("testing", tech, "config", tuple(names), (15, 0, 0), step=2, category=category)


def _flags(owner: str, name: str, patterns: list[str], ignore_case: bool = False):
    for pattern in patterns:
        yield ContentRule(
            "flag", name, "exists", pattern, scope="all", label=owner, ignore_case=ignore_case
        )


def _content_rules():
    # Frameworks: literals of four characters and more, dependencies, proofs.
    for tech, patterns in frameworks.PATTERNS.items():
        for pattern in patterns:
            if len(pattern) >= 4:
                yield ContentRule("frameworks", tech, "literal", pattern, 1, style="literal")
    for tech, names in frameworks.REQUIREMENTS.items():
        for name in names:
            yield ContentRule(
                "frameworks", tech, "present_lower", name, 15, scope="requirements",
                style="requirement", step=2,
            )
    for tech, names in frameworks.PACKAGE_JSON.items():
        for name in names:
            yield ContentRule(
                "frameworks", tech, "present", f'"{name}"', 15, scope="package_json",
                style="dependency", label=name, step=2,
            )
    for tech, patterns in frameworks.STRONG_EVIDENCE.items():
        yield from _flags("frameworks", f"strong:{tech}", patterns)
    yield from _flags("frameworks", "react_code", [r"useState", r"useEffect", r"React\.Component"])
    yield from _flags("frameworks", "flask_sqlalchemy", [r"flask_sqlalchemy", r"SQLAlchemy\(app\)"])

    # Databases: every pattern ignores case.
    for tech, patterns in databases.CONFIG_FILES.items():
        for pattern in patterns:
            yield ContentRule(
                "databases", tech, "name", pattern, 20, scope="all", style="config", ignore_case=True, step=1
            )
    tables = ((databases.URLS, 10, "url"), (databases.DRIVERS, 8, "driver"))
    for table, weight, style in tables:
        for tech, patterns in table.items():
            for pattern in patterns:
                yield ContentRule(
                    "databases", tech, "regex", pattern, weight, style=style, ignore_case=True, step=1
                )
    for orm, patterns in databases.ORMS.items():
        for database, weight, needs, excludes in databases.ORM_ROUTES.get(orm, []):
            scope = orm_scope(needs, excludes)
            for pattern in patterns:
                yield ContentRule(
                    "databases", database, "regex", pattern, weight, scope=scope, style="orm",
                    label=orm, ignore_case=True, step=1,
                )
    for dialect, patterns in databases.QUERIES.items():
        database, weight, label = databases.QUERY_TARGETS[dialect]
        for pattern in patterns:
            yield ContentRule(
                "databases", database, "regex", pattern, weight, style="query", label=label,
                ignore_case=True, step=1,
            )
    for tech, patterns in databases.CONNECTIONS.items():
        yield from _flags("databases", f"connection:{tech}", patterns)
    extras = (
        (databases.CONTAINER_VARIABLES, 15, "container", "variables"),
        (databases.NPM_PACKAGES, 10, "npm_suffix", "npm_dependency"),
        (databases.PYTHON_PACKAGES, 10, "pip_suffix", "pip_dependency"),
    )
    for table, weight, scope, style in extras:
        for tech, pattern in table.items():
            yield ContentRule(
                "databases+extra", tech, "exists", pattern, weight, scope=scope, style=style, step=4
            )

    # Build systems and package managers.
    tables = (("build_systems", build.BUILD_CONTENT), ("package_managers", build.PACKAGE_CONTENT))
    for detector, table in tables:
        for tech, patterns in table.items():
            for pattern in patterns:
                yield ContentRule(detector, tech, "regex", pattern, 2, style="pattern")
    for owner in ("build_systems", "package_managers"):
        for tech, patterns in build.USAGE.items():
            for pattern in patterns:
                yield ContentRule(
                    "flag", f"usage:{tech}", "exists", pattern, scope="automation", label=owner
                )

    # Frontend, DevOps: at most ten matches per file and pattern.
    for tech, patterns in frontend.CONTENT.items():
        category = _sub_category(FRONTEND_TABLES, frontend.SUB_CATEGORIES, tech)
        for pattern in patterns:
            yield ContentRule(
                "frontend", tech, "regex", pattern, 1, 10, style="pattern", category=category
            )
    yield from _flags("frontend", "django_template", frontend.DJANGO_TEMPLATE)
    yield from _flags("frontend", "angular_specific", frontend.ANGULAR_SPECIFIC)
    yield from _flags("frontend", "tailwind_specific", frontend.TAILWIND_SPECIFIC)
    for tech, patterns in devops.CONTENT.items():
        category = _sub_category(DEVOPS_TABLES, devops.SUB_CATEGORIES, tech)
        for pattern in patterns:
            yield ContentRule(
                "devops", tech, "regex", pattern, 1, 10, style="pattern", category=category
            )
    yield from _flags("devops", "packer_specific", devops.PACKER_SPECIFIC)
    yield ContentRule(
        "flag", "helm_chart", "exists", r"apiVersion:.*helm", scope="chart", label="devops", ignore_case=True
    )

    for tech, patterns in architecture.CODE_PATTERNS.items():
        for pattern in patterns:
            yield ContentRule("architecture", tech, "regex", pattern, 2, style="code", step=5)

    # Testing.
    manifests = (
        (testing.PYTHON, testing.PYTHON_CATEGORY, "python_manifest", "requirements: "),
        (testing.RUBY, testing.RUBY_CATEGORY, "gemfile", "Gemfile: "),
    )
    for table, categories, scope, label in manifests:
        for tech, packages in table.items():
            category = DEPENDENCY_RANK + testing.SUB_CATEGORIES.index(listed(categories, tech))
            for package in packages:
                yield ContentRule(
                    "testing", tech, "present", package, 15, scope=scope, style="package",
                    label=label + package, category=category,
                )
    tables = ((testing.IMPORTS, "test_import"), (testing.CODE, "test_code"))
    for table, style in tables:
        for tech, patterns in table.items():
            category = testing.SUB_CATEGORIES.index(listed(testing.CONTENT_CATEGORY, tech))
            for pattern in patterns:
                yield ContentRule(
                    "testing", tech, "regex", pattern, 1, 10, style=style, step=4, category=category,
                    # A pattern with a capturing group reports that group as its match.
                    group=min(re.compile(pattern).groups, 1),
                )
    yield from _flags("testing", "react_testing_library", testing.TESTING_LIBRARY_SPECIFIC)
    yield from _flags("testing", "enzyme", testing.ENZYME_SPECIFIC)
    yield from _flags("testing", "rspec", testing.RSPEC_SPECIFIC)


def orm_scope(needs: list[str], excludes: list[str]) -> str:
    """Scope of an ORM rule that depends on database words in the file."""
    return "text" if not needs and not excludes else f"orm:{','.join(needs)}:{','.join(excludes)}"


def _numbered(rules):
    return tuple(replace(rule, ordinal=i) for i, rule in enumerate(dict.fromkeys(rules)))


@lru_cache(maxsize=1)
def default_rules() -> RuleSet:
    """Every shipped rule, numbered in order."""
    return RuleSet(_numbered(_path_rules()), _numbered(_content_rules()))


def path_gate(rule: PathRule) -> list[str]:
    """Substrings of which one must be in the path before a path rule is evaluated."""
    if rule.kind in ("match", "search"):
        found: list[str] = []
        for pattern in rule.patterns:
            some = anchors(pattern)
            if not some:
                return [""]
            found += some
        return list(dict.fromkeys(found))
    if rule.kind == "top_name":
        return [rule.patterns[1]]
    return list(rule.patterns)


def path_regex(rule: PathRule) -> str:
    """Java pattern of a match or search rule, empty for the other kinds."""
    if rule.kind == "match":
        return r"\A(?:" + "|".join(to_java(p) for p in rule.patterns) + ")"
    return to_java(rule.patterns[0]) if rule.kind == "search" else ""


def content_gate(rule: ContentRule) -> list[str]:
    """Literals of which one must be in the text before a content rule is evaluated."""
    if rule.kind == "name":
        return [""]
    if rule.kind in ("literal", "present"):
        return [rule.pattern]
    if rule.kind == "present_lower":
        return [rule.pattern.lower()]
    return anchors(rule.pattern, rule.ignore_case) or [""]


def content_regex(rule: ContentRule) -> str:
    if rule.kind in ("literal", "present", "present_lower"):
        return ""
    return to_java(rule.pattern, rule.ignore_case)
