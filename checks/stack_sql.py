"""The whole analysis as one chain of SQL common table expressions.

It shares the rule tables with the library but none of its logic: rules apply by joins, corrections
by CASE steps, and patterns run as they are written in the tables on another regex engine.
"""

from __future__ import annotations

from corpuslens.rules import architecture, build, databases, devops, eligibility, frameworks, frontend
from corpuslens.rules import languages, testing, validation
from corpuslens.rules.ruleset import default_rules
from corpuslens.sources.derived import derived_corpus_sql


def text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def table(name: str, columns: str, rows) -> str:
    body = ",\n".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def names(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def exact_round(value: str, digits: int) -> str:
    """Round the exact binary value, ties to even."""
    scaled = f"(CAST({value} * {2.0**56!r} AS HUGEINT) * {10**digits})"
    whole, rest = f"({scaled} // {2**56})", f"({scaled} % {2**56})"
    up = f"CASE WHEN {rest} > {2**55} OR ({rest} = {2**55} AND {whole} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST({whole} + {up} AS DOUBLE) / {float(10**digits)!r}"


NAME = "regexp_extract(path, '[^/]*$')"
EXT = r"regexp_extract(regexp_extract(path, '[^/]*$'), '^\.*[^.].*(\.[^.]*)$', 1)"


def corpus() -> str:
    """files: the derived corpus with the content of unreadable files nulled."""
    listed = eligibility.CONTENT_EXTENSIONS
    return f"""{derived_corpus_sql().replace("files AS (", "raw_files AS (")},
files AS (
  SELECT repo_id, path, size, {NAME} AS name, {EXT} AS ext,
         CASE WHEN lower({EXT}) IN {names(listed)} OR {NAME} IN {names(listed + eligibility.CONTENT_NAMES)}
              THEN content END AS content
  FROM raw_files
)"""


def language_tables() -> str:
    return f"""{table("special_names", "name, lang", languages.SPECIAL_FILES.items())},
{table("ext_langs", "ext, lang", languages.EXTENSIONS.items())},
lang_counts AS (
  SELECT repo_id, coalesce(s.lang, e.lang) AS tech,
         CAST(sum(CASE WHEN s.lang IS NOT NULL THEN 3 ELSE 1 END) AS DOUBLE) AS matches
  FROM files f LEFT JOIN special_names s ON s.name = f.name LEFT JOIN ext_langs e ON e.ext = lower(f.ext)
  WHERE s.lang IS NOT NULL OR e.lang IS NOT NULL GROUP BY ALL
),
lang_shares AS (
  SELECT *, matches / sum(matches) OVER (PARTITION BY repo_id) * 100 AS share FROM lang_counts
),
langs AS (
  SELECT repo_id, tech, matches, {exact_round('share', 2)} AS percentage,
         {exact_round('least(100.0, share * 2)', 2)} AS confidence FROM lang_shares
)"""


def path_tables() -> str:
    rules = default_rules().path_rules
    literal = [
        (r.ordinal, r.detector, r.tech, r.kind, *map(float, r.weights), r.category, p)
        for r in rules if r.kind not in ("match", "search", "top_name") for p in r.patterns
    ]
    regex = [
        (r.ordinal, r.detector, r.tech, r.kind, float(r.weights[0]), r.category,
         ("^(?:" + "|".join(r.patterns) + ")") if r.kind == "match" else r.patterns[0])
        for r in rules if r.kind in ("match", "search")
    ]
    pairs = [(r.tech, *r.patterns) for r in rules if r.kind == "top_name"]
    unit, integration, e2e, general = (
        200 + testing.SUB_CATEGORIES.index(c) for c in ("unit", "integration", "e2e", "general")
    )
    category = f"""CASE WHEN contains(lower({{0}}), 'unit') THEN {unit} WHEN contains(lower({{0}}), 'integration') THEN {integration}
      WHEN contains(lower({{0}}), 'e2e') OR contains(lower({{0}}), 'end-to-end') THEN {e2e} ELSE {general} END"""
    test_dirs = [(i, d) for i, d in enumerate(testing.TEST_DIRECTORIES)]
    return f"""{table("path_pats", "rid, detector, tech, kind, w1, w2, w3, category, pat", literal)},
{table("path_rx", "rid, detector, tech, kind, w1, category, rx", regex)},
{table("top_names", "flag, top, wanted", pairs)},
{table("test_dirs", "no, dir", test_dirs)},
path_tiers AS (
  SELECT repo_id, path, rid, any_value(detector) AS detector, any_value(tech) AS tech, any_value(category) AS category,
    any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3,
    min(CASE
      WHEN kind = 'directory' THEN CASE WHEN NOT starts_with(path, '.') AND contains('/' || regexp_replace(path, '[^/]*$', ''),
             CASE WHEN ends_with(pat, '/') THEN '/' || pat ELSE pat || '/' END) THEN 1 END
      WHEN kind = 'top' THEN CASE WHEN starts_with(path, pat) THEN 1 END
      WHEN kind = 'sign' THEN 1
      WHEN kind = 'sign_lower' THEN 1
      WHEN kind = 'glob' THEN CASE WHEN ends_with(name, pat) THEN 1 END
      WHEN name = pat THEN 1
      WHEN kind = 'name' THEN NULL
      WHEN kind = 'config' THEN CASE WHEN ends_with(name, pat) THEN 1 END
      WHEN kind = 'suffix_tier' AND ends_with(name, pat) THEN 2
      WHEN kind IN ('literal', 'tier') AND contains(name, pat) THEN 2
      ELSE 3 END) AS tier
  FROM files JOIN path_pats ON contains(path, pat) OR (kind = 'sign_lower' AND contains(lower(path), pat))
  GROUP BY repo_id, path, rid
),
test_files AS (
  SELECT repo_id, path, any_value(ext) AS ext, min_by(dir, no) AS dir FROM files JOIN test_dirs ON contains(path, dir)
  GROUP BY repo_id, path
),
path_hits AS (
  SELECT repo_id, path, detector, tech, CASE tier WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END AS points, category
  FROM path_tiers WHERE tier IS NOT NULL
  UNION ALL SELECT repo_id, path, detector, tech, w1, CASE WHEN kind = 'match' THEN {category.format("path")} ELSE category END
  FROM files JOIN path_rx ON regexp_matches(CASE WHEN kind = 'match' THEN name ELSE path END, rx)
  UNION ALL SELECT repo_id, path, 'flag', flag, 0, -1 FROM files JOIN top_names ON name = wanted AND starts_with(path, top)
  UNION ALL SELECT repo_id, path, 'testing', 'Tests', 2, ({category.format("dir")}) - 200 FROM test_files
)"""


def content_tables() -> str:
    rules = default_rules().content_rules
    rows = [
        (r.ordinal, r.detector, r.tech, r.kind, r.pattern, float(r.weight), r.cap, r.scope, r.ignore_case, r.category)
        for r in rules if r.kind != "name"
    ]
    config = [(r.tech, r.pattern, float(r.weight)) for r in rules if r.kind == "name"]
    orm = []
    for scope in dict.fromkeys(r.scope for r in rules if r.scope.startswith("orm:")):
        needs, excludes = ([w for w in p.split(",") if w] for p in scope.split(":")[1:])
        tests = []
        if needs:
            tests.append("(" + " OR ".join(f"contains(lower(f.content), {text(w)})" for w in needs) + ")")
        tests += [f"NOT contains(lower(f.content), {text(w)})" for w in excludes]
        orm.append(f"WHEN {text(scope)} THEN {' AND '.join(tests)}")
    frontend_deps = [("frontend", p, t, 200 + frontend.SUB_CATEGORIES.index(c)) for p, (t, c) in frontend.DEPENDENCIES.items()]
    unit = {t: c for c, ts in testing.NPM_CATEGORY.items() for t in ts}
    testing_deps = [
        ("testing", p, t, 300 + testing.SUB_CATEGORIES.index(unit.get(t, "general"))) for t, ps in testing.NPM.items() for p in ps
    ]
    code = {c: 100 + devops.SUB_CATEGORIES.index(c) for c in ("containerization", "cicd")}
    special = lambda tech, category, test: (
        f"UNION ALL SELECT repo_id, path, 'devops', {text(tech)}, 15, {code[category]} FROM files WHERE {test}"
    )
    has = lambda *ws: " AND ".join(f"contains(content, {text(w)})" for w in ws)
    specials = "\n".join([
        special("Docker", "containerization", has("FROM ", "RUN ") + " AND (contains(content, 'WORKDIR ') OR contains(content, 'COPY ') OR contains(content, 'CMD '))"),
        special("Kubernetes", "containerization", has("apiVersion: ", "kind: ", "metadata:", "spec:")),
        special("GitHub Actions", "cicd", has("name: ", "on: ", "jobs:", "steps:", "uses: ")),
    ])
    return f"""{table("content_rules", "rid, detector, tech, kind, pat, weight, cap, scope, ic, category", rows)},
{table("config_names", "tech, rx, weight", config)},
{table("packages", "detector, package, tech, category", frontend_deps + testing_deps)},
texts AS (SELECT DISTINCT content FROM files WHERE content IS NOT NULL),
text_matches AS (
  SELECT content, rid, detector, tech, kind, weight, cap, scope, category,
    CASE kind
      WHEN 'literal' THEN (length(content) - length(replace(content, pat, ''))) // length(pat)
      WHEN 'regex' THEN len(regexp_extract_all(content, CASE WHEN ic THEN '(?i)' || pat ELSE pat END))
      WHEN 'exists' THEN CAST(regexp_matches(content, CASE WHEN ic THEN '(?i)' || pat ELSE pat END) AS INT)
      WHEN 'present_lower' THEN CAST(contains(lower(content), pat) AS INT)
      ELSE CAST(contains(content, pat) AS INT) END AS n,
    kind = 'literal' AND (contains(content, 'import ' || pat) OR contains(content, 'require(' || pat)
      OR contains(content, 'include ' || pat)) AS imported
  FROM texts, content_rules
),
content_hits AS (
  SELECT repo_id, path, detector, tech, CASE WHEN cap > 0 THEN least(n, cap) ELSE n END * weight * CASE WHEN imported THEN 2 ELSE 1 END AS points, category
  FROM files f JOIN text_matches m ON f.content = m.content
  WHERE n > 0 AND CASE scope
    WHEN 'requirements' THEN name = 'requirements.txt'
    WHEN 'package_json' THEN name = 'package.json'
    WHEN 'container' THEN contains(lower(path), 'dockerfile') OR contains(lower(path), 'docker-compose')
    WHEN 'npm_suffix' THEN ends_with(path, 'package.json')
    WHEN 'pip_suffix' THEN ends_with(path, 'requirements.txt') OR ends_with(path, 'Pipfile')
    WHEN 'automation' THEN regexp_matches(path, '(\\.sh|\\.yml|\\.yaml)$|\\.github/workflows/') OR regexp_matches(lower(path), 'jenkins|travis|gitlab-ci|dockerfile')
    WHEN 'chart' THEN ends_with(path, 'Chart.yaml') OR ends_with(path, 'Chart.yml')
    WHEN 'python_manifest' THEN name IN ('requirements.txt', 'Pipfile', 'pyproject.toml', 'requirements.in')
    WHEN 'gemfile' THEN name IN ('Gemfile', 'Gemfile.lock')
    {' '.join(orm)}
    ELSE true END
  UNION ALL SELECT repo_id, path, 'databases', tech, weight, -1 FROM files JOIN config_names ON regexp_matches(name, '(?i)' || rx)
    WHERE content IS NOT NULL
  UNION ALL SELECT repo_id, path, detector, tech, 15, category
    FROM (SELECT repo_id, path, unnest(coalesce(json_keys(content, '$.dependencies'), []) || coalesce(json_keys(content, '$.devDependencies'), [])) AS package
          FROM files WHERE name = 'package.json' AND json_valid(content)) JOIN packages USING (package)
  {specials}
),
pts AS (
  SELECT repo_id, detector, tech, CAST(sum(points) AS DOUBLE) AS p, max(category) AS category
  FROM (SELECT * FROM path_hits UNION ALL SELECT * FROM content_hits) WHERE detector <> 'flag' GROUP BY ALL
),
flags AS (
  SELECT DISTINCT repo_id, tech AS flag FROM (SELECT * FROM path_hits UNION ALL SELECT * FROM content_hits) WHERE detector = 'flag'
),
shape AS (
  SELECT repo_id,
    coalesce(bool_or(regexp_matches(path, 'settings\\.py|urls\\.py|manage\\.py')), false) AS django_files,
    coalesce(bool_or(regexp_matches(path, '\\.(jsx|tsx)$')), false) AS jsx_files,
    bool_or(ends_with(path, 'package.json')) AS package_json,
    bool_or(regexp_matches(path, '(requirements\\.txt|setup\\.py)$')) AS pip_file,
    bool_or(ends_with(path, 'pom.xml') AND {has("<project", "<artifactId>")} AND (contains(content, '<groupId>') OR contains(content, '<parent>'))) AS valid_pom,
    bool_or(regexp_matches(path, 'build\\.gradle(\\.kts)?$') AND {has("repositories", "dependencies")}) AS valid_gradle,
    bool_or(contains(lower(path), 'webpack') AND ends_with(path, '.js') AND contains(content, 'module.exports') AND regexp_matches(content, 'entry|output|module')) AS valid_webpack,
    bool_or(contains(path, 'tailwind.config.js')) AS tailwind_file,
    bool_or(regexp_matches(path, '\\.(js|jsx|ts|tsx)$')) AS js_files,
    bool_or(ends_with(path, '.rb')) AS ruby_files,
    count(*) FILTER ((ends_with(path, 'requirements.txt') AND regexp_matches(content, '(^|\n)[ \t]*[^# \t\n=][^\n]*='))
      OR (ends_with(path, 'setup.py') AND {has("install_requires", "[", "]")})) AS pip_declarations,
    min_by(regexp_matches(content, '"(dependencies|devDependencies)"'), path) FILTER (ends_with(path, 'package.json')) AS declares
  FROM files WHERE content IS NOT NULL GROUP BY repo_id
)"""


def has_flag(flag: str, repo: str = "t.repo_id") -> str:
    return f"EXISTS (SELECT 1 FROM flags g WHERE g.repo_id = {repo} AND g.flag = {flag})"


def scored(name: str, source: str, thresholds: dict[str, int], default: int) -> str:
    special = " ".join(f"WHEN {text(t)} THEN {v}" for t, v in thresholds.items())
    limit = f"CASE tech {special} ELSE {default} END" if special else str(default)
    return f"""{name} AS (
  SELECT repo_id, tech, p AS matches, {exact_round('conf', 2)} AS confidence, category FROM (
    SELECT *, least(100.0, p / max(p) OVER (PARTITION BY repo_id) * 100) AS conf, max(p) OVER (PARTITION BY repo_id) AS best FROM {source})
  WHERE best > 0 AND conf >= {limit})"""


def halve(name: str, source: str, tech: str, holds: str, divisor: int = 2) -> str:
    return f"""{name} AS (SELECT t.* REPLACE (CASE WHEN tech = {text(tech)} AND NOT coalesce({holds}, false) THEN floor(p / {divisor}) ELSE p END AS p)
  FROM {source} t LEFT JOIN shape s ON s.repo_id = t.repo_id)"""


def framework_steps() -> str:
    required = table("required", "tech, lang", frameworks.REQUIRED_LANGUAGE.items())
    source = table("source_langs", "loose, lang", frameworks.SOURCE_LANGUAGE.items())
    strong = table("provable", "tech", [(t,) for t in frameworks.STRONG_EVIDENCE])
    return f"""{required}, {source}, {strong},
lang_files AS (
  SELECT repo_id, lang AS language, count(*) AS n FROM files JOIN source_langs ON loose = lower(regexp_extract(path, '[^.]*$'))
  WHERE content IS NOT NULL GROUP BY ALL
),
dominant AS (SELECT repo_id, language, n FROM (SELECT *, sum(n) OVER (PARTITION BY repo_id) AS total FROM lang_files) WHERE n > 0.1 * total),
fw1 AS (
  SELECT t.* REPLACE (CASE WHEN r.lang IS NOT NULL AND d.language IS NULL THEN floor(p / 5) ELSE p END AS p)
  FROM (SELECT * FROM pts WHERE detector = 'frameworks') t LEFT JOIN required r ON r.tech = t.tech
  LEFT JOIN dominant d ON d.repo_id = t.repo_id AND d.language = r.lang
),
fw2 AS (
  SELECT t.* REPLACE (CASE WHEN v.tech IS NOT NULL AND NOT {has_flag("'strong:' || t.tech")} THEN floor(p / 3) ELSE p END AS p)
  FROM fw1 t LEFT JOIN provable v ON v.tech = t.tech
),
{halve("fw3", "fw2", "Django", "s.django_files")},
{halve("fw4", "fw3", "React", "s.jsx_files OR " + has_flag("'react_code'"))},
fw5 AS (
  SELECT t.* REPLACE (CASE WHEN t.tech = 'SQLAlchemy' AND k.p IS NOT NULL THEN greatest(t.p, k.p * CASE WHEN {has_flag("'flask_sqlalchemy'")} THEN 0.9 ELSE 0.8 END) ELSE t.p END AS p)
  FROM fw4 t LEFT JOIN fw4 k ON k.repo_id = t.repo_id AND k.tech = 'Flask'
),
{scored("frameworks_found", "fw5", {"SQLAlchemy": 20}, 35)}"""


def database_steps() -> str:
    rivals = ", ".join(f"coalesce(max(p) FILTER (tech = {text(d)}), -1) AS r{i}" for i, d in enumerate(databases.SPECIFIC_SQL))
    chain, previous = "", "db_rivals"
    for i in range(len(databases.SPECIFIC_SQL)):
        chain += f"db_g{i} AS (SELECT * REPLACE (CASE WHEN r{i} > g THEN floor(g / 2) ELSE g END AS g) FROM {previous}),\n"
        previous = f"db_g{i}"
    return f"""{table("connectable", "tech", [(t,) for t in databases.CONNECTIONS])},
db1 AS (
  SELECT t.repo_id, t.tech, CASE WHEN c.tech IS NOT NULL AND NOT {has_flag("'connection:' || t.tech")} THEN floor(p / 2) ELSE p END AS p
  FROM pts t LEFT JOIN connectable c ON c.tech = t.tech WHERE detector = 'databases'
),
db2 AS (
  SELECT repo_id, tech, sum(p) AS p, -1 AS category
  FROM (SELECT * FROM db1 UNION ALL SELECT repo_id, tech, p FROM pts WHERE detector = 'databases+extra') GROUP BY ALL
),
db_rivals AS (SELECT repo_id, {rivals}, max(p) FILTER (tech = 'SQL Database') AS g FROM db2 GROUP BY repo_id),
{chain}
db3 AS (SELECT t.* REPLACE (CASE WHEN tech = 'SQL Database' THEN g ELSE p END AS p) FROM db2 t JOIN {previous} USING (repo_id)),
{scored("databases_found", "db3", {}, 35)}"""


def build_steps() -> str:
    pairs = [(i, f, b) for i, (f, b) in enumerate(build.SPLIT_DIRECTORIES)]
    usage = table("usage", "tech", [(t,) for t in build.USAGE])
    used = f"CASE WHEN u.tech IS NOT NULL AND {has_flag(chr(39) + 'usage:' + chr(39) + ' || t.tech')} THEN p + 10 ELSE p END"
    aligned = """SELECT a.* REPLACE (CASE WHEN b.confidence - a.confidence > 20 THEN greatest(b.confidence - 10, a.confidence) ELSE a.confidence END AS confidence)
  FROM {0} a LEFT JOIN {1} b ON b.repo_id = a.repo_id AND b.tech = a.tech"""
    return f"""{usage}, {table("split_pairs", "no, front, back", pairs)},
bs1 AS (SELECT t.* REPLACE ({used} AS p) FROM pts t LEFT JOIN usage u ON u.tech = t.tech WHERE detector = 'build_systems'),
{halve("bs2", "bs1", "Maven", "s.valid_pom")}, {halve("bs3", "bs2", "Gradle", "s.valid_gradle")}, {halve("bs4", "bs3", "Webpack", "s.valid_webpack")},
{scored("bs_found", "bs4", {}, 35)},
splits AS (
  SELECT a.repo_id, min_by(front, no) AS front, min_by(back, no) AS back
  FROM split_pairs JOIN flags a ON a.flag = 'top:' || front JOIN flags b ON b.flag = 'top:' || back AND b.repo_id = a.repo_id GROUP BY a.repo_id
),
pm1 AS (
  SELECT repo_id, tech, sum(p) AS p FROM (
    SELECT repo_id, tech, p FROM pts WHERE detector = 'package_managers'
    UNION ALL SELECT t.repo_id, 'npm', 30 FROM splits t WHERE {has_flag("'topnpm:' || t.front")}
    UNION ALL SELECT t.repo_id, 'pip', 30 FROM splits t WHERE {has_flag("'toppip:' || t.back")}) GROUP BY ALL
),
pm2 AS (SELECT t.* REPLACE ({used} AS p) FROM pm1 t LEFT JOIN usage u ON u.tech = t.tech),
pm3 AS (
  SELECT repo_id, tech, sum(p) AS p, -1 AS category FROM (
    SELECT * FROM pm2
    UNION ALL SELECT repo_id, 'npm', 20 FROM shape WHERE package_json
    UNION ALL SELECT repo_id, 'npm', 10 FROM shape WHERE package_json AND declares
    UNION ALL SELECT repo_id, 'pip', 10 * pip_declarations FROM shape WHERE pip_declarations > 0
    UNION ALL SELECT repo_id, 'pip', 20 FROM shape WHERE pip_file) GROUP BY ALL
),
{halve("pm4", "pm3", "Maven", "s.valid_pom")}, {halve("pm5", "pm4", "Gradle", "s.valid_gradle")},
pm6 AS (
  SELECT t.* REPLACE (CASE WHEN t.tech = 'npm' AND k.tech IS NOT NULL AND t.p > 0 THEN greatest(t.p, 10) ELSE t.p END AS p)
  FROM pm5 t LEFT JOIN pm5 k ON k.repo_id = t.repo_id AND k.tech = 'pip'
),
{scored("pm_found", "pm6", {"npm": 25}, 35)},
build_systems_found AS ({aligned.format("bs_found", "pm_found")}),
package_managers_found AS ({aligned.format("pm_found", "bs_found")})"""


def frontend_steps() -> str:
    return f"""fe0 AS (SELECT * FROM pts WHERE detector = 'frontend'),
{halve("fe1", "fe0", "Angular", "NOT " + has_flag("'django_template'") + " OR " + has_flag("'angular_specific'"), 5)},
{halve("fe2", "fe1", "Tailwind CSS", "s.tailwind_file OR " + has_flag("'tailwind_specific'"), 5)},
{scored("frontend_found", "fe2", {}, 35)}"""


def devops_steps() -> str:
    def implied(name, source, tech, base):
        return f"""{name} AS (SELECT t.* REPLACE (CASE WHEN t.tech = {text(base)} AND k.p > t.p THEN greatest(t.p, k.p - 5) ELSE t.p END AS p)
  FROM {source} t LEFT JOIN {source} k ON k.repo_id = t.repo_id AND k.tech = {text(tech)})"""

    cloud = 100 + devops.SUB_CATEGORIES.index("cloud")
    return f"""dv0 AS (SELECT repo_id, tech, p, category FROM pts WHERE detector = 'devops'),
{implied("dv1", "dv0", "Docker Compose", "Docker")}, {implied("dv2", "dv1", "Helm", "Kubernetes")},
dv3 AS (
  SELECT repo_id, tech, max(p) AS p, CASE WHEN tech = 'AWS' AND bool_or(lifted) THEN {cloud} ELSE max(category) END AS category FROM (
    SELECT *, false AS lifted FROM dv2 UNION ALL SELECT repo_id, 'AWS', greatest(p - 5, 0), -1, true FROM dv2 WHERE tech = 'AWS CDK') GROUP BY repo_id, tech
),
{halve("dv4", "dv3", "Helm", has_flag("'helm_chart'") + " OR (" + has_flag("'helm_templates'") + " AND EXISTS (SELECT 1 FROM files v WHERE v.repo_id = t.repo_id AND (ends_with(v.path, 'values.yaml') OR ends_with(v.path, 'values.yml'))))", 10)},
{halve("dv5", "dv4", "Packer", has_flag("'packer_specific'"), 10)},
{scored("devops_found", "dv5", {}, 40)}"""


def architecture_steps() -> str:
    members = [(tech, i * 100 + j, len(s), m) for i, (tech, sets) in enumerate(architecture.DIRECTORY_SETS.items()) for j, s in enumerate(sets) for m in s]
    conventions = [(i, tech, float(points), needed, len(signs)) for i, (tech, points, needed, signs, _) in enumerate(architecture.CONVENTIONS)]
    counts = ", ".join(
        f"count(*) FILTER ({' OR '.join(f'contains(lower(path), {text(w)})' for w in words)}) AS {name}" for name, words in architecture.COMPONENTS.items()
    )
    enough = lambda *c: " AND ".join(f"c.{x} >= 2" for x in c)

    def halved(name, source, tech, holds):
        return f"""{name} AS (SELECT t.* REPLACE (CASE WHEN tech = {text(tech)} AND NOT ({holds}) THEN floor(p / 2) ELSE p END AS p)
  FROM {source} t JOIN components c ON c.repo_id = t.repo_id LEFT JOIN services v ON v.repo_id = t.repo_id)"""

    return f"""{table("set_members", "tech, set_no, size, member", members)},
{table("conventions", "no, tech, points, needed, size", conventions)},
components AS (SELECT repo_id, {counts}, count(*) FILTER (contains(path, '/features/') OR contains(path, '/modules/')) AS feature_files FROM files GROUP BY repo_id),
services AS (SELECT repo_id, count(DISTINCT split_part(path, '/', 2)) AS services FROM files WHERE split_part(path, '/', 1) IN ('services', 'microservices') AND contains(path, '/') GROUP BY repo_id),
dir_names AS (
  SELECT repo_id, name, count(*) AS n FROM (
    SELECT repo_id, unnest(list_slice(string_split(path, '/'), 1, least(3, len(string_split(path, '/')) - 1))) AS name FROM files) WHERE name <> '' GROUP BY ALL
),
busy AS (SELECT *, min(name) OVER (PARTITION BY repo_id) AS first_name, count(*) OVER (PARTITION BY repo_id) AS modules FROM dir_names WHERE n > 5 AND name NOT IN {names(architecture.GENERIC_DIRECTORIES)}),
dir_exts AS (SELECT DISTINCT repo_id, split_part(path, '/', 1) AS name, ext FROM files WHERE contains(path, '/')),
feature_modules AS (
  SELECT b.repo_id, any_value(b.modules) AS modules FROM busy b JOIN dir_exts d ON d.repo_id = b.repo_id AND d.name = b.name
    JOIN dir_exts e ON e.repo_id = b.repo_id AND e.name = b.first_name AND e.ext = d.ext
  WHERE b.modules >= 3 GROUP BY b.repo_id HAVING count(DISTINCT b.name) = any_value(b.modules)
),
set_hits AS (
  SELECT repo_id, m.tech, set_no, any_value(size) AS size, count(*) AS found FROM (SELECT DISTINCT repo_id, tech AS member FROM pts WHERE detector = 'architecture+directory') JOIN set_members m USING (member) GROUP BY ALL
),
convention_hits AS (
  SELECT g.repo_id, c.tech, c.points FROM conventions c JOIN flags g ON starts_with(g.flag, 'convention:' || c.no || ':')
  GROUP BY g.repo_id, c.no, c.tech, c.points, c.needed HAVING count(*) >= c.needed
),
ar0 AS (
  SELECT repo_id, tech, sum(p) AS p, -1 AS category FROM (
    SELECT repo_id, tech, p FROM pts WHERE detector = 'architecture'
    UNION ALL SELECT repo_id, tech, CASE WHEN found = size THEN 20 WHEN found >= size * 0.7 THEN 10 ELSE 2 * found END FROM set_hits
    UNION ALL SELECT repo_id, split_part(tech, '/', 1), 5 FROM pts WHERE detector = 'architecture+file'
    UNION ALL SELECT * FROM convention_hits
    UNION ALL SELECT repo_id, 'Feature-based architecture', 25 FROM feature_modules) GROUP BY ALL
),
{halved("ar1", "ar0", "MVC", enough("models", "views", "controllers"))},
{halved("ar2", "ar1", "MVVM", enough("models", "views", "viewmodels"))},
{halved("ar3", "ar2", "Clean Architecture", enough("entities", "usecases", "adapters"))},
{halved("ar4", "ar3", "Microservices", has_flag("'micro'") + " OR coalesce(v.services, 0) >= 3")},
{halved("ar5", "ar4", "Event-Driven Architecture", has_flag("'event'"))},
ar6 AS (SELECT t.* REPLACE (CASE WHEN tech = 'REST API' AND {has_flag("'rest'")} THEN p + 10 ELSE p END AS p) FROM ar5 t),
ar7 AS (
  SELECT t.* REPLACE (CASE WHEN t.tech = 'MVVM' AND c.p > t.p THEN floor(t.p / 3) WHEN t.tech = 'MVC' AND c.p >= t.p THEN floor(t.p / 3) ELSE t.p END AS p)
  FROM ar6 t LEFT JOIN ar6 c ON c.repo_id = t.repo_id AND c.tech = CASE t.tech WHEN 'MVVM' THEN 'MVC' WHEN 'MVC' THEN 'MVVM' END
),
{halved("ar8", "ar7", "Feature-based architecture", "c.feature_files >= 5")},
{scored("architecture_found", "ar8", {}, 35)}"""


def testing_steps() -> str:
    zero = lambda tech, holds: f"WHEN tech = {text(tech)} AND NOT ({holds}) THEN 0"
    return f"""ext_ratio AS (
  SELECT repo_id, ext, tests, sources FROM (
    SELECT f.repo_id, f.ext, count(*) FILTER (t.path IS NOT NULL) AS tests, count(*) FILTER (t.path IS NULL) AS sources
    FROM files f LEFT JOIN test_files t ON t.repo_id = f.repo_id AND t.path = f.path WHERE f.ext <> '' GROUP BY ALL)
  WHERE tests > 0 AND sources > 0 AND tests >= 0.5 * sources
),
te1 AS (
  SELECT t.repo_id, t.tech, t.category, CASE {zero("React Testing Library", "s.js_files AND " + has_flag("'react_testing_library'"))}
    {zero("Enzyme", "s.js_files AND " + has_flag("'enzyme'"))} {zero("RSpec", "s.ruby_files AND " + has_flag("'rspec'"))} ELSE p END AS p
  FROM pts t LEFT JOIN shape s ON s.repo_id = t.repo_id WHERE detector = 'testing'
  UNION ALL SELECT repo_id, 'High Test Coverage', {testing.SUB_CATEGORIES.index("coverage")}, 10 * count(*) FROM ext_ratio GROUP BY repo_id
),
{scored("testing_found", "te1", {}, 40)}"""


def validation_steps() -> str:
    pairs = lambda t: [(k, v) for k, vs in t.items() for v in vs]

    def compatible(name: str, source: str, allow: str) -> str:
        return f"""{name} AS (
  SELECT repo_id, tech, matches, category, CASE WHEN is_foreign THEN confidence / 2 ELSE confidence END AS confidence FROM (
    SELECT t.*, confidence < 80 AND EXISTS (SELECT 1 FROM lead_langs l WHERE l.repo_id = t.repo_id)
      AND NOT EXISTS (SELECT 1 FROM lead_langs l JOIN {allow} a ON a.lang = l.tech WHERE l.repo_id = t.repo_id AND a.tech = t.tech) AS is_foreign FROM {source} t)
  WHERE NOT (is_foreign AND confidence <= 40))"""

    categories = ["languages", "frameworks", "databases", "build_systems", "package_managers", "frontend", "devops", "architecture", "testing"]
    sources = {"languages": "langs", "frameworks": "fw_ok", "databases": "db_ok", "build_systems": "bs_ok", "package_managers": "pm_ok"}
    union = " UNION ALL ".join(
        f"SELECT repo_id, {text(c)} AS category, tech, matches, confidence FROM {sources.get(c, c + '_found')}" for c in categories
    )
    return f"""{table("fw_allow", "lang, tech", pairs(validation.LANGUAGE_FRAMEWORKS))}, {table("build_allow", "lang, tech", pairs(validation.LANGUAGE_BUILD_TOOLS))},
{table("fw_dbs", "fw, tech", pairs(validation.FRAMEWORK_DATABASES))},
lead_langs AS (SELECT repo_id, tech FROM (SELECT *, max(confidence) OVER (PARTITION BY repo_id) AS best FROM langs) WHERE confidence >= best * 0.5),
top_fw AS (SELECT repo_id, tech FROM frameworks_found QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC, matches DESC, tech) = 1),
{compatible("fw_ok", "frameworks_found", "fw_allow")},
{compatible("bs_ok", "build_systems_found", "build_allow")},
{compatible("pm_ok", "package_managers_found", "build_allow")},
db_ok AS (
  SELECT d.* REPLACE (CASE WHEN f.tech IS NOT NULL THEN least(100.0, confidence * 1.2) ELSE confidence END AS confidence)
  FROM databases_found d LEFT JOIN top_fw t ON t.repo_id = d.repo_id LEFT JOIN fw_dbs f ON f.fw = t.tech AND f.tech = d.tech
),
stack AS (SELECT * FROM ({union}) WHERE confidence >= 15),
prim AS (SELECT repo_id, category, tech FROM stack QUALIFY row_number() OVER (PARTITION BY repo_id, category ORDER BY confidence DESC, matches DESC, tech) = 1)"""


STEPS = {
    "frameworks": framework_steps, "databases": database_steps, "build_systems": build_steps, "package_managers": build_steps,
    "frontend": frontend_steps, "devops": devops_steps, "architecture": architecture_steps, "testing": testing_steps,
}


def base_sql() -> str:
    return ",\n".join([corpus(), language_tables()])


def hits_sql() -> str:
    return ",\n".join([base_sql(), path_tables(), content_tables()])


def detector_sql(detector: str) -> str:
    return ",\n".join([hits_sql(), STEPS[detector]()])


def stack_sql() -> str:
    return ",\n".join([hits_sql(), *(f() for f in dict.fromkeys(STEPS.values())), validation_steps()])
