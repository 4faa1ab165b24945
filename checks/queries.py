"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import stack_sql as q
from corpuslens.functions import numbers, paths, text
from corpuslens.operators import answers, content_facts, facts, landscape, landscape_state, prompts, recommend, report, sampling, scan, scores, validation
from corpuslens.plans import analysis
from corpuslens.rules import sampling as sampling_rules
from corpuslens.rules import conditions, eligibility, frameworks
from corpuslens.rules import recommendations as advice
from corpuslens.rules.ruleset import default_rules
from corpuslens.sources import corpus as corpora
from corpuslens.session import materialize, shared_directory
from corpuslens.sources import repositories, sinks, store, trees
from corpuslens.sources.derived import derived_corpus, spread


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None):
    def register(run):
        CHECKS[name] = Check(run, sql)
        return run

    return register


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.from_table(derived_corpus(spark, sf_dir))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# Languages.


@check("primary_language", with_(q.base_sql(), select="""
SELECT repo_id, tech AS language, confidence FROM langs
QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC, matches DESC, tech) = 1"""))
def primary_language(spark, sf_dir):
    languages = analysis.detect_languages(corpus(spark, sf_dir)).withColumn("category", F.lit("languages"))
    return validation.top_per_category(languages, 1).select("repo_id", F.col("tech").alias("language"), "confidence")


@check("language_shares", with_(q.base_sql(), select="""
SELECT repo_id, tech, matches, percentage, confidence,
       confidence >= 0.5 * max(confidence) OVER (PARTITION BY repo_id) AS is_primary FROM langs"""))
def language_shares(spark, sf_dir):
    from pyspark.sql import Window as W

    best = F.max("confidence").over(W.partitionBy("repo_id"))
    return analysis.detect_languages(corpus(spark, sf_dir)).withColumn("is_primary", F.col("confidence") >= best * 0.5)


# Paths and eligibility.

_URL_PATH = "regexp_replace(url, '^[a-z]+://[^/]*/?', '')"


@check("path_parts", f"""
SELECT page_id, regexp_extract(p, '[^/]*$') AS name,
       regexp_extract(regexp_extract(p, '[^/]*$'), '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext,
       lower(regexp_extract(p, '[^.]*$')) AS loose,
       CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) END AS top
FROM (SELECT page_id, {_URL_PATH} AS p FROM pages)""")
def path_parts(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    rows = read(spark, sf_dir, "pages").select("page_id", path.alias("p"))
    p = F.col("p")
    return rows.select(
        "page_id", paths.base_name(p).alias("name"), paths.extension(paths.base_name(p)).alias("ext"),
        paths.loose_extension(p).alias("loose"), paths.first_level_directory(p).alias("top"),
    )


@check("ancestor_dirs", with_(q.corpus(), select="""
SELECT DISTINCT repo_id, array_to_string(list_slice(parts, 1, i), '/') AS dir FROM (
  SELECT repo_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT repo_id, string_split(path, '/') AS parts FROM files))
WHERE NOT starts_with(array_to_string(list_slice(parts, 1, i), '/'), '.')"""))
def ancestor_dirs(spark, sf_dir):
    return corpus(spark, sf_dir).select("repo_id", F.explode(paths.ancestor_directories(F.col("path"))).alias("dir")).distinct()


@check("exclude_dirs", with_(q.derived_corpus_sql(), select="""
SELECT repo_id, count(*) AS kept FROM files
WHERE NOT list_has_any(string_split(path, '/')[1:-2], ['frontend', 'tests', 'app']) GROUP BY repo_id"""))
def exclude_dirs(spark, sf_dir):
    kept = corpora.exclude_directories(derived_corpus(spark, sf_dir), ["frontend", "tests", "app"])
    return kept.groupBy("repo_id").agg(F.count("*").alias("kept"))


@check("path_substrings", with_(q.derived_corpus_sql(), select="""
SELECT repo_id, path FROM files WHERE contains(path, 'docker') OR contains(path, '.github') OR contains(path, 'test_')"""))
def path_substrings(spark, sf_dir):
    return derived_corpus(spark, sf_dir).where(paths.matches_any(F.col("path"), ["docker", ".github", "test_"])).select("repo_id", "path")


@check("eligible_files", with_(q.corpus(), select="""
SELECT repo_id, count(*) AS files, count(content) AS readable, CAST(sum(length(content)) AS BIGINT) AS chars FROM files GROUP BY repo_id"""))
def eligible_files(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("repo_id").agg(
        F.count("*").alias("files"), F.count("content").alias("readable"), F.sum(F.length("content")).alias("chars")
    )


@check("binary_sniff", """
SELECT doc_id, length(regexp_replace(t, '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) * 10 > length(t) AS is_binary,
       trim(t, ' ' || chr(9) || chr(10) || chr(13)) = '' AS is_blank
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', chr(7)) ELSE text END AS t FROM documents)""")
def binary_sniff(spark, sf_dir):
    noisy = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("\x07"))).otherwise(F.col("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", noisy.alias("t"))
    return rows.select(
        "doc_id", text.is_binary_text(F.col("t")).alias("is_binary"), text.is_blank(F.col("t")).alias("is_blank"))


@check("files_by_extension", with_(q.corpus(), select="SELECT repo_id, lower(ext) AS ext, count(*) AS n FROM files WHERE ext <> '' GROUP BY ALL"))
def files_by_extension(spark, sf_dir):
    return facts.files_by_extension(corpus(spark, sf_dir))


@check("loaded_tree", with_(q.corpus(), select="""
SELECT repo_id, path, size, CASE WHEN content IS NOT NULL THEN md5(content) END AS content_md5, CAST(NULL AS VARCHAR) AS error FROM files"""))
def loaded_tree(spark, sf_dir):
    """Every derived file written into trees of repositories, listed and read again."""
    def loaded(target):
        found = corpora.load_corpus(spark, target, errors=True)
        return found.select("repo_id", "path", "size", F.md5("content").alias("content_md5"), "error")

    return trees.through_trees(derived_corpus(spark, sf_dir), loaded)


@check("loaded_manifests", with_(q.derived_corpus_sql(), select="""
SELECT repo_id, path, size, md5(content) AS content_md5 FROM files
WHERE regexp_extract(path, '[^/]*$') IN ('package.json', 'requirements.txt') AND size > 60 AND starts_with(repo_id, 'repo_1')"""))
def loaded_manifests(spark, sf_dir):
    """The data source by itself: filters on name, size and repository decide which files are opened."""
    wanted = F.col("name").isin("package.json", "requirements.txt") & (F.col("size") > 60) & F.startswith("repo_id", F.lit("repo_1"))

    def manifests(target):
        listing = f"{shared_directory(spark)}/corpuslens/listing-{uuid.uuid4().hex}"
        repositories.write_listing(repositories.list_tree(spark, target), listing, corpora.readable_name)
        return repositories.open_listing(spark, listing).where(wanted).select("repo_id", "path", "size", F.md5("content").alias("content_md5"))

    return trees.through_trees(derived_corpus(spark, sf_dir), manifests)


# Rule hits.


@check("path_rule_hits", with_(q.base_sql(), q.path_tables(), select="""
SELECT repo_id, detector, tech, count(*) AS hits, CAST(sum(points) AS DOUBLE) AS points FROM path_hits GROUP BY ALL"""))
def path_rule_hits(spark, sf_dir):
    hits = scan.path_hits(corpus(spark, sf_dir), default_rules())
    return hits.groupBy("repo_id", "detector", "tech").agg(F.count("*").alias("hits"), F.sum("points").alias("points"))


_CONTENT_ONLY = "NOT starts_with(detector, 'none')"


@check("content_rule_hits", with_(q.hits_sql(), select="""
SELECT repo_id, detector, tech, CAST(sum(points) AS DOUBLE) AS points FROM content_hits WHERE detector <> 'flag' GROUP BY ALL
UNION ALL SELECT DISTINCT repo_id, detector, tech, 0.0 FROM content_hits WHERE detector = 'flag'"""))
def content_rule_hits(spark, sf_dir):
    files = corpus(spark, sf_dir)
    hits = scan.content_hits(files, default_rules(), content_facts.wanted_facts(analysis.DETECTORS))
    of_rules = ~F.col("detector").isin("count", "manifest", "source_language") & ~F.startswith("tech", F.lit("fact:"))
    return hits.where(of_rules).groupBy("repo_id", "detector", "tech").agg(F.sum("points").alias("points"))


_PAGE_RULES = default_rules().for_detectors(["frontend", "devops", "testing"])


@check("page_rule_hits", with_(
    q.table("rules", "detector, tech, pat, cap", [
        (r.detector, r.tech, r.pattern, r.cap) for r in _PAGE_RULES.content_rules if r.kind == "regex"]),
    select="""SELECT page_id, detector, tech, CAST(sum(n) AS DOUBLE) AS points
FROM (SELECT page_id, detector, tech, least(len(regexp_extract_all(html, pat)), cap) AS n FROM pages, rules) WHERE n > 0 GROUP BY ALL"""))
def page_rule_hits(spark, sf_dir):
    pages = spread(read(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("repo_id"), F.col("url").alias("path"), F.col("html").alias("content")))
    hits = scan.content_hits(pages, _PAGE_RULES).where("detector <> 'flag' and category < 300")
    return hits.groupBy(F.col("repo_id").cast("bigint").alias("page_id"), "detector", "tech").agg(F.sum("points").alias("points"))


_PAGES_AS_FILES = r"""files AS (
  SELECT CAST(page_id AS VARCHAR) AS repo_id, url AS path, regexp_extract(url, '[^/]*$') AS name,
         regexp_extract(regexp_extract(url, '[^/]*$'), '^\.*[^.].*(\.[^.]*)$', 1) AS ext, html AS content FROM pages)"""


@check("page_content_rule_hits", with_(_PAGES_AS_FILES, q.content_tables(), select="""
SELECT CAST(repo_id AS BIGINT) AS page_id, detector, tech, CAST(sum(points) AS DOUBLE) AS points FROM content_hits WHERE detector <> 'flag' GROUP BY ALL
UNION ALL SELECT DISTINCT CAST(repo_id AS BIGINT), detector, tech, 0.0 FROM content_hits WHERE detector = 'flag'"""))
def page_content_rule_hits(spark, sf_dir):
    """Every content rule, flags and dependencies included, over pages as files."""
    pages = spread(read(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("repo_id"), F.col("url").alias("path"), F.col("html").alias("content")))
    hits = scan.content_hits(pages, default_rules(), content_facts.wanted_facts(analysis.DETECTORS))
    of_rules = ~F.col("detector").isin("count", "manifest", "source_language") & ~F.startswith("tech", F.lit("fact:"))
    return hits.where(of_rules).groupBy(F.col("repo_id").cast("bigint").alias("page_id"), "detector", "tech").agg(F.sum("points").alias("points"))


_LITERALS = [("tion", "t"), ("ment ", "m"), ("import ", "i"), (". ", "s"), ("aux", "a")]


@check("literal_rule_hits", with_(q.table("lits", "pat, tag", _LITERALS), select="""
SELECT source, tag, CAST(sum((length(text) - length(replace(text, pat, ''))) // length(pat)) AS BIGINT) AS n,
       count(*) FILTER (contains(text, 'import ' || pat) OR contains(text, 'require(' || pat) OR contains(text, 'include ' || pat)) AS imported
FROM documents, lits GROUP BY ALL"""))
def literal_rule_hits(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    tagged = F.array(*[
        F.struct(
            F.lit(tag).alias("tag"), text.literal_count(F.col("text"), F.lit(pat)).alias("c"),
            text.import_like(F.col("text"), F.lit(pat)).alias("imp"),
        )
        for pat, tag in _LITERALS
    ])
    return documents.select("source", F.inline(tagged)).groupBy("source", "tag").agg(
        F.sum("c").alias("n"), F.count_if("imp").alias("imported"))


@check("manifest_deps", with_(q.corpus(), select="""
SELECT repo_id, section, package, count(*) AS n FROM (
  SELECT repo_id, 'dependencies' AS section, unnest(json_keys(content, '$.dependencies')) AS package FROM files WHERE name = 'package.json'
  UNION ALL SELECT repo_id, 'devDependencies', unnest(json_keys(content, '$.devDependencies')) FROM files WHERE name = 'package.json') GROUP BY ALL"""))
def manifest_deps(spark, sf_dir):
    deps = facts.manifest_dependencies(corpus(spark, sf_dir))
    return deps.groupBy("repo_id", "section", "package").agg(F.count("*").alias("n"))


@check("text_functions", """
SELECT event_id, CASE WHEN length(u) > 60 THEN left(u, 57) || '...' ELSE u END AS short,
       regexp_replace(u, '://[^@/]+@', '://***@', 'g') AS masked, length(u) // 4 AS tokens,
       CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM (SELECT event_id, props, event_type || '://user' || user_id || ':' || props || '@db' || event_id || '/' || repeat(event_type, 5) AS u FROM events)""")
def text_functions(spark, sf_dir):
    u = F.concat("event_type", F.lit("://user"), F.col("user_id").cast("string"), F.lit(":"), "props", F.lit("@db"),
                 F.col("event_id").cast("string"), F.lit("/"), F.repeat("event_type", F.lit(5)))
    rows = read(spark, sf_dir, "events").select("event_id", "props", u.alias("u"))
    return rows.select(
        "event_id", text.shorten(F.col("u")).alias("short"), text.mask_credentials(F.col("u")).alias("masked"),
        text.estimated_tokens(F.col("u")).alias("tokens"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@check("evidence_top5", with_(q.base_sql(), q.path_tables(), select="""
SELECT repo_id, detector, tech, string_agg(evidence, '|' ORDER BY path, evidence) AS evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, detector, tech ORDER BY path, rid) AS rn FROM (
    SELECT repo_id, detector, tech, 'Found file: ' || regexp_extract(path, '[^/]*$') AS evidence, min(path) AS path, min_by(rid, path) AS rid
    FROM path_tiers JOIN (SELECT DISTINCT rid AS r, kind FROM path_pats) k ON k.r = rid
    WHERE kind = 'suffix_tier' AND tier IN (1, 2) GROUP BY ALL)) WHERE rn <= 5 GROUP BY ALL"""))
def evidence_top5(spark, sf_dir):
    rules = default_rules().for_detectors(["build_systems", "package_managers"])
    hits = scan.path_hits(corpus(spark, sf_dir), rules)
    suffix = [r.ordinal for r in rules.path_rules if r.kind == "suffix_tier"]
    named = hits.where(F.col("ordinal").isin(suffix) & F.startswith("evidence", F.lit("Found file: ")))
    return scores.top_evidence(named).select("repo_id", "detector", "tech", F.array_join("evidence", "|").alias("evidence"))


@check("normalized_confidence", with_(q.hits_sql(), select=f"""
SELECT repo_id, detector, tech, p AS points, {q.exact_round('least(100.0, p / best * 100)', 2)} AS confidence FROM (
  SELECT repo_id, detector, tech, p, max(p) OVER (PARTITION BY repo_id, detector) AS best FROM pts WHERE detector IN ('frontend', 'devops')) WHERE best > 0"""))
def normalized_confidence(spark, sf_dir):
    wanted = ["frontend", "devops"]
    files = corpus(spark, sf_dir)
    hits = analysis.detector_hits(files, default_rules().for_detectors(wanted), wanted)
    row = scores.score_rows(scores.tallies(hits), wanted)
    parts = [
        F.transform(
            F.map_entries(scores.normalised(F.col(d), {}, 0)), _confidence_of(d)
        )
        for d in wanted
    ]
    return row.select("repo_id", F.inline(F.concat(*parts)))


def _confidence_of(detector: str):
    return lambda e: F.struct(
        F.lit(detector).alias("detector"), e["key"].alias("tech"), e["value"]["matches"].alias("points"),
        e["value"]["confidence"].alias("confidence"),
    )


# Detectors.


def _detector(name: str):
    category = "category"
    decoded = "NULL"
    if name in scores.CATEGORISED:
        from corpuslens.rules import devops, frontend, testing

        names = {"frontend": frontend, "devops": devops, "testing": testing}[name].SUB_CATEGORIES
        decoded = f"list_extract({list(names)!r}, {category} % 100 + 1)"
    sql = with_(q.detector_sql(name), select=f"""
SELECT repo_id, '{name}' AS category, tech, matches, confidence, CAST({decoded} AS VARCHAR) AS sub_category FROM {name}_found""")

    @check(name, sql)
    def run(spark, sf_dir):
        return analysis.detect_rows(corpus(spark, sf_dir), name)


for _name in analysis.DETECTORS:
    _detector(_name)


@check("literal_directory_architecture")
def literal_directory_architecture(spark, sf_dir):
    return analysis.detect_rows(corpus(spark, sf_dir), "architecture", default_rules().with_literal_directories())


# Facts.


@check("dominant_languages", with_(q.detector_sql("frameworks"), select="SELECT repo_id, language, n FROM dominant"))
def dominant_languages(spark, sf_dir):
    return facts.dominant_languages(corpus(spark, sf_dir))


@check("test_source_ratio", with_(q.detector_sql("testing"), select="SELECT repo_id, ext, tests, sources FROM ext_ratio"))
def test_source_ratio(spark, sf_dir):
    return facts.test_source_ratio(corpus(spark, sf_dir))


@check("mvc_balance", with_(q.detector_sql("architecture"), select="SELECT * FROM components"))
def mvc_balance(spark, sf_dir):
    return facts.component_counts(corpus(spark, sf_dir))


@check("service_dirs", with_(q.detector_sql("architecture"), select="SELECT repo_id, services FROM services"))
def service_dirs(spark, sf_dir):
    return facts.service_directories(corpus(spark, sf_dir))


@check("directory_frequency", with_(q.detector_sql("architecture"), select="SELECT repo_id, name, n FROM dir_names"))
def directory_frequency(spark, sf_dir):
    return facts.directory_frequency(corpus(spark, sf_dir))


@check("feature_modules", with_(q.detector_sql("architecture"), select="SELECT repo_id, modules FROM feature_modules"))
def feature_modules(spark, sf_dir):
    return facts.feature_modules(corpus(spark, sf_dir)).select("repo_id", "modules")


@check("repository_facts", with_(q.corpus(), select="""
SELECT repo_id, count(*) AS file_count, count(content) AS content_count, bool_or(contains(path, '.git')) AS has_git,
       bool_or(regexp_matches(path, '\\.(md|rst)$')) AS has_docs,
       bool_or(contains(path, '.github/workflows') OR regexp_matches(lower(path), 'jenkins|gitlab-ci')) AS has_ci FROM files GROUP BY repo_id"""))
def repository_facts(spark, sf_dir):
    return facts.repository_facts(corpus(spark, sf_dir))


# The finished stack.

_STACK = q.stack_sql()


def analysed(spark: SparkSession, sf_dir: str) -> analysis.Analysis:
    return analysis.analyze(corpus(spark, sf_dir))


@check("cross_validated_stack", with_(_STACK, select="SELECT repo_id, category, tech, matches, round(confidence, 4) AS confidence FROM stack"))
def cross_validated_stack(spark, sf_dir):
    return analysed(spark, sf_dir).scored.select("repo_id", "category", "tech", "matches", F.round("confidence", 4).alias("confidence"))


@check("stack_with_evidence")
def stack_with_evidence(spark, sf_dir):
    return analysed(spark, sf_dir).stack


@check("primary_technologies", with_(_STACK, select="SELECT * FROM prim"))
def primary_technologies(spark, sf_dir):
    return analysed(spark, sf_dir).primary


@check("top3_per_category", with_(_STACK, select="""
SELECT repo_id, category, tech, CAST(row_number() OVER (PARTITION BY repo_id, category ORDER BY confidence DESC, matches DESC, tech) AS INT) AS rank
FROM stack QUALIFY rank <= 3"""))
def top3_per_category(spark, sf_dir):
    return validation.top_per_category(analysed(spark, sf_dir).scored, 3).select("repo_id", "category", "tech", "rank")


@check("filter_stack", with_(_STACK, select="""
SELECT repo_id, category, tech, round(confidence, 4) AS confidence FROM stack WHERE confidence >= 60 AND category IN ('languages', 'devops')"""))
def filter_stack(spark, sf_dir):
    kept = validation.filter_stack(analysed(spark, sf_dir).scored, 60, ["languages", "devops"])
    return kept.select("repo_id", "category", "tech", F.round("confidence", 4).alias("confidence"))


@check("filter_stack_with_answers", with_(_STACK, select="""
SELECT repo_id, category, tech, round(confidence, 4) AS confidence FROM stack WHERE confidence >= 60 AND category IN ('languages', 'devops')
UNION ALL SELECT 'repo_' || o_custkey, 'ai_analysis', o_orderpriority, CAST(o_orderkey % 50 AS DOUBLE) FROM orders"""))
def filter_stack_with_answers(spark, sf_dir):
    found = analysed(spark, sf_dir).scored.select("repo_id", "category", "tech", "confidence")
    answered = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("repo_"), F.col("o_custkey").cast("string")).alias("repo_id"), F.lit("ai_analysis").alias("category"),
        F.col("o_orderpriority").alias("tech"), (F.col("o_orderkey") % 50).cast("double").alias("confidence"))
    kept = validation.filter_stack(found.unionByName(answered), 60, ["languages", "devops"], ["ai_analysis"])
    return kept.select("repo_id", "category", "tech", F.round("confidence", 4).alias("confidence"))


_COUNTS = """counts AS (
  SELECT category, tech, count(*) AS n_repos FROM stack WHERE confidence > 50 AND category <> 'architecture' GROUP BY ALL
  UNION ALL SELECT 'primary_' || category, tech, count(*) FROM prim WHERE category IN ('languages', 'frameworks') GROUP BY ALL)"""


@check("landscape_counts", with_(_STACK, _COUNTS, select="SELECT category, tech, n_repos FROM counts"))
def landscape_counts(spark, sf_dir):
    found = analysed(spark, sf_dir)
    return landscape.landscape_counts(found.scored, found.primary)


@check("landscape_maintained", with_(_STACK, _COUNTS, select="SELECT category, tech, n_repos FROM counts"))
def landscape_maintained(spark, sf_dir):
    """Counts after two changes equal those over all: outdated repositories are replaced, copies withdrawn."""
    found = analysed(spark, sf_dir)
    rows = materialize(landscape.contributions(found.scored, found.primary), "landscape-check")
    state = landscape_state.LandscapeState(spark, f"{shared_directory(spark)}/corpuslens/landscape-{uuid.uuid4().hex}", 16)
    outdated = F.pmod(F.xxhash64("repo_id"), F.lit(3)) == 0
    copies = rows.withColumn("repo_id", F.concat(F.lit("copy_"), "repo_id"))
    before = rows.withColumn("tech", F.when(outdated, F.concat(F.lit("old "), "tech")).otherwise(F.col("tech"))).unionByName(copies)
    state.apply(before, before.select("repo_id"))
    changed = rows.where(outdated)
    state.apply(changed, changed.select("repo_id").unionByName(copies.select("repo_id")))
    return state.counts()


@check("landscape_top10", with_(_STACK, _COUNTS, select="""
SELECT category, tech, n_repos, CAST(row_number() OVER (PARTITION BY category ORDER BY n_repos DESC, tech) AS INT) AS rank FROM counts QUALIFY rank <= 10"""))
def landscape_top10(spark, sf_dir):
    found = analysed(spark, sf_dir)
    return landscape.landscape_top(landscape.landscape_counts(found.scored, found.primary), 10)


@check("chart_rows", with_(_STACK, select="""
SELECT s.repo_id, s.category, s.tech, round(s.confidence, 4) AS confidence, p.tech IS NOT NULL AS is_primary,
       CAST(row_number() OVER (PARTITION BY s.repo_id, s.category ORDER BY s.confidence DESC, s.matches DESC, s.tech) AS INT) AS rank
FROM stack s LEFT JOIN prim p ON p.repo_id = s.repo_id AND p.category = s.category AND p.tech = s.tech"""))
def chart_rows(spark, sf_dir):
    found = analysed(spark, sf_dir)
    return landscape.chart_rows(found.scored, found.primary).withColumn("confidence", F.round("confidence", 4))


_SEVERITY = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
_TECH = lambda c, t: f"coalesce(bool_or(category = '{c}' AND tech = '{t}'), false)"


def _advice_sql(conflicts, practices, companions: str) -> str:
    rule_rows = []
    conditions = {
        "jquery_react": "jquery AND react", "sqlite_microservices": "sqlite AND micro", "django_react": "django AND react AND NOT webpack",
        "mongo_express": "mongodb AND express AND NOT mongoose", "flask_sqlalchemy": "flask AND NOT sqlalchemy", "no_git": "NOT has_git",
        "no_tests": "NOT testing", "no_docker": "NOT docker", "no_docs": "NOT has_docs", "no_ci": "NOT has_ci",
    }
    for part, rules, only, source in ((2, advice.CONFLICTS, conflicts, "compatibility_analysis"), (3, advice.BEST_PRACTICES, practices, "best_practices")):
        for nth, (key, (words, reason, severity)) in enumerate(rules.items()):
            if key in only:
                rule_rows.append(
                    f"SELECT repo_id, {q.text(words)} AS text, '{severity}' AS severity, {q.text(reason)} AS reason, '{source}' AS source, "
                    f"{part} AS part, 0 AS sec, {nth} AS place FROM advice WHERE {conditions[key]}")
    return f"""repo_facts AS (
  SELECT repo_id, bool_or(contains(path, '.git')) AS has_git, bool_or(regexp_matches(path, '\\.(md|rst)$')) AS has_docs,
    bool_or(contains(path, '.github/workflows') OR regexp_matches(lower(path), 'jenkins|gitlab-ci')) AS has_ci FROM files GROUP BY repo_id),
advice AS (
  SELECT r.repo_id, any_value(has_git) AS has_git, any_value(has_docs) AS has_docs, any_value(has_ci) AS has_ci,
    {_TECH('frameworks', 'jQuery')} AS jquery, {_TECH('frameworks', 'React')} AS react, {_TECH('frameworks', 'Django')} AS django,
    {_TECH('frameworks', 'Express')} AS express, {_TECH('frameworks', 'Mongoose')} AS mongoose, {_TECH('frameworks', 'Flask')} AS flask,
    {_TECH('frameworks', 'SQLAlchemy')} AS sqlalchemy, {_TECH('databases', 'SQLite')} AS sqlite, {_TECH('databases', 'MongoDB')} AS mongodb,
    {_TECH('devops', 'Docker')} AS docker, coalesce(bool_or(category = 'testing'), false) AS testing,
    coalesce(bool_or(category = 'build_systems' AND contains(lower(tech), 'webpack')), false) AS webpack,
    coalesce(bool_or(category = 'architecture' AND tech = 'Microservices' AND confidence > 70), false) AS micro
  FROM repo_facts r LEFT JOIN stack s ON s.repo_id = r.repo_id GROUP BY r.repo_id),
{companions},
all_advice AS (
  SELECT repo_id, 'Consider adding ' || companion || ' to your project, which is commonly used with ' || tech AS text, severity,
         why AS reason, 'stack_analysis' AS source, 1 AS part, sec, nth AS place FROM companions
  UNION ALL {' UNION ALL '.join(rule_rows)})"""


_NTH_ADVICE = f"""SELECT repo_id, text, severity, reason, source,
  CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {_SEVERITY}, part, sec, place, text) AS INT) AS nth FROM"""
_COMPANIONS = q.table("companion_table", "tech, companion, why, severity, nth", [
    (t, n, why + " for " + t, s, i) for t, es in advice.COMPANIONS.items() for i, (n, why, s) in enumerate(es)]) + f""",
companions AS (
  SELECT p.repo_id, c.*, list_position({list(validation.CATEGORIES)}, p.category) AS sec FROM prim p JOIN companion_table c ON c.tech = p.tech
  WHERE NOT EXISTS (SELECT 1 FROM stack s WHERE s.repo_id = p.repo_id AND s.tech = c.companion
                    AND s.category IN ('frameworks', 'frontend', 'testing', 'build_systems', 'package_managers')))"""


@check("recommendations", with_(_STACK, _advice_sql(advice.CONFLICTS, advice.BEST_PRACTICES, _COMPANIONS), select=f"{_NTH_ADVICE} all_advice"))
def recommendations(spark, sf_dir):
    found = analysed(spark, sf_dir)
    rows = recommend.recommendations(found.scored, found.primary, facts.repository_facts(found.files))
    return rows.select("repo_id", "text", "severity", "reason", "source", "nth")


_OWN_FLAGS = (*conditions.FLAGS, conditions.Flag("styled", "category = 'frontend' and confidence >= 50"), conditions.Flag("much", "matches > 20 and sub_category is null"))
_OWN_ADVICE = (
    conditions.Advice("style", "conflict", "styled and not testing", "Test the pages", "Pages break", "high"),
    conditions.Advice("size", "practice", "much and (has_ci or not docker)", "Split the project", "It is large", "low"),
)


@check("caller_advice", with_(_STACK, _advice_sql((), ("no_git",), _COMPANIONS), """own AS (
  SELECT r.repo_id, any_value(has_ci) AS has_ci, bool_or(category = 'frontend' AND confidence >= 50) AS styled,
    coalesce(bool_or(matches > 20 AND category NOT IN ('frontend', 'devops', 'testing')), false) AS much,
    coalesce(bool_or(category = 'testing'), false) AS testing, coalesce(bool_or(category = 'devops' AND tech = 'Docker'), false) AS docker
  FROM repo_facts r LEFT JOIN stack s ON s.repo_id = r.repo_id GROUP BY r.repo_id)""", select="""
SELECT repo_id, 'Test the pages' AS text, 'high' AS severity, 'Pages break' AS reason, 'compatibility_analysis' AS source FROM own WHERE styled AND NOT testing
UNION ALL SELECT repo_id, 'Split the project', 'low', 'It is large', 'best_practices' FROM own WHERE much AND (has_ci OR NOT docker)"""))
def caller_advice(spark, sf_dir):
    """Flags and advice that a caller wrote: the conditions are text."""
    found = analysed(spark, sf_dir)
    rows = recommend.recommendations(found.scored, found.primary, facts.repository_facts(found.files), flags=_OWN_FLAGS, advice=_OWN_ADVICE)
    return rows.where("source <> 'stack_analysis'").select("repo_id", "text", "severity", "reason", "source")


_REVIEW_COMPANIONS = q.table("companion_table", "tech, companion, nth", [
    (t, n, i) for t, ns in advice.FRAMEWORK_COMPANIONS.items() for i, n in enumerate(ns)]) + """,
companions AS (
  SELECT p.repo_id, c.*, 0 AS sec, 'medium' AS severity, 'Common companion technology for ' || c.tech AS why FROM prim p JOIN companion_table c ON c.tech = p.tech
  WHERE p.category = 'frameworks' AND NOT EXISTS (SELECT 1 FROM stack s WHERE s.repo_id = p.repo_id AND s.tech = c.companion
                    AND s.category IN ('frameworks', 'frontend', 'testing', 'build_systems', 'package_managers')))"""

_REVIEW_SUGGESTIONS = """suggested AS (
  SELECT 'repo_' || (o_custkey // 10) AS repo_id, CASE o_orderkey % 3 WHEN 0 THEN 'technologies' WHEN 1 THEN 'architecture' ELSE 'code_quality' END AS section,
         o_orderkey AS ord, 'Look at ' || o_orderpriority AS text, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'medium' END AS severity,
         'Seen in ' || o_orderkey AS reason FROM orders)"""


@check("review_recommendations", with_(_STACK, _advice_sql(("jquery_react", "sqlite_microservices", "django_react"), ("no_git", "no_tests"), _REVIEW_COMPANIONS),
                                       _REVIEW_SUGGESTIONS, select=f"""
{_NTH_ADVICE} (SELECT repo_id, text, severity, reason, source, part, sec, place FROM all_advice
UNION ALL SELECT repo_id, text, severity, reason, section, 0, sec, ord FROM (
  SELECT *, CASE section WHEN 'technologies' THEN 1 WHEN 'architecture' THEN 2 ELSE 3 END AS sec FROM suggested)
QUALIFY row_number() OVER (PARTITION BY repo_id, text ORDER BY sec, ord) = 1)"""))
def review_recommendations(spark, sf_dir):
    found = analysed(spark, sf_dir)
    suggested = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("repo_"), F.floor(F.col("o_custkey") / 10).cast("string")).alias("repo_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "technologies").when(F.col("o_orderkey") % 3 == 1, "architecture").otherwise("code_quality").alias("section"),
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("Look at "), "o_orderpriority").alias("text"),
        F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "low").otherwise("medium").alias("severity"),
        F.concat(F.lit("Seen in "), F.col("o_orderkey").cast("string")).alias("reason"),
    )
    rows = recommend.review_recommendations(suggested, found.scored, found.primary, facts.repository_facts(found.files))
    return rows.select("repo_id", "text", "severity", "reason", "source", "nth")


# Samples, chunks, prompts.

_QUOTA = "CASE WHEN n < 50 THEN least({0}, n) WHEN n < 500 THEN {1} ELSE {2} END"


@check("sample_representative", with_(q.corpus(), q.table("pats", "no, pat", list(enumerate(sampling_rules.PRIORITY_PATTERNS))), f"""
quotas AS (SELECT repo_id, {_QUOTA.format(10, 20, 30)} AS quota FROM (SELECT repo_id, count(*) AS n FROM files GROUP BY repo_id)),
matching AS (SELECT repo_id, path, min(no) AS no FROM files JOIN pats ON pat = name OR pat = lower(ext) WHERE content IS NOT NULL AND length(content) < 100000 GROUP BY ALL),
chosen AS (SELECT m.repo_id, path, row_number() OVER (PARTITION BY m.repo_id ORDER BY no, path) AS rank, quota FROM matching m JOIN quotas USING (repo_id) QUALIFY rank <= quota),
folders AS (
  SELECT repo_id, regexp_replace(path, '/?[^/]*$', '') AS folder, min(path) FILTER (length(content) < 50000) AS path FROM files f
  WHERE content IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.repo_id = f.repo_id AND c.path = f.path) GROUP BY ALL),
filled AS (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY folder) AS rn FROM folders),
used AS (SELECT repo_id, count(*) AS used FROM chosen GROUP BY repo_id)""", select="""
SELECT repo_id, path FROM chosen UNION ALL
SELECT f.repo_id, path FROM filled f JOIN quotas q ON q.repo_id = f.repo_id LEFT JOIN used u ON u.repo_id = f.repo_id
WHERE rn <= quota - coalesce(used, 0) AND path IS NOT NULL"""))
def sample_representative(spark, sf_dir):
    return sampling.representative_files(corpus(spark, sf_dir)).select("repo_id", "path")


@check("sample_architecture")
def sample_architecture(spark, sf_dir):
    return sampling.architecture_files(corpus(spark, sf_dir)).select("repo_id", "path")


@check("sample_quality", with_(q.corpus(), f"""
quotas AS (SELECT repo_id, {_QUOTA.format(10, 15, 20)} AS quota FROM (SELECT repo_id, count(*) AS n FROM files GROUP BY repo_id)),
eligible AS (
  SELECT repo_id, path, lower(ext) AS ext, row_number() OVER (PARTITION BY repo_id, lower(ext) ORDER BY regexp_replace(path, '/?[^/]*$', ''), path) - 1 AS pos,
    count(*) OVER (PARTITION BY repo_id, lower(ext)) AS in_ext, count(*) OVER (PARTITION BY repo_id) AS in_repo
  FROM files WHERE content IS NOT NULL AND lower(ext) IN {q.names(sampling_rules.CODE_EXTENSIONS)} AND length(content) < 100000),
planned AS (
  SELECT e.*, quota, least(greatest(1, quota // exts), in_ext) AS take, greatest(1, in_ext // least(greatest(1, quota // exts), in_ext)) AS step
  FROM eligible e JOIN quotas USING (repo_id) JOIN (SELECT repo_id, count(DISTINCT ext) AS exts FROM eligible GROUP BY repo_id) USING (repo_id))""", select="""
SELECT repo_id, path FROM planned WHERE in_repo <= quota OR pos = 0 OR (take = 2 AND pos = in_ext - 1) OR (take > 2 AND pos % step = 0)
QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ext, pos) <= quota"""))
def sample_quality(spark, sf_dir):
    return sampling.quality_files(corpus(spark, sf_dir)).select("repo_id", "path")


def _prompt_sql(kind: str) -> str:
    """A prompt template with its slots as columns."""
    columns = {"{filename}": "name", "{language}": "l.language", "{code}": "content"}
    parts = re.split("(" + "|".join(map(re.escape, columns)) + ")", prompts.TEMPLATES[kind])
    return " || ".join(columns.get(p) or q.text(p) for p in parts if p)


@check("review_prompts", with_(q.corpus(), q.table("langs_by_ext", "ext, language", sampling_rules.REVIEW_LANGUAGE.items()), select=" UNION ALL ".join(f"""
SELECT repo_id, path, '{kind}' AS kind, md5({_prompt_sql(kind)}) AS prompt
FROM files f JOIN langs_by_ext l ON l.ext = lower(f.ext) WHERE content IS NOT NULL""" for kind in prompts.TEMPLATES)))
def review_prompts(spark, sf_dir):
    files = sampling.review_language(corpus(spark, sf_dir))
    kinds = [
        prompts.review_prompts(files, template).select("repo_id", "path", F.lit(kind).alias("kind"), F.md5("prompt").alias("prompt"))
        for kind, template in prompts.TEMPLATES.items()
    ]
    return reduce(DataFrame.unionByName, kinds)


@check("token_chunks", """
SELECT doc_id, line_no, tokens, running, CAST((running - tokens) // 50 AS BIGINT) AS chunk_no FROM (
  SELECT doc_id, line_no, tokens, CAST(sum(tokens) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS running FROM (
    SELECT doc_id, CAST(i - 1 AS INT) AS line_no, length(lines[i]) // 4 AS tokens FROM (
      SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))))""")
def token_chunks(spark, sf_dir):
    rows = prompts.token_chunks(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"), 50)
    return rows.select(F.col("text_id").alias("doc_id"), "line_no", "tokens", "running", "chunk_no")


@check("chunk_texts", """
SELECT conv_id, chunk_no, md5(string_agg(line, chr(10) ORDER BY part, line_no)) AS chunk FROM (
  WITH lines AS (
    SELECT conv_id, turn AS line_no, text AS line, length(text) // 4 AS tokens, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS running
    FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)),
  numbered AS (
    SELECT *, CAST((running - tokens) // 40 AS BIGINT) AS chunk_no FROM lines)
  SELECT conv_id, chunk_no, 1 AS part, line_no, line FROM numbered
  UNION ALL
  SELECT t.conv_id, t.chunk_no + 1, 0, t.line_no, t.line FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, chunk_no ORDER BY line_no DESC) AS back FROM numbered) t
  JOIN (SELECT DISTINCT conv_id, chunk_no FROM numbered) n ON n.conv_id = t.conv_id AND n.chunk_no = t.chunk_no + 1 WHERE back <= 1)
GROUP BY ALL""")
def chunk_texts(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("line"))
    joined = turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n").alias("text"))
    lines = prompts.token_chunks(joined.select(F.col("conv_id").alias("text_id"), "text"), 40)
    return prompts.chunk_texts(lines, 1).select(F.col("text_id").alias("conv_id"), "chunk_no", F.md5("chunk").alias("chunk"))


# Answers of a language model, derived from tables: one answer per order.

_NAMES = ["Flask", "React", "PostgreSQL", "Docker", "MVC", "Kafka", "Vue.js"]
_SQL_NAMES = "list_extract([" + ", ".join(q.text(n) for n in _NAMES) + "], CAST(o_orderkey % 7 + 1 AS INT))"
_ANSWERS = f"""ans AS (
  SELECT 'repo_' || (o_custkey // 10) AS repo_id, 'f' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS path, o_orderkey AS k,
    {_SQL_NAMES} AS name, CASE o_orderkey % 3 WHEN 0 THEN 'framework' WHEN 1 THEN 'database' ELSE 'library' END AS kind,
    CAST(40 + o_orderkey % 60 AS DOUBLE) AS confidence, 'proof ' || (o_orderkey % 9) AS proof, o_orderpriority AS advice,
    CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'medium' END AS severity, o_orderkey % 11 = 0 AS broken
  FROM orders)"""


def raw_answers(spark: SparkSession, sf_dir: str, kind: str = "category", column: str = "technologies") -> DataFrame:
    """Answer texts as a model returns them: bare, fenced, or cut off."""
    k = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    item = F.struct(
        F.get(F.array(*[F.lit(n) for n in _NAMES]), (k % 7).cast("int")).alias("name"),
        F.when(k % 3 == 0, "framework").when(k % 3 == 1, "database").otherwise("library").alias(kind),
        F.when(k % 13 > 0, (F.lit(40) + k % 60).cast("double")).alias("confidence"),
        F.array(F.concat(F.lit("proof "), (k % 9).cast("string"))).alias("evidence"),
    )
    advice_item = F.struct(
        F.col("o_orderpriority").alias("text"), F.when(status == "F", "high").when(status == "O", "low").otherwise("medium").alias("severity"))
    document = F.to_json(F.struct(F.array(item).alias(column), F.array(advice_item).alias("suggestions")))
    answer = (
        F.when(k % 11 == 0, F.concat(F.lit("```json\n"), F.left(document, F.lit(20)), F.lit("\n```")))
        .when(k % 4 == 0, document)
        .when(k % 4 == 1, F.concat(F.lit("Here:\n```json\n"), document, F.lit("\n```\nDone.")))
        .otherwise(F.concat(F.lit("```\n"), document, F.lit("\n```")))
    )
    return spread(read(spark, sf_dir, "orders")).select(
        F.concat(F.lit("repo_"), F.floor(F.col("o_custkey") / 10).cast("string")).alias("repo_id"),
        F.concat(F.lit("f"), F.lpad(k.cast("string"), 9, "0")).alias("path"), answer.alias("answer"))


_ITEM = "CASE WHEN k % 13 > 0 THEN confidence ELSE 50 END"


@check("parse_answers", with_(_ANSWERS, select=f"""
SELECT repo_id, path, NOT broken AS success, CASE WHEN NOT broken THEN name END AS name, CASE WHEN NOT broken THEN kind END AS kind,
       CASE WHEN NOT broken THEN {_ITEM} END AS confidence, CASE WHEN NOT broken THEN 'AI-detected suggestion' END AS reason FROM ans"""))
def parse_answers(spark, sf_dir):
    rows = answers.parse_answers(raw_answers(spark, sf_dir), "technologies")
    first = F.get("technologies", F.lit(0))
    return rows.select(
        "repo_id", "path", "success", first["name"].alias("name"), first["category"].alias("kind"),
        first["confidence"].alias("confidence"), F.get("suggestions", F.lit(0))["reason"].alias("reason"))


@check("parse_answers_loose", """
SELECT o_orderkey AS k, o_orderkey % 6 < 4 AS success,
  CASE WHEN o_orderkey % 6 < 4 THEN 'T' || (o_orderkey % 10) END AS name,
  CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 101 AS DOUBLE) WHEN 1 THEN -5.0 WHEN 2 THEN 20000.0 WHEN 3 THEN 50.0 END AS confidence,
  CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus || '|' || o_orderpriority WHEN 2 THEN '' WHEN 3 THEN o_orderstatus END AS evidence,
  CASE WHEN o_orderkey % 6 >= 4 THEN 'Failed to parse AI response as JSON' END AS error FROM orders""")
def parse_answers_loose(spark, sf_dir):
    """Well-formed answers with odd field types, an object in place of a list, and text after the JSON."""
    k, quoted = F.col("o_orderkey"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name = F.concat(F.lit('"name": "T'), (k % 10).cast("string"), F.lit('"'))
    item = (
        F.when(k % 6 == 0, F.concat(name, F.lit(', "confidence": "'), (k % 101).cast("string"), F.lit('", "evidence": '), quoted(F.col("o_orderpriority"))))
        .when(k % 6 == 1, F.concat(name, F.lit(', "confidence": -5, "evidence": ['), quoted(F.col("o_orderstatus")), F.lit(","), quoted(F.col("o_orderpriority")), F.lit("]")))
        .when(k % 6 == 2, F.concat(name, F.lit(', "confidence": 20000.0')))
        .otherwise(F.concat(name, F.lit(', "confidence": "high", "evidence": '), quoted(F.col("o_orderstatus"))))
    )
    listed = F.when(k % 6 == 3, F.concat(F.lit("{"), item, F.lit("}"))).otherwise(F.concat(F.lit("[{"), item, F.lit("}]")))
    document = F.concat(F.lit('{"technologies": '), listed, F.lit("}"))
    answer = F.when(k % 6 == 4, F.concat(document, F.lit(" thanks"))).when(k % 6 == 5, F.lit("")).otherwise(document)
    rows = answers.parse_answers(read(spark, sf_dir, "orders").select(k.alias("k"), answer.alias("answer")), "technologies")
    first = F.when(F.col("success"), F.get("technologies", F.lit(0)))
    return rows.select("k", "success", first["name"].alias("name"), first["confidence"].alias("confidence"), F.array_join(first["evidence"], "|").alias("evidence"), "error")


@check("rounding", """
SELECT l_orderkey, l_linenumber, one || '' AS one, two FROM (
  SELECT l_orderkey, l_linenumber, x, printf('%.1f', x) AS one, CAST(printf('%.2f', x) AS DOUBLE) AS two FROM (
    SELECT *, (l_extendedprice - 30000.0) * l_discount * CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 WHEN 2 THEN 0.125 ELSE 1000.0 END AS x FROM lineitem))""")
def rounding(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    scale = F.when(n == 0, 1.0).when(n == 1, 0.001).when(n == 2, 0.125).otherwise(1000.0)
    x = (F.col("l_extendedprice") - 30000.0) * F.col("l_discount") * scale
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.one_decimal(x).alias("one"), numbers.exact_round(x, 2).alias("two"))


def _merged_sql(kind: str) -> str:
    return f"""
SELECT m.repo_id, m.name, m.kind AS {kind}, m.confidence, e.evidence FROM (
  SELECT repo_id, name, min_by(kind, path) AS kind, max({_ITEM}) AS confidence FROM ans WHERE NOT broken GROUP BY ALL) m
JOIN (SELECT repo_id, name, string_agg(proof, '|' ORDER BY path) AS evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY path) AS rn FROM (
    SELECT repo_id, name, proof, min(path) AS path FROM ans WHERE NOT broken GROUP BY ALL)) GROUP BY ALL) e ON e.repo_id = m.repo_id AND e.name = m.name"""


@check("merge_technologies", with_(_ANSWERS, select=_merged_sql("category")))
def merge_technologies(spark, sf_dir):
    parsed = answers.parse_answers(raw_answers(spark, sf_dir), "technologies").where("success")
    return answers.merge_findings(parsed, "technologies", "category").withColumn("evidence", F.array_join("evidence", "|"))


@check("merge_patterns", with_(_ANSWERS, select=_merged_sql("type")))
def merge_patterns(spark, sf_dir):
    parsed = answers.parse_answers(raw_answers(spark, sf_dir, "type", "patterns"), "architecture").where("success")
    return answers.merge_findings(parsed, "patterns", "type").withColumn("evidence", F.array_join("evidence", "|"))


@check("merge_suggestions", with_(_ANSWERS, select=f"""
SELECT repo_id, text, severity, file, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {_SEVERITY}, file) AS INT) AS nth FROM (
  SELECT repo_id, advice AS text, min_by(severity, path) AS severity, min(path) AS file FROM ans WHERE NOT broken GROUP BY ALL)"""))
def merge_suggestions(spark, sf_dir):
    parsed = answers.parse_answers(raw_answers(spark, sf_dir), "technologies").where("success")
    return answers.merge_suggestions(parsed).select("repo_id", "text", "severity", "file", "nth")


@check("merge_quality", """
SELECT source AS repo_id, 'readability' AS aspect, round(avg(quality * 100.0), 6) AS score, '' AS weaknesses,
  (SELECT string_agg(s, '|' ORDER BY p) FROM (
     SELECT 'lang ' || d2.lang AS s, min(lpad(CAST(d2.doc_id AS VARCHAR), 9, '0')) AS p FROM documents d2 JOIN labels l2 USING (doc_id)
     WHERE d2.source = d.source GROUP BY 1 ORDER BY p)) AS strengths
FROM documents d JOIN labels USING (doc_id) GROUP BY source""")
def merge_quality(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    aspect = F.struct(
        (F.col("quality") * 100.0).alias("score"), F.array(F.concat(F.lit("lang "), "lang")).alias("strengths"),
        F.array().cast("array<string>").alias("weaknesses"))
    typed = rows.select(
        F.col("source").alias("repo_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"),
        F.create_map(F.lit("readability"), aspect).alias("quality_assessment"))
    merged = answers.merge_quality(typed)
    return merged.select(
        "repo_id", "aspect", F.round("score", 6).alias("score"), F.array_join("weaknesses", "|").alias("weaknesses"),
        F.array_join("strengths", "|").alias("strengths"))


@check("merge_issues", """
SELECT source AS repo_id, description, severity, file, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, file) AS INT) AS nth
FROM (SELECT source, lang || ' text' AS description, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 1 THEN 'low' ELSE 'medium' END AS severity,
             lpad(CAST(doc_id AS VARCHAR), 9, '0') AS file FROM documents JOIN labels USING (doc_id))""")
def merge_issues(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    issue = F.struct(
        F.concat("lang", F.lit(" text")).alias("description"),
        F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 1, "low").otherwise("medium").alias("severity"))
    typed = rows.select(
        F.col("source").alias("repo_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.array(issue).alias("issues"))
    return answers.merge_issues(typed).select("repo_id", "description", "severity", "file", "nth")


@check("merge_chunks", """
SELECT CAST(conv_id AS VARCHAR) AS repo_id, 'chat' AS path, bool_and(length(text) > 20) AS success, count(*) AS chunks,
  (SELECT string_agg(role || ':' || best || ':' || proofs, ';' ORDER BY lead) FROM (
     SELECT role, max(CAST(length(text) AS INT)) AS best, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS proofs, min(turn) AS lead
     FROM conversations c2 WHERE c2.conv_id = c.conv_id GROUP BY role)) AS technologies
FROM conversations c GROUP BY conv_id""")
def merge_chunks(spark, sf_dir):
    item = F.struct(
        F.col("role").alias("name"), F.lit("library").alias("category"), F.length("text").alias("confidence"),
        F.array(F.col("turn").cast("string")).alias("evidence"))
    chunks = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("repo_id"), F.lit("chat").alias("path"), F.col("turn").alias("chunk_no"),
        (F.length("text") > 20).alias("success"), F.array(item).alias("technologies"),
        F.array(F.struct(F.col("role").alias("name"), F.lit("design").alias("type"))).alias("patterns"),
        F.array(F.struct(F.col("text"), F.lit("low").alias("severity"))).alias("suggestions"))
    line = lambda t: F.concat(t["name"], F.lit(":"), t["confidence"].cast("string"), F.lit(":"), F.array_join(t["evidence"], ","))
    return answers.merge_chunks(chunks).select(
        "repo_id", "path", "success", "chunks", F.array_join(F.transform("technologies", line), ";").alias("technologies"))


_AI = f"""ai AS (
  SELECT repo_id, lower(name) AS lname, max(name) AS name, max({_ITEM}) AS conf, min_by(kind, path) AS kind FROM ans WHERE NOT broken GROUP BY repo_id, lower(name))"""
_JUDGED = "category IN ('frameworks', 'databases', 'architecture')"


@check("ai_cross_validation", with_(_STACK, _ANSWERS, _AI, select=f"""
SELECT s.repo_id, category, tech, matches, round(CASE
    WHEN {_JUDGED} AND conf > 80 AND confidence < 60 THEN least(100.0, confidence * 1.5)
    WHEN {_JUDGED} AND conf > 50 THEN least(100.0, confidence * 1.2)
    WHEN {_JUDGED} AND conf IS NULL AND confidence < 50 THEN confidence * 0.8 ELSE confidence END, 4) AS confidence
FROM stack s LEFT JOIN ai ON ai.repo_id = s.repo_id AND lname = lower(tech)
UNION ALL
SELECT repo_id, CASE kind WHEN 'framework' THEN 'frameworks' WHEN 'database' THEN 'databases' ELSE 'frameworks' END, name, 0, round(conf * 0.9, 4) FROM ai
WHERE conf >= 70 AND NOT EXISTS (SELECT 1 FROM stack s WHERE s.repo_id = ai.repo_id AND lower(s.tech) = lname
  AND category IN ('frameworks', 'databases', 'frontend', 'build_systems', 'package_managers'))"""))
def ai_cross_validation(spark, sf_dir):
    found = analysed(spark, sf_dir).scored.withColumn("evidence", F.array().cast("array<string>"))
    technologies = answers.merge_findings(
        answers.parse_answers(raw_answers(spark, sf_dir), "technologies").where("success"), "technologies", "category")
    patterns = answers.merge_findings(
        answers.parse_answers(raw_answers(spark, sf_dir, "type", "patterns"), "architecture").where("success"), "patterns", "type")
    return answers.cross_validate_with_answers(found, technologies, patterns).select(
        "repo_id", "category", "tech", "matches", F.round("confidence", 4).alias("confidence"))


@check("advice_lists", """
SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 3 THEN NULL ELSE 'Use ' || o_orderpriority END AS text FROM orders""")
def advice_lists(spark, sf_dir):
    k = F.col("o_orderkey")
    listed = F.array(F.struct(F.concat(F.lit("Use "), "o_orderpriority").alias("text"), F.lit("low").alias("severity")))
    document = (
        F.when(k % 5 == 0, F.to_json(F.struct(listed.alias("recommendations"))))
        .when(k % 5 == 1, F.to_json(F.struct(listed.alias("result"))))
        .when(k % 5 == 2, F.to_json(listed))
        .when(k % 5 == 4, F.to_json(F.struct(F.lit("seen").alias("note"), listed.alias("further_advice"))))
        .otherwise(F.lit('{"note": 1}'))
    )
    rows = read(spark, sf_dir, "orders").select(k.alias("k"), answers.suggested_items(document).alias("items"))
    return rows.select("k", F.get("items", F.lit(0))["text"].alias("text"))


# Result store.


@check("result_store_appends", """
SELECT doc_id, any_value(found) AS result FROM (
  SELECT doc_id, CASE WHEN bool_or(lang = 'en') OVER k THEN 'first ' || length(text) ELSE 'second ' || length(text) END AS found
  FROM documents WINDOW k AS (PARTITION BY text)) GROUP BY doc_id""")
def result_store_appends(spark, sf_dir):
    """Append the results of one language, then those of all, of which only new keys are stored; then look all up."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "lang", "text", store.content_key(F.col("text")).alias("key"))
    results = store.ResultStore(spark, f"{shared_directory(spark)}/corpuslens/store-{uuid.uuid4().hex}", prefix=1)
    of_run = lambda rows, name: rows.select("key", F.concat(F.lit(name), F.length("text").cast("string")).alias("result"))
    results.append(of_run(documents.where("lang = 'en'"), "first "))
    results.append(of_run(documents, "second "))
    results.append(of_run(documents, "third "))
    return results.with_results(documents.select("doc_id", "key")).select("doc_id", "result")


_KEY = "md5(text || 'analysis' || 'gpt-4o')"


@check("result_store_misses", f"""
SELECT doc_id, {_KEY} AS key FROM documents WHERE {_KEY} NOT IN (SELECT {_KEY} FROM documents JOIN embeddings ON vec_id = doc_id)""")
def result_store_misses(spark, sf_dir):
    keyed = read(spark, sf_dir, "documents").select("doc_id", store.content_key(F.col("text")).alias("key"))
    return store.misses(keyed, _stored(spark, sf_dir, keyed)).select("doc_id", "key")


@check("result_store_lookup", f"""
SELECT d.doc_id, s.label FROM documents d LEFT JOIN (
  SELECT {_KEY} AS key, min(CAST(label AS VARCHAR)) AS label FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1) s ON s.key = {_KEY.replace('text', 'd.text')}""")
def result_store_lookup(spark, sf_dir):
    keyed = read(spark, sf_dir, "documents").select("doc_id", store.content_key(F.col("text")).alias("key"))
    return store.with_results(keyed, _stored(spark, sf_dir, keyed)).select("doc_id", F.col("result").alias("label"))


def _stored(spark, sf_dir, keyed):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("result"))
    return keyed.join(vectors, "doc_id").select("key", "result")


# Reports.

_MONEY = "format('{:.1f}', confidence)"
_TITLE = "array_to_string(list_transform(string_split(category, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
_ORDER = "list_position(['languages','frameworks','databases','build_systems','package_managers','frontend','devops','architecture','testing'], category)"


@check("report_text", with_(_STACK, f"""
section_lines AS (
  SELECT repo_id, {_ORDER} AS no, {_TITLE} || ':' || chr(10) || string_agg('  - ' || tech || ' (' || {_MONEY} || '%)' || chr(10), '' ORDER BY confidence DESC, matches DESC, tech) AS part
  FROM stack GROUP BY repo_id, category),
primary_lines AS (SELECT repo_id, string_agg('  - ' || {_TITLE} || ': ' || tech || chr(10), '' ORDER BY {_ORDER}) AS part FROM prim GROUP BY repo_id),
sizes AS (SELECT repo_id, count(*) AS n FROM files GROUP BY repo_id)""", select="""
SELECT s.repo_id, '===== REPOSITORY ANALYSIS REPORT =====' || chr(10) || chr(10) || 'Repository: ' || s.repo_id || chr(10) || 'Files analyzed: ' || n || chr(10)
  || 'Analyzed at: now' || chr(10) || chr(10) || coalesce('Primary Technologies:' || chr(10) || p.part || chr(10), '')
  || coalesce((SELECT string_agg(part || chr(10), '' ORDER BY no) FROM section_lines l WHERE l.repo_id = s.repo_id), '')
  || '==========================================' AS report
FROM sizes s LEFT JOIN primary_lines p ON p.repo_id = s.repo_id"""))
def report_text(spark, sf_dir):
    found = analysed(spark, sf_dir)
    return report.text_report(found.scored, found.primary, found.meta.withColumn("analyzed_at", F.lit("now")))


@check("report_markdown")
def report_markdown(spark, sf_dir):
    found = analysed(spark, sf_dir)
    return report.markdown_report(found.stack, found.primary, found.meta.withColumn("analyzed_at", F.lit("now")))


@check("document_folder", """
SELECT CAST(o_orderkey AS VARCHAR) AS repo_id, md5('order ' || o_orderkey || ' ' || o_orderpriority) AS document_md5, 'kept' AS part FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), md5('order ' || o_orderkey || ' ' || o_orderpriority), 'first' FROM orders""")
def document_folder(spark, sf_dir):
    """Documents written, replaced by those of open orders, and both versions read back."""
    folder = sinks.DocumentFolder(spark, f"{shared_directory(spark)}/corpuslens/documents-{uuid.uuid4().hex}", 1 << 20)
    key = F.col("o_orderkey").cast("string")
    orders = read(spark, sf_dir, "orders")
    made = orders.select(key.alias("repo_id"), F.concat(F.lit("order "), key, F.lit(" "), "o_orderpriority").alias("document"), "o_orderstatus")
    first = folder.write(made)
    folder.write(made.where("o_orderstatus = 'O'"))
    digest = ["repo_id", F.md5("document").alias("document_md5")]
    return folder.documents().select(*digest, F.lit("kept").alias("part")).unionByName(folder.documents(first).select(*digest, F.lit("first").alias("part")))


@check("stack_json", with_(_STACK, select="""
SELECT f.repo_id, any_value(f.n) AS file_count, count(s.tech) AS techs, max(p.tech) FILTER (p.category = 'languages') AS language
FROM (SELECT repo_id, count(*) AS n FROM files GROUP BY repo_id) f LEFT JOIN stack s ON s.repo_id = f.repo_id
LEFT JOIN prim p ON p.repo_id = f.repo_id AND p.category = s.category AND p.tech = s.tech GROUP BY f.repo_id"""))
def stack_json(spark, sf_dir):
    found = analysed(spark, sf_dir)
    documents = report.stack_documents(found.scored, found.primary, found.meta.drop("analyzed_at"))
    parsed = F.from_json("document", "stack map<string,map<string,string>>, primary_technologies map<string,string>, metadata struct<file_count:bigint>")
    n = F.aggregate(F.map_values(F.col("d.stack")), F.lit(0), lambda a, m: a + F.size(m))
    return documents.select("repo_id", parsed.alias("d")).select(
        "repo_id", F.col("d.metadata.file_count").alias("file_count"), F.coalesce(n, F.lit(0)).cast("bigint").alias("techs"),
        F.col("d.primary_technologies")["languages"].alias("language"))


@check("stack_summary", with_(_STACK, select="""
SELECT repo_id, string_agg(category || '=' || tech, ',' ORDER BY category) AS chosen FROM prim GROUP BY repo_id"""))
def stack_summary(spark, sf_dir):
    found = analysed(spark, sf_dir)
    parsed = F.from_json("summary", "primary_technologies map<string,string>")["primary_technologies"]
    lines = F.transform(F.map_entries(parsed), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return prompts.stack_summary(found.scored, found.primary).select("repo_id", F.array_join(F.sort_array(lines), ",").alias("chosen"))


@check("findings_text", with_(_ANSWERS, select=f"""
SELECT repo_id, string_agg('- ' || name || ' (' || kind || ', ' || {_MONEY} || '% confidence)', chr(10) ORDER BY confidence DESC, name) AS text FROM (
  SELECT repo_id, name, min_by(kind, path) AS kind, max({_ITEM}) AS confidence FROM ans WHERE NOT broken GROUP BY ALL) GROUP BY repo_id"""))
def findings_text(spark, sf_dir):
    parsed = answers.parse_answers(raw_answers(spark, sf_dir), "technologies").where("success")
    merged = answers.merge_findings(parsed, "technologies", "category")
    return prompts.findings_text(merged, "category", "No technologies detected.")


_POINTS = "chr(10) || aspect || ' {0}:' || chr(10) || array_to_string(list_transform({0}[1:3], lambda p: '- ' || p), chr(10))"


@check("quality_text", f"""
WITH q AS (
  SELECT CAST(o_custkey AS VARCHAR) AS repo_id, o_orderkey % 3 AS no, ['Readability', 'Maintainability', 'Performance'][o_orderkey % 3 + 1] AS aspect,
    CAST(count(*) * 7.25 AS DOUBLE) AS score, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS strengths,
    coalesce(list(DISTINCT o_orderstatus ORDER BY o_orderstatus) FILTER (o_orderstatus <> 'O'), []) AS weaknesses
  FROM orders GROUP BY ALL)
SELECT repo_id, string_agg(aspect || ': ' || format('{{:.1f}}', score) || '/100', chr(10) ORDER BY no) || chr(10) || string_agg(
  {_POINTS.format('strengths')} || CASE WHEN len(weaknesses) > 0 THEN chr(10) || {_POINTS.format('weaknesses')} ELSE '' END, chr(10) ORDER BY no) AS text
FROM q GROUP BY repo_id""")
def quality_text(spark, sf_dir):
    """Customers stand for repositories, their orders for findings; up to five strengths, at times no weakness."""
    aspect = F.element_at(F.array(*[F.lit(a) for a in answers.ASPECTS]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("repo_id"), aspect.alias("aspect"))
    return prompts.quality_text(rows.agg(
        (F.count("*") * 7.25).alias("score"), F.array_sort(F.collect_set("o_orderpriority")).alias("strengths"),
        F.array_sort(F.collect_set(F.nullif(F.col("o_orderstatus"), F.lit("O")))).alias("weaknesses")))


@check("repository_text", with_(q.base_sql(), select="""
SELECT repo_id, 'Repository path: ' || repo_id || chr(10) || 'File count: ' || count(*) AS text FROM files GROUP BY repo_id"""))
def repository_text(spark, sf_dir):
    return prompts.repository_text(analysed(spark, sf_dir).meta)


@check("review_report")
def review_report(spark, sf_dir):
    technologies = answers.parse_answers(raw_answers(spark, sf_dir), "technologies").where("success")
    patterns = answers.parse_answers(raw_answers(spark, sf_dir, "type", "patterns"), "architecture").where("success")
    found = answers.merge_findings(technologies, "technologies", "category")
    suggestions = answers.merge_suggestions(technologies)
    quality = found.select("repo_id", F.lit("readability").alias("aspect"), F.col("confidence").alias("score")).groupBy("repo_id", "aspect").agg(F.avg("score").alias("score"))
    issues = suggestions.select("repo_id", "nth", "severity", F.col("text").alias("description"))
    return report.review_report(found, answers.merge_findings(patterns, "patterns", "type"), quality, issues, suggestions)
