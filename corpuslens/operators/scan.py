"""Rule scan: every file against every rule, as one narrow map stage.

The rules travel as one constant array of structs.  For each file the array is first cut down by
the literals it contains, and only what passes is evaluated, so no join copies file contents per
rule and nothing but small hit rows leaves the stage.  One search finds all literals of all rules
(see ``functions.literals``); rules are then looked up under the literals that were found.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import asdict
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import paths, text
from corpuslens.functions.literals import literals_found, minimal_literals
from corpuslens.operators import content_facts
from corpuslens.rules import architecture, languages, testing
from corpuslens.rules.ruleset import (
    NAME_RANK,
    ContentRule,
    RuleSet,
    content_gate,
    content_regex,
    path_gate,
    path_regex,
)
from corpuslens.session import materialize

HIT_COLUMNS = [
    "repo_id", "path", "detector", "tech", "points", "category", "step", "ordinal", "evidence",
]
_PATH_RULE = (
    "struct<detector:string,tech:string,kind:string,patterns:array<string>,weights:array<double>,"
    "step:int,category:int,ordinal:int,gate:array<string>,keys:array<string>,java:string>"
)
_CONTENT_RULE = (
    "struct<detector:string,tech:string,kind:string,pattern:string,weight:double,cap:int,"
    "scope:string,style:string,label:string,group:int,ignore_case:boolean,step:int,category:int,"
    "ordinal:int,gate:array<string>,keys:array<string>,java:string,head:string>"
)
_MIN_LITERAL = 3
_BUCKETS = 1024


def fold(column: Column) -> Column:
    """Lower case, the form in which literals are searched."""
    return F.lower(column)


def _fold_literal(literal: str) -> str:
    return literal.lower()


def _capped_head(rule: ContentRule) -> str:
    """Pattern of the shortest prefix holding ``cap`` matches of a lone character set."""
    if rule.cap and re.fullmatch(r"\[[^\]^\\]+\]", rule.pattern):
        return rf"\A(?:[^{rule.pattern[1:-1]}]*+{rule.pattern}){{0,{rule.cap}}}"
    return ""


def _index(rows: list[dict]) -> tuple[tuple[str, ...], tuple[str, ...], str]:
    """Searched literals, short literals, and the rules as a hash table on literals, in JSON.

    A rule is filed under every literal that opens its gate ("" when nothing is known).  The table
    is an array of buckets addressed by the checksum of the literal.
    """
    literals = {_fold_literal(a) for r in rows for a in r["gate"]}
    short = tuple(sorted(a for a in literals if a and len(a) < _MIN_LITERAL))
    searched, representative = minimal_literals(a for a in literals if len(a) >= _MIN_LITERAL)
    filed: dict[str, list[dict]] = {}
    for row in rows:
        keys = sorted({representative.get(a, a) for a in map(_fold_literal, row["gate"])})
        for key in keys:
            filed.setdefault(key, []).append({**row, "keys": keys})
    buckets: list[list[dict]] = [[] for _ in range(_BUCKETS)]
    for key, rules in filed.items():
        buckets[zlib.crc32(key.encode()) % _BUCKETS].append({"key": key, "rules": rules})
    return tuple(searched), short, json.dumps(buckets)


def _table(document: str, row_type: str) -> Column:
    """The hash table as a constant that the optimizer folds once."""
    return F.from_json(F.lit(document), f"array<array<struct<key:string,rules:array<{row_type}>>>>")


def found_literals(folded: Column, searched, short) -> Column:
    """Literals present in a folded text, and the empty one that opens gateless rules."""
    few = [F.when(F.contains(folded, F.lit(a)), F.lit(a)) for a in short]
    return F.concat(literals_found(folded, searched), F.array_compact(F.array(*few, F.lit(""))))


def _candidates(table: Column, found: Column) -> Column:
    """Rules filed under a literal that was found, each once."""

    def lookup(literal):
        bucket = F.get(table, F.pmod(F.crc32(literal), F.lit(_BUCKETS)).cast("int"))
        filed = F.flatten(F.transform(F.filter(bucket, lambda b: b["key"] == literal), lambda b: b["rules"]))
        first = lambda r: F.get(F.filter(r["keys"], lambda k: F.array_contains(found, k)), F.lit(0))
        return F.filter(filed, lambda r: (F.size(r["keys"]) == 1) | (first(r) == literal))

    return F.flatten(F.transform(found, lookup))


@lru_cache(maxsize=64)
def _path_index(rules: RuleSet):
    return _index([{**asdict(r), "gate": path_gate(r), "java": path_regex(r)} for r in rules.path_rules])


@lru_cache(maxsize=64)
def _content_index(rules: RuleSet):
    return _index([
        {
            **asdict(r), "gate": content_gate(r), "java": content_regex(r), "head": _capped_head(r),
            "ignore_case": r.ignore_case or r.kind == "present_lower",
        }
        for r in rules.content_rules
    ])


def _patterns_met(rules: RuleSet, path: Column, name: Column) -> Column:
    """Regular expressions of path rules that a path meets, each a constant that is compiled once.

    Inside a lambda they would be compiled again for every candidate of every path.
    """
    subjects = {"match": name, "search": path}
    gates: dict[tuple[str, str], set[str]] = {}
    for rule in rules.path_rules:
        if rule.kind in subjects:
            gates.setdefault((rule.kind, path_regex(rule)), set()).update(path_gate(rule))
    met = []
    for (kind, java), gate in gates.items():
        holds = F.rlike(subjects[kind], F.lit(java))
        if gate and "" not in gate:
            holds = reduce(Column.__or__, [F.contains(path, F.lit(a)) for a in sorted(gate)]) & holds
        met.append(F.when(holds, F.lit(f"{kind} {java}")))
    return F.array_compact(F.array(*met)) if met else F.array().cast("array<string>")


def _path_tier(rule: Column, path: Column, name: Column, folders: Column, met: Column) -> Column:
    """1 exact name, 2 part of the name, 3 part of the path, 0 no match."""
    patterns = rule["patterns"]
    exact = F.array_contains(patterns, name)
    in_name = F.exists(patterns, lambda p: F.contains(name, p))
    in_path = F.exists(patterns, lambda p: F.contains(path, p))
    ends_name = F.exists(patterns, lambda p: F.endswith(name, p))
    kind = rule["kind"]
    visible = ~F.startswith(path, F.lit("."))
    in_folders = F.exists(
        patterns,
        lambda p: F.contains(
            folders, F.when(F.endswith(p, F.lit("/")), F.concat(F.lit("/"), p)).otherwise(F.concat(p, F.lit("/")))
        ),
    )
    return (
        F.when(kind.isin("literal", "tier"), F.when(exact, 1).when(in_name, 2).when(in_path, 3).otherwise(0))
        .when(kind == "suffix_tier", F.when(exact, 1).when(ends_name, 2).when(in_path, 3).otherwise(0))
        .when(kind == "name", exact.cast("int"))
        .when(kind == "config", (exact | ends_name).cast("int"))
        .when(kind == "glob", ends_name.cast("int"))
        .when(kind.isin("match", "search"), F.array_contains(met, F.concat_ws(" ", kind, rule["java"])).cast("int"))
        .when(kind == "sign", in_path.cast("int"))
        .when(kind == "sign_lower", F.exists(patterns, lambda p: F.contains(F.lower(path), p)).cast("int"))
        .when(kind == "directory", (visible & in_folders).cast("int"))
        .when(kind == "top", F.startswith(path, patterns[0]).cast("int"))
        .when(kind == "top_name", (F.startswith(path, patterns[0]) & (name == patterns[1])).cast("int"))
        .otherwise(0)
    )


def _matched_folder(path: Column, pattern: Column) -> Column:
    """The ancestor directory that ends with a directory pattern."""
    slashed = F.concat(F.lit("/"), path)
    end = F.instr(slashed, F.concat(F.lit("/"), pattern)) + F.length(pattern)
    return F.substring(slashed, F.lit(2), end - 2)


def test_directory(path: Column, directories) -> Column:
    """First test directory a path is in, NULL when in none."""
    return F.coalesce(*[F.when(F.contains(path, F.lit(d)), F.lit(d)) for d in directories], F.lit(None).cast("string"))


def _test_category(word_in: Column) -> Column:
    names = testing.SUB_CATEGORIES
    return (
        F.when(F.contains(word_in, F.lit("unit")), names.index("unit"))
        .when(F.contains(word_in, F.lit("integration")), names.index("integration"))
        .when(paths.matches_any(word_in, ["e2e", "end-to-end"]), names.index("e2e"))
        .otherwise(names.index("general"))
    )


def path_hits(files: DataFrame, rules: RuleSet, carried: tuple[str, ...] = ()) -> DataFrame:
    """Hits of the path rules beside the ``carried`` columns; reads only these, ``repo_id`` and ``path``."""
    base = files.select(
        "repo_id",
        "path",
        *carried,
        paths.base_name(F.col("path")).alias("name"),
        fold(F.concat(F.lit("/"), F.col("path"))).alias("folded"),
        F.concat(F.lit("/"), F.regexp_replace("path", "[^/]*$", "")).alias("folders"),
    )
    searched, short, table = _path_index(rules)
    base = base.withColumn("found", found_literals(F.col("folded"), searched, short))
    path, name, folders = F.col("path"), F.col("name"), F.col("folders")
    base = base.withColumn("met", _patterns_met(rules, path, name))
    scored = F.transform(
        _candidates(_table(table, _PATH_RULE), F.col("found")),
        lambda r: F.struct(r.alias("rule"), _path_tier(r, path, name, folders, F.col("met")).alias("tier")),
    )
    rows = base.select("repo_id", "path", *carried, "name", F.inline(F.filter(scored, lambda s: s["tier"] > 0)))
    rule, tier = F.col("rule"), F.col("tier")
    evidence = (
        F.when(rule["kind"] == "match", F.concat(F.lit("Found test file: "), name))
        .when(rule["kind"] == "config", F.concat(F.lit("Found config file: "), name))
        .when(rule["kind"] == "glob", F.concat(F.lit("Found file with extension: "), name))
        .when(rule["kind"] == "search", F.concat(F.lit("Found file pattern: "), name))
        .when(rule["kind"] == "directory", _matched_folder(path, rule["patterns"][0]))
        .when(rule["detector"] == "flag", F.lit(None))
        .when((tier == 1) | ((tier == 2) & (rule["kind"] == "suffix_tier")), F.concat(F.lit("Found file: "), name))
        .when(tier == 2, F.concat(F.lit("Found pattern in filename: "), name))
        .otherwise(F.concat(F.lit("Found pattern in path: "), path))
    )
    hits = rows.select(
        "repo_id",
        "path",
        *carried,
        rule["detector"].alias("detector"),
        rule["tech"].alias("tech"),
        F.get(rule["weights"], tier - 1).alias("points"),
        F.when(rule["kind"] == "match", NAME_RANK + _test_category(F.lower(path)))
        .otherwise(rule["category"])
        .alias("category"),
        rule["step"].alias("step"),
        rule["ordinal"].alias("ordinal"),
        evidence.alias("evidence"),
    )
    if not any(r.detector == "testing" for r in rules.path_rules):
        return hits
    directory = test_directory(path, rules.test_directories)
    tests = (
        files.select("repo_id", "path", *carried, directory.alias("directory"))
        .where("directory is not null")
        .select(
            "repo_id",
            "path",
            *carried,
            F.lit("testing").alias("detector"),
            F.lit("Tests").alias("tech"),
            F.lit(2.0).alias("points"),
            _test_category(F.lower("directory")).alias("category"),
            F.lit(1).alias("step"),
            F.lit(0).alias("ordinal"),
            F.concat(F.lit("Found test directory: "), "directory", F.lit(" in "), "path").alias("evidence"),
        )
    )
    return hits.unionByName(tests)


def _scopes(rules: RuleSet, path: Column, name: Column, content: Column, lowered: Column) -> Column:
    """Names of the rule scopes a file belongs to."""
    lower_path = F.lower(path)
    scanned = content.isNotNull()

    def suffix(*ends):
        found = F.endswith(path, F.lit(ends[0]))
        for end in ends[1:]:
            found = found | F.endswith(path, F.lit(end))
        return found

    automation = (
        suffix(".sh", ".yml", ".yaml")
        | F.contains(path, F.lit(".github/workflows/"))
        | paths.matches_any(lower_path, ["jenkins", "travis", "gitlab-ci", "dockerfile"])
    )
    known = {
        "all": F.lit(True),
        "text": scanned,
        "requirements": name == "requirements.txt",
        "package_json": name == "package.json",
        "container": paths.matches_any(lower_path, ["dockerfile", "docker-compose"]),
        "npm_suffix": suffix("package.json"),
        "pip_suffix": suffix("requirements.txt", "Pipfile"),
        "automation": automation,
        "chart": suffix("Chart.yaml", "Chart.yml"),
        "python_manifest": name.isin("requirements.txt", "Pipfile", "pyproject.toml", "requirements.in"),
        "gemfile": name.isin("Gemfile", "Gemfile.lock"),
    }
    entries = []
    for scope in dict.fromkeys(r.scope for r in rules.content_rules):
        if scope.startswith("orm:"):
            needs, excludes = ([w for w in part.split(",") if w] for part in scope.split(":")[1:])
            applies = scanned
            if needs:
                applies = applies & paths.matches_any(lowered, needs)
            if excludes:
                applies = applies & ~paths.matches_any(lowered, excludes)
        else:
            applies = known[scope]
        entries.append(F.when(applies, F.lit(scope)))
    return F.array_compact(F.array(*entries)) if entries else F.array().cast("array<string>")


# Stands for a file's name in the evidence of a content that several files share.
_SHOWN_NAME = "\x00\x01name\x01\x00"


def content_hits(files: DataFrame, rules: RuleSet, facts: list[Column] | None = None, copies: bool | None = None) -> DataFrame:
    """Hits of the content rules; returns no text.

    ``facts`` are further arrays of hits over ``path``, ``name``, ``content`` and ``shown``, computed alongside.
    Corpora hold many copies of the same files.  With ``copies`` every different content is scanned once and
    its hits are sent to all its paths (``distinct_content_hits``); without, every file is scanned where it is
    read, and no text is shuffled.  By default the share of different contents decides; results are the same.
    """
    places = None
    if copies is None:
        places = materialize(_places(files, rules), "places")
        copies = _has_copies(places)
    if copies:
        return distinct_content_hits(files, rules, facts, places)
    base = files.where("content is not null").select("repo_id", "path", paths.base_name(F.col("path")).alias("name"), "content")
    return _scanned(base.withColumn("shown", F.col("name")), ["repo_id", "path"], rules, facts)


def _places(files: DataFrame, rules: RuleSet) -> DataFrame:
    """(repo_id, path, own_name, key) of every file that has a text, without it."""
    return keyed_contents(files, rules).select("repo_id", "path", F.when(F.col("shown") == _SHOWN_NAME, F.col("name")).alias("own_name"), "key")


def _has_copies(places: DataFrame, share: float = 0.7) -> bool:
    """Whether clearly fewer contents than files are different, by a sketch of all of them."""
    row = places.agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("different")).first()
    return row["different"] < share * row["n"]


def _traits(rules: RuleSet) -> Column:
    """Everything that rules and facts ask of a path, as names: scopes, name rules, file kinds."""
    path, name = F.col("path"), F.col("name")
    scopes = _scopes(rules, path, name, F.lit(""), F.lit(""))
    named = [
        F.when(F.rlike(name, F.lit(content_regex(r))), F.lit(f"rule {r.detector} {r.ordinal} {r.pattern}")) for r in rules.content_rules if r.kind == "name"
    ]
    parts = [scopes, content_facts.path_traits(), *([F.array_compact(F.array(*named))] if named else [])]
    return F.array_join(F.concat(*parts), "\x00")


def keyed_contents(files: DataFrame, rules: RuleSet) -> DataFrame:
    """(repo_id, path, name, content, shown, key): equal keys have equal hits, but for the name in the evidence.

    The key digests content and traits of the path; a content that holds the name's stand-in is its own.
    """
    rows = files.where("content is not null").select("repo_id", "path", paths.base_name(F.col("path")).alias("name"), "content")
    own = F.contains("content", F.lit(_SHOWN_NAME))
    key = F.md5(F.concat_ws("\x01", F.md5("content"), _traits(rules), F.when(own, F.concat_ws("\x01", "repo_id", "path"))))
    return rows.withColumn("shown", F.when(own, F.col("name")).otherwise(F.lit(_SHOWN_NAME))).withColumn("key", F.unhex(key))


def distinct_contents(files: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per key of ``keyed_contents``; tasks drop the copies they hold before the shuffle."""
    return keyed_contents(files, rules).select("key", "path", "name", "content", "shown").dropDuplicates(["key"])


def distinct_content_hits(files: DataFrame, rules: RuleSet, facts: list[Column] | None = None, places: DataFrame | None = None) -> DataFrame:
    """As ``content_hits``, scanning one copy of each content.

    The hits of the different contents are narrow and written once; then they meet the narrow (path, key) rows.
    A content that very many files share makes that side of the join skewed, which Spark splits: neither side
    holds a text.
    """
    places = _places(files, rules) if places is None else places
    hits = materialize(_scanned(distinct_contents(files, rules), ["key"], rules, facts), "content-hits")
    joined = places.join(hits, "key")
    # Where no text can hold the stand-in, every one in the evidence is a name's place.
    evidence = F.coalesce(F.replace("evidence", F.lit(_SHOWN_NAME), "own_name"), "evidence").alias("evidence")
    return joined.select(*[evidence if c == "evidence" else c for c in HIT_COLUMNS])


def _plain_text(regex: str) -> str | None:
    """The literal text of a pattern whose wildcards take any number of digits, whichever they are; else None."""
    rest = re.sub(r"\[(?:\\p\{\w+\}|\\n|[^\]\\\d])*\][*+]|\.[*+]", "/", regex)
    rest = re.sub(r"\\A|\(\?:|[$^]", "/", rest)
    rest = re.sub(r"\\([^\w])", r"\1", rest.replace(".", "\x00").replace("\\\x00", "."))
    return None if re.search(r"[\\\x00\[{]|[0-9][()|*+]|[()|][0-9]", rest) else rest.replace("?", "")


@lru_cache(maxsize=64)
def _digit_runs(rules: RuleSet) -> tuple[str, str] | None:
    """Pattern and replacement of the runs of digits in a path that no rule and no path fact can tell apart.

    Such a run is longer than every run in a literal or pattern of the rules, no literal can end or start inside it,
    and it is not part of the extension.  None if the rules may depend on single digits.
    """
    texts = [*rules.test_directories, *(w for words in architecture.COMPONENTS.values() for w in words), *languages.SPECIAL_FILES]
    texts += [a for r in rules.path_rules for a in (*path_gate(r), *(() if r.kind in ("match", "search") else r.patterns))]
    patterns = [path_regex(r) for r in rules.path_rules if r.kind in ("match", "search")]
    patterns += [content_regex(r) for r in rules.content_rules if r.kind == "name"]
    texts += [_plain_text(a) for a in patterns]
    if any(t is None or re.fullmatch("[0-9]+", t) for t in texts):
        return None
    longest = max((len(run) for t in texts for run in re.findall("[0-9]+", t)), default=0)
    before = {m[1] for t in texts if (m := re.search("(.)[0-9]+$", t, re.S))}
    after = {m[1] for t in texts if (m := re.match("[0-9]+(.)", t, re.S))}
    guard = lambda chars: "".join("\\" + c if not c.isalnum() else c for c in sorted({d for c in chars for d in (c.lower(), c.upper())}))
    return f"(?s)(?<![0-9{guard(before)}])[0-9]{{{longest + 1},}}+(?![{guard(after)}0-9])(?=.*\\.)", "0" * (longest + 1)


def path_shape(path: Column, rules: RuleSet) -> Column:
    """The path with its long numbers alike: paths of equal shape meet the same rules and path facts."""
    runs = _digit_runs(rules)
    return path if runs is None else F.regexp_replace(path, F.lit(runs[0]), F.lit(runs[1]))


def _content_digest() -> Column:
    return F.unhex(F.md5("content"))


def file_groups(files: DataFrame, rules: RuleSet) -> DataFrame:
    """(repo_id, path, digest, files, pick): files of one repository with equal content and shape of the path, counted.

    ``path`` is that shape and ``pick`` names one of the files by the hash of its key.
    """
    keyed = files.select("repo_id", path_shape(F.col("path"), rules).alias("path"), _content_digest().alias("digest"), _file_hash().alias("pick"))
    return keyed.groupBy("repo_id", "path", "digest").agg(F.count("*").alias("files"), F.min("pick").alias("pick"))


def _file_hash() -> Column:
    return F.xxhash64("repo_id", "path")


def groups_pay(groups: DataFrame, share: float = 0.7, most: int = 500_000) -> bool:
    """Whether clearly fewer contents than files are different, and few enough to name a file of each in every task."""
    row = groups.where("digest is not null").agg(F.sum("files").alias("n"), F.approx_count_distinct("digest").alias("different")).first()
    return row["n"] is not None and row["different"] < min(share * row["n"], most)


def grouped_hits(files: DataFrame, groups: DataFrame, rules: RuleSet, facts: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sums of hits over the files of a group, and the manifest hits of single files; neither has evidence.

    The first has the points of all files of a group and is for sums and maxima over a repository.
    """
    columns = ["repo_id", "detector", "tech", (F.col("points") * F.col("files")).alias("points"), "category"]
    keyed = groups.where("digest is not null").withColumn("name", paths.base_name(F.col("path")))
    keyed = materialize(keyed.withColumn("key", F.unhex(F.md5(F.concat_ws("\x01", F.hex("digest"), _traits(rules))))), "keys")
    first = keyed.groupBy("key").agg(F.min("pick").alias("pick"))
    picked = F.broadcast(keyed.join(first, ["key", "pick"]).select("key", "pick", "path", "name"))  # at most one row per content and traits
    texts = files.select(_file_hash().alias("pick"), "content").join(F.broadcast(first.select("pick")), "pick", "left_semi")
    base = texts.where("content is not null").join(picked, "pick").dropDuplicates(["key"]).withColumn("shown", F.col("name"))
    hits = materialize(_scanned(base, ["key"], rules, facts), "content-hits")
    sums = keyed.groupBy("repo_id", "key").agg(F.sum("files").alias("files")).join(hits, "key").select(*columns)
    if rules.path_rules:
        sums = path_hits(groups, rules, ("files",)).select(*columns).unionByName(sums)
    tech = hits.where("detector = 'manifest'").select("key", "detector", "tech").join(keyed.select("key", "digest").distinct(), "key")
    manifests = files.where(F.endswith("path", F.lit("package.json"))).select("repo_id", "path", _content_digest().alias("digest"))
    manifests = manifests.groupBy("repo_id", "digest").agg(F.min("path").alias("path")).join(tech.drop("key").distinct(), "digest").drop("digest")
    return sums, manifests


def _scanned(base: DataFrame, carried: list[str], rules: RuleSet, facts: list[Column] | None) -> DataFrame:
    """The hits of each row's content beside the ``carried`` columns."""
    content, path, name = F.col("content"), F.col("path"), F.col("name")
    base = base.withColumn("folded", fold(content))
    searched, short, table = _content_index(rules)
    base = base.withColumn("found", found_literals(F.col("folded"), searched, short))
    base = base.withColumn("scopes", _scopes(rules, path, name, content, F.col("folded")))
    folded = F.col("folded")
    none = F.array().cast("array<string>")

    def passes(rule):
        gated = F.exists(
            rule["gate"], lambda a: F.when(rule["ignore_case"], F.contains(folded, a)).otherwise(F.contains(content, a))
        )
        return F.array_contains(F.col("scopes"), rule["scope"]) & gated

    def found(rule):
        subject = F.when(rule["head"] != "", F.call_function("regexp_extract", content, rule["head"], F.lit(0))).otherwise(content)
        return (
            F.when(rule["kind"] == "regex", F.regexp_extract_all(subject, rule["java"], rule["group"]))
            .when(rule["kind"] == "exists", F.when(F.rlike(content, rule["java"]), F.array(F.lit(""))).otherwise(none))
            .when(rule["kind"] == "name", F.when(F.rlike(name, rule["java"]), F.array(F.lit(""))).otherwise(none))
            .when(rule["kind"] == "literal", none)
            .otherwise(F.array(F.lit("")))
        )

    def counted(entry):
        rule = entry["rule"]
        literal = rule["kind"] == "literal"
        return F.struct(
            rule.alias("rule"),
            F.when(literal, text.literal_count(content, rule["pattern"]))
            .otherwise(F.size(entry["found"]))
            .alias("n"),
            F.get(entry["found"], F.lit(0)).alias("match"),
            (literal & text.import_like(content, rule["pattern"])).alias("imported"),
            F.when(
                F.startswith(rule["tech"], F.lit("connection:")), F.call_function("regexp_extract", content, rule["java"], F.lit(0))
            ).alias("proof"),
        )

    selected = F.filter(_candidates(_table(table, _CONTENT_RULE), F.col("found")), passes)
    matched = F.filter(
        F.transform(selected, lambda r: F.struct(r.alias("rule"), found(r).alias("found"))),
        lambda e: (e["rule"]["kind"] == "literal") | (F.size(e["found"]) > 0),
    )
    hits = F.transform(F.transform(matched, counted), lambda c: _content_hit(c, F.col("shown")))
    return base.select(*carried, F.inline(F.concat(hits, *(facts or []))))


def _content_hit(counted: Column, name: Column) -> Column:
    """Points and evidence of one matched rule."""
    rule, match, imported = counted["rule"], counted["match"], counted["imported"]
    style, tech = rule["style"], rule["tech"]
    n = F.when(rule["cap"] > 0, F.least(counted["n"], rule["cap"])).otherwise(counted["n"])
    in_name = F.concat(F.lit(" in "), name)
    evidence = (
        F.when(style == "literal", F.concat(
            F.when(imported, F.lit("Found import: ")).otherwise(F.lit("Found pattern: ")),
            rule["pattern"], in_name))
        .when(style == "requirement", F.concat(F.lit("Found pattern: "), rule["pattern"], in_name))
        .when(style == "dependency", F.concat(F.lit("Found dependency: "), rule["label"], in_name))
        .when(style == "config", F.concat(F.lit("Config file: "), name))
        .when(style == "url", F.concat(F.lit("Connection string: "), text.mask_credentials(text.shorten(match))))
        .when(style == "driver", F.concat(F.lit("Driver: "), match))
        .when(style == "orm", F.concat(F.lit("ORM ("), rule["label"], F.lit("): "), match))
        .when(style == "query", F.concat(rule["label"], F.lit(": "), F.left(match, F.lit(40)), F.lit("...")))
        .when(style == "variables", F.concat(F.lit("Found "), tech, F.lit(" environment variables"), in_name))
        .when(style == "npm_dependency", F.concat(F.lit("Found "), tech, F.lit(" dependency in package.json")))
        .when(style == "pip_dependency", F.concat(F.lit("Found "), tech, F.lit(" dependency"), in_name))
        .when(style == "pattern", F.concat(F.lit("Pattern match: "), text.shorten(match)))
        .when(style == "code", F.concat(F.lit("Code pattern"), in_name, F.lit(": "), rule["pattern"]))
        .when(style == "package", F.concat(F.lit("Found in "), rule["label"]))
        .when(style == "test_import", F.concat(F.lit("Found import"), in_name, F.lit(": "), text.shorten(match)))
        .when(style == "test_code", F.concat(F.lit("Found code pattern"), in_name, F.lit(": "), text.shorten(match)))
        .otherwise(counted["proof"])
    )
    return F.struct(
        rule["detector"].alias("detector"),
        tech.alias("tech"),
        (n * rule["weight"] * F.when(imported, 2).otherwise(1)).cast("double").alias("points"),
        rule["category"].alias("category"),
        rule["step"].alias("step"),
        rule["ordinal"].alias("ordinal"),
        evidence.alias("evidence"),
    )
