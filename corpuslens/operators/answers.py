"""Language-model answers as data: extract, validate, merge, and compare with detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.functions.text import severity_rank
from corpuslens.operators.running import running

SUGGESTIONS = "array<struct<text:string,severity:string,reason:string>>"
FINDING = "struct<name:string,{kind}:string,confidence:double,evidence:array<string>>"
ASPECT = "struct<score:double,strengths:array<string>,weaknesses:array<string>>"
ASPECTS = ["readability", "maintainability", "performance"]
SCHEMAS = {
    "technologies": f"technologies array<{FINDING.format(kind='category')}>, suggestions {SUGGESTIONS}",
    "architecture": f"patterns array<{FINDING.format(kind='type')}>, suggestions {SUGGESTIONS}",
    "code_quality": (
        f"quality_assessment map<string,{ASPECT}>, "
        "issues array<struct<type:string,severity:string,description:string,location:string>>, "
        f"suggestions {SUGGESTIONS}"
    ),
}
_FENCE = "```"


def fenced_json(answer: Column) -> Column:
    """Text of the first ``json`` fence, else of the first fence, else the whole answer.

    An unclosed fence runs to the last character, which it leaves out.
    """

    def inside(opening: str) -> Column:
        start = F.instr(answer, opening) + len(opening)
        end = F.call_function("locate", F.lit(_FENCE), answer, start)
        length = F.when(end > 0, end - start).otherwise(F.length(answer) - start)
        return F.substring(answer, start, F.greatest(length, F.lit(0)))

    tagged = _FENCE + "json"
    return F.trim(
        F.when(F.contains(answer, F.lit(tagged)), inside(tagged))
        .when(F.contains(answer, F.lit(_FENCE)), inside(_FENCE))
        .otherwise(answer),
        F.lit(" \t\n\r"),
    )


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _texts(text: Column) -> Column:
    """A list of texts, or one text as a list of one."""
    listed = F.from_json(text, "array<string>")
    return F.when(F.startswith(text, F.lit("[")), listed).when(text.isNotNull(), F.array(text))


def _items(listed: Column, /, **kinds) -> Column:
    """Items of a JSON list (an object counts as a list of one), every field read leniently."""
    loose = F.from_json(listed, "array<struct<" + ",".join(f"{name}:string" for name in kinds) + ">>")
    return F.transform(loose, lambda x: F.struct(*[(read(x[name]) if read else x[name]).alias(name) for name, read in kinds.items()]))


def _aspects(text: Column) -> Column:
    read = {"score": _number, "strengths": _texts, "weaknesses": _texts}
    loose = F.from_json(text, "map<string,struct<score:string,strengths:string,weaknesses:string>>")
    return F.transform_values(loose, lambda _, v: F.struct(*[f(v[name]).alias(name) for name, f in read.items()]))


def parse_answers(raw: DataFrame, kind: str) -> DataFrame:
    """Typed columns of raw answers of one kind; ``error`` is set where the JSON is malformed.

    Only syntax makes an answer malformed (text after the JSON included); a field of another type than
    usual is read as far as it goes: numbers in quotes, one text in place of a list.
    """
    lists = {
        "technologies": {"technologies": dict(name=None, category=None, confidence=_number, evidence=_texts)},
        "architecture": {"patterns": dict(name=None, type=None, confidence=_number, evidence=_texts)},
        "code_quality": {"quality_assessment": None, "issues": dict(type=None, severity=None, description=None, location=None)},
    }[kind] | {"suggestions": dict(text=None, severity=None, reason=None)}
    text = fenced_json(F.col("answer"))
    fields = ", ".join(f"{name} string" for name in (*lists, "success", "error"))
    # Generated columns are computed once; a plain projection would parse anew for every use.
    whole = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    loose = F.struct(F.from_json(text, fields).alias("loose"), F.coalesce(whole, F.lit(False)).alias("whole"))
    parsed = raw.select(*raw.columns, F.inline(F.array(loose)))
    read = {name: (_aspects(F.col(f"loose.{name}")) if kinds is None else _items(F.col(f"loose.{name}"), **kinds)) for name, kinds in lists.items()}
    error = F.when(~F.col("whole"), F.lit("Failed to parse AI response as JSON")).otherwise(F.col("loose.error"))
    succeeded = F.col("whole") & error.isNull() & F.coalesce(F.col("loose.success").try_cast("boolean"), F.lit(True))
    judged = parsed.select(*raw.columns, *[value.alias(name) for name, value in read.items()], succeeded.alias("success"), error.alias("error"))
    return validated(judged, kind)


def _defaults(items: Column, **values) -> Column:
    fill = {k: (F.array().cast("array<string>") if v == [] else F.lit(v)) for k, v in values.items()}

    def item(x):
        return F.struct(*[F.coalesce(x[k], v).alias(k) for k, v in fill.items()])

    return F.transform(items, item)


def validated(rows: DataFrame, kind: str) -> DataFrame:
    """Fill in missing lists and fields of successful answers."""

    def filled(column: str, **values) -> Column:
        items = _defaults(F.col(column), **values)
        return F.when(F.col("success"), F.coalesce(items, F.filter(_defaults(F.array().cast(_item_type(rows, column)), **values), lambda _: F.lit(True)))).otherwise(F.col(column))

    if kind == "technologies":
        rows = rows.withColumn("technologies", filled(
            "technologies", name="Unknown Technology", category="unknown", confidence=50.0, evidence=[]))
    elif kind == "architecture":
        rows = rows.withColumn("patterns", filled(
            "patterns", name="Unknown Pattern", type="unknown", confidence=50.0, evidence=[]))
    else:
        empty = F.array().cast("array<string>")
        blank = F.create_map(*[
            x for a in ASPECTS for x in (F.lit(a), F.struct(F.lit(0.0).alias("score"), empty.alias("strengths"), empty.alias("weaknesses")))
        ])
        rows = rows.withColumn(
            "quality_assessment",
            F.when(F.col("success"), F.coalesce("quality_assessment", blank)).otherwise(F.col("quality_assessment")),
        ).withColumn("issues", F.when(
            F.col("success"), F.coalesce("issues", F.array().cast(_item_type(rows, "issues")))).otherwise(F.col("issues")))
    return rows.withColumn("suggestions", filled(
        "suggestions", text="Unknown suggestion", severity="medium", reason="AI-detected suggestion"))


def _item_type(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def suggested_items(answer_json: Column) -> Column:
    """First list found under the usual fields of an advice answer, the answer itself, or any list of items in it."""
    listed = "array<struct<text:string,severity:string,reason:string>>"
    fields = ["recommendations", "response", "suggestions", "result"]
    parsed = F.from_json(answer_json, ", ".join(f"{f} {listed}" for f in fields))
    others = F.map_values(F.from_json(answer_json, "map<string,string>"))
    lists = F.transform(F.filter(others, lambda v: F.startswith(v, F.lit("["))), lambda v: F.from_json(v, listed))
    usable = F.filter(lists, lambda x: F.exists(x, lambda item: item["text"].isNotNull()))
    whole = F.when(F.startswith(F.ltrim(answer_json), F.lit("[")), F.from_json(answer_json, listed))
    return F.coalesce(*[parsed[f] for f in fields], whole, F.get(usable, F.lit(0)))


def merge_findings(answers: DataFrame, column: str, kind: str, evidence_limit: int | None = None) -> DataFrame:
    """Findings of all files of a repository by name: best confidence, first kind, distinct evidence in order."""
    flat = answers.select("repo_id", "path", F.posexplode(column).alias("nth", "item")).select(
        "repo_id", "path", "nth", "item.*"
    )
    merged = flat.groupBy("repo_id", "name").agg(
        F.max("confidence").alias("confidence"), F.min(F.struct("path", "nth", kind)).alias("first")
    )
    distinct = (
        flat.select("repo_id", "name", "path", "nth", F.posexplode("evidence").alias("at", "proof"))
        .groupBy("repo_id", "name", "proof")
        .agg(F.min(F.struct("path", "nth", "at")).alias("place"))
    )
    rank = F.row_number().over(W.partitionBy("repo_id", "name").orderBy("place"))
    proofs = (
        distinct.withColumn("rank", rank)
        .where(_up_to("rank", evidence_limit))
        .groupBy("repo_id", "name")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "proof"))), lambda s: s["proof"]).alias("evidence"))
    )
    return merged.join(proofs, ["repo_id", "name"], "left").select(
        "repo_id", "name", F.col(f"first.{kind}").alias(kind), "confidence",
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
    )


def _up_to(rank: str, limit: int | None) -> Column:
    return F.lit(True) if limit is None else F.col(rank) <= limit


def merge_suggestions(answers: DataFrame, limit: int | None = None) -> DataFrame:
    """Suggestions by exact text, first file wins, most severe first."""
    first = (
        answers.select("repo_id", "path", F.posexplode("suggestions").alias("nth", "item"))
        .select("repo_id", "path", "nth", "item.*")
        .groupBy("repo_id", "text")
        .agg(F.min(F.struct("path", "nth", "severity", "reason")).alias("f"))
        .select("repo_id", "text", "f.severity", "f.reason", F.col("f.path").alias("file"), F.col("f.nth").alias("at"))
    )
    return _most_severe(first, limit, "file", "at").drop("at")


def _most_severe(rows: DataFrame, limit: int | None, *then: str) -> DataFrame:
    """Rows with their rank ``nth`` in their repository.

    All rows of a repository are ranked over ranges of rows, so that no task holds a large repository;
    with a limit Spark cuts the window's input in every task before rows meet.
    """
    severity = severity_rank(F.col("severity"))
    if limit is None:
        others = [c for c in rows.columns if c not in ("repo_id", *then)]
        return running(rows, ["repo_id"], [severity, *then, *others], position="nth").withColumn("nth", F.col("nth").cast("int"))
    order = W.partitionBy("repo_id").orderBy(severity, *then)
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def merge_issues(answers: DataFrame, limit: int | None = None) -> DataFrame:
    """Issues of all files with their file, most severe first."""
    flat = answers.select("repo_id", F.col("path").alias("file"), F.posexplode("issues").alias("at", "item")).select(
        "repo_id", "file", "at", "item.*"
    )
    return _most_severe(flat, limit, "file", "at").drop("at")


def merge_quality(answers: DataFrame, limit: int | None = None) -> DataFrame:
    """Average score and first distinct strengths and weaknesses per aspect."""
    flat = answers.select("repo_id", "path", F.explode("quality_assessment").alias("aspect", "a")).where(
        F.col("aspect").isin(ASPECTS)
    )
    scores = flat.groupBy("repo_id", "aspect").agg(F.coalesce(F.avg("a.score"), F.lit(0.0)).alias("score"))
    points = [
        F.struct(F.lit(kind).alias("kind"), F.col(f"a.{kind}").alias("points")) for kind in ("strengths", "weaknesses")
    ]
    distinct = (
        flat.select("repo_id", "aspect", "path", F.inline(F.array(*points)))
        .select("repo_id", "aspect", "kind", "path", F.posexplode("points").alias("at", "point"))
        .groupBy("repo_id", "aspect", "kind", "point")
        .agg(F.min(F.struct("path", "at")).alias("place"))
    )
    rank = F.row_number().over(W.partitionBy("repo_id", "aspect", "kind").orderBy("place"))
    chosen = distinct.withColumn("rank", rank).where(_up_to("rank", limit))

    def listed(kind):
        entries = F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "point")))
        return F.transform(F.sort_array(entries), lambda s: s["point"]).alias(kind)

    lists = chosen.groupBy("repo_id", "aspect").agg(listed("strengths"), listed("weaknesses"))
    none = F.array().cast("array<string>")
    return scores.join(lists, ["repo_id", "aspect"], "left").select(
        "repo_id", "aspect", "score", F.coalesce("strengths", none).alias("strengths"), F.coalesce("weaknesses", none).alias("weaknesses")
    )


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """One answer per file from the answers of its chunks (repo_id, path, chunk_no, success, ...).

    Technologies merge by name with their evidence strung together, patterns keep the first of a
    name, suggestions the first of an opening sentence; the file succeeds when every chunk did.
    """
    keys = ["repo_id", "path"]
    overall = chunks.groupBy(*keys).agg(
        F.bool_and(F.coalesce("success", F.lit(False))).alias("success"), F.count("*").alias("chunks")
    )

    def first_by(column: str, key: Column):
        flat = chunks.select(*keys, "chunk_no", F.posexplode(column).alias("nth", "item"))
        return flat.groupBy(*keys, key.alias("key")).agg(F.min(F.struct("chunk_no", "nth", "item")).alias("f"))

    def in_order(rows: DataFrame, value: Column, name: str) -> DataFrame:
        entries = F.sort_array(F.collect_list(F.struct("f.chunk_no", "f.nth", value.alias("item"))))
        return rows.groupBy(*keys).agg(F.transform(entries, lambda s: s["item"]).alias(name))

    flat = chunks.select(*keys, "chunk_no", F.posexplode("technologies").alias("nth", "t"))
    proofs = F.transform(
        F.sort_array(F.collect_list(F.struct("chunk_no", "nth", F.col("t.evidence").alias("e")))), lambda s: s["e"]
    )
    by_name = flat.groupBy(*keys, F.col("t.name").alias("name")).agg(
        F.min(F.struct("chunk_no", "nth", F.col("t.category").alias("category"))).alias("f"),
        F.max("t.confidence").alias("confidence"),
        F.flatten(proofs).alias("evidence"),
    )
    technologies = in_order(
        by_name, F.struct("name", F.col("f.category").alias("category"), "confidence", "evidence"), "technologies"
    )
    patterns = in_order(first_by("patterns", F.col("item.name")), F.col("f.item"), "patterns")
    opening = F.substring_index(F.col("item.text"), ".", 1)
    suggestions = in_order(first_by("suggestions", opening), F.col("f.item"), "suggestions")
    joined = overall
    for part in (technologies, patterns, suggestions):
        joined = joined.join(part, keys, "left")
    return joined


_ADDED = {
    "framework": "frameworks", "database": "databases", "frontend": "frontend", "build_system": "build_systems",
    "package_manager": "package_managers",
}
_LABELS = {"frameworks": "framework", "databases": "database", "architecture": "architecture"}


def cross_validate_with_answers(stack: DataFrame, technologies: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adjust a stack by merged findings of language-model answers and add what it lacks.

    Of findings whose names differ in case only, the one sorting last counts.
    """

    def named(findings: DataFrame, kind: str) -> DataFrame:
        return findings.groupBy("repo_id", F.lower("name").alias("lower_name")).agg(
            F.max(F.struct("name", "confidence", F.col(kind).alias("kind"), "evidence")).alias("ai")
        )

    tech_names = named(technologies, "category").withColumn("is_pattern", F.lit(False))
    all_names = tech_names.unionByName(named(patterns, "type").withColumn("is_pattern", F.lit(True)))
    keyed = stack.withColumn("lower_name", F.lower("tech")).withColumn("is_pattern", F.col("category") == "architecture")
    joined = keyed.join(all_names, ["repo_id", "lower_name", "is_pattern"], "left")
    judged = F.col("category").isin(list(_LABELS))
    label = F.when(F.col("category") == "frameworks", "framework").when(F.col("category") == "databases", "database").otherwise("architecture")
    ai, own = F.col("ai.confidence"), F.col("confidence")
    strong, fair = judged & (ai > 80) & (own < 60), judged & (ai > 50)
    unseen = judged & ai.isNull() & (own < 50)
    none = F.array().cast("array<string>")
    note = (
        F.when(strong, F.concat(F.lit("AI analysis confirmed this "), label, F.lit(" with high confidence")))
        .when(fair, F.concat(F.lit("AI analysis confirmed this "), label))
        .when(unseen, F.concat(F.lit("AI analysis did not detect this "), label, F.when(F.col("category") == "architecture", " pattern").otherwise("")))
    )
    adjusted = joined.select(
        "repo_id", "category", "tech", "matches",
        F.when(strong, F.least(F.lit(100.0), own * 1.5)).when(fair, F.least(F.lit(100.0), own * 1.2))
        .when(unseen, own * 0.8).otherwise(own).alias("confidence"),
        "sub_category",
        F.when(note.isNotNull(), F.concat(F.coalesce("evidence", none), F.array(note))).otherwise(F.col("evidence")).alias("evidence"),
    )
    present = stack.where(F.col("category").isin(list(_ADDED.values()))).select("repo_id", F.lower("tech").alias("lower_name"))
    target = F.lit("frameworks")
    for kind, category in _ADDED.items():
        target = F.when(F.col("ai.kind") == kind, category).otherwise(target)
    added = (
        tech_names.join(present, ["repo_id", "lower_name"], "left_anti")
        .where(F.col("ai.confidence") >= 70)
        .select(
            "repo_id", target.alias("category"), F.col("ai.name").alias("tech"), F.lit(0.0).alias("matches"),
            (F.col("ai.confidence") * 0.9).alias("confidence"), F.lit(None).cast("string").alias("sub_category"),
            F.concat(
                F.array(F.concat(F.lit("Detected by AI with "), F.col("ai.confidence").cast("string"), F.lit("% confidence"))),
                F.transform(F.slice("ai.evidence", 1, 3), lambda e: F.concat(F.lit("AI evidence: "), e)),
            ).alias("evidence"),
        )
    )
    return adjusted.unionByName(added)
