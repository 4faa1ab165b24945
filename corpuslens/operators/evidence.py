"""Evidence that corrections add, in the shape of hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import detectors as d
from corpuslens.operators import facts
from corpuslens.rules import architecture


def _rows(df: DataFrame, detector: str, tech, step, evidence, ordinal=None) -> DataFrame:
    return df.select(
        "repo_id",
        F.lit("").alias("path"),
        F.lit(detector).alias("detector"),
        tech.alias("tech"),
        F.lit(None).cast("double").alias("points"),
        F.lit(-1).alias("category"),
        (F.lit(step) if isinstance(step, int) else step).alias("step"),
        (F.lit(0) if ordinal is None else ordinal).cast("int").alias("ordinal"),
        evidence.alias("evidence"),
    )


def _connections(hits: DataFrame, rules: dict[str, tuple[int, str]]) -> DataFrame:
    """The first file of a repository that opens a connection to a database."""
    first = (
        hits.where("detector = 'flag' and tech like 'connection:%'")
        .groupBy("repo_id", "tech")
        .agg(F.min(F.struct("path", "ordinal", "evidence")).alias("first"))
    )
    table = facts.lookup_table(
        hits, [(t, o, p) for t, (o, p) in rules.items()], "tech string, lead int, pattern string"
    )
    joined = first.join(table, "tech")
    proof = F.when(F.col("first.ordinal") == F.col("lead"), F.col("first.evidence")).otherwise(F.col("pattern"))
    return _rows(
        joined, "databases", F.substring_index("tech", ":", -1), 3,
        F.concat(F.lit("Found database connection: "), proof),
    )


def _directories(hits: DataFrame) -> DataFrame:
    """Per directory set of a repository, the members found and where."""
    sets = [
        (tech, i * 100 + j, list(members))
        for i, (tech, sets) in enumerate(architecture.DIRECTORY_SETS.items())
        for j, members in enumerate(sets)
    ]
    table = facts.lookup_table(hits, sets, "tech string, set_no int, members array<string>")
    flat = table.select("tech", "set_no", F.size("members").alias("size"), F.posexplode("members").alias("at", "member"))
    found = (
        hits.where("detector = 'architecture+directory'")
        .groupBy("repo_id", F.col("tech").alias("member"))
        .agg(F.min("evidence").alias("folder"))
    )
    grouped = (
        found.join(F.broadcast(flat), "member")
        .groupBy("repo_id", "tech", "set_no", "size")
        .agg(F.sort_array(F.collect_list(F.struct("at", "member", "folder"))).alias("members"))
    )
    listed = F.array_join(
        F.transform("members", lambda m: F.concat(m["member"], F.lit(" ("), m["folder"], F.lit(")"))), ", "
    )
    n = F.size("members")
    head = (
        F.when(n == F.col("size"), "Found complete directory pattern: ")
        .when(n >= F.col("size") * 0.7, "Found partial directory pattern: ")
        .otherwise("Found some directories: ")
    )
    return _rows(grouped, "architecture", F.col("tech"), 1, F.concat(head, listed), F.col("set_no"))


def _file_names(hits: DataFrame) -> DataFrame:
    """The first file of each architecture file pattern."""
    first = (
        hits.where("detector = 'architecture+file'")
        .groupBy("repo_id", "tech")
        .agg(F.min(F.struct("path", "ordinal", "evidence")).alias("first"))
    )
    return _rows(
        first, "architecture", F.substring_index("tech", "/", 1), 2, F.col("first.evidence"), F.col("first.ordinal")
    )


def _row_remarks(rows: DataFrame) -> DataFrame:
    """Conventions, modules and imbalances of the architecture of a repository."""
    entries = []
    for i, (tech, _, needed, _, text) in enumerate(architecture.CONVENTIONS):
        count = d.convention_count(i)
        before, _, after = text.partition("{count}")
        message = F.concat(F.lit(before), count.cast("string"), F.lit(after)) if after else F.lit(text)
        entries.append((tech, 3, i, count >= needed, message))
    number = lambda c: F.col(c).cast("string")
    entries.append((
        "Feature-based architecture", 4, 0, F.col("modules").isNotNull(),
        F.concat(F.lit("Found "), number("modules"), F.lit(" potential feature modules: "), F.col("first_names"), F.lit("...")),
    ))

    def imbalance(tech, *parts):
        low = ~reduce(Column.__and__, [F.col(c) >= 2 for _, c in parts])
        listed = F.concat_ws(", ", *[F.concat(F.lit(f"{label} ("), number(c), F.lit(")")) for label, c in parts])
        entries.append((tech, 6, 0, low, F.concat(F.lit(f"Imbalance in {tech} components: "), listed)))

    imbalance("MVC", ("Models", "models"), ("Views", "views"), ("Controllers", "controllers"))
    imbalance("MVVM", ("Models", "models"), ("Views", "views"), ("ViewModels", "viewmodels"))
    imbalance("Clean Architecture", ("Entities", "entities"), ("UseCases", "usecases"), ("Adapters", "adapters"))
    entries += [
        ("Microservices", 6, 0, ~(d.flagged("micro") | (F.col("services") >= 3)),
         F.lit("Limited evidence for true microservices architecture")),
        ("Event-Driven Architecture", 6, 0, ~d.flagged("event"),
         F.lit("Limited evidence for true event-driven architecture")),
        ("REST API", 6, 0, d.flagged("rest"), F.lit("Found strong REST API indicators")),
        ("Feature-based architecture", 6, 0, F.col("feature_files") < 5,
         F.concat(F.lit("Only found "), number("feature_files"), F.lit(" files in feature directories"))),
    ]
    remarks = F.array_compact(F.array(*[
        F.when(test, F.struct(
            F.lit(tech).alias("tech"), F.lit(step).alias("step_no"), F.lit(i).alias("ord"), message.alias("message")
        ))
        for tech, step, i, test, message in entries
    ]))
    flat = rows.select("repo_id", F.inline(remarks))
    return _rows(flat, "architecture", F.col("tech"), F.col("step_no"), F.col("message"), F.col("ord"))


def _coverage(files: DataFrame) -> DataFrame:
    ratio = facts.test_source_ratio(files)
    message = F.concat(
        F.lit("Found good test coverage for "), "ext", F.lit(" files: "), F.col("tests").cast("string"),
        F.lit(" tests for "), F.col("sources").cast("string"), F.lit(" source files"),
    )
    return _rows(ratio, "testing", F.lit("High Test Coverage"), 6, message)


def derived(files: DataFrame, hits: DataFrame, rows: DataFrame, connections: dict[str, tuple[int, str]]) -> DataFrame:
    """All evidence that does not come from a single rule hit."""
    return (
        _connections(hits, connections)
        .unionByName(_directories(hits))
        .unionByName(_file_names(hits))
        .unionByName(_row_remarks(rows))
        .unionByName(_coverage(files))
    )
