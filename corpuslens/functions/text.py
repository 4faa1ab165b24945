"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL_SHARE = 0.1


def decode_lossy(data: Column) -> Column:
    """UTF-8 text of binary data with malformed bytes dropped."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))


def is_binary_text(content: Column) -> Column:
    """More than a tenth of all characters are control characters."""
    # Texts are read once for a first control character; only those with one are counted, by whole runs of others.
    some = F.rlike(content, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    controls = F.regexp_replace(content, r"[^\x00-\x08\x0B\x0C\x0E-\x1F]++", "")
    return some & (F.length(controls) / F.length(content) > CONTROL_SHARE)


def is_blank(content: Column) -> Column:
    """Nothing but whitespace (Unicode whitespace included)."""
    return ~F.rlike(content, F.lit(r"[^\t\n\x0B\f\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"))


def literal_count(content: Column, literal: Column) -> Column:
    """Occurrences of a literal that do not overlap."""
    rest = F.replace(content, literal, F.lit(""))
    return ((F.length(content) - F.length(rest)) / F.length(literal)).cast("int")


def import_like(content: Column, literal: Column) -> Column:
    """The literal follows ``import``, ``require(`` or ``include`` somewhere."""
    return (
        F.contains(content, F.concat(F.lit("import "), literal))
        | F.contains(content, F.concat(F.lit("require("), literal))
        | F.contains(content, F.concat(F.lit("include "), literal))
    )


def shorten(text: Column) -> Column:
    """At most 60 characters; longer text keeps 57 and an ellipsis."""
    return F.when(F.length(text) > 60, F.concat(F.left(text, F.lit(57)), F.lit("..."))).otherwise(text)


def mask_credentials(text: Column) -> Column:
    """Hide ``user:password@`` of a connection string."""
    return F.regexp_replace(text, "://[^@/]+@", "://***@")


def has_requirement_line(content: Column) -> Column:
    """Some line that is neither blank nor a comment has an equals sign."""
    return F.exists(
        F.split(content, "\n"),
        lambda line: (~F.startswith(F.ltrim(line, F.lit(" \t\r\f\x0b")), F.lit("#"))) & F.contains(line, F.lit("=")),
    )


def manifest_sections(content: Column) -> Column:
    """Package maps of a manifest's two dependency sections; malformed JSON and sections give NULL."""
    return F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def severity_rank(severity: Column) -> Column:
    """high 0, medium 1, low 2, anything else 3."""
    return (
        F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)
    )


def title_case(name: Column) -> Column:
    """``build_systems`` as ``Build Systems``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
