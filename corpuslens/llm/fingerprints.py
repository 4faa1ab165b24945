"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

A text is a list of paragraphs (its ``\\n``-separated lines).  The digest of a paragraph is the SHA-256 of
its text; a section ends after a paragraph whose digest begins with ``0``, so that an edit moves the
borders of its own section only; the digest of a section covers its paragraphs' digests, the root covers
the sections'.  Below the paragraphs stand pieces of at most 32 characters that end at a space or a
sentence end; each has a mark, a 64-bit hash whose low six bits hold the piece's length.

- Roots test equality: equal texts, and practically only these, have equal roots.
- ``likeness`` weighs the pieces that two trees share, by length, against the larger tree: 1 for equal
  texts (two empty ones included), 0 for trees without a common piece.
- ``locate_edits`` compares branches: only sections whose digest differs are looked into, and places of
  paragraphs on both sides come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.llm.common import documents_of

PIECE = r"[^\n.!?]{0,31}[.!?\n ]|[^\n.!?]{1,32}"
SECTION_END = "(?<=0[0-9a-f]{63},)"
IDS_PER_BLOCK = 64
BLOCKS_PER_RANGE = 1 << 16
_NO_ID = -(1 << 63)


def paragraph_digests(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))


def section_digests(paragraphs: Column) -> Column:
    """Digests of the runs of paragraphs between two section ends."""
    joined = F.concat(F.array_join(paragraphs, ","), F.lit(","))
    runs = F.filter(F.split(joined, SECTION_END, -1), lambda s: s != "")
    return F.transform(runs, lambda s: F.sha2(s, 256))


def root_digest(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ","), 256)


def root_of(text: Column) -> Column:
    return root_digest(section_digests(paragraph_digests(text)))


def piece_marks(text: Column) -> Column:
    """Distinct marks of the pieces, the leaves of the tree."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    mark = lambda p: F.shiftleft(F.shiftright(F.xxhash64(p), 6), 6).bitwiseOR(F.length(p).cast("long"))
    return F.array_distinct(F.transform(pieces, mark))


def _weight(marks: Column) -> Column:
    return F.aggregate(marks, F.lit(0).cast("long"), lambda acc, m: acc + m.bitwiseAND(F.lit(63).cast("long")))


def likeness(left: Column, right: Column) -> Column:
    """Share of the larger tree's leaf length that both trees have, of two arrays of marks."""
    larger = F.greatest(_weight(left), _weight(right))
    return F.when(larger == 0, 1.0).otherwise(_weight(F.array_intersect(left, right)) / larger)


def tree(text: Column) -> Column:
    """The whole fingerprint: root, section digests, paragraph digests, leaf marks."""
    return F.struct(
        root_of(text).alias("root"), section_digests(paragraph_digests(text)).alias("sections"),
        paragraph_digests(text).alias("paragraphs"), piece_marks(text).alias("marks"),
    )


def _split_sections(paragraphs: Column) -> Column:
    """The paragraph digests of each section, in order."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(state: Column, digest: Column) -> Column:
        grown = F.concat(state["open"], F.array(digest))
        ends = digest.startswith("0")
        return F.struct(
            F.when(ends, F.concat(state["done"], F.array(grown))).otherwise(state["done"]).alias("done"),
            F.when(ends, F.array().cast("array<string>")).otherwise(grown).alias("open"),
        )

    finish = lambda state: F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
    return F.aggregate(paragraphs, start, step, finish)


def _common_prefix(left: Column, right: Column) -> Column:
    """Length of the leading run of equal elements."""
    shorter = F.least(F.size(left), F.size(right))
    equal = F.zip_with(F.slice(left, F.lit(1), shorter), F.slice(right, F.lit(1), shorter), lambda x, y: x == y)
    at = F.array_position(equal, False)
    return F.when(at > 0, at - 1).otherwise(shorter).cast("int")


def _trimmed(rows: DataFrame) -> DataFrame:
    """Rows of arrays ``left`` and ``right`` with ``head`` and ``tail``, the lengths of their equal beginnings and ends."""
    rows = rows.withColumn("head", _common_prefix(F.col("left"), F.col("right")))
    after = lambda c: F.reverse(F.slice(c, F.col("head") + 1, F.size(c)))
    return rows.withColumn("tail", _common_prefix(after("left"), after("right")))


def _longest_rising(values: Column) -> Column:
    """A longest strictly rising subsequence of distinct numbers."""
    empty = F.array().cast("array<int>")

    def extend(state: Column, value: Column) -> Column:
        below = F.size(F.filter(state["tails"], lambda t: t < value))
        tails = F.concat(F.slice(state["tails"], F.lit(1), below), F.array(value), F.slice(state["tails"], below + 2, F.size(state["tails"])))
        return F.struct(tails.alias("tails"), F.concat(state["lengths"], F.array(below + 1)).alias("lengths"))

    lengths = F.aggregate(values, F.struct(empty.alias("tails"), empty.alias("lengths")), extend, lambda state: state["lengths"])

    def back(state: Column, entry: Column) -> Column:
        fits = (entry["length"] == state["need"]) & (entry["value"] < state["limit"])
        return F.when(fits, F.struct(
            (state["need"] - 1).alias("need"), entry["value"].alias("limit"), F.concat(state["kept"], F.array(entry["value"])).alias("kept"),
        )).otherwise(state)

    def trace(known: Column) -> Column:
        entries = F.reverse(F.zip_with(values, known, lambda v, n: F.struct(v.alias("value"), n.alias("length"))))
        start = F.struct(F.array_max(known).alias("need"), F.lit(2**31 - 1).alias("limit"), empty.alias("kept"))
        return F.aggregate(entries, start, back, lambda state: state["kept"])

    return F.get(F.transform(F.array(lengths), trace), 0)


def _kept(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, left_place, right_place) of branches (key, gap, digest, place) that both sides have in the same order.

    The n-th copy of a digest in a gap answers to the n-th on the other side.
    """
    on = ["key", "gap", "digest", "copy"]
    numbered = F.row_number().over(W.partitionBy("key", "gap", "digest").orderBy("place")).alias("copy")
    left = left.select("key", "gap", "digest", F.col("place").alias("left_place"), numbered)
    right = right.select("key", "gap", "digest", F.col("place").alias("right_place"), numbered)
    pairs = left.join(right, on).select("key", "left_place", "right_place")
    orders = pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("left_place", "right_place"))).alias("pairs"))
    rising = orders.select("key", F.explode(_longest_rising(F.transform("pairs", lambda p: p["right_place"]))).alias("right_place"))
    return pairs.join(rising, ["key", "right_place"]).select("key", "left_place", "right_place")


def locate_edits(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, removed, inserted): places (from 0) of the paragraphs of ``left`` and ``right`` that the other one lacks.

    ``pairs`` has a text pair for each value of the column ``key``, which is unique; null texts are empty.
    Without the paragraphs named both texts are the same list of paragraphs; a moved paragraph is named on
    both sides, of several copies as many as the other side lacks.  Branches are compared from the root
    down: pairs of equal roots give two empty lists and are not looked into, sections with equal digests
    in the same order are passed over, and only the paragraphs of the others are compared, between the
    same two sections passed over.  At both levels equal beginnings and ends go first; the order of what
    remains takes time that grows with its square.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = pairs.select(F.col(key).alias("key"), paragraph_digests(text(left)).alias("l"), paragraph_digests(text(right)).alias("r"))
    differing = whole.where(root_digest(section_digests(F.col("l"))) != root_digest(section_digests(F.col("r"))))
    trees = differing.select("key", "l", "r", _split_sections(F.col("l")).alias("ls"), _split_sections(F.col("r")).alias("rs"))
    digests = lambda c: F.transform(c, lambda s: F.sha2(F.concat(F.array_join(s, ","), F.lit(",")), 256))
    trees = _trimmed(trees.select("key", "ls", "rs", digests("ls").alias("left"), digests("rs").alias("right")))

    def sections(names: str, paragraphs: str) -> DataFrame:
        starts = F.transform(F.col(paragraphs), lambda s, i: F.aggregate(F.slice(F.col(paragraphs), F.lit(1), i), F.lit(0), lambda n, p: n + F.size(p)))
        branch = F.arrays_zip(F.col(names).alias("digest"), F.col(paragraphs).alias("paragraphs"), starts.alias("first"))
        middle = F.slice(branch, F.col("head") + 1, F.size(names) - F.col("head") - F.col("tail"))
        opened = trees.select("key", F.posexplode(middle).alias("place", "branch"))
        return opened.select("key", F.lit(0).alias("gap"), "place", "branch.digest", "branch.paragraphs", "branch.first")

    sides = {"left": sections("left", "ls"), "right": sections("right", "rs")}
    kept = _kept(*sides.values())

    def rest(side: str) -> DataFrame:
        """(key, gap, firsts): the paragraphs (digest, place) of a side's differing sections by gap."""
        same = kept.select("key", F.col(f"{side}_place").alias("place"), F.lit(1).alias("same"))
        rows = sides[side].drop("gap").join(same, ["key", "place"], "left")
        before = W.partitionBy("key").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = rows.withColumn("gap", F.count("same").over(before)).where("same is null")
        rows = rows.select("key", "gap", "first", F.posexplode("paragraphs").alias("at", "digest"))
        entry = F.struct((F.col("first") + F.col("at")).alias("place"), "digest")
        return rows.groupBy("key", "gap").agg(F.array_sort(F.collect_list(entry)).alias(f"{side}s"))

    none = F.array().cast("array<struct<place:int,digest:string>>")
    gaps = rest("left").join(rest("right"), ["key", "gap"], "full").select("key", "gap", F.coalesce("lefts", none).alias("lefts"), F.coalesce("rights", none).alias("rights"))
    only = lambda c: F.transform(c, lambda p: p["digest"])
    gaps = _trimmed(gaps.select("*", only("lefts").alias("left"), only("rights").alias("right")))

    def paragraphs(entries: str) -> DataFrame:
        middle = F.slice(F.col(entries), F.col("head") + 1, F.size(entries) - F.col("head") - F.col("tail"))
        return gaps.select("key", "gap", F.explode(middle).alias("p")).select("key", "gap", "p.digest", "p.place")

    lefts, rights = paragraphs("lefts"), paragraphs("rights")
    agreeing = _kept(lefts, rights)

    def lacking(rows: DataFrame, side: str, name: str) -> DataFrame:
        left_over = rows.join(agreeing.select("key", F.col(f"{side}_place").alias("place")), ["key", "place"], "left_anti")
        return left_over.groupBy("key").agg(F.array_sort(F.collect_list("place")).alias(name))

    empty = F.array().cast("array<int>")
    found = pairs.select(F.col(key).alias("key")).join(lacking(lefts, "left", "removed"), "key", "left").join(lacking(rights, "right", "inserted"), "key", "left")
    return found.select(F.col("key").alias(key), F.coalesce("removed", empty).alias("removed"), F.coalesce("inserted", empty).alias("inserted"))


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the following row in descending doc_id.

    Rows of equal doc_id follow each other by text, rows without doc_id come last, and the first row
    follows the last.  Texts are shuffled once, into blocks of 64 ids; the last row of a block takes the
    first of the next block that has rows, found over block numbers alone.  The only window without a
    key sees one row per 4 million ids.
    """
    rows = documents_of(docs).withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    numbered = rows.withColumn("block", F.shiftright("id", IDS_PER_BLOCK.bit_length() - 1))
    order = W.partitionBy("block").orderBy(F.desc("id"), "text")
    rows = numbered.select("*", F.lead("text").over(order).alias("follower"), F.row_number().over(order).alias("place"))
    firsts = rows.where("place = 1").select(F.col("block").alias("first_block"), F.col("text").alias("first_text"))

    blocks = numbered.select("block").distinct().withColumn("range", F.shiftright("block", BLOCKS_PER_RANGE.bit_length() - 1))
    ranges = blocks.groupBy("range").agg(F.max("block").alias("top"))
    down = W.orderBy(F.desc("range"))
    around = down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranges = ranges.select("range", F.coalesce(F.lead("top").over(down), F.first("top").over(around)).alias("below"))
    blocks = blocks.withColumn("next", F.lead("block").over(W.partitionBy("range").orderBy(F.desc("block"))))
    blocks = blocks.join(ranges, "range").select("block", F.coalesce("next", "below").alias("first_block"))
    tails = blocks.join(firsts, "first_block").select("block", "first_text")
    return rows.join(tails, "block").select("doc_id", "text", F.coalesce("follower", "first_text").alias("next_text"))


def edited_text(text: Column, other: Column) -> Column:
    """The last half of a text (rounded down) replaced by as much of the start of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    A null text is empty; an empty text has one empty paragraph, no leaves, and likeness 1 to another
    empty one.  Repeated rows are rows of their own.
    """
    rows = with_next_text(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        root_of(F.col("text")).alias("fingerprint"), root_of(F.col("edited")).alias("edited_fingerprint"),
        piece_marks(F.col("text")).alias("own"), piece_marks(F.col("edited")).alias("changed"), piece_marks(F.col("next_text")).alias("other"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"),
    )
