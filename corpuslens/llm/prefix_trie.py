"""Conversation prefix trie by whole-sequence collapse.

Conversations that begin with the same turns share prefixes.  The trie's nodes are the different sequences of
first turns; nothing walks the trie, it is a table:

1. *Collapse*: conversations with the same whole sequence of turns become one weighted sequence with its
   least conv_id and the list of those that end there, read as a sorted stream (``collapsed``).
2. *Leaves*: a sequence that is a proper prefix of another is dropped by an anti-join (``leaf_paths``).
3. *Weighted prefixes*: every prefix of every different sequence is a row with the sequence's weight;
   grouping by prefix gives members, leaves and the least conv_id of each node.
4. *Subtree sums*: a node's own weight is given to the least leaf below it, which owns it.  Along a leaf's
   path the owned weights are summed up from its end, and the sums of all leaves through a node add up to
   its subtree: rows grow with the lengths of the sequences, not with pairs of nodes above each other.

A prefix is named by its depth and 128 bits: the exclusive or of hashes of (place, turn).  That can be
accumulated in any order, so that places and names are running totals over ranges of rows
(``operators.running``) and a conversation that holds a third of all rows lies in many tasks.

Rows are ordered by turn, null first; rows of equal turn by role and text.  Null roles and texts are empty.
Repeated rows are turns of their own.  Rows without a conv_id belong to no conversation.  An empty table has no
nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import written
from corpuslens.operators.running import running

BLOCK_OF_IDS = 100
MOST_SHARED = 6
NAME = ["depth", "high", "low"]


def _turn_names(place: Column, turn: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at its place."""
    return [F.xxhash64(F.lit(seed), place.cast("long"), turn) for seed in ("high", "low")]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_key, n_chars): the turns of every conversation, numbered from 1, without their texts."""
    text = lambda name: F.coalesce(conversations[name].cast("string"), F.lit(""))
    key = F.md5(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), text("role").alias("role"), F.unhex(key).alias("turn_key"),
        F.length(text("text")).cast("long").alias("n_chars"),
    )
    numbered = running(rows.where("conv_id is not null"), ["conv_id"], [F.asc_nulls_first("turn"), "role", "turn_key"], position="place")
    return numbered.select("conv_id", "place", "turn_key", "n_chars")


def rebuilt(turns: DataFrame, block: int = BLOCK_OF_IDS, shared: int = MOST_SHARED) -> DataFrame:
    """Every conversation with its first turns replaced by those of its block's first one.

    ``h`` = crc32(conv_id) % ``shared`` turns come from conversation conv_id - conv_id % ``block`` (all if it
    has fewer, none if it is not there), then follow the conversation's own turns after its first ``h``.
    Returns (conv_id, place, turn_key, n_chars); conversations that have no turns left give no rows.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    ids = turns.select("conv_id").distinct().withColumn("h", h.cast("long"))
    first = turns.where(F.col("place") < shared).select(F.col("conv_id").alias("source"), "place", "turn_key", "n_chars")
    lengths = first.groupBy("source").agg(F.max("place").alias("n_source"))
    ids = ids.withColumn("source", F.col("conv_id") - F.col("conv_id") % block)
    # At most ``block`` conversations meet the ``shared`` turns of a source.
    taken = ids.join(first, "source").where("place <= h").select("conv_id", "place", "turn_key", "n_chars")
    moved = ids.join(lengths, "source", "left").select("conv_id", "h", (F.col("h") - F.least("h", F.coalesce("n_source", F.lit(0)))).alias("missing"))
    own = turns.join(moved, "conv_id").where("place > h")
    return taken.unionByName(own.select("conv_id", (F.col("place") - F.col("missing")).alias("place"), "turn_key", "n_chars"))


def collapsed(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(depth, high, low, conv_id, n_convs, ends_sha256): one row per different whole sequence.

    ``conv_id`` is the least of those with this sequence, ``ends_sha256`` digests all of them in ascending
    order.  The list is streamed, not held: a digest needs its input in order, in one task.
    """
    high, low = _turn_names(F.col("place"), F.col("turn_key"))
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("depth"), F.bit_xor(high).alias("high"), F.bit_xor(low).alias("low"))
    named = ids.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NAME])
    schema = "depth long, high long, low long, conv_id long, n_convs long, ends_sha256 string"
    fields = [("depth", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least, n, digest, out = None, 0, 0, None, []
        for batch in batches:
            for *name, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != last:
                    if last is not None:
                        out.append((*last, least, n, digest.hexdigest()))
                    last, least, n, digest = name, conv_id, 0, hashlib.sha256()
                digest.update(b",%d" % conv_id if n else b"%d" % conv_id)
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))
                out = []
        if last is not None:
            out.append((*last, least, n, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return named.select(*NAME, "conv_id").repartition(*NAME).sortWithinPartitions(*NAME, "conv_id").mapInArrow(run, schema)


def prefixes(sequences: DataFrame, turns: DataFrame) -> DataFrame:
    """Every prefix of every different sequence: its name, its parent's, its last turn's length, and the sequence.

    Returns (sequence, n_convs, depth, high, low, up_high, up_low, n_chars); ``sequence`` is the least
    conv_id of the sequence; the root, which all share, is depth 0.
    """
    high, low = _turn_names(F.col("place"), F.col("turn_key"))
    kept = turns.join(sequences.select("conv_id", "n_convs"), "conv_id").select("conv_id", "n_convs", "place", "n_chars", high.alias("own_high"), low.alias("own_low"))
    named = running(kept, ["conv_id"], ["place"], xors={"high": "own_high", "low": "own_low"}, position="depth")
    none = F.lit(None).cast("long")
    roots = sequences.select(F.col("conv_id").alias("sequence"), "n_convs", *[F.lit(0).cast("long").alias(c) for c in NAME], none.alias("up_high"), none.alias("up_low"), F.lit(0).cast("long").alias("n_chars"))
    up = [F.col(a).bitwiseXOR(F.col(b)).alias(c) for a, b, c in (("high", "own_high", "up_high"), ("low", "own_low", "up_low"))]
    return written(roots.unionByName(named.select(F.col("conv_id").alias("sequence"), "n_convs", *NAME, *up, "n_chars")), "prefixes")


def leaf_paths(sequences: DataFrame, paths: DataFrame) -> DataFrame:
    """The sequences that are no proper prefix of another one."""
    inner = paths.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_high").alias("high"), F.col("up_low").alias("low")).distinct()
    return sequences.join(inner, NAME, "left_anti").select(F.col("conv_id").alias("sequence"), F.lit(True).alias("leaf"))


def trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """The nodes of the prefix trie of ``conversations`` (conv_id, turn, role, text).

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node:
    the least conv_id of the conversations that begin with the node's turns, and its parent's (null at the
    root); how many they are; how many longer prefixes follow directly; leaves in its subtree; how many
    characters of last turns a trie saves in its subtree against texts written out; the digest of the
    conv_ids that end there.  With ``rebuild`` conversations are first rebuilt from their blocks (``rebuilt``).
    """
    own = turns_of(conversations)
    turns = written(rebuilt(own), "rebuilt") if rebuild else own
    sequences = written(collapsed(own.select("conv_id").distinct(), turns), "sequences")
    paths = prefixes(sequences, turns)
    paths = written(paths.join(leaf_paths(sequences, paths), "sequence", "left"), "paths")

    nodes = paths.groupBy(*NAME).agg(
        F.min("sequence").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf"), F.col("sequence"))).alias("owner"),
        F.max("n_chars").alias("n_chars"), F.max("up_high").alias("up_high"), F.max("up_low").alias("up_low"),
    )
    nodes = written(nodes.withColumn("own_saved", (F.col("n_convs") - 1) * F.col("n_chars")), "nodes")

    # What each leaf owns, summed up from its end; above the owned part, which is the end of its path, the whole sum.
    owned = paths.where("leaf").select("sequence", *NAME).join(nodes.select(*NAME, "owner", "own_saved"), NAME)
    owned = owned.select("sequence", *NAME, F.when(F.col("owner") == F.col("sequence"), F.col("own_saved")).otherwise(0).alias("owned"))
    below = running(owned, ["sequence"], [F.desc("depth")], sums={"below": "owned"}).groupBy(*NAME).agg(F.sum("below").alias("saved_tokens"))

    # Parents: children are counted before they meet their parent, which then is one row of the other side.
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_high").alias("high"), F.col("up_low").alias("low")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("high").alias("up_high"), F.col("low").alias("up_low"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(below, NAME).join(children, NAME, "left").join(sequences.select(*NAME, "ends_sha256"), NAME, "left")
    whole = whole.join(parents, ["depth", "up_high", "up_low"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


# A checksum in SQL: the table's entries by the polynomial, then a step per byte of the decimal id.
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def _crc_entry(value: str) -> str:
    return f"list_reduce(list_prepend({value}, range(8)), lambda c, k: {_CRC_STEP.format('c')})"


TRIE_SQL = f"""
WITH crc_table AS (SELECT list({_crc_entry('i')} ORDER BY i) AS entries FROM range(256) t(i)),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS source,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc_table),
parts AS (
  SELECT i.conv_id, 0 AS part, o.place, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.source AND o.place <= i.h
  UNION ALL
  SELECT i.conv_id, 1, o.place, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.place > i.h),
numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM parts),
paths AS (
  SELECT conv_id, depth, length(text) AS n_chars,
    list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM numbered
  UNION ALL SELECT conv_id, 0, 0, [] FROM ids),
named AS (SELECT conv_id, depth, n_chars, path::VARCHAR || md5(to_json(path)) AS name,
    CASE WHEN depth > 0 THEN path[:-2]::VARCHAR || md5(to_json(path[:-2])) END AS up FROM paths),
lengths AS (SELECT i.conv_id, coalesce(max(depth), 0) AS n FROM ids i LEFT JOIN numbered USING (conv_id) GROUP BY 1),
nodes AS (
  SELECT depth, name, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_chars) AS saved,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends
  FROM named JOIN lengths USING (conv_id) GROUP BY depth, name),
children AS (SELECT up AS name, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
below AS (
  SELECT a.depth, a.name, sum(b.saved) AS saved_tokens, count(*) FILTER (WHERE c.name IS NULL) AS n_leaves
  FROM (SELECT DISTINCT a.depth, a.name, b.depth AS low_depth, b.name AS low_name
        FROM named a JOIN named b ON a.conv_id = b.conv_id AND a.depth <= b.depth) a
  JOIN nodes b ON b.depth = a.low_depth AND b.name = a.low_name
  LEFT JOIN children c ON c.depth = b.depth AND c.name = b.name GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.name = n.name
LEFT JOIN children c ON c.depth = n.depth AND c.name = n.name
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.name = n.up
"""
