"""Prefix trie of conversations, built by van Emde Boas recursion over digests of turns.

A turn is 128 bits of the SHA-256 of its role and text. Salted with its depth it gives two 64-bit numbers, and a node
(a distinct sequence of first turns) is named by its depth and the exclusive or of them: any stretch of turns can
be added to the name of the prefix before it, in one step and in any grouping.

``trie`` cuts conversations into segments of ``SEGMENT`` turns, named by the prefix before them, and then halves all
segments at once, round by round: the first half is a sequence of the upper trie, the second one of the lower forest
whose root is the name of the cut prefix. Equal sequences under one root become one row with the number of its
conversations, so a stretch that a third of all conversations share is cut further only once. After the last round
every row is one edge. Totals are grafted upward in the opposite order: what stands below a cut prefix is added to
its ancestors in the upper half, which one of its conversations lists.

Defined cases: null role or text reads as empty; turns go by turn number (null first), equal numbers by digest, so
repeated rows stay as repeated turns; a null conv_id is one conversation of its own, counted like any other, whose id
no smallest member shows unless it is alone; conversations without turns are given as ids and end at the root; an
empty table has no node, not even the root. Further columns are ignored, whatever their names.

Scale: texts are read once and never shuffled. Places of turns come from range partitions, a segment has at most
``SEGMENT`` turns, so neither a conversation nor a prefix with a third of all rows meets in one task: sums and counts
combine map-side, hot parents (at most ``HOT`` by their definition) are broadcast, and the members that end at a node
are listed by ranges of their ids. Rounds: log2 of the longest conversation; each grafts at most half the nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.merkle import SQL_CRC
from ledgerlens.llm.positions import ranked
from ledgerlens.llm.sparkops import settle

SEGMENT_BITS = 6
SEGMENT = 1 << SEGMENT_BITS
#: parents with more than one in HOT of all nodes as children; there can be no more than HOT of them
HOT = 1024
#: members that end at a node are listed by ranges of so many ids
RANGE_BITS = 8
WORD = "[^\\x20\\x09-\\x0D]+"


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return turns.select("conv_id", "turn", F.substring(F.unhex(whole), 1, 16).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _segments(digests: DataFrame) -> DataFrame:
    """(conv_id, j, a, b, seq, names): turns j * SEGMENT and on, the name of the prefix before them and of each of theirs."""
    place = F.col("pos")
    items = ranked(digests.select("conv_id", "turn", "digest", "words"), ["conv_id"], ["turn", "digest"]).select(
        "conv_id", F.shiftright(place, SEGMENT_BITS).alias("j"),
        F.struct(place.alias("pos"), F.xxhash64(place, "digest").alias("a"), F.xxhash64(F.lit("second"), place, "digest").alias("b"), "words").alias("t"))
    segs = items.groupBy("conv_id", "j").agg(F.sort_array(F.collect_list("t")).alias("seq"), F.bit_xor("t.a").alias("xa"), F.bit_xor("t.b").alias("xb"))
    # what comes before a segment: the segments before it in its block of SEGMENT segments, and the blocks before that
    segs = segs.withColumn("block", F.shiftright("j", SEGMENT_BITS))
    before = lambda w, c: F.coalesce(F.bit_xor(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    by_block = Window.partitionBy("conv_id", "block").orderBy("j")
    blocks = segs.groupBy("conv_id", "block").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"))
    by_conv = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), before(by_conv, "xa").alias("ba"), before(by_conv, "xb").alias("bb"))
    segs = segs.withColumns({"a": before(by_block, "xa"), "b": before(by_block, "xb")})
    segs = segs.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")))
    segs = segs.select("conv_id", "j", F.col("a").bitwiseXOR(F.col("ba")).alias("a"), F.col("b").bitwiseXOR(F.col("bb")).alias("b"), "seq")
    start = F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)").alias("all"))
    step = lambda s, t: (s["a"].bitwiseXOR(t["a"]), s["b"].bitwiseXOR(t["b"]))
    names = F.aggregate("seq", start, lambda s, t: F.struct(
        step(s, t)[0].alias("a"), step(s, t)[1].alias("b"),
        F.concat(s["all"], F.array(F.struct(step(s, t)[0].alias("a"), step(s, t)[1].alias("b")))).alias("all")))["all"]
    return settle(segs.withColumn("names", names).withColumn("seq", F.transform("seq", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["words"].alias("words")))))


def _edges(segs: DataFrame, longest: int) -> DataFrame:
    """(d, a, b, pa, pb, n, first, words): every node but the root, by halving all sequences together."""
    cur = segs.select((F.col("j") * SEGMENT).alias("d"), "a", "b", "seq", F.lit(1).cast("long").alias("n"), F.col("conv_id").alias("first"))
    fold = lambda root, part, c: F.aggregate(part, root, lambda x, t: x.bitwiseXOR(t[c]))
    once = lambda rows: rows.groupBy("d", "a", "b", "seq").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    cur, half = once(cur), SEGMENT // 2
    while half >= longest:
        half //= 2
    while half >= 1:
        cut = F.slice("seq", F.lit(1), F.lit(half))
        upper = F.struct("d", "a", "b", cut.alias("seq"))
        lower = F.when(F.size("seq") > half, F.struct((F.col("d") + half).alias("d"), fold(F.col("a"), cut, "a").alias("a"), fold(F.col("b"), cut, "b").alias("b"),
                                                      F.slice("seq", F.lit(half + 1), F.lit(half)).alias("seq")))
        cur = once(cur.select(F.explode(F.array_compact(F.array(upper, lower))).alias("s"), "n", "first").select("s.*", "n", "first"))
        half //= 2
    turn = F.get("seq", 0)
    return cur.select((F.col("d") + 1).alias("d"), F.col("a").bitwiseXOR(turn["a"]).alias("a"), F.col("b").bitwiseXOR(turn["b"]).alias("b"),
                      F.col("a").alias("pa"), F.col("b").alias("pb"), "n", "first", turn["words"].alias("words"))


def _graft(segs: DataFrame, own: DataFrame, longest: int) -> DataFrame:
    """(d, a, b, pa, pb, first, leaves, saved): rows to be summed by node into the totals of its whole subtree."""
    total, half = own, 1
    while half < longest:
        # prefixes cut at an odd multiple of half: all that stands below them within the next half
        cut = total.where((F.col("d") - 1) % (2 * half) == half).groupBy((F.col("d") - 1).alias("hi"), "pa", "pb").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("first").alias("rep"))
        lo, at = F.col("hi") - half, F.shiftright
        ways = cut.select("hi", lo.alias("lo"), "leaves", "saved", "rep", F.explode(F.sequence(at(lo, SEGMENT_BITS), at(F.col("hi") - 1, SEGMENT_BITS))).alias("s"))
        way = ways.join(segs, F.col("rep").eqNullSafe(F.col("conv_id")) & (F.col("s") == F.col("j")))
        prev = lambda i, c: F.when(i == 0, F.col(c)).otherwise(F.get("names", i - 1)[c])
        nodes = F.transform("names", lambda x, i: F.struct((F.col("j") * SEGMENT + i + 1).alias("d"), x["a"].alias("a"), x["b"].alias("b"),
                                                          prev(i, "a").alias("pa"), prev(i, "b").alias("pb")))
        rows = way.select(F.explode(F.filter(nodes, lambda x: (x["d"] > F.col("lo")) & (x["d"] <= F.col("hi")))).alias("x"), "leaves", "saved").select("x.*", "leaves", "saved")
        more = rows.groupBy("d", "a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.lit(None).cast(own.schema["first"].dataType).alias("first"),
                                               F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        total, half = total.unionByName(settle(more)), 2 * half
    return total


def _with_parents(tree: DataFrame, n_nodes: int) -> DataFrame:
    """``tree`` with the parent's smallest member; a parent with very many children is broadcast, not shuffled to."""
    parents = tree.select(F.col("d").alias("qd"), F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("first").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") > max(1, n_nodes // HOT)
    same = (F.col("d") - 1 == F.col("qd")) & (F.col("pa") == F.col("qa")) & (F.col("pb") == F.col("qb"))
    kids, heavy = tree.where("d > 0"), F.broadcast(parents.where(hot).drop("n_children"))
    found = kids.join(heavy, same).unionByName(kids.join(heavy, same, "left_anti").join(parents.where(~hot).drop("n_children"), same))
    root = tree.where("d = 0").withColumn("parent_conv_id", F.lit(None).cast(tree.schema["first"].dataType))
    return found.drop("qd", "qa", "qb").unionByName(root)


@dataclass
class Trie:
    """``nodes`` (d, a, b: depth and name; conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) and
    ``ends`` (d, a, b, chunk, conv_ids): the conversations that end at a node, ascending, by ranges of ids."""

    nodes: DataFrame
    ends: DataFrame


def trie(digests: DataFrame, conversations: DataFrame | None = None) -> Trie:
    """The trie of rows (conv_id, turn, digest, words); ``conversations`` (conv_id) adds those without turns."""
    segs = _segments(digests)
    last = F.get("names", F.size("names") - 1)
    # the name of a whole conversation is that of its last segment's last turn
    ends = segs.groupBy("conv_id").agg(F.max(F.struct((F.col("j") * SEGMENT + F.size("names")).alias("d"), last["a"].alias("a"), last["b"].alias("b"))).alias("e"))
    if conversations is not None:
        none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("d", "a", "b")])
        ends = ends.unionByName(conversations.select("conv_id").distinct().select("conv_id", none.alias("e"))).groupBy("conv_id").agg(F.max("e").alias("e"))
    ends = settle(ends.select("conv_id", "e.*"))
    n_convs, first, longest = ends.agg(F.count("*"), F.min("conv_id"), F.max("d")).first()
    nodes = settle(_edges(segs, longest or 1))
    id_type = nodes.schema["first"].dataType
    root = nodes.sparkSession.range(1 if n_convs else 0).select(*[F.lit(0).cast("long").alias(c) for c in ("d", "a", "b", "pa", "pb")], F.lit(n_convs).cast("long").alias("n"),
                                                                F.lit(first).cast(id_type).alias("first"), F.lit(0).cast("long").alias("words"))
    kids = nodes.groupBy((F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    tree = settle(nodes.unionByName(root).join(kids, ["d", "a", "b"], "left").fillna(0, ["n_children"]))
    own = tree.select("d", "a", "b", "pa", "pb", "first", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
                      ((F.col("n") - 1) * F.col("words")).alias("saved"))
    total = _graft(segs, own.where("d > 0"), longest or 0)
    # every depth-1 node's total goes to the root, beside its own row
    whole = total.select("d", "a", "b", "leaves", "saved").unionByName(own.where("d = 0").select("d", "a", "b", "leaves", "saved")).unionByName(
        total.where("d = 1").select(*[F.lit(0).cast("long").alias(c) for c in ("d", "a", "b")], "leaves", "saved"))
    totals = whole.groupBy("d", "a", "b").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    n_nodes = tree.count()
    out = _with_parents(tree, n_nodes).join(totals, ["d", "a", "b"]).select(
        "d", "a", "b", F.col("first").alias("conv_id"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    # a list of structs keeps the null id
    listed = ends.groupBy("d", "a", "b", F.shiftright("conv_id", RANGE_BITS).alias("chunk")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("conv_id"))), lambda x: x["conv_id"]).alias("conv_ids"))
    return Trie(out, listed)


def prefix_trie(turns: DataFrame) -> Trie:
    """The trie of conversations given as rows (conv_id, turn, role, text)."""
    return trie(turn_digests(turns))


def _heads(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % 4, F.lit(0))


def rebuilt(digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digests, conversations) with the first 0 to 3 turns of each conversation taken from the first of its twenty."""
    placed = ranked(digests, ["conv_id"], ["turn", "digest"])
    ids = placed.where("pos = 0").select("conv_id")
    wants = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), _heads(F.col("conv_id")).alias("h"))
    turn = lambda part: F.struct(F.lit(part).alias("part"), "pos").alias("turn")
    heads = placed.where("pos < 3").select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    given = wants.join(heads, "base").where("pos < h").select("conv_id", turn(0), "digest", "words")
    own = placed.where(F.col("pos") >= _heads(F.col("conv_id"))).select("conv_id", turn(1), "digest", "words")
    return given.unionByName(own), ids


def op11(spark, sf_dir: str) -> DataFrame:
    out = trie(*rebuilt(turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    ids = F.array_join(F.transform("conv_ids", lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")
    lists = out.ends.select("d", "a", "b", F.struct("chunk", ids.alias("ids")).alias("part")).groupBy("d", "a", "b").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    text = F.coalesce(F.array_join(F.transform("parts", lambda p: p["ids"]), ","), F.lit(""))
    return out.nodes.join(lists, ["d", "a", "b"], "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.sha2(text, 256).alias("ends_sha256"))


SQL = f"""
WITH RECURSIVE crc_of AS (SELECT DISTINCT conv_id AS x FROM conversations WHERE conv_id IS NOT NULL), {SQL_CRC},
t AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
             len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS w FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM t),
c AS (SELECT x AS conv_id, x - x % 20 AS base, crc % 4 AS h FROM crc),
r AS (SELECT c.conv_id, 0 AS part, pos, k, w FROM c JOIN p ON p.conv_id = c.base AND pos < h
      UNION ALL SELECT c.conv_id, 1, pos, k, w FROM c JOIN p ON p.conv_id = c.conv_id AND pos >= h),
s AS (SELECT conv_id, w, row_number() OVER o AS d, string_agg(k, '') OVER o AS name FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY part, pos)),
n AS (SELECT d, name, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w FROM s GROUP BY d, name
      UNION ALL SELECT 0, '', min(conv_id), count(*), 0 FROM c HAVING count(*) > 0),
kids AS (SELECT substr(name, 1, length(name) - 64) AS name, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(kids.n, 0) AS n_children, (n.n - 1) * n.w AS saved FROM n LEFT JOIN kids USING (name)),
up AS (SELECT substr(name, 1, 64 * unnest(range(0, d + 1))) AS name, n_children, saved FROM own),
tot AS (SELECT name, count(*) FILTER (WHERE n_children = 0) AS leaves, sum(saved) AS saved FROM up GROUP BY name),
last AS (SELECT c.conv_id, coalesce(max_by(s.name, s.d), '') AS name FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id),
ends AS (SELECT name, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last GROUP BY name)
SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, par.conv_id AS parent_conv_id, own.n AS n_convs, CAST(own.n_children AS BIGINT) AS n_children,
       CAST(tot.leaves AS BIGINT) AS n_leaves, CAST(tot.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM own JOIN tot USING (name) LEFT JOIN n par ON own.d > 0 AND par.name = substr(own.name, 1, length(own.name) - 64) LEFT JOIN ends ON ends.name = own.name
"""
