"""Merkle manifest of a dataset: built levels as parent-linked node rows, climbed by a recursive query.

H is SHA-256 in lowercase hex; inputs are concatenated, digests as hex text. A row's fields make its leaf. The leaves
of each group, in the order of their id, form a binary tree: while more than one node remains, every two consecutive
ones become their H, a last lone one its own. The groups' roots, in the order of the groups, form the top tree.

``manifest`` builds the levels and stores them. Levels are built by pages of ``PAGE`` children, ``HEIGHT`` levels at
once; a node row links a page's child to the page's top (its parent in the next stored level) and holds the siblings on
the way, in a group's last page those through the top tree as well. ``climb`` is a Spark recursive query that starts with one row per leaf, folds the digest presented now with
the siblings of each node row and appends them, until no parent is left. ``check`` compares the result with the root.

Defined cases: a null field is ``-``, every other its length in UTF-8 bytes, a colon and its value, so null, empty and
neighbouring texts differ; any type whose text is its value will do. Null groups and null ids sort first. Rows that
share an id are ordered by their leaf, equal rows take neighbouring places; each has its own proof. A lone leaf is its
group's root, a lone group's root the whole root, and their proofs are empty. An empty table gives no rows. Further
columns are ignored, whatever their names. Whole texts are hashed.

Scale: texts are read once and only digests move. Places come from range partitions (``positions.ranked``), pages hold
at most ``PAGE`` rows, and a node row that stands above more than ``BLOCK`` leaves is stored once per block of them, so
no key of the climb's joins is shared by more than ``BLOCK`` rows however large a group is. A corpus of n leaves takes
log(n) / log(PAGE) rounds. Groups are meant to be far fewer than leaves, but any number works.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.positions import ranked
from ledgerlens.llm.sparkops import settle

HEIGHT = 9
PAGE = 1 << HEIGHT
#: leaves that share a key of the climb
BLOCK_BITS = HEIGHT
BLOCK = 1 << BLOCK_BITS
#: the level of the step from a one-page group's root through the top tree
TOP = 1000


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The 32 bytes of H of the encoded values."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def _hash(digests: Column) -> Column:
    """H of concatenated 32-byte digests, as 32 bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def _pages(children: DataFrame) -> DataFrame:
    """(tree, n0, n, page, kids, levels) from (tree, n0, n, idx, digest, own): the pages of one stored level.

    ``levels`` holds the digests of every level inside the page, the kids' first; n is the tree's nodes in this level.
    """
    kid = F.struct((F.col("idx").bitwiseAND(F.lit(PAGE - 1))).alias("place"), "digest", "own")
    pages = children.groupBy("tree", "n0", "n", F.shiftright("idx", HEIGHT).alias("page")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    # a tree's last page ends at its root, every other page is folded HEIGHT times, lone nodes too
    height = F.when(F.col("n") > PAGE, F.lit(HEIGHT)).otherwise(F.ceil(F.log2(F.col("n"))).cast("int"))
    rounds = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.expr("cast(array() as array<int>)"))
    pair = lambda below, i: _hash(F.concat(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.expr("X''"))))
    above = lambda below: F.transform(F.sequence(F.lit(0), F.ceil(F.size(below) / 2).cast("int") - 1), lambda i: pair(below, i))
    levels = F.aggregate(rounds, F.array(F.transform("kids", lambda k: k["digest"])), lambda got, _: F.concat(got, F.array(above(F.element_at(got, -1)))))
    return settle(pages.withColumn("levels", levels))


def _climbers(pages: DataFrame) -> DataFrame:
    """(tree, n0, n, idx, digest, own, path): each child with the siblings on its way to the page's top; null: none."""
    kids = pages.select("tree", "n0", "n", "page", "levels", F.explode("kids").alias("kid"))
    place = F.col("kid.place")
    sibling = lambda level, l: F.get(level, F.call_function("shiftright", place, l.cast("int")).bitwiseXOR(F.lit(1)).cast("int"))
    path = F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), sibling)
    return kids.select("tree", "n0", "n", (F.shiftleft("page", HEIGHT) + place).alias("idx"), "kid.digest", "kid.own", path.alias("path"))


def _tops(pages: DataFrame) -> DataFrame:
    return pages.withColumn("digest", F.get(F.element_at("levels", -1), 0))


def _build(leaves: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(start, nodes, roots) of a forest from leaves (tree, pos, size, digest, own).

    start: the leaves with the siblings of their own page; nodes: the rows above; roots: (tree, n0, digest).
    """
    level = leaves.select("tree", F.col("size").alias("n0"), F.col("size").alias("n"), F.col("pos").alias("idx"), "digest", "own")
    largest = leaves.agg(F.max("size")).first()[0] or 0
    pages = _pages(level)
    start, nodes, roots, k = _climbers(pages), None, _tops(pages).where(f"n <= {PAGE}"), 0
    while largest > PAGE:
        largest, k = -(-largest // PAGE), k + 1
        level = _tops(pages).where(f"n > {PAGE}").select(
            "tree", "n0", F.ceil(F.col("n") / PAGE).alias("n"), F.col("page").alias("idx"), "digest", F.lit(None).cast("int").alias("own"))
        pages = _pages(level)
        span = HEIGHT * k - BLOCK_BITS     # a node stands above 2 to the span blocks of leaves
        last = F.shiftright(F.col("n0") - 1, BLOCK_BITS)
        blocks = F.sequence(F.shiftleft("idx", span), F.least(last, F.shiftleft(F.col("idx") + 1, span) - 1))
        rows = _climbers(pages).select(F.lit(k).alias("k"), "tree", "idx", F.explode(blocks).alias("block"), F.col("idx").alias("right"), "path",
                                       F.when(F.col("n") > PAGE, F.lit(k + 1)).alias("up"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
        roots = roots.select("tree", "n0", "digest").unionByName(_tops(pages).where(f"n <= {PAGE}").select("tree", "n0", "digest"))
    return start, nodes, roots.select("tree", "n0", "digest")


def _joined(path: Column) -> Column:
    """The siblings of a path as one binary."""
    return F.aggregate(F.filter(path, lambda x: x.isNotNull()), F.expr("X''"), lambda a, x: F.concat(a, x))


def _fold(digest: Column, path: Column, right: Column) -> Column:
    steps = F.transform(path, lambda s, l: F.struct(s.alias("s"), F.call_function("shiftright", right, l.cast("int")).bitwiseAND(F.lit(1)).alias("right")))
    return F.aggregate(steps, digest, lambda h, x: _hash(F.when(x["s"].isNull(), h).when(x["right"] == 1, F.concat(x["s"], h)).otherwise(F.concat(h, x["s"]))))


#: the climb; shiftright finds the node above a leaf, the block keeps every join key small. A set bit l of ``right`` says
#: that the climber is the right one of its pair in the path's level l; ``add`` is what the node appends to the way.
_CLIMB = f"""
WITH RECURSIVE climb (own, tree, pos, k, folded, way) AS (
  SELECT own, tree, pos, k, folded, way FROM {{start}}
  UNION ALL
  SELECT c.own, c.tree, c.pos, n.up,
         aggregate(transform(n.path, (s, l) -> struct(s, shiftright(n.right, l) & 1L AS r)), c.folded, (h, x) -> unhex(sha2(lower(hex(
           CASE WHEN x.s IS NULL THEN h WHEN x.r = 1L THEN concat(x.s, h) ELSE concat(h, x.s) END)), 256))),
         concat(c.way, n.add)
  FROM climb c JOIN {{nodes}} n
  ON n.k = c.k AND n.tree = c.tree AND n.block = shiftright(c.pos, {BLOCK_BITS})
     AND n.idx = CASE WHEN c.k = {TOP} THEN 0L ELSE shiftright(c.pos, {HEIGHT} * c.k) END
)
SELECT own, tree, pos, folded, way FROM climb WHERE k IS NULL LIMIT ALL
"""


def climb(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """(own, tree, pos, folded, way): every start row (own, tree, pos, k, folded, way) at the top of its way."""
    return start.sparkSession.sql(_CLIMB, start=start, nodes=nodes)


def _forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(start, nodes, roots) with the start rows of ``climb``, their own page's siblings folded in."""
    start, nodes, roots = _build(leaves)
    at = F.when(F.col("n") > PAGE, F.lit(1)).otherwise(F.lit(TOP))
    return start.select("own", "tree", F.col("idx").alias("pos"), at.alias("k"), "digest", "n0", "path"), nodes, roots


@dataclass
class Manifest:
    """``leaves`` (id, tree, pos, leaf, path ...), ``nodes`` (stored levels), ``roots`` (group, n_leaves, subroot) and ``root``."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    root: str | None


def _one_tree(rows: DataFrame) -> tuple[DataFrame, str | None]:
    """(rows with place and path through the top tree, root) for the groups' roots (tree, n0, digest)."""
    one = ranked(rows, [], ["tree"]).select(F.lit("").alias("tree"), "pos", "size", "digest", F.struct("tree", "n0", "digest").alias("own"))
    start, nodes, roots = _forest(one)
    top = roots.select(F.lower(F.hex("digest"))).first()
    ways = start.select("own", "tree", "pos", "k", F.col("digest").alias("folded"), F.col("path").alias("way"))
    if nodes is not None:     # with more than a page of groups, their own page does not lead to the root yet
        ways = climb(ways, settle(nodes.withColumn("add", F.col("path"))))
    return ways.select("own.tree", "own.n0", "own.digest", "pos", F.col("way").alias("path")), top[0] if top else None


def manifest(docs: DataFrame, fields: Sequence[str], id_col: str, group_col: str, presented: dict[str, Column] | None = None) -> Manifest:
    """Build and store the manifest of ``docs``.

    ``presented`` gives fields as they are presented for checking now, as columns over ``docs``; their leaf is
    computed in the same reading of the texts and kept beside the true one.
    """
    shown = presented or {}
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*fields, id_col, group_col])]).alias("r"),
                      *[shown[c].alias(f"_s{i}") if c in shown else F.lit(0).alias(f"_s{i}") for i, c in enumerate(fields)])
    leaf = leaf_digest([F.col(f"r.`{c}`") for c in fields])
    same = F.lit(True)
    for i, c in enumerate(fields):
        if c in shown:
            same = same & F.col(f"_s{i}").eqNullSafe(F.col(f"r.`{c}`"))
    now = leaf_digest([F.col(f"_s{i}") if c in shown else F.col(f"r.`{c}`") for i, c in enumerate(fields)])
    group = F.col(f"r.`{group_col}`").cast("string")
    rows = own.select(F.col(f"r.`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"), leaf.alias("leaf"),
                      F.when(~same, now).alias("now"))
    placed = ranked(rows, ["tree"], ["id", "leaf"])
    start, nodes, roots = _forest(placed.select("tree", "pos", "size", F.col("leaf").alias("digest"), F.struct("id", "now").alias("own")))
    ways, root = _one_tree(roots)
    # the top tree's path follows a group's last page; one-page groups climb it in a step of its own
    stored = ways.where(f"n0 <= {PAGE}").select(
        F.lit(TOP).alias("k"), "tree", F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("block"), F.col("pos").alias("right"), "path",
        F.lit(None).cast("int").alias("up"))
    if nodes is not None:
        above = ways.select(F.col("tree").alias("t"), F.col("pos").alias("rank"), F.col("path").alias("top"))
        at_end = F.col("up").isNull()
        whole = nodes.join(above, F.col("tree") == F.col("t")).select(
            "k", "tree", "idx", "block",
            F.when(at_end, F.col("right").bitwiseOR(F.call_function("shiftleft", F.col("rank"), F.size("path")))).otherwise(F.col("right")).alias("right"),
            F.when(at_end, F.concat("path", "top")).otherwise(F.col("path")).alias("path"), "up")
        stored = stored.unionByName(whole)
    stored = settle(stored.withColumn("add", _joined(F.col("path"))))
    groups = ways.select("tree", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("group"), F.col("n0").alias("n_leaves"),
                         F.lower(F.hex("digest")).alias("subroot"))
    return Manifest(start, stored, settle(groups), root)


def check(m: Manifest) -> DataFrame:
    """(id, group, leaf, subroot, root, proof, folded_root, verified): each leaf as presented now against the root.

    ``proof`` is the siblings' hex digests, 64 characters each, from the leaf's level to the root's; a node alone has none.
    """
    start = m.leaves.select(F.struct(F.col("own.id").alias("id"), F.col("digest").alias("leaf")).alias("own"), "tree", "pos", "k",
                            _fold(F.coalesce("own.now", "digest"), F.col("path"), F.col("pos")).alias("folded"), _joined(F.col("path")).alias("way"))
    hexed = lambda c: F.lower(F.hex(c))
    top = climb(start, m.nodes).join(m.roots.select(F.col("tree").alias("t"), "group", "subroot"), F.col("tree") == F.col("t"))
    return top.select("own.id", "group", hexed(F.col("own.leaf")).alias("leaf"), "subroot", F.lit(m.root).alias("root"),
                      hexed("way").alias("proof"), hexed(F.col("folded")).alias("folded_root")
                      ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    m = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang",
                 presented={"n_chars": F.col("n_chars") + F.when(struck, F.lit(1)).otherwise(F.lit(0))})
    return check(m).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                           "folded_root", "verified")


def _sql_encoded(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_encoded(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: CRC-32 as DuckDB SQL: its table of 256 entries by rule, folded over the bytes of a decimal number
SQL_CRC = """
crc_steps AS (SELECT CAST(range AS BIGINT) AS i, 0 AS s, CAST(range AS BIGINT) AS v FROM range(256)
              UNION ALL SELECT i, s + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE s < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE s = 8),
crc AS (SELECT x, xor(list_reduce([CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(x AS VARCHAR), '')],
                                  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
        FROM crc_of, crc_table)"""
SQL = f"""
WITH RECURSIVE crc_of AS (SELECT DISTINCT doc_id AS x FROM documents WHERE doc_id IS NOT NULL), {SQL_CRC},
d AS (SELECT documents.*, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
             coalesce('=' || lang, '') AS tree, {_sql_leaf('n_chars')} AS leaf,
             CASE WHEN crc.crc % 7 = 0 THEN {_sql_leaf('n_chars + 1')} ELSE {_sql_leaf('n_chars')} END AS now
      FROM documents LEFT JOIN crc ON doc_id = x),
low AS (SELECT tree, 0 AS l, pos AS i, n, leaf AS h FROM d
        UNION ALL SELECT tree, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, l, i // 2, n),
sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS l, pos AS i, n, h FROM sub
         UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // 2, n),
heights AS (SELECT tree, max(l) AS top FROM low GROUP BY tree),
nodes AS (SELECT tree, l, i, n, h FROM low WHERE n > 1
          UNION ALL SELECT tree, top + high.l, high.i, high.n, high.h FROM high, heights WHERE high.n > 1),
climb AS (SELECT doc_id, tree, 0 AS l, pos AS i, now AS h, '' AS proof, FALSE AS up FROM d
          UNION ALL
          SELECT c.doc_id, c.tree, c.l + 1, c.i // 2,
                 sha256(CASE WHEN s.h IS NULL THEN c.h WHEN c.i % 2 = 1 THEN s.h || c.h ELSE c.h || s.h END), c.proof || coalesce(s.h, ''), c.up
          FROM (SELECT climb.doc_id, climb.tree, climb.l, CASE WHEN climb.l = heights.top THEN sub.pos ELSE climb.i END AS i, climb.h, climb.proof, climb.up
                FROM climb JOIN heights ON climb.tree = heights.tree JOIN sub ON climb.tree = sub.tree) c
          JOIN (SELECT DISTINCT tree, l FROM nodes) here ON here.tree = c.tree AND here.l = c.l
          LEFT JOIN nodes s ON s.tree = c.tree AND s.l = c.l AND s.i = xor(c.i, 1)),
root AS (SELECT h FROM high WHERE n = 1),
ends AS (SELECT tree, max(l) + 1 AS l FROM nodes GROUP BY tree)
SELECT d.doc_id, d.leaf, sub.h AS subroot, root.h AS root, sha256(climb.proof) AS proof_sha256, climb.h AS folded_root, climb.h = root.h AS verified
FROM climb JOIN d ON climb.doc_id = d.doc_id JOIN sub ON sub.tree = d.tree, root LEFT JOIN ends ON ends.tree = climb.tree WHERE climb.l = coalesce(ends.l, 0)
"""
