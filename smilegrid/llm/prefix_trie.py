"""Prefix trie of conversations, summed over subtrees by an Euler tour.

A node is a distinct sequence of first turns. Prefixes are identified by 128 bits
that a running exclusive-or builds from the hashes of (turn, place), so a long
conversation is hashed in blocks. Two different prefixes agree by chance about once in 2^128.

Every node has an enter and an exit arc. Arcs point to the arc that follows in the
tour: into the first child, from child to next child, from the last child back out.
The list of arcs is ranked by contraction: in every round a coin per arc lets about a quarter of
the arcs be absorbed by the arc before, until few enough are left for one task; then
the absorbed ones get their places back, round by round. Work is linear in the arcs, and
prefix sums of leaves and savings come with the places. What lies between a node's
arcs is its subtree.

Nothing is gathered by conversation, node or parent: turns are numbered in ranges, siblings follow
each other in the order of node numbers, and the ids that end in a node are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, load, numbered

#: Turns of a conversation that are hashed in one window; ids in one piece of a node's list.
BLOCK, PIECE = 4096, 256
#: A list of at most so many arcs is walked in one task.
LAST = 1 << 16
KEY = ["depth", "k1", "k2"]
NO_IDS = hashlib.sha256(b"").hexdigest()


def ranked_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, i, l1, l2, bytes): each turn's number in its conversation, from 1, the hashes of role and text and the text's UTF-8 bytes.

    Turns are ordered by turn (null first), then role, then text. A null role or text is
    empty. Rows with a null id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    lane = lambda k: F.xxhash64(F.lit(k), F.length("role"), "role", "text")
    place = F.monotonically_increasing_id()
    rows = cut(
        rows.select(
            "conv_id", lane(1).alias("l1"), lane(2).alias("l2"), F.octet_length("text").cast("long").alias("bytes"), F.shiftright(place, 33).alias("part"), place.alias("place")
        ),
        "turns",
    )
    # A conversation may span ranges: how many of its turns lie in earlier ones.
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    number = F.col("place") - F.col("first") + F.col("before") + 1
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", number.alias("i"), "l1", "l2", "bytes")


def rebuilt(ranked: DataFrame, base_of: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: (conv_id, d, l1, l2, bytes) and (conv_id, turns).

    `base_of` and `heads` are functions of conv_id: whose first turns, and how many
    (at most `most`, a constant) are taken; then come the own turns after as many.
    """
    sizes = cut(ranked.groupBy("conv_id").agg(F.max("i").alias("n")).withColumns({"base": base_of, "h": heads.cast("long")}), "sizes")
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plans = sizes.join(of_base, "base", "left").select("conv_id", "base", "h", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("m"))
    plans = cut(plans, "plans")
    own = ranked.join(plans.select("conv_id", "h", "m"), "conv_id").where(F.col("i") > F.col("h"))
    own = own.select("conv_id", (F.col("m") + F.col("i") - F.col("h")).alias("d"), "l1", "l2", "bytes")
    first = ranked.where(F.col("i") <= most).withColumnRenamed("conv_id", "base")
    taken = plans.select("conv_id", "base", "h").join(first, "base").where(F.col("i") <= F.col("h"))
    taken = taken.select("conv_id", F.col("i").alias("d"), "l1", "l2", "bytes")
    return own.unionByName(taken), plans.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, d, l1, l2, bytes) with the hashes of the first d turns (k1, k2) and of one fewer (p1, p2)."""
    rows = turns.select("conv_id", "d", "bytes", F.xxhash64("l1", "d").alias("t1"), F.xxhash64("l2", "d", F.lit(2)).alias("t2"), F.floor(F.col("d") / BLOCK).alias("block"))
    rows = cut(rows, "places")
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *[F.bit_xor(b).over(earlier).alias(b) for b in ("b1", "b2")]).where("block > 0")
    within = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.bit_xor(f"t{i}").over(within).alias(f"k{i}") for i in (1, 2)]).join(carried, ["conv_id", "block"], "left")
    rows = rows.withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)})
    return rows.select("conv_id", F.col("d").alias("depth"), "bytes", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i in (1, 2)])


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id, parent, n_convs, bytes): the distinct prefixes, the root (depth 0) included."""
    found = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    found = cut(found, "nodes")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.sparkSession.range(1).select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(top["conv_id"]).cast("long").alias("conv_id"), none.alias("parent"), F.lit(top["n_convs"]).alias("n_convs"), zero.alias("bytes")
    ).where("n_convs > 0")
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    deep = found.where("depth > 1").join(above, ["depth", "p1", "p2"])
    flat = found.where("depth = 1").withColumn("parent", F.lit(top["conv_id"]).cast("long"))
    return root.unionByName(deep.select(*root.columns)).unionByName(flat.select(*root.columns))


def list_ranks(arcs: DataFrame, weights: list[str]) -> DataFrame:
    """(id, *weights): for every element of a linked list (id, next, *weights), the sums of the weights of all before it.

    `next` is null for the last. Each round stores what is left and what was absorbed.
    """
    live, rounds = arcs, []
    off = {w: f"{w}_off" for w in weights}
    while live.count() > LAST:
        coin = lambda c, r=len(rounds): F.xxhash64(F.col(c), F.lit(r)).bitwiseAND(1) == 1
        takes = F.col("next").isNotNull() & coin("id") & ~coin("next")
        before = live.where(takes).select(F.col("id").alias("into"), F.col("next").alias("id"), *[F.col(w).alias(o) for w, o in off.items()])
        met = live.where(~coin("id")).join(before, "id", "left")
        left = met.select(
            F.coalesce("into", "id").alias("id"), "next", *[(F.col(w) + F.coalesce(o, F.lit(0))).alias(w) for w, o in off.items()], F.when(F.col("into").isNotNull(), F.col("id")).alias("absorbed"), *off.values()
        )
        rest = live.where(coin("id") & ~takes).select("id", "next", *weights, F.lit(None).cast("long").alias("absorbed"), *[F.lit(None).cast("long").alias(o) for o in off.values()])
        stored = cut(left.unionByName(rest), "contracted")
        rounds.append(stored.where("absorbed is not null").select("absorbed", "id", *off.values()))
        live = stored.select("id", "next", *weights)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        at = {row["id"]: row for row in rows}
        head = at.keys() - {row["next"] for row in rows}
        here, sums, out = (head.pop() if head else None), dict.fromkeys(weights, 0), []
        while here is not None:
            row = at[here]
            out.append({"id": here, **sums})
            sums = {w: sums[w] + row[w] for w in weights}
            here = row["next"]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.int64()), *[(w, pa.int64()) for w in weights]]))

    found = cut(live.coalesce(1).mapInArrow(walk, "id long, " + ", ".join(f"{w} long" for w in weights)), "ranks")
    for absorbed in reversed(rounds):
        back = absorbed.join(found, "id").select(F.col("absorbed").alias("id"), *[(F.col(w) + F.col(o)).alias(w) for w, o in off.items()])
        found = cut(found.unionByName(back), "ranks")
    return found


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered nodes with (node, n_children), and the arcs (id, next, one, leaves, saved) of their Euler tour.

    Numbers follow (parent, depth, conv_id), so a node's children are consecutive: the one after a
    child that is not the last is its next sibling. The enter arc of node v is 2v, its exit arc 2v + 1.
    """
    table = cut(numbered(nodes, "node", [F.col("parent").asc_nulls_first(), F.col("depth"), F.col("conv_id")]), "numbered")
    children = table.where("depth > 0").groupBy("parent", "depth").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "first", "last", "n_children")
    table = cut(table.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    enter = table.select(
        (F.col("node") * 2).alias("id"),
        F.coalesce(F.col("first") * 2, F.col("node") * 2 + 1).alias("next"),
        one.alias("one"),
        F.when(F.col("first").isNull(), one).otherwise(none).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    lasts = table.where("last is not null").select(F.col("last").alias("node"), F.col("node").alias("up"))
    after = F.when(F.col("depth") > 0, F.coalesce(F.col("up") * 2 + 1, F.col("node") * 2 + 2))
    leave = table.select("node", "depth").join(lasts, "node", "left").select((F.col("node") * 2 + 1).alias("id"), after.alias("next"), one.alias("one"), none.alias("leaves"), none.alias("saved"))
    return table.drop("first", "last"), cut(enter.unionByName(leave), "arcs")


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of rows (depth, k1, k2, conv_id): the ids of a node, ascending and comma-joined, hashed.

    Ids are sorted in ranges and joined in pieces; the pieces of a node meet in one task as a stream.
    """
    sorted_ = numbered(ends, "index", [F.col(c) for c in (*KEY, "conv_id")])
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = sorted_.groupBy(*KEY, F.floor(F.col("index") / PIECE).alias("piece")).agg(text.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(k, pa.int64()) for k in KEY], ("ends_sha256", pa.string())])
        last, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in out], schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*last, state.hexdigest())))], schema)

    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    return dealt.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of all conversations, from `turns` (conv_id, d, l1, l2, bytes) with d counting
    from 1 without gaps and `convs` (conv_id, turns).

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (the subtree's bytes that need not be read again for each further member), ends_sha256
    and enter_at, exit_at: the places of the node's arcs in the tour. No conversations give no rows.
    """
    rows = cut(prefixes(turns), "prefixes")
    nodes, arcs = tour(nodes_of(rows, convs))
    ranks = list_ranks(arcs, ["one", "leaves", "saved"])
    leaving = F.col("id") % 2 == 1
    between = lambda w: F.sum(F.when(leaving, F.col(w)).otherwise(-F.col(w)))
    subtree = ranks.groupBy(F.floor(F.col("id") / 2).alias("node")).agg(
        between("leaves").alias("n_leaves"), between("saved").alias("saved_tokens"), F.min("one").alias("enter_at"), F.max("one").alias("exit_at")
    )
    whole = rows.join(convs.select("conv_id", F.col("turns").alias("depth")), ["conv_id", "depth"], "left_semi").select(*KEY, "conv_id")
    turnless = convs.where("turns = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id")
    out = nodes.join(subtree, "node").join(id_digests(whole.unionByName(turnless)), KEY, "left")
    return out.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"), "enter_at", "exit_at"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = cut(ranked_turns(load(spark, sf_dir, "conversations")), "ranked")
    heads = F.crc32(F.col("conv_id").cast("string")) % 9
    turns, convs = rebuilt(ranked, F.col("conv_id") - F.col("conv_id") % 5, heads, 8)
    return trie(turns, convs).drop("enter_at", "exit_at")


OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT conv_id, max(i) AS n, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
           lambda s: list_prepend(CAST(ord(s) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 9 AS h
  FROM own GROUP BY conv_id),
plans AS (SELECT s.conv_id, s.base, s.h, s.n, least(s.h, coalesce(b.n, 0)) AS m FROM sizes s LEFT JOIN sizes b ON s.base = b.conv_id),
turns AS (
  SELECT p.conv_id, o.i AS d, o.role, o.text FROM plans p JOIN own o ON o.conv_id = p.base AND o.i <= p.h
  UNION ALL SELECT p.conv_id, p.m + o.i - p.h, o.role, o.text FROM plans p JOIN own o ON o.conv_id = p.conv_id AND o.i > p.h),
rows AS (
  SELECT conv_id, d, octet_length(encode(text)) AS bytes,
         sha256(string_agg(sha256(role) || sha256(text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM plans),
ends AS (SELECT conv_id, max(d) AS d FROM rows GROUP BY conv_id),
marked AS (SELECT r.*, min(r.conv_id) OVER (PARTITION BY r.d, r.k) AS node, e.d IS NOT NULL AS ending FROM rows r LEFT JOIN ends e ON r.conv_id = e.conv_id AND r.d = e.d),
nodes AS (
  SELECT node AS conv_id, d, count(*) AS n, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ending), '')) AS ends_sha256
  FROM marked GROUP BY node, d),
linked AS (
  SELECT n.*, p.node AS parent, (n.n - 1) * n.bytes AS saved FROM nodes n LEFT JOIN marked p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
counted AS (SELECT l.*, coalesce(c.k, 0) AS n_children FROM linked l
            LEFT JOIN (SELECT parent, d, count(*) AS k FROM linked WHERE d > 0 GROUP BY ALL) c ON c.parent = l.conv_id AND c.d = l.d + 1),
below AS (
  SELECT a.node, a.d, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(c.saved) AS saved
  FROM counted c JOIN marked a ON a.conv_id = c.conv_id AND a.d <= c.d GROUP BY a.node, a.d)
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, c.parent AS parent_conv_id, CAST(c.n AS BIGINT) AS n_convs, CAST(c.n_children AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.node = c.conv_id AND b.d = c.d
"""
