"""The trie of conversations: one node per distinct sequence of first turns.

Fixed-length block hashing. Every turn has a digest; the digest of a prefix is the exclusive or of its turns' digests mixed with their
positions (two independent 64-bit values), so running over slices of rows gives the digests of all prefixes, however long a conversation is.
Conversations are grouped by blocks of ``BLOCK`` turns first: equal blocks behind equal prefixes become one row with the number of
conversations, the smallest of them and the turns. Where only one block follows a prefix, its turns are nodes as they are. Only where
siblings diverge, the distinct blocks, not the conversations, are refined to their turns.

Sums over subtrees need no walk: a node is owned by its smallest conversation, so the words and childless nodes of a subtree are what its
members own. A subtree of a third of all conversations is a partial aggregate like any other.

Rows without a conversation id belong to no conversation. A null role or text is empty; a null turn comes first; turns with the same number are
ordered by the md5 of ``<length of role>:<role><text>``, and repeated rows are repeated turns. An empty table has no nodes, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.operators.slices import SLICE, in_slices, join_edges, numbered, per_slice, slices_before
from obsflow.session import checkpointed

BLOCK = 4
#: Lists of ids are put together from chunks for so many consecutive ids (a power of two).
CHUNK_BITS = 8
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "p1", "p2"]


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, digest, words``, sliced: position counts the turns of a conversation from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = [F.col("turn").asc_nulls_first(), "digest"]
    sliced = in_slices(rows, ["conv_id", *order])
    return numbered(sliced, ["conv_id"], order).drop("turn")


def mixed(position: Column) -> list[Column]:
    """Two hashes of a turn at a position."""
    return [F.xxhash64(F.lit(1), position, "digest").alias("x1"), F.xxhash64(F.lit(2), "digest", position).alias("x2")]


def prefixes(turns: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns with the digests and words of the prefix they end, and one row per conversation.

    ``heads`` has ``conv_id, skip, head``: the conversation starts with the turns ``head`` (an array of digest and words) in place of its first ``skip``.
    The first table is ``conv_id, i, p1, p2, x1, x2, words, upto``; the second ``conv_id, n, total, p1, p2``.
    """
    if heads is None:
        ids = turns.groupBy("conv_id").agg(F.lit(0).alias("skip"))
        heads = ids.withColumn("head", F.array().cast("array<struct<digest:binary,words:bigint>>"))
    led = heads.select("conv_id", "skip", F.posexplode("head").alias("_at", "_turn")).select(
        "conv_id", (F.col("_at") + 1).cast("long").alias("i"), "_turn.digest", "_turn.words"
    )
    led = led.select("conv_id", "i", *mixed(F.col("i")), "words")
    # A head has few turns, so its prefixes are sums over an array.
    listed = led.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "x1", "x2", "words"))).alias("_head"))
    run = F.transform("_head", lambda t: F.aggregate(
        F.filter("_head", lambda u: u["i"] <= t["i"]),
        F.struct(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(0).cast("long").alias("upto")),
        lambda s, u: F.struct(s["p1"].bitwiseXOR(u["x1"]).alias("p1"), s["p2"].bitwiseXOR(u["x2"]).alias("p2"), (s["upto"] + u["words"]).alias("upto")),
    ))
    listed = listed.select("conv_id", F.explode(F.arrays_zip("_head", run.alias("_run"))).alias("_z"))
    first = listed.select("conv_id", "_z._head.i", "_z._run.p1", "_z._run.p2", "_z._head.x1", "_z._head.x2", "_z._head.words", "_z._run.upto")
    first = checkpointed(first)
    end = F.max_by(F.struct("p1", "p2"), "i")
    start = first.groupBy("conv_id").agg(F.max("i").alias("_k"), F.max("upto").alias("_w"), end["p1"].alias("_h1"), end["p2"].alias("_h2"))
    start = heads.select("conv_id", "skip").join(start, "conv_id", "left").na.fill(0, ["_k", "_w", "_h1", "_h2"])

    # One row per conversation and slice carries what is in front, in the layout of the windows.
    touched = turns.select(SLICE, "conv_id").distinct().join(start, "conv_id")
    own = join_edges(turns, touched, ["conv_id"]).where(F.col("position") > F.col("skip"))
    own = own.withColumn("i", F.col("position") - F.col("skip") + F.col("_k"))
    own = own.select(SLICE, "conv_id", "i", *mixed(F.col("i")), "words", "_h1", "_h2", "_w")
    edges = own.groupBy(SLICE, "conv_id").agg(F.bit_xor("x1").alias("_e1"), F.bit_xor("x2").alias("_e2"), F.sum("words").alias("_ew"))
    before = slices_before(["conv_id"])
    carried = edges.select(SLICE, "conv_id", *[F.coalesce(f(c).over(before), F.lit(0)).alias(f"{c}b") for f, c in ((F.bit_xor, "_e1"), (F.bit_xor, "_e2"), (F.sum, "_ew"))])
    running = per_slice(["conv_id"], ["i"])
    inner = own.withColumns({"p1": F.bit_xor("x1").over(running), "p2": F.bit_xor("x2").over(running), "upto": F.sum("words").over(running)})
    rest = join_edges(inner, carried, ["conv_id"]).select(
        "conv_id", "i", F.col("p1").bitwiseXOR(F.col("_e1b")).bitwiseXOR(F.col("_h1")).alias("p1"),
        F.col("p2").bitwiseXOR(F.col("_e2b")).bitwiseXOR(F.col("_h2")).alias("p2"), "x1", "x2", "words",
        (F.col("upto") + F.col("_ewb") + F.col("_w")).alias("upto"),
    )
    rows = checkpointed(first.unionByName(rest))
    ends = rows.groupBy("conv_id").agg(F.max("i").alias("n"), F.max("upto").alias("total"), end["p1"].alias("p1"), end["p2"].alias("p2"))
    whole = heads.select("conv_id").join(ends, "conv_id", "left").na.fill(0, ["n", "total", "p1", "p2"])
    return rows, checkpointed(whole)


def blocks(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """``conv_id, total, block, s1, s2, turns``: the blocks of every conversation with the digests of the prefix in front.

    Block -1 stands for the root. ``turns`` are the nodes along a block, at most ``BLOCK``.
    """
    zero = F.lit(0).cast("long")
    node = F.struct(F.col("i").alias("depth"), "p1", "p2", (F.col("upto") - F.col("words")).alias("before"), "words")
    start = F.min_by(F.struct(F.col("p1").bitwiseXOR(F.col("x1")).alias("s1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("s2")), "i")
    dealt = rows.groupBy("conv_id", F.floor((F.col("i") - 1) / BLOCK).cast("long").alias("block"))
    cut = dealt.agg(start.alias("_s"), F.array_sort(F.collect_list(node)).alias("turns")).select("conv_id", "block", "_s.*", "turns")
    top = F.array(F.struct(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("before"), zero.alias("words")))
    root = whole.select("conv_id", F.lit(-1).cast("long").alias("block"), zero.alias("s1"), zero.alias("s2"), top.alias("turns"))
    return cut.unionByName(root).join(whole.select("conv_id", "total"), "conv_id")


#: A distinct block: its last node says which turns it has and what is in front.
BLOCK_KEY = ["block", "length", "e1", "e2"]


def _keyed(cut: DataFrame) -> DataFrame:
    last = F.element_at("turns", -1)
    return cut.withColumns({"length": F.size("turns"), "e1": last["p1"], "e2": last["p2"]})


def _nodes_of(distinct: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row per node: turns of single blocks as they are, those of diverging ones grouped.

    ``distinct`` has one row per distinct block, ``alone`` and the columns that ``measures`` combine.
    """
    along = distinct.select("alone", "block", "s1", "s2", *measures, F.posexplode("turns").alias("_at", "_t"), "turns")
    above = F.when(F.col("_at") > 0, F.get("turns", F.col("_at") - 1))
    flat = along.select(
        "alone", "_t.*", F.when(F.col("block") >= 0, F.coalesce(above["p1"], "s1")).alias("up1"),
        F.when(F.col("block") >= 0, F.coalesce(above["p2"], "s2")).alias("up2"), *measures,
    )
    same = [F.first(c).alias(c) for c in ("before", "words", "up1", "up2")]
    joined = flat.where("not alone").groupBy(*NODE).agg(*same, *[m.alias(c) for c, m in measures.items()])
    return flat.where("alone").select(joined.columns).unionByName(joined)


def id_list_digests(ends: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256`` of the ids that end in a node, ascending and joined by commas.

    SHA-256 reads its input in order, so one task reads the list of a node, but as chunks of text, one at a time.
    """
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("_chunk")
    texts = ends.groupBy(*NODE, chunk).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = texts.repartition(*NODE).sortWithinPartitions(*NODE, "_chunk").drop("_chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        names = [*NODE, "ends_sha256"]

        def row() -> list:
            return [*last, state.hexdigest()]

        for batch in batches:
            out = []
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append(row())
                last, state = node, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row()], names=names)

    return dealt.mapInArrow(run, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def trie(turns: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """The nodes of the conversations in ``turns`` (see :func:`ordered_turns`), begun by ``heads`` where given.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` and the node's digests.
    """
    rows, whole = prefixes(turns, heads)
    cut = checkpointed(_keyed(blocks(rows, whole)))
    same = [F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("turns").alias("turns")]
    distinct = cut.groupBy(*BLOCK_KEY).agg(*same, F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("total").alias("totals"))
    siblings = distinct.groupBy("block", "s1", "s2").agg((F.count("*") == 1).alias("alone"))
    distinct = checkpointed(distinct.join(siblings, ["block", "s1", "s2"]))
    nodes = checkpointed(_nodes_of(distinct, {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id"), "totals": F.sum("totals")}))

    children = nodes.where(F.col("up1").isNotNull()).groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").na.fill(0, ["n_children"])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = checkpointed(nodes.join(parents, ["depth", "up1", "up2"], "left"))

    # What each conversation owns, and how many words stand in front of its first own node.
    owners = nodes.groupBy("conv_id").agg(
        F.sum("words").alias("owned"), F.min("before").alias("first_before"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    shares = cut.join(owners, "conv_id").groupBy(*BLOCK_KEY).agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("n_leaves"))
    sums = _nodes_of(distinct.join(shares, BLOCK_KEY), {"owned": F.sum("owned"), "n_leaves": F.sum("n_leaves")})
    found = nodes.join(sums.select(*NODE, F.col("owned").alias("below"), "n_leaves"), NODE).join(owners.select("conv_id", "first_before"), "conv_id")
    in_members = F.col("totals") - F.col("n_convs") * F.col("before")
    in_nodes = F.col("below") - (F.col("before") - F.col("first_before"))
    ends = id_list_digests(whole.select("conv_id", F.col("n").alias("depth"), "p1", "p2"))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (in_members - in_nodes).alias("saved_tokens"),
        F.coalesce("ends_sha256", nobody).alias("ends_sha256"), "p1", "p2",
    )


def shared_heads(turns: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """``conv_id, skip, head``: the first ``skip`` turns (crc32 of the id modulo ``most + 1``) come from the first conversation of the family."""
    leader = F.col("conv_id") - F.col("conv_id") % family
    skip = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    listed = turns.where((F.col("position") <= most) & (F.col("conv_id") == leader)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "digest", "words"))).alias("_all"))
    listed = listed.select(F.col("conv_id").alias("_leader"), F.transform("_all", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("_all"))
    ids = turns.select("conv_id").distinct().select("conv_id", skip.alias("skip"), leader.alias("_leader"))
    head = F.slice(F.coalesce("_all", F.array().cast("array<struct<digest:binary,words:bigint>>")), F.lit(1), F.col("skip"))
    return checkpointed(ids.join(listed, "_leader", "left").select("conv_id", "skip", head.alias("head")))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations whose first turns come from the first of their family of twenty."""
    turns = checkpointed(ordered_turns(conversations))
    return trie(turns, shared_heads(turns))
