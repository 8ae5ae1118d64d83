"""Prefix trie of conversations as a z-fast trie that Spark builds in batches.

A conversation is a string of turns; a chained 128-bit hash of its first d turns names the
depth-d node. The compacted trie is a table of nodes, each with the edge above it: the hashes
of the depths that the edge runs through. A node is found by its handle, the hash at the
two-fattest depth of its edge. A batch looks up all conversations that are not placed yet: fat
binary search over handles finds the deepest node whose extent they begin with, one more
lookup the edge in which they leave the trie. Edges are cut where conversations leave or end,
and of those that go on alike one, by a hash, becomes a leaf; the others are the next batch, so
about log(n) batches do. Sums over subtrees come from pointer doubling; at last edges are
expanded into a row for each depth. Texts never leave their first task; equal conversations
are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.llm.staging import discard, stage
from segflow.llm.wordhash import lean

#: Conversations of a base, turns that its first turns may give to others, and bytes of a hash.
GROUP, SHARED, WIDTH = 100, 6, 16
_ROOT = bytes(WIDTH)
#: Conversation ids joined at once, before a node's ends are hashed in order.
IDS = 1024

_CHAIN = "conv_id long, key binary, n int, hashes array<binary>, upto array<long>"


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the greatest power of two; low < high."""
    bits = F.length(F.bin(low.cast("long").bitwiseXOR(high.cast("long")))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high.cast("long"), bits), bits).cast("int")


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): array<struct<turn, digest, chars>> in order, with a 128-bit digest in place of each role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"))
    return t.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuild(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % group, where h = crc32(c) % shared."""
    bases = turns.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, shared).alias("given"))
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int"))
    met = own.join(bases, "base", "left")
    first = F.when(F.col("given").isNotNull(), F.slice("given", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return met.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hashes, upto = [_ROOT], [0]
            for t in turns:
                hashes.append(hashlib.blake2b(hashes[-1] + t["digest"], digest_size=WIDTH).digest())
                upto.append(upto[-1] + t["chars"])
            out.append((conv_id, hashes[-1], len(turns), hashes, upto))
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["conv_id", "key", "n", "hashes", "upto"])


def _located(pending: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """pending with ``p``, the depth down to which the trie has it, ``edge_of``, the node in whose edge p lies (null: p is a node), and ``next``, its hash below p (null: it ends there).

    Rows of the trie have (node, top, ext, edge, handle, first): an edge runs through depths
    top + 1 to ext, the node's own.
    """
    handles = trie.select("handle", F.col("node").alias("hit"), F.col("top").alias("hit_top"), F.col("ext").alias("hit_ext"))
    at = pending.withColumn("low", F.lit(0)).withColumn("high", F.col("n"))
    open_ = F.col("low") < F.col("high")
    for _ in range(longest.bit_length()):  # each step leaves a depth divisible by a smaller power of two
        f = F.when(open_, two_fattest(F.col("low"), F.col("high")))
        at = at.withColumn("f", f).withColumn("asked", F.get("hashes", F.col("f")))
        at = at.join(handles, F.col("asked") == F.col("handle"), "left")
        whole = (F.col("hit_ext") <= F.col("n")) & (F.get("hashes", F.col("hit_ext")) == F.col("hit"))
        found = F.col("hit").isNotNull()
        # the whole extent: go on below it; the handle only: the trie is left in this node's edge
        low = F.when(found & whole, F.col("hit_ext")).when(found, F.col("hit_top")).otherwise(F.col("low"))
        high = F.when(found & whole, F.col("high")).when(found, F.col("hit_top")).when(open_, F.col("f") - 1).otherwise(F.col("high"))
        at = at.withColumns({"low": low, "high": high}).drop("f", "asked", "handle", "hit", "hit_top", "hit_ext")
    edges = trie.select("first", F.col("node").alias("edge_of"), "edge")
    at = at.withColumn("below", F.get("hashes", F.col("low") + 1)).join(edges, F.col("below") == F.col("first"), "left")
    # chained hashes of an edge differ, so those in common are the common beginning
    shared = F.when(F.col("edge_of").isNotNull(), F.size(F.array_intersect("edge", F.slice("hashes", F.col("low") + 2, F.size("edge"))))).otherwise(0)
    at = at.withColumn("p", F.col("low") + shared)
    return at.select(*pending.columns, "p", "edge_of", F.get("hashes", F.col("p") + 1).alias("next"))


def _node(top: Column, ext: Column, edge: Column, upto: Column, parent: Column) -> list[Column]:
    """Columns of a node; ``upto`` has the characters down to depths top to ext."""
    return [
        F.element_at(edge, -1).alias("node"),
        parent.alias("parent"),
        top.alias("top"),
        ext.alias("ext"),
        edge.alias("edge"),
        upto.alias("upto"),
        F.element_at(edge, two_fattest(top, ext) - top).alias("handle"),
        F.get(edge, F.lit(0)).alias("first"),
    ]


def _grown(trie: DataFrame, located: DataFrame, leaves: DataFrame) -> DataFrame:
    """The trie with edges cut where conversations leave or end, and new leaves."""
    cuts = located.filter("edge_of is not null").groupBy(F.col("edge_of").alias("node")).agg(F.array_sort(F.collect_set("p")).alias("cuts"))  # an edge's depths at most
    marked = trie.join(cuts, "node", "left").withColumn("bounds", F.concat(F.array("top"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("ext")))
    pieces = marked.select("top", "edge", "upto", "parent", "bounds", F.posexplode(F.slice("bounds", F.lit(1), F.size("bounds") - 1)).alias("i", "a"))
    pieces = pieces.withColumn("b", F.get("bounds", F.col("i") + 1))
    k = F.col("a") - F.col("top")
    edge, upto = F.slice("edge", k + 1, F.col("b") - F.col("a")), F.slice("upto", k + 1, F.col("b") - F.col("a") + 1)
    cut = pieces.select(*_node(F.col("a"), F.col("b"), edge, upto, F.when(F.col("i") == 0, F.col("parent")).otherwise(F.get("edge", k - 1))))
    p, n = F.col("p"), F.col("n")
    grown = leaves.select(*_node(p, n, F.slice("hashes", p + 2, n - p), F.slice("upto", p + 1, n - p + 1), F.get("hashes", p)))
    return cut.unionByName(grown)


def build_trie(spark, classes: DataFrame) -> DataFrame:
    """The compacted trie of ``classes`` (key, n, hashes, upto): (node, parent, top, ext, edge, upto, handle, first), staged; the root's top is -1."""
    longest = classes.agg(F.max("n")).first()[0] or 0
    root = spark.range(1).select(F.lit(-1).alias("top"), F.lit(0).alias("ext"), F.array(F.lit(_ROOT)).alias("edge"), F.array(F.lit(0).cast("long"), F.lit(0).cast("long")).alias("upto"))
    trie = stage(root.select(F.lit(_ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), "top", "ext", "edge", "upto", F.lit(_ROOT).alias("handle"), F.lit(_ROOT).alias("first")), "trie")
    pending, passed = classes.select("key", "n", "hashes", "upto"), []
    while True:
        located = stage(_located(pending, trie, longest), "located")
        # of those that go on alike from one place a leaf is made; which one, a hash decides
        chosen = located.filter("next is not null").groupBy("next").agg(F.min(F.struct(F.xxhash64("key").alias("rank"), F.col("key").alias("leaf"))).alias("x")).select("next", "x.leaf")
        dealt = stage(located.filter("next is not null").join(chosen, "next").withColumn("is_leaf", F.col("key") == F.col("leaf")).drop("leaf"), "dealt")
        grown = stage(_grown(trie, located, dealt.filter("is_leaf")), "trie")
        discard(trie, located, *passed)
        trie, passed = grown, [dealt]
        pending = dealt.filter("not is_leaf").select("key", "n", "hashes", "upto")
        if pending.isEmpty():
            discard(dealt)
            return trie


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """(node, members, weighed, chars, n_leaves, least) summed over each node's subtree by pointer doubling: after k steps over 2**k levels."""
    sums, names = stage(nodes, "sums"), ["members", "weighed", "chars", "n_leaves"]
    while not sums.filter("up is not null").isEmpty():
        more = sums.filter("up is not null").groupBy(F.col("up").alias("node")).agg(*(F.sum(c).alias(f"more_{c}") for c in names), F.min("least").alias("more_least"))
        above = sums.select(F.col("node").alias("up"), F.col("up").alias("farther"))
        both = sums.join(more, "node", "left").join(above, "up", "left")
        added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in names]
        new = stage(both.select("node", F.col("farther").alias("up"), *added, F.least("least", "more_least").alias("least")), "sums")
        discard(sums)
        sums = new
    return sums.drop("up")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and place to a digest of each key's ids; the state of one key is in memory."""
    key, digest, out = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == key:
                digest.update(b",")
            else:
                if digest:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["node", "ends_sha256"])
            out = []
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def ends_digest(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (key, conv_id): the hash of each key's ids, ascending and joined by commas. Ids are joined by ranges first, so that a hot key is few rows."""
    parts = members.groupBy("key", F.expr(f"conv_id div {IDS}").alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(lean(_hash_ends), "node binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row for each node of the prefix trie.

    Input: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn
    (null first; ties by the digest of role and text; repeated rows stay), null role or text is
    empty. Conversations are rebuilt as ``rebuild`` says (shared=1: each keeps its own turns).
    ``conv_id`` is the node's smallest member. ``saved_tokens``: over the node's subtree, members
    but one times the characters of the last text. Rows with a null conv_id take no part; no
    conversations: no rows, not even the root's. The digests of one conversation's turns (28
    bytes a turn) come together in a row.
    """
    spark = conversations.sparkSession
    chained = stage(rebuild(turn_digests(conversations), group, shared).mapInArrow(lean(_chain), _CHAIN), "chained")
    classes = stage(chained.groupBy("key").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.first("upto").alias("upto"), F.count("*").alias("copies"), F.min("conv_id").alias("first_conv")), "classes")
    if classes.isEmpty():
        return classes.select(F.col("first_conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.lit("").alias("ends_sha256"))
    trie = build_trie(spark, classes)
    children = trie.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_below"))
    ends = classes.select(F.col("key").alias("node"), "copies", "first_conv")
    here = trie.select("node", F.col("parent").alias("up"), F.element_at("upto", -1).alias("chars_to"), (F.element_at("upto", -1) - F.get("upto", F.lit(0))).alias("chars"))
    here = here.join(ends, "node", "left").join(children, "node", "left")
    copies = F.coalesce("copies", F.lit(0))
    n_below = F.coalesce("n_below", F.lit(0))
    own = stage(here.select("node", "up", copies.alias("members"), (copies * F.col("chars_to")).alias("weighed"), "chars", (n_below == 0).cast("long").alias("n_leaves"), F.col("first_conv").alias("least"), n_below.alias("n_below")), "own")
    sums = _subtree_sums(own.drop("n_below"))

    nodes = trie.select("node", "parent", "top", "ext", "upto").join(sums, "node").join(own.select("node", "n_below"), "node").join(ends_digest(chained.select("key", "conv_id")), "node", "left")
    nodes = stage(nodes, "nodes").join(sums.select(F.col("node").alias("parent"), F.col("least").alias("least_above")), "parent", "left")
    each = nodes.select("*", F.posexplode(F.sequence(F.col("top") + 1, F.col("ext"))).alias("k", "depth"))
    last, first = F.col("depth") == F.col("ext"), F.col("k") == 0
    above, top = F.get("upto", F.col("k")), F.get("upto", F.lit(0))  # characters down to the depth before, and to the edge's top
    saved = F.col("weighed") - F.col("members") * above - (F.col("chars") - (above - top))
    return each.select(
        F.col("least").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(first, F.col("least_above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.when(last, F.col("n_below")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        saved.alias("saved_tokens"),
        F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
