"""Conversation prefix trie: how far conversations run alike, and what that saves.

A node is a sequence of turns with which some conversation starts. The trie is built
with vertical bitmaps. Conversations sorted by id are cut into shards of consecutive
ids; in a shard, an index maps each (position, turn) to the bitset of conversations
with that turn there. A depth-first walk intersects a node's bitset with the postings
of the next position: each intersection that isn't empty is a child, its popcount the
number of members, its lowest bit the smallest one, and the members without a further
turn are the end list. Nodes are named by a digest chained over their turns, so the
nodes of all shards meet by name; a node that many conversations share comes as one
row per shard, never as one row per conversation.

Sums over subtrees use that the nodes with the same smallest member form one path: if
it is the smallest of a node, it is so of all nodes further along it. Every
conversation so owns one path, which hangs from a node of another. Sums of whole paths
climb from path to path, one round for each path above, and inside a path they are
running sums from its end. Neither needs a node to list those above or below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from docmill.llm.common import store

SHARED_TURNS, FAMILY = 6, 100    # borrowed turns are a checksum modulo the one; who lends, a multiple of the other
SHARD = 4096                     # conversations that a bitset covers
SHARD_TURNS = 1 << 16            # turns at which a shard ends early; a longer conversation is one of its own
ROOT = bytes(16)

_NODES = {"key": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "n_convs": pa.int64(),
          "conv_id": pa.int64(), "chars": pa.int64(), "ends": pa.string()}
_NODE_TYPES = "key binary, parent binary, depth long, n_convs long, conv_id long, chars long, ends string"


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``conv_id, ..`` with their place among those of the conversation in
    this partition."""
    part, now, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for conv in batch.column(0).to_pylist():
            if conv != now:
                now, seen = conv, 0
            seen += 1
            places.append(seen)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(places, pa.int64()), pa.array([part] * len(places), pa.int32())],
            names=[*batch.schema.names, "place", "part"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_name binary, chars``: turns by ``turn`` (null first), then role
    and text, numbered from 1.

    A range partitioning down to single rows spreads a conversation of any length over
    partitions; their counts are added up before.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    order = ["conv_id", "turn", "role", "text", "row"]
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        F.monotonically_increasing_id().alias("row"))
    # the length of the role keeps ("ab", "c") and ("a", "bc") apart
    name = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    turns = store(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", name.alias("turn_name"), F.length("text").cast("long").alias("chars"))
        .mapInArrow(_ranked, "conv_id long, turn_name binary, chars long, place long, part int"), "turns")
    # only conversations cut by a partition's edge have a part after the first
    later = turns.groupBy("conv_id", "part").agg(F.max("place").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ).where("before is not null").drop("n")
    return turns.join(F.broadcast(later), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_name", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_name, chars`` with the first turns taken from the family's head.

    ``pos`` orders turns but may leave gaps. Each conversation also has a row with
    ``pos`` 0 and no turn, so that one without turns is not lost.
    """
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS
    head = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = turns.groupBy("conv_id").agg(F.lit(0).cast("long").alias("pos"))
    own = turns.where(F.col("pos") > shared)
    lent = turns.where((F.col("conv_id") == head) & (F.col("pos") < SHARED_TURNS)).withColumnRenamed("conv_id", "head")
    taken = convs.select("conv_id", head.alias("head"), shared.alias("shared")).join(lent, "head").where("pos <= shared")
    return own.unionByName(taken.select(own.columns)).unionByName(convs, allowMissingColumns=True)


def _child(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


def walk(ids: list[int], turns: list[list[tuple[bytes, int]]]) -> Iterator[tuple]:
    """Nodes of one shard, depth first; ``ids`` ascend."""
    index: dict[tuple[int, bytes], int] = {}
    ended: dict[int, int] = {}
    for k, path in enumerate(turns):
        bit = 1 << k
        ended[len(path)] = ended.get(len(path), 0) | bit
        for at, (turn, _) in enumerate(path):
            index[at, turn] = index.get((at, turn), 0) | bit
    stack = [(ROOT, None, 0, (1 << len(ids)) - 1, 0)]
    while stack:
        key, parent, depth, members, chars = stack.pop()
        ends = members & ended.get(depth, 0)
        low = (members & -members).bit_length() - 1
        yield key, parent, depth, members.bit_count(), ids[low], chars, _listed(ids, ends)
        rest = members ^ ends
        while rest:
            turn, chars = turns[(rest & -rest).bit_length() - 1][depth]
            child = rest & index[depth, turn]
            stack.append((_child(key, turn), key, depth + 1, child, chars))
            rest ^= child


def _listed(ids: list[int], members: int) -> str | None:
    out = []
    while members:
        low = members & -members
        out.append(str(ids[low.bit_length() - 1]))
        members ^= low
    return ",".join(out) or None


def _nodes(shard: int, shard_turns: int):
    """Rows sorted by ``conv_id, pos`` to nodes of their shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, turns, size, out = [], [], 0, []
        lone = None         # key, depth and last length of a conversation that is walked as it streams in

        def emit():
            nonlocal out
            rows, out = out, []
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _NODES.values())], names=list(_NODES))

        def flush():
            nonlocal ids, turns, size
            if ids:
                for node in walk(ids, turns):
                    out.append(node)
                    if len(out) >= 1 << 14:
                        yield from emit()
            ids, turns, size = [], [], 0

        def close(conv):
            nonlocal lone
            key, parent, depth, chars = lone
            out.append((key, parent, depth, 1, conv, chars, str(conv)))
            lone = None

        now = None
        for batch in batches:
            for conv, turn, chars in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != now:
                    if lone is not None:
                        close(now)
                    if len(ids) >= shard or size >= shard_turns:
                        yield from flush()
                    now = conv
                    ids.append(conv)
                    turns.append([])
                if turn is None:
                    continue
                if lone is None and len(turns[-1]) >= shard_turns:
                    path = turns.pop()
                    ids.pop()
                    yield from flush()
                    lone = (ROOT, None, 0, 0)
                else:
                    path = []
                for step in (*path, (turn, chars)) if lone is not None else ():
                    key, parent, depth, length = lone
                    out.append((key, parent, depth, 1, conv, length, None))
                    lone = (_child(key, step[0]), key, depth + 1, step[1])
                    if len(out) >= 1 << 14:
                        yield from emit()
                if lone is None:
                    turns[-1].append((turn, chars))
                    size += 1
        if lone is not None:
            close(now)
        yield from flush()
        if out:
            yield from emit()
    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of shards, sorted by name and smallest member, to whole nodes. Shards hold
    consecutive ids, so the end lists follow one another in order."""
    now, row, digest, some, out = None, None, None, False, []

    def emit():
        nonlocal out
        rows, out = out, []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), _NODES.values())],
            names=[*list(_NODES)[:-1], "ends_sha256"])

    for batch in batches:
        for key, parent, depth, n, conv, chars, ends in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if key != now:
                if row:
                    out.append((*row, digest.hexdigest()))
                now, row, digest, some = key, [key, parent, depth, 0, conv, chars], hashlib.sha256(), False
            row[3] += n
            if ends is not None:
                digest.update(("," + ends if some else ends).encode())
                some = True
        if out:
            yield emit()
    if row:
        out.append((*row, digest.hexdigest()))
        yield emit()


def trie_nodes(turns: DataFrame, shard: int = SHARD, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``key, parent, depth, n_convs, conv_id, chars, ends_sha256`` of the trie over
    ``conv_id, pos, turn_name, chars``. A conversation is walked by one task, as a stream."""
    parts = turns.select("conv_id", "turn_name", "chars", "pos").repartitionByRange("conv_id") \
        .sortWithinPartitions("conv_id", "pos").mapInArrow(_nodes(shard, shard_turns), _NODE_TYPES)
    return store(parts.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(
        _joined, _NODE_TYPES.replace("ends string", "ends_sha256 string")), "trie-nodes")


def prefix_trie(conversations: DataFrame, shard: int = SHARD, shard_turns: int = SHARD_TURNS,
                rebuild: bool = True) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns are ordered by ``turn`` (null first), ties by role and text; repeated rows
    are turns of their own; null role and text are empty. Rows without a ``conv_id``
    belong to no conversation and are left out. An empty table has no nodes, not even
    a root. With ``rebuild`` off, conversations are taken as they are. Other columns
    are ignored.
    """
    turns = numbered_turns(conversations)
    if rebuild:
        turns = rebuilt(turns)
    nodes = trie_nodes(turns, shard, shard_turns)
    own = (F.col("n_convs") - 1) * F.col("chars")
    paths = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("head"), F.max("depth").alias("end"), F.min_by("parent", "depth").alias("above"),
        F.sum(own).alias("saved"))
    # where a path hangs: the node above its first one
    hung = store(paths.join(
        nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("on"), F.col("depth").alias("at")), "above", "left")
        .drop("above"), "trie-paths")
    below = hung.where("on is not null").groupBy(F.col("on").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.count(F.lit(1)).alias("hanging"))
    # an end on which another path hangs is no leaf
    paths = store(hung.join(below.withColumnRenamed("depth", "end"), ["conv_id", "end"], "left").select(
        "conv_id", "head", "end", "on", "at", "saved", F.when(F.col("hanging").isNull(), 1).otherwise(0).cast("long").alias("leaves")),
        "trie-paths")

    def climbed(sums: DataFrame) -> DataFrame:
        """Sums of paths, added up where those paths hang."""
        return store(sums.join(paths.select("conv_id", "on", "at"), "conv_id").where("on is not null")
                     .groupBy(F.col("on").alias("conv_id"), F.col("at").alias("depth"))
                     .agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-sums")

    rounds = [climbed(paths.select("conv_id", "saved", "leaves"))]
    while not rounds[-1].isEmpty():
        rounds.append(climbed(rounds[-1].groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))))
    from_below = rounds[0]
    for r in rounds[1:]:
        from_below = from_below.unionByName(r)
    from_below = from_below.groupBy("conv_id", "depth").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    rows = (nodes.join(paths.select("conv_id", "head", "end", "on", "leaves"), "conv_id")
            .join(below, ["conv_id", "depth"], "left").join(from_below, ["conv_id", "depth"], "left"))
    to_end = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    is_end = F.col("depth") == F.col("end")
    leaves = F.when(is_end, F.col("leaves")).otherwise(0) + F.coalesce("more_leaves", F.lit(0))
    return rows.select(
        "conv_id", "depth",
        F.when(F.col("depth") > F.col("head"), F.col("conv_id")).otherwise(F.col("on")).alias("parent_conv_id"),
        "n_convs",
        (F.when(is_end, 0).otherwise(1) + F.coalesce("hanging", F.lit(0))).cast("long").alias("n_children"),
        F.sum(leaves).over(to_end).cast("long").alias("n_leaves"),
        F.sum(own + F.coalesce("more_saved", F.lit(0))).over(to_end).cast("long").alias("saved_tokens"),
        "ends_sha256")
