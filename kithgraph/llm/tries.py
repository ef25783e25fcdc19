"""Prefix trie of conversations, built as double-array tries over shards of their sorted order.

A conversation is a sequence of turns; a turn is known by the SHA-256 of its role and text, a node by a chain of such digests from the root,
so equal prefixes have equal names everywhere.  Distinct sequences get positions in their order, and every run of positions is a shard: a
prefix shared by a third of the corpus is cut into as many shards as it needs.  A task packs its shard into BASE and CHECK over dense turn ids
and walks it.  A row of the order owns the nodes that its predecessor has not, and ends a branch if its successor does not go on from it, so the
figures of a shard add up: nodes that shards share, those above the cuts, are merged by one aggregate.

Sequences are cut into stretches of bounded length; each stretch is a trie below the node where the last one ended, the deepest first.
Conversations are therefore never held whole; one of n turns takes n / ``stretch`` rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph.llm.common import arrow, written
from kithgraph.operators.numbering import global_positions

STRETCH = 256  # turns of a stretch
SHARD = 2048  # sequences of a shard
PACKED = 1 << 16  # turns packed into one double array
PIECE = 1 << 14  # ids of one piece of a digest's text

NODES = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("top", pa.bool_()), ("depth", pa.int64()), ("n", pa.int64()), ("least", pa.int64()),
                   ("children", pa.int64()), ("leaves", pa.int64()), ("held", pa.int64()), ("stored", pa.int64())])


class DoubleArray:
    """Trie over symbols 1, 2, ...: the child of state s by symbol c is t = base[s] + c where check[t] = s.  State 0 is the top."""

    def __init__(self) -> None:
        self.base, self.check, self.free = [0], [-1], 1  # check: -1 taken by the top, -2 free

    def _taken(self, slot: int) -> bool:
        return slot < len(self.check) and self.check[slot] != -2

    def add(self, state: int, symbols: list[int]) -> list[int]:
        """Places the children of a state and returns their states; ``symbols`` are distinct and ascending."""
        while self._taken(self.free):
            self.free += 1
        slot, tries = self.free, 0
        while True:
            base = slot - symbols[0]
            if not self._taken(slot) and not any(self._taken(base + c) for c in symbols):
                break
            tries += 1
            slot = slot + 1 if tries < 64 else max(slot + 1, len(self.check))  # behind the last slot all fit
        grow = base + symbols[-1] + 1 - len(self.check)
        if grow > 0:
            self.base += [0] * grow
            self.check += [-2] * grow
        self.base[state] = base
        for c in symbols:
            self.check[base + c] = state
        return [base + c for c in symbols]

    def walk(self, symbols: list[int]) -> list[int]:
        """States along a sequence, as far as the trie has it."""
        state, path = 0, []
        for c in symbols:
            target = self.base[state] + c
            if not 0 <= target < len(self.check) or self.check[target] != state:
                break
            state = target
            path.append(state)
        return path


def packed(rows: list[list[int]]) -> DoubleArray:
    """Double array of sequences that are sorted so that equal prefixes stand together."""
    trie, open_ = DoubleArray(), [(0, 0, len(rows), 0)]
    while open_:
        state, low, high, depth = open_.pop()
        groups: list[tuple[int, int, int]] = []
        at = low
        while at < high:
            if len(rows[at]) <= depth:
                at += 1
                continue
            start, symbol = at, rows[at][depth]
            while at < high and len(rows[at]) > depth and rows[at][depth] == symbol:
                at += 1
            groups.append((symbol, start, at))
        if groups:
            groups.sort()
            states = trie.add(state, [g[0] for g in groups])
            open_ += [(s, a, b, depth + 1) for s, (_, a, b) in zip(states, groups)]
    return trie


def common(a: tuple, b: tuple | None) -> int:
    """Turns that two rows share from below the same node; -1 where they stand below different nodes."""
    if b is None or a[0] != b[0]:
        return -1
    n = 0
    for x, y in zip(a[1], b[1]):
        if x != y:
            break
        n += 1
    return n


def shard_nodes(previous: tuple | None, rows: list[tuple], following: tuple | None, depth: int) -> Iterator[tuple]:
    """Figures of the nodes of a run of rows (above, turns, sizes, n, n_end, least, leaves, held, stored).

    ``above`` names the node below which the turns stand, at ``depth``; the last three figures are what lies below the row's end.
    """
    symbols: dict[tuple[bool, bytes], int] = {}
    dense = [[symbols.setdefault((True, r[0]), len(symbols) + 1), *(symbols.setdefault((False, t), len(symbols) + 1) for t in r[1])] for r in rows]
    trie, nodes = packed(dense), {}
    for i, row in enumerate(rows):
        above, turns, sizes, n, n_end, least, leaves, held, stored = row
        shared = max(0, common(row, rows[i - 1] if i else previous))
        after = rows[i + 1] if i + 1 < len(rows) else following
        leaves += int(n == n_end and not (after is not None and common(row, after) == len(turns)))
        # from the end: bytes at and below each depth, of all members and of the nodes this row owns
        every = [held + n * s for s in accumulate(reversed(sizes), initial=0)][::-1]
        own = [stored + s for s in accumulate((b if j >= shared else 0 for j, b in zip(range(len(sizes) - 1, -1, -1), reversed(sizes))), initial=0)][::-1]
        key = above
        path = trie.walk(dense[i])
        if len(path) != len(turns) + 1:
            raise AssertionError("a sequence is not in its trie")
        for j, state in enumerate(path):
            node = nodes.get(state)
            if node is None:
                parent, key = key, hashlib.sha256(key + turns[j - 1]).digest() if j else key
                node = nodes[state] = [key, parent if j else None, j == 0, depth + j, 0, least, 0, 0, 0, 0]
            key = node[0]
            node[4] += n
            node[5] = min(node[5], least)
            node[6] += int(shared <= j < len(turns))
            node[7] += leaves
            below = max(j - 1, 0)  # a node's own last turn counts, but for the top's, which belongs to the trie above
            node[8] += every[below]
            node[9] += own[below]
    return map(tuple, nodes.values())


def _level_nodes(rows: DataFrame, depth: int, shard: int, packed_turns: int) -> DataFrame:
    """Figures of all nodes of one level of stretches, a row for each shard that has them."""
    at = F.col("position") - 1
    beside = F.array(F.struct(F.floor(at / shard).alias("shard"), F.lit(False).alias("halo")),
                     F.struct(F.floor((at - 1) / shard).alias("shard"), F.lit(True).alias("halo")),
                     F.struct(F.floor((at + 1) / shard).alias("shard"), F.lit(True).alias("halo")))
    # the first row of a shard is also seen by the shard before it, and the last by the one after it
    dealt = (rows.withColumn("to", F.explode(F.filter(beside, lambda x: ~x["halo"] | (x["shard"] != F.floor(at / shard)))))
             .select("to.shard", "to.halo", "position", "above", "turns", "sizes", "n", "n_end", "least", "leaves", "held", "stored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, previous, open_, turns = None, None, [], 0

        def closed(following):
            nonlocal previous, open_, turns
            if open_:
                found = list(shard_nodes(previous, open_, following, depth))
                previous, open_, turns = open_[-1], [], 0
                for i in range(0, len(found), 1 << 13):
                    yield arrow(NODES, *zip(*found[i:i + (1 << 13)]))

        for batch in batches:
            for shard_, halo, _, *row in zip(*(c.to_pylist() for c in batch.columns)):
                row = tuple(row)
                if shard_ != now:
                    yield from closed(None)
                    now, previous = shard_, None
                if halo:
                    yield from closed(row)
                    previous = row
                    continue
                if turns >= packed_turns:
                    yield from closed(row)
                open_.append(row)
                turns += len(row[1]) + 1
        yield from closed(None)

    kind = "key binary, parent binary, top boolean, depth long, n long, least long, children long, leaves long, held long, stored long"
    return dealt.repartition("shard").sortWithinPartitions("shard", "position").mapInArrow(run, kind)


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n, turn, size): turns of each conversation in order, as digests with the UTF-8 bytes of their texts.

    Order: turn (null first), then role and text.  The table is sorted in range chunks, so a very long conversation is
    spread over chunks; the few that cross a chunk's edge get the counts of the chunks before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = (F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text")), 256))
    chunked = written(rows.repartitionByRange(width, *order).sortWithinPartitions(*order).select(
        "conv", digest.alias("turn"), F.octet_length("text").cast("long").alias("size"), F.spark_partition_id().alias("chunk"),
        F.monotonically_increasing_id().alias("place")), "trie-turns")
    counts = chunked.groupBy("conv", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    crossing = counts.select("conv", "chunk", before.alias("before")).filter("before > 0")  # one row for each chunk at most
    local = F.row_number().over(Window.partitionBy("conv", "chunk").orderBy("place"))
    return (chunked.withColumn("local", local).join(F.broadcast(crossing), ["conv", "chunk"], "left")
            .select("conv", (F.col("local") + F.coalesce("before", F.lit(0))).cast("long").alias("n"), "turn", "size"))


def inheriting(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) and their turns (conv, depth, turn, size) after each has taken over the start of its group's first.

    Conversation c takes the first h turns of conversation c - c % ``group`` (all, if it has fewer; none, if it is not there), h being the CRC-32
    of c in decimal modulo ``most``, and goes on with its own turns after its first h.
    """
    turns = written(turns, "trie-numbered")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = sizes.select("conv", "own", F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most)).alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("own").alias("has"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    convs = written(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    starts = turns.filter(F.col("n") < most).select(F.col("conv").alias("base"), "n", "turn", "size")
    taken = convs.join(starts, "base").filter("n <= h").select("conv", F.col("n").alias("depth"), "turn", "size")
    own = turns.join(convs, "conv").filter("n > h").select("conv", (F.col("n") - F.col("h") + F.col("taken")).alias("depth"), "turn", "size")
    return convs.select("conv", "length"), taken.unionByName(own)


def _stretches(convs: DataFrame, turns: DataFrame, stretch: int) -> list[DataFrame]:
    """By level: (conv, above, turns, sizes, end, last); a conversation has a row in every level it reaches."""
    cut = turns.withColumn("level", F.floor((F.col("depth") - 1) / stretch).cast("int"))
    listed = cut.groupBy("conv", "level").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "size"))).alias("list"))  # of ``stretch`` turns at most
    every = written(convs.filter("length = 0").select("conv", F.lit(0).alias("level"), F.expr("CAST(array() AS array<binary>)").alias("turns"),
                                                      F.expr("CAST(array() AS array<bigint>)").alias("sizes"))
                    .unionByName(listed.select("conv", "level", F.col("list.turn").alias("turns"), F.col("list.size").alias("sizes"))).join(convs, "conv"),
                    "trie-stretches")
    levels = every.agg(F.max("level")).first()[0]
    chain = F.aggregate("turns", F.col("above"), lambda a, t: F.unhex(F.sha2(F.concat(a, t), 256)))
    found: list[DataFrame] = []
    for level in range(0 if levels is None else levels + 1):
        rows = every.filter(F.col("level") == level)
        rows = rows.join(found[-1].select("conv", F.col("end").alias("above")), "conv") if found else rows.withColumn("above", F.lit(b""))
        rows = rows.withColumn("end", chain).withColumn("last", F.col("length") <= (level + 1) * stretch)
        found.append(written(rows.select("conv", "above", "turns", "sizes", "end", "last"), f"trie-level{level}"))
    return found


def _digests(ends: DataFrame, piece: int) -> DataFrame:
    """(key, ends): SHA-256 of the ids that end at a node, ascending and joined by commas.

    Ids are sorted in range chunks and joined to pieces of bounded size there, so that what one node's hash reads in its task, in
    order and piece by piece, is short.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, convs, rows, start = batch["key"].to_pylist(), batch["conv"].to_pylist(), [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start] or i - start == piece:
                    rows.append((keys[start], convs[start], ",".join(map(str, convs[start:i]))))
                    start = i
            if rows:
                yield arrow(pa.schema([("key", pa.binary()), ("low", pa.int64()), ("text", pa.string())]), *zip(*rows))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                if key == now:
                    digest.update(b"," + text.encode())
                else:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(text.encode())
            if len(done) >= 1 << 13:
                yield arrow(pa.schema([("key", pa.binary()), ("ends", pa.string())]), *zip(*done))
                done = []
        if now is not None:
            done.append((now, digest.hexdigest()))
            yield arrow(pa.schema([("key", pa.binary()), ("ends", pa.string())]), *zip(*done))

    width = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(width, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(joined, "key binary, low long, text string")
    return pieces.repartition("key").sortWithinPartitions("key", "low").select("key", "text").mapInArrow(hashed, "key binary, ends string")


def prefix_trie(convs: DataFrame, turns: DataFrame, stretch: int = STRETCH, shard: int = SHARD, packed_turns: int = PACKED, piece: int = PIECE) -> DataFrame:
    """(least, depth, parent_least, n, children, leaves, saved, ends) of every distinct start of conversations.

    ``convs`` has (conv, length), ``turns`` has (conv, depth, turn, size) with depths 1 to length.  ``least`` is the smallest conversation of the
    node, ``saved`` the bytes that storing each node's last turn once spares in its subtree.  Conversations without turns belong to the root.
    An empty table gives an empty table.
    """
    levels = _stretches(convs, turns, stretch)
    nodes: list[DataFrame] = []
    below: DataFrame | None = None
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level].groupBy("end").agg(F.first("above").alias("above"), F.first("turns").alias("turns"), F.first("sizes").alias("sizes"), F.count("*").alias("n"),
                                                F.sum(F.col("last").cast("long")).alias("n_end"), F.min("conv").alias("least"))
        if below is None:
            same = same.select("*", *(F.lit(0).cast("long").alias(c) for c in ("leaves", "held", "stored")))
        else:
            same = same.join(below, "end", "left").na.fill(0, ["leaves", "held", "stored"])
        ordered = global_positions(same.drop("end"), [F.col("above"), F.col("turns")])
        found = written(_level_nodes(ordered, level * stretch, shard, packed_turns), f"trie-nodes{level}")
        if level:  # the top of such a trie is the end of a stretch above: it only brings children
            below = found.filter("top").groupBy(F.col("key").alias("end")).agg(*(F.sum(c).alias(c) for c in ("leaves", "held", "stored")))
            zero = {c: F.when(F.col("top"), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in ("n", "leaves", "held", "stored")}
            found = found.select(*(zero.get(c, F.col(c)) for c in found.columns))
        nodes.append(found)
    if not nodes:
        return convs.sparkSession.createDataFrame([], "least long, depth long, parent_least long, n long, children long, leaves long, saved long, ends string")
    merged = written(reduce(DataFrame.unionByName, nodes).groupBy("key").agg(
        F.max("parent").alias("parent"), F.min("depth").alias("depth"), F.min("least").alias("least"), F.sum("n").alias("n"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum(F.col("held") - F.col("stored")).alias("saved")), "trie-merged")
    ends = reduce(DataFrame.unionByName, [x.filter("last").select(F.col("end").alias("key"), "conv") for x in levels])
    parents = merged.select(F.col("key").alias("parent"), F.col("least").alias("parent_least"))
    none = hashlib.sha256(b"").hexdigest()
    return (merged.join(_digests(ends, piece), "key", "left").join(parents, "parent", "left")
            .select("least", "depth", "parent_least", "n", "children", "leaves", "saved", F.coalesce("ends", F.lit(none)).alias("ends")))
