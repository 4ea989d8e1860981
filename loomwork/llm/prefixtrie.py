"""Prefix trie of conversations, as balanced parentheses per shard.

A conversation is a string of fixed-width items, one per turn, so plain string order is
depth-first order of the trie with shorter sequences first. The distinct sequences are
sorted over shards; each shard writes its part of the trie as parentheses and answers
everything from them: ``find_close`` delimits subtrees, ranks count leaf pairs, sums in
preorder give savings. Nodes on the path from one shard to the next (a shared spine) have
a part in each, and parts add up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.steps import materialize

ITEM = 40                  # characters of an item: 32 of a hash, 8 of the text's length
SHARD_TURNS = 1 << 17      # turns of distinct sequences in a shard, about
BLOCK = 64                 # parentheses in a block of the excess directory
PIECE_BYTES = 1 << 16      # of listed identifiers in a row
SALTS = 16
NOTHING = hashlib.sha256(b"").hexdigest()


class Parens:
    """Balanced parentheses with minima of the excess per block, and blocks of blocks."""

    def __init__(self, opens: np.ndarray):
        """``opens``: True for an opening one."""
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1)).astype(np.int64)
        pad = -len(opens) % BLOCK
        level = np.concatenate((self.excess, np.full(pad, 1 << 40))).reshape(-1, BLOCK)
        self.padded = level.ravel()
        #: levels[0]: least excess of each block; above, of each pair of the level below
        self.levels = [level.min(axis=1) if len(opens) else np.zeros(0, np.int64)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.concatenate((low, np.full(len(low) % 2, 1 << 40)))
            self.levels.append(low.reshape(-1, 2).min(axis=1))
        first = np.flatnonzero(opens)
        self.preorder = np.cumsum(opens) - 1
        #: leaves before each position: an opening one right before its closing one
        pairs = opens & ~np.concatenate((opens[1:], [True])) if len(opens) else opens
        self.leaf_rank = np.concatenate(([0], np.cumsum(pairs)))
        self.first = first

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing one of the opening ones at positions ``at``."""
        goal = self.excess[at] - 1
        found = np.full(len(at), -1, np.int64)
        self._scan(at + 1, goal, found, np.arange(len(at)), at // BLOCK)
        todo = np.flatnonzero(found < 0)
        if not len(todo):
            return found
        # up to the first block to the right that falls to the goal, then down to its first part
        node, level = at[todo] // BLOCK, np.zeros(len(todo), np.int64)
        target = goal[todo]
        going = np.arange(len(todo))
        for depth, low in enumerate(self.levels):
            here = node[going]
            right = here + 1
            ok = (here % 2 == 0) & (right < len(low))
            ok[ok] = low[right[ok]] <= target[going[ok]]
            node[going[ok]], level[going[ok]] = right[ok], depth
            going = going[~ok]
            node[going] //= 2
        for depth in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(level == depth)
            left = node[down] * 2
            hit = self.levels[depth - 1][left] <= target[down]
            node[down], level[down] = np.where(hit, left, left + 1), depth - 1
        self._scan(node * BLOCK, target, found, todo, node)
        return found

    def _scan(self, start, goal, found, rows, block) -> None:
        """Look through the rest of one block for the first place at the goal."""
        at, end, live = start.copy(), (block + 1) * BLOCK, np.arange(len(start))
        while len(live):
            inside = at[live] < np.minimum(end[live], len(self.excess))
            live = live[inside]
            hit = self.excess[at[live]] == goal[live]
            found[rows[live[hit]]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Leaf pairs from each opening one to its closing one."""
        return self.leaf_rank[close] - self.leaf_rank[at]


def _range_minimum(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least value of each run of ``size`` values from ``first``: two overlapping powers of two."""
    tables, width = [values], 1
    while 2 * width <= len(values):
        tables.append(np.minimum(tables[-1][:-width], tables[-1][width:]))
        width *= 2
    power = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(power):
        at = np.flatnonzero(power == k)
        out[at] = np.minimum(tables[k][first[at]], tables[k][first[at] + size[at] - (1 << k)])
    return out


def shared(a: str, b: str) -> int:
    """Turns two sequences begin with."""
    low, high = 0, min(len(a), len(b)) // ITEM
    if a[:high * ITEM] == b[:high * ITEM]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid * ITEM] == b[:mid * ITEM] else (low, mid)
    return low


def node_key(prefix: str) -> str:
    return hashlib.sha256(prefix.encode()).hexdigest()[:32]


_NODES = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends_sha256 string, key string, parent_key string")


def encode_shard(seqs: list[str], n: np.ndarray, low: np.ndarray, ends: list[str],
                 before: int, after: int) -> dict[str, list]:
    """Nodes of the trie of sorted distinct sequences, as columns.

    ``n`` conversations have a sequence, ``low`` is the least of them. ``before`` is the
    number of nodes (root included) that the first sequence shares with the last one of
    the shard to the left, 0 if there is none; ``after`` likewise to the right. Nodes on
    these shared paths have a ``key`` and only this shard's part of their sums; nodes
    right below have the key of their parent.
    """
    sizes = np.array([len(s) // ITEM + 1 for s in seqs])          # nodes on the path
    lcp = np.array([before] + [shared(a, b) + 1 for a, b in zip(seqs, seqs[1:])])
    # closes and opens in turn; the spine from the left is opened again
    held = lcp.copy()
    held[0] = 0
    closed = np.concatenate(([0], sizes[:-1] - held[1:]))
    opened = sizes - held
    counts = np.column_stack((closed, opened)).ravel()
    opens = np.repeat(np.tile([False, True], len(seqs)), counts)
    opens = np.concatenate((opens, np.zeros(sizes[-1], bool)))
    tree = Parens(opens)
    nodes = len(tree.first)
    owner = np.repeat(np.arange(len(seqs)), opened)               # sequence that opens a node
    start = np.cumsum(opened) - opened
    depth = np.arange(nodes) - start[owner] + held[owner]
    last = start + opened - 1                                     # node at a sequence's end

    weight, least = np.zeros(nodes, np.int64), np.full(nodes, np.iinfo(np.int64).max)
    weight[last], least[last] = n, low
    tokens = np.array([int(seqs[i][ITEM * d - 8:ITEM * d], 16) if d else 0
                       for i, d in zip(owner.tolist(), depth.tolist())], np.int64)
    close = tree.find_close(tree.first)
    size = (close - tree.first + 1) // 2
    run = np.arange(nodes)
    total = np.concatenate(([0], np.cumsum(weight)))
    n_convs = total[run + size] - total[run]
    here = run >= before                                          # opened by this shard
    cost = (n_convs - here) * tokens
    total = np.concatenate(([0], np.cumsum(cost)))
    saved = total[run + size] - total[run]
    # the last sequence is no leaf if the next shard goes on below it
    leaves = tree.leaves(tree.first, close)
    if after >= sizes[-1]:
        leaves -= (run <= last[-1]) & (run + size > last[-1])
    parent, path = np.full(nodes, -1, np.int64), np.zeros(int(sizes.max()), np.int64)
    for i in range(len(seqs)):
        path[held[i]:sizes[i]] = np.arange(start[i], last[i] + 1)
        parent[start[i]:last[i] + 1] = np.concatenate(
            ([path[held[i] - 1] if held[i] else -1], path[held[i]:sizes[i] - 1]))
    children = np.bincount(parent[here & (parent >= 0)], minlength=nodes)
    smallest = _range_minimum(least, run, size)

    spine = run < before
    spine[path[:min(after, int(sizes[-1]))]] = True
    keys = [node_key(seqs[i][:ITEM * d]) if s else None
            for i, d, s in zip(owner.tolist(), depth.tolist(), spine.tolist())]
    above = [keys[p] if p >= 0 else None for p in parent.tolist()]
    listed: list = [None] * nodes
    for at, e in zip(last.tolist(), ends):
        listed[at] = e
    mother = [None if p < 0 or k is not None else m for p, k, m in zip(
        parent.tolist(), above, smallest[parent].tolist())]
    return {"depth": depth.tolist(), "conv_id": smallest.tolist(), "parent_conv_id": mother,
            "n_convs": n_convs.tolist(), "n_children": children.tolist(),
            "n_leaves": leaves.tolist(), "saved_tokens": saved.tolist(),
            "ends_sha256": listed, "key": keys, "parent_key": above}


_SORTED = "part int, seq string, n long, low long, ends string"
_TYPES = [pa.int64()] * 7 + [pa.string()] * 3


def _encoder(edges: dict[int, tuple[int, int]]):
    """Encode the shards of a task one after another; each is one part of the sort."""
    def encode(rows: list) -> pa.RecordBatch:
        part = rows[0][0]
        found = encode_shard([r[1] for r in rows], np.array([r[2] for r in rows]),
                             np.array([r[3] for r in rows]), [r[4] for r in rows], *edges[part])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(found.values(), _TYPES)], list(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != row[0]:
                    yield encode(held)
                    held = []
                held.append(row)
        if held:
            yield encode(held)
    return run


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows as lists of bounded size."""
    names = ["key", "first", "ids"]
    key, first, ids, held = None, None, [], 0
    for batch in batches:
        out = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != key or held >= PIECE_BYTES):
                out.append((key, first, ",".join(ids)))
                ids, held = [], 0
            if not ids:
                key, first = k, c
            ids.append(str(c))
            held += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))
    if ids:
        yield pa.RecordBatch.from_pydict(dict(zip(names, ([key], [first], [",".join(ids)]))))


def _hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key over its lists in order, a list at a time."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("key", "ends"), map(list, zip(*out)))))
    if state is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends": [state.hexdigest()]})


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ascending decimal ids of each key, comma-joined.

    Ids of one key are listed by many tasks and only the lists meet in one, which
    streams them: its memory does not grow, its time does, as a digest has one order.
    """
    tasks = max(1, math.ceil(members.count() / (1 << 20)))
    lists = members.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions(
        "key", "conv_id").mapInArrow(_listing, "key string, first long, ids string")
    return lists.repartition(tasks, "key").sortWithinPartitions("key", "first").mapInArrow(
        _hashing, "key string, ends string")


def turn_items(turns: DataFrame) -> DataFrame:
    """``conv_id, items``: a conversation's turns in order, each as one item.

    By turn, null first; turns with equal numbers go by their hash, so that reruns agree.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length of the role keeps (a, bc) and (ab, c) apart
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    item = F.concat(F.substring(F.sha2(whole, 256), 1, 32),
                    F.lower(F.lpad(F.hex(F.length(text)), 8, "0")))
    said = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", item.alias(
        "item")).alias("turn"))
    return said.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select(
        "conv_id", F.col("turns.item").alias("items"))


def rebuilt(items: DataFrame, every: int = 100, modulus: int = 6) -> DataFrame:
    """``conv_id, seq``: the first h turns of conversation ``c - c % every``, then c's after its h.

    h is the unsigned CRC-32 of the decimal id modulo ``modulus``.
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(every))
    heads = items.where(F.pmod("conv_id", F.lit(every)) == 0).select(
        F.col("conv_id").alias("base"), F.slice("items", 1, max(modulus - 1, 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    own = F.expr("slice(items, h + 1, greatest(size(items) - h, 0))")
    return items.withColumn("base", base).withColumn("h", h).join(heads, "base", "left").select(
        "conv_id", F.array_join(F.concat(
            F.coalesce(F.expr("slice(head, 1, h)"), F.array().cast("array<string>")), own), "")
        .alias("seq"))


def trie(members: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the sequences in ``conv_id, seq``, the root included.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. No members, no rows; an
    empty sequence ends at the root.
    """
    members = materialize(members.select("conv_id", "seq", F.substring(
        F.sha2("seq", 256), 1, 32).alias("key")), "members")
    ends = materialize(_ends(members.select("key", "conv_id")), "ends")
    whole = members.groupBy("key", "seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
    distinct = materialize(whole.join(ends, "key").select("seq", "n", "low", "ends"), "sequences")
    turns = distinct.agg(F.sum(F.length("seq") / ITEM + 1)).first()[0] or 0
    shards = max(1, math.ceil(turns / shard_turns))
    parts = materialize(distinct.repartitionByRange(shards, "seq").sortWithinPartitions("seq").select(
        F.spark_partition_id().alias("part"), "seq", "n", "low", "ends"), "sorted")
    borders = sorted(parts.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias(
        "last")).collect())
    meet = [shared(a.last, b.first) + 1 for a, b in zip(borders, borders[1:])]
    edges = {b.part: pair for b, pair in zip(borders, zip([0, *meet], [*meet, 0]))}
    if not edges:
        return _finished(parts.sparkSession.createDataFrame([], _NODES))
    nodes = materialize(parts.repartition(shards, "part").sortWithinPartitions("part", "seq")
                        .mapInArrow(_encoder(edges), _NODES), "nodes")
    spine = materialize(nodes.where("key IS NOT NULL").groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"), F.max("parent_key").alias("parent_key")), "spine")
    every = nodes.where("key IS NULL").drop("key").unionByName(
        spine.withColumn("parent_conv_id", F.lit(None).cast("long")).drop("key"))
    # a parent of very many children is dealt over SALTS parts of the join
    above = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"),
                         F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    inner = every.where("parent_key IS NULL")
    hung = every.where("parent_key IS NOT NULL").withColumn(
        "salt", F.pmod(F.hash("conv_id"), F.lit(SALTS))).join(
        above, ["parent_key", "salt"]).withColumn("parent_conv_id", F.col("above"))
    return _finished(inner.unionByName(hung.select(*inner.columns)))


def _finished(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of all rebuilt conversations.

    ``turns`` needs ``conv_id, turn, role, text``; other columns are ignored. Null role or
    text is empty, rows without ``conv_id`` are no conversation, repeated rows are turns
    of their own. An empty table gives no rows. A conversation is one row of 40 bytes per
    turn from here on, so one of a million turns takes 40 MB in a task.
    """
    return trie(rebuilt(turn_items(turns)), shard_turns)
