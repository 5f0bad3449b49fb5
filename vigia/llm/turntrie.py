"""Prefix trie of conversations: which turns many conversations share from their beginning.

Every turn gets a fixed-width id (16 bytes of its SHA-256, compared as a big-endian number), a conversation's key is
its turns' ids one after the other, and keys in byte order are dealt to tasks in ranges of (key, conversation).
A task takes its sorted keys in blocks of bounded size and puts each block into an adaptive radix tree: nodes of 4,
16, 48 or 256 children that grow with use, one-way paths compressed into their lower node. Only byte depths that
end a turn are nodes of the conversation trie.

Nodes that begin and end inside a block are finished there. The others lie on the path of the block's first or last
key; each block gives its share of them, and the shares add up: conversations, leaves, tokens, and children counted
where they begin. Inside a task the next block knows the last key; between tasks one row a task (first and last key)
tells which nodes were begun twice and which last key was no leaf after all. So no task needs a whole subtree, and a
first turn, a conversation or a group of copies that fills a third of the table is spread over as many tasks as its
rows need. Ids that end at a node are hashed as a stream in order; those of a node that lies in several tasks, or
has very many, travel as joined pieces and are hashed in one pass of bounded memory, which SHA-256 demands.

Defined results: rows without conv_id take no part; a null turn comes first, and turns with the same number stand in
the order of their ids; null role or text is empty; repeated rows are turns of their own; a conversation is one row
(24 bytes a turn), texts of any length only pass through a hash; an empty table has no nodes; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vigia.llm.common import small_batches, stage

WIDTH = 16
BLOCK_KEYS, BLOCK_BYTES, PIECE_TEXT = 4_096, 4 << 20, 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD_GAP = r"[\x20\x09-\x0D]+"


# ---------------------------------------------------------------- adaptive radix tree

class Node:
    """Inner or leaf node. ``prefix`` is the compressed path behind the byte that leads here; ``value`` belongs to
    the key that ends here. Up to 4 and 16 children stand in sorted arrays, up to 48 behind a table of 256 slot
    numbers, beyond that in a table of 256 children."""

    __slots__ = ("prefix", "value", "layout", "bytes", "kids")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value, self.layout, self.bytes, self.kids = prefix, value, 4, bytearray(), []

    def child(self, byte: int):
        if self.layout <= 16:
            at = bisect_left(self.bytes, byte)
            return self.kids[at] if at < len(self.bytes) and self.bytes[at] == byte else None
        if self.layout == 48:
            slot = self.bytes[byte]
            return self.kids[slot - 1] if slot else None
        return self.kids[byte]

    def add(self, byte: int, node: "Node") -> None:
        if self.layout <= 16 and len(self.kids) == self.layout or self.layout == 48 and len(self.kids) == 48:
            self._grow()
        if self.layout <= 16:
            at = bisect_left(self.bytes, byte)
            self.bytes.insert(at, byte)
            self.kids.insert(at, node)
        elif self.layout == 48:
            self.kids.append(node)
            self.bytes[byte] = len(self.kids)
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            slots = bytearray(256)
            for slot, byte in enumerate(self.bytes, 1):
                slots[byte] = slot
            self.layout, self.bytes = 48, slots
        else:
            self.layout, self.kids, self.bytes = 256, [self.kids[s - 1] if s else None for s in self.bytes], bytearray()

    def ordered(self) -> Iterator["Node"]:
        if self.layout == 48:
            return (self.kids[s - 1] for s in self.bytes if s)
        return (k for k in self.kids if k is not None)


def insert(root: Node, key: bytes, value) -> None:
    node, at = root, 0
    while True:
        path = node.prefix
        if key.startswith(path, at):
            at += len(path)
        else:  # the path parts here: what is below moves into a new child
            same = shared(path, key[at:at + len(path)])
            below = Node(path[same + 1:], node.value)
            below.layout, below.bytes, below.kids = node.layout, node.bytes, node.kids
            node.prefix, node.value, node.layout, node.bytes, node.kids = path[:same], None, 4, bytearray(), []
            node.add(path[same], below)
            at += same
        if at == len(key):
            node.value = value
            return
        child = node.child(key[at])
        if child is None:
            node.add(key[at], Node(key[at + 1:], value))
            return
        node, at = child, at + 1


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


# ---------------------------------------------------------------- one block of sorted keys

class Group:
    """All conversations of one key that a task has: the smallest id, how many, and the ids' text so far."""

    __slots__ = ("key", "words", "conv", "n", "ids", "size", "from_id", "ends", "split")

    def __init__(self, key: bytes, words: list[int], conv: int):
        self.key, self.words, self.conv, self.n = key, words, conv, 0
        self.ids, self.size, self.from_id, self.ends, self.split = [], 0, conv, None, False


class Sum:
    """What lies below a byte depth: turn nodes that wait for their parent, and what they add to it."""

    __slots__ = ("n", "conv", "children", "leaves", "saved", "waiting", "some", "first", "last", "sample")

    def __init__(self):
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.waiting, self.some, self.first, self.last, self.sample = None, [], False, False, False, None

    def take(self, other: "Sum") -> None:
        self.n += other.n
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.conv = other.conv if self.conv is None else min(self.conv, other.conv)
        self.waiting += other.waiting
        self.some |= other.some
        self.first |= other.first
        self.last |= other.last
        self.sample = self.sample or other.sample


def path_ids(key: bytes, depth: int) -> list[bytes]:
    """Identity of the nodes at depths 0..depth of a key's path."""
    state, out = hashlib.sha256(), []
    for t in range(depth + 1):
        if t:
            state.update(key[(t - 1) * WIDTH:t * WIDTH])
        out.append(state.copy().digest()[:WIDTH])
    return out


def block_nodes(groups: list[Group], before: bytes | None, after: bytes | None) -> list[dict]:
    """Rows of one block's nodes. ``before`` and ``after``: the keys around it, None at the task's ends."""
    first, last = groups[0], groups[-1]
    begun_to = -1 if before is None else shared(before, first.key) // WIDTH  # these depths began earlier
    open_first = len(first.key) // WIDTH if before is None else begun_to
    open_last = len(last.key) // WIDTH if after is None or last.split else shared(after, last.key) // WIDTH
    goes_on = after is not None and after.startswith(last.key)
    first_ids, last_ids = path_ids(first.key, open_first), path_ids(last.key, open_last)
    rows: list[dict] = []

    def identity(s: Sum, t: int) -> bytes | None:
        if s.first and t <= open_first:
            return first_ids[t]
        return last_ids[t] if s.last and t <= open_last else None

    def close(s: Sum, t: int, group: Group | None) -> Sum:
        """The turn node at depth ``t``, with the key that ends there; what it adds to its parent."""
        begun = not (s.first and t <= begun_to)
        words = s.sample.words[t - 1] if t else 0
        leaf = group is not None and not s.some and not (group is last and goes_on)
        ident = identity(s, t)
        row = {"kind": "node" if ident is None else "part", "ident": ident, "depth": t, "conv_id": s.conv,
               "n_convs": s.n, "n_children": s.children, "n_leaves": s.leaves + leaf,
               "saved": s.saved + s.n * words - (words if begun else 0), "ends": group.ends if group else None,
               "parent": identity(s, t - 1) if ident is not None and t else None, "parent_conv": None}
        for child in s.waiting:
            if ident is None:
                child["parent_conv"] = s.conv
            elif child["kind"] == "node":
                child["parent"] = ident
        rows.append(row)
        up = Sum()
        up.take(s)
        up.children, up.leaves, up.saved, up.waiting, up.some = int(begun), row["n_leaves"], row["saved"], [row], True
        return up

    root = Node(b"")
    for group in groups:
        insert(root, group.key, group)
    total = Sum()
    stack = [(root, -1, len(root.prefix), root.ordered(), Sum())]
    while stack:
        node, start, end, kids, s = stack[-1]
        kid = next(kids, None)
        if kid is not None:
            stack.append((kid, end, end + 1 + len(kid.prefix), kid.ordered(), Sum()))
            continue
        stack.pop()
        group = node.value
        if group is not None:
            own = Sum()
            own.n, own.conv, own.sample, own.first, own.last = group.n, group.conv, group, group is first, group is last
            s.take(own)
        for t in range(end // WIDTH, start // WIDTH, -1):  # -1 for the root, whose depth 0 is a node
            s = close(s, t, group if t * WIDTH == end else None)
        (stack[-1][4] if stack else total).take(s)
    return rows


# ---------------------------------------------------------------- one task

ROW = ("kind string, ident binary, parent binary, depth long, conv_id long, parent_conv long, n_convs long, n_children long, "
       "n_leaves long, saved long, ends string, body binary, tail binary, words array<long>")
ARROW = pa.schema([("kind", pa.string()), ("ident", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()),
                   ("conv_id", pa.int64()), ("parent_conv", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                   ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("body", pa.binary()),
                   ("tail", pa.binary()), ("words", pa.list_(pa.int64()))])


def task_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task's range of (key, conversation), in order."""
    held: list[Group] = []  # a block in the making; its last group may still grow
    out: list[dict] = []
    state = {"before": None, "bytes": 0}
    very_first: Group | None = None

    def text(group: Group) -> None:
        if group.ids:
            out.append({"kind": "text", "ident": path_ids(group.key, len(group.key) // WIDTH)[-1], "conv_id": group.from_id,
                        "body": ",".join(map(str, group.ids)).encode()})
        group.ids, group.size, group.split = [], 0, True

    def finish(group: Group) -> None:
        if group.split or group is very_first:
            text(group)
        else:
            group.ends, group.ids = hashlib.sha256(",".join(map(str, group.ids)).encode()).hexdigest(), []

    def cut(after: bytes | None) -> None:
        out.extend(block_nodes(held, state["before"], after))
        state.update(before=held[-1].key, bytes=0)
        held.clear()

    for batch in batches:
        for key, conv, words in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "words"))):
            if not held or held[-1].key != key:
                if held:
                    finish(held[-1])
                    if len(held) >= BLOCK_KEYS or state["bytes"] >= BLOCK_BYTES or held[-1].split and held[-1] is not very_first:
                        cut(key)
                held.append(Group(key, words, conv))
                very_first = very_first or held[-1]
                state["bytes"] += len(key)
            group = held[-1]
            if not group.ids:
                group.from_id = conv
            group.n += 1
            group.ids.append(conv)
            group.size += 20
            if group.size >= PIECE_TEXT:
                text(group)
        if len(out) >= BLOCK_KEYS:
            yield pa.RecordBatch.from_pylist(out, ARROW)
            out.clear()
    if held:
        last = held[-1]
        text(last)
        cut(None)
        out.append({"kind": "edge", "conv_id": very_first.conv, "body": very_first.key, "tail": last.key, "words": very_first.words})
    if out:
        yield pa.RecordBatch.from_pylist(out, ARROW)


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What neighbouring tasks counted twice, from their first and last keys in order."""
    tail = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if tail is not None:
                both = shared(tail, row["body"]) // WIDTH
                no_leaf = row["body"].startswith(tail)
                ids, saved = path_ids(tail, len(tail) // WIDTH if no_leaf else both), 0
                for t in range(len(ids) - 1, -1, -1):
                    saved += row["words"][t - 1] if 0 < t <= both else 0
                    out.append({"kind": "part", "ident": ids[t], "depth": t, "parent": ids[t - 1] if t else None, "n_convs": 0,
                                "n_children": -int(t < both), "n_leaves": -int(no_leaf), "saved": saved})
            tail = row["tail"]
        if out:
            yield pa.RecordBatch.from_pylist(out, ARROW)


def text_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each identity's pieces, which come in order."""
    now, state = None, None
    for batch in batches:
        done = []
        for ident, body in zip(batch.column("ident").to_pylist(), batch.column("body").to_pylist()):
            if ident == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = ident, hashlib.sha256()
            state.update(body)
        if done:
            yield _pairs(done)
    if now is not None:
        yield _pairs([(now, state.hexdigest())])


def _pairs(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["ident", "sha"])


# ---------------------------------------------------------------- tables

def turn_keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, with id (hex) and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH).alias("id"),
        F.size(F.array_remove(F.split(text, WORD_GAP), "")).cast("long").alias("words"))
    return (turns.withColumn("base", F.expr("conv_id - conv_id % 20")).repartition("base").groupBy("base", "conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("turns")))


def keyed_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, key, words) of conversations as they are."""
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
                        F.transform("turns", lambda t: t["words"]).alias("words"))


def with_borrowed_beginnings(turns: DataFrame) -> DataFrame:
    """Conversations rebuilt: the first h turns of the conversation whose id ends the last step of 20, then the own
    turns behind the first h; h is crc32 of the decimal id modulo 4."""
    lead = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 3))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    return (turns.withColumns({"lead": lead, "h": h})
            .withColumn("turns", F.concat(F.coalesce(F.slice("lead", F.lit(1), F.col("h")), F.slice("turns", 1, 0)),
                                          F.slice("turns", F.col("h") + 1, F.size("turns"))))
            .select("conv_id", "turns"))


def trie_nodes(keyed: DataFrame) -> DataFrame:
    """Every node of the trie over (conv_id, key, words): conv_id is the smallest member and with depth names the node."""
    keyed = stage(keyed, "keys")  # ranges are sampled from it, then dealt
    small_batches(keyed.sparkSession)
    rows = stage(keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(task_rows, ROW),
                 "trie_rows")
    edges = rows.where("kind = 'edge'").select("conv_id", "body", "tail", "words")
    fixes = edges.repartition(1).sortWithinPartitions("body", "conv_id").mapInArrow(corrections, ROW)
    hashes = (rows.where("kind = 'text'").select("ident", "conv_id", "body").repartition("ident")
              .sortWithinPartitions("ident", "conv_id").mapInArrow(text_hashes, "ident binary, sha string"))
    shared_nodes = rows.where("kind = 'part'").unionByName(fixes).groupBy("ident").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("ends").alias("ends"))
    shared_nodes = stage(shared_nodes.join(hashes, "ident", "left").withColumn("ends", F.coalesce("sha", "ends")).drop("sha"),
                         "shared_nodes")
    parents = shared_nodes.select(F.col("ident").alias("parent"), F.col("conv_id").alias("parent_conv"))
    columns = ("conv_id", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends")
    closed = rows.where("kind = 'node'")
    nodes = closed.where("parent is null").select(*columns)
    for more in (closed.where("parent is not null").drop("parent_conv").join(parents, "parent"),
                 shared_nodes.join(parents, "parent", "left")):
        nodes = nodes.unionByName(more.select(*columns))
    return nodes.select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, rebuilt: bool = False) -> DataFrame:
    """Nodes of the trie over all conversations, as they are or rebuilt with borrowed beginnings."""
    turns = turn_keys(conversations)
    return trie_nodes(keyed_conversations(with_borrowed_beginnings(turns) if rebuilt else turns))
