"""A trie of conversations' turns: which beginnings conversations share, and what sharing saves.

Each turn becomes a digest of 128 bits, and a conversation the digests' binary
concatenation, so that order as binary is the order of turn arrays.  Conversations
are dealt by ranges of (turns, id) and sorted.  A task sweeps over its rows with a
stack: the common prefix of neighbours says which open nodes end, and a node that
ends hands its sums to the one below.  Equal conversations are ordered by id, so a
group of copies is cut between tasks like anything else.

The nodes of a task's first and last row may go on in other tasks.  They leave the
task as parts, and one more sweep, over the parts alone, stitches the open stacks
in the order of tasks: as many rows as tasks times the turns of two conversations.
Ids that end at such a node leave in pieces and are hashed in order, by node.  A
parent's id is known only when it ends itself, so it is joined in at last.

A conversation is one row, of 16 bytes and a number for each turn.

Defined results: turns without a conversation's id are left out; null turn numbers
come first, and turns of equal number are ordered by their digests; a null role or
text is an empty one; repeated rows are turns each; a very long text only adds its
digest; an empty table has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import materialize, words_of

#: Bytes of a turn's digest.
WIDTH = 16
#: Ids of a piece, and rows that a task hands back at a time.
PIECE, HANDED = 8192, 4096
ROOT = bytes(WIDTH)
NOTHING = hashlib.sha256(b"").hexdigest()
_SWEPT = {
    "kind": "string", "part": "int", "seq": "int", "depth": "int", "left": "boolean", "right": "boolean", "id": "binary", "parent": "binary", "conv_id": "long",
    "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved": "long", "words": "long", "ends": "string", "ids": "binary",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in _SWEPT.items())


def turn_arrays(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of a digest in hexadecimal and the text's number of words."""
    name, body = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    digest = F.left(F.sha2(F.concat(F.length(name).cast("string"), F.lit(":"), name, body), 256), F.lit(2 * WIDTH))
    one = F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.size(words_of(body)).alias("words"))
    known = rows.where(F.col(f"`{conv}`").isNotNull()).groupBy(F.col(f"`{conv}`").cast("long").alias("conv_id"))
    ordered = known.agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


class Node:
    """An open node: what its ended children and its own conversations add up to."""

    __slots__ = ("children", "conv", "depth", "ends", "id", "leaves", "left", "n", "parent", "pending", "saved", "seq", "sha", "words")

    def __init__(self, depth: int, key: bytes, parent: bytes | None, words: int, left: bool = False) -> None:
        self.depth, self.id, self.parent, self.words, self.left = depth, key, parent, words, left
        self.conv: int | None = None
        self.n = self.children = self.leaves = self.saved = self.seq = 0
        self.sha, self.ends, self.pending = None, None, []

    def meet(self, conv: int | None, n: int) -> None:
        """Count ``n`` conversations of which ``conv`` is the smallest."""
        self.n += n
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv

    def total(self) -> tuple[int, int]:
        """Leaves and saved words of the whole subtree, once it has ended."""
        return self.leaves or 1, self.saved + (self.n - 1) * self.words

    def take(self, child: Node) -> None:
        """Add a child that has ended."""
        leaves, saved = child.total()
        self.meet(child.conv, child.n)
        self.children, self.leaves, self.saved = self.children + 1, self.leaves + leaves, self.saved + saved

    def row(self, kind: str, **more) -> dict:
        leaves, saved = self.total() if kind == "node" else (self.leaves, self.saved)
        own = {"depth": self.depth, "id": self.id, "parent": self.parent, "conv_id": self.conv, "n_convs": self.n, "n_children": self.children, "n_leaves": leaves, "saved": saved, "words": self.words, "ends": self.ends}
        return own | {"kind": kind} | more


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in held], _ARROW[t]) for k, t in _SWEPT.items()], names=list(_SWEPT))

    for row in rows:
        held.append(row)
        if len(held) == HANDED:
            yield batch()
            held = []
    if held:
        yield batch()


def _shared_turns(a: bytes, b: bytes) -> int:
    """How many whole turns two keys begin with in common."""
    if a == b:
        return len(a) // WIDTH
    most = min(len(a), len(b)) // WIDTH
    low, high = 0, most  # the common prefix has low turns at least and high at most
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def sweep(part: int, rows: Iterator[tuple[int, bytes, list[int]]], piece_ids: int = PIECE) -> Iterator[dict]:
    """Nodes that begin and end among sorted rows, parts of those that may not, and pieces of ids."""
    stack: list[Node] = []
    before: bytes | None = None
    deepest: Node | None = None  # of the first row: ids may have ended there before

    def piece(node: Node) -> dict:
        ids = ",".join(map(str, node.pending)).encode()
        if node.sha is None:
            node.sha = hashlib.sha256(ids)
        else:
            node.sha.update(b"," + ids)
        node.pending, node.seq = [], node.seq + 1
        return {"kind": "piece", "part": part, "seq": node.seq, "id": node.id, "ids": ids}

    def end(node: Node, right: bool) -> Iterator[dict]:
        open_run = node is deepest or (right and node is stack[-1])
        if node.pending:
            last = piece(node)
            if open_run:
                yield last
        node.ends = None if open_run else node.sha.hexdigest() if node.sha else None
        if node.left or right:
            yield node.row("part", part=part, left=node.left, right=right)
        else:
            yield node.row("node")

    for conv, key, words in rows:
        depth = len(key) // WIDTH
        common = -1 if before is None else _shared_turns(before, key)
        while len(stack) > common + 1:
            node = stack[-1]
            yield from end(node, False)
            stack.pop()
            if not node.left:
                stack[-1].take(node)
        for d in range(common + 1, depth + 1):
            name = hashlib.blake2b(stack[-1].id + key[(d - 1) * WIDTH : d * WIDTH], digest_size=WIDTH).digest() if d else ROOT
            stack.append(Node(d, name, stack[-1].id if d else None, words[d - 1] if d else 0, left=before is None))
        if before is None:
            deepest = stack[-1]
        top = stack[-1]
        top.meet(conv, 1)
        top.pending.append(conv)
        if len(top.pending) == piece_ids:
            yield piece(top)
        before = key
    for node in stack:
        yield from end(node, True)


def stitch(parts: Iterator[tuple[int, list[dict]]]) -> Iterator[dict]:
    """Whole nodes of the parts of all tasks, given in the tasks' order, each task's by (right alone, depth)."""
    stack: list[Node] = []

    def opened(r: dict) -> Node:
        node = Node(r["depth"], r["id"], r["parent"], r["words"])
        merge(node, r)
        return node

    def merge(node: Node, r: dict) -> None:
        node.meet(r["conv_id"], r["n_convs"])
        node.children, node.leaves, node.saved = node.children + r["n_children"], node.leaves + r["n_leaves"], node.saved + r["saved"]
        node.ends = node.ends or r["ends"]

    def shrink(size: int) -> Iterator[dict]:
        while len(stack) > size:
            node = stack.pop()
            yield node.row("node")
            if stack:
                stack[-1].take(node)

    for _, rows in parts:
        first, both = [r for r in rows if r["left"]], sum(r["left"] and r["right"] for r in rows)
        common = 0
        while common < min(len(stack), len(first)) and stack[common].id == first[common]["id"]:
            common += 1
        yield from shrink(common)
        for node, r in zip(stack, first):
            merge(node, r)
        stack += [opened(r) for r in first[common:]]
        yield from shrink(both)
        stack += [opened(r) for r in rows if not r["left"]]
    yield from shrink(0)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def prefix_trie(conversations: DataFrame, piece_ids: int = PIECE) -> DataFrame:
    """The nodes of (conv_id, turns), as ``turn_arrays`` makes them.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), all
    numbers long: the smallest conversation that begins with the node's turns, their number, the
    smallest of its parent (null for the root), how many begin so, how many turns follow next, the
    childless nodes of the subtree, (n_convs - 1) times the words of the last turn summed over the
    subtree, and the SHA-256 of the ids of conversations that end there.
    ``piece_ids`` ids at most of a node that may go on are handed over at a time.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    order = ["key", "conv_id"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((c, k, w) for b in batches for c, k, w in zip(*(b.column(n).to_pylist() for n in ("conv_id", "key", "words"))))
        yield from _batches(sweep(TaskContext.get().partitionId(), given, piece_ids))

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def by_part() -> Iterator[tuple[int, list[dict]]]:
            held: list[dict] = []
            for r in _rows_of(batches):
                if held and held[0]["part"] != r["part"]:
                    yield held[0]["part"], held
                    held = []
                held.append(r)
            if held:
                yield held[0]["part"], held

        yield from _batches(stitch(by_part()))

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, now, sha = [], [], None, None
        for r in _rows_of(batches):
            if r["id"] != now:
                if sha:
                    ids.append(now)
                    found.append(sha.hexdigest())
                now, sha = r["id"], hashlib.sha256(r["ids"])
            else:
                sha.update(b"," + r["ids"])
        if sha:
            ids.append(now)
            found.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.string())], names=["id", "sha"])

    swept = materialize(ranges.mapInArrow(run, _SCHEMA), "swept")
    parts = swept.where("kind = 'part'").coalesce(1).sortWithinPartitions("part", ~F.col("left"), "depth")
    open_nodes = materialize(parts.mapInArrow(join_parts, _SCHEMA), "stitched")
    pieces = swept.where("kind = 'piece'").select("id", "part", "seq", "ids").join(open_nodes.where("ends is null").select("id"), "id", "left_semi")
    hashed = pieces.repartition("id").sortWithinPartitions("id", "part", "seq").mapInArrow(hash_pieces, "id binary, sha string")
    columns = ["id", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    stitched = open_nodes.join(hashed, "id", "left").withColumn("ends", F.coalesce("ends", "sha"))
    nodes = swept.where("kind = 'node'").select(columns).unionByName(stitched.select(columns))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")
    )
