"""Repair of damaged conversations by a dynamic program over edits.

The rows of a conversation are read in order. After each row the program keeps
the cheapest edits that lead to each state of the turn grammar, and of equally
cheap ones those whose initials are least. Edits are linked nodes: candidates
share all of their prefixes, so a step makes a few nodes however long the
conversation is. A node knows its ancestors at distances of powers of two and
a rolling hash of the initials from the root; two equally cheap candidates are
compared by searching their longest common prefix through those ancestors, and
nodes with equal hashes are compared initial by initial.

Rows stream through a task in sorted order. Once all states share a prefix it
is written out and its nodes are let go, and a state that no longer can win is
dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperspark.llm.common import SPACE_CHARS, prepare

# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# The state after a turn whose role has this initial.
AFTER = {
    "s": {NOTHING: SYSTEM},
    "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
# The role that an edit must give in each state to go on.
NEXT_ROLE = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LEGAL_PAIRS = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
# What it costs at most to finish from one state (first) as another (second)
# would have finished: system rows are deleted, missing turns inserted.
MIMIC = {
    NOTHING: {SYSTEM: 0, USER: 3, ASSISTANT: 0},
    SYSTEM: {NOTHING: 6, USER: 3, ASSISTANT: 6},
    USER: {NOTHING: 7, SYSTEM: 3, ASSISTANT: 3},
    ASSISTANT: {NOTHING: 4, SYSTEM: 0, USER: 3},
}

HASH_BASE, HASH_PRIME = 1_000_003, (1 << 61) - 1
# Nodes made before the common prefix is first looked for.
SETTLE_AFTER = 2048

OUT = ("conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
       "audit string, repaired_sha256 string")


class Node:
    """One edit after a prefix of edits. ``ups[j]`` is the ancestor 2^j above."""

    __slots__ = ("initial", "depth", "hash", "ups")

    def __init__(self, parent: Node | None, initial: str, depth: int = 0, hash_: int = 0):
        self.initial = initial
        if parent is None:
            self.depth, self.hash, self.ups = depth, hash_, ()
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * HASH_BASE + ord(initial)) % HASH_PRIME
        ups, up, j = [], parent, 0
        while True:
            ups.append(up)
            if j >= len(up.ups):
                break
            up = up.ups[j]
            j += 1
        self.ups = tuple(ups)

    @property
    def parent(self) -> Node:
        return self.ups[0]


def equal(a: Node, b: Node) -> bool:
    """Whether two nodes of one depth stand for the same initials."""
    if a.hash != b.hash:
        return False
    while a is not b:
        if a.initial != b.initial:
            return False
        a, b = a.parent, b.parent
    return True


def ancestor(node: Node, depth: int) -> Node:
    while (up := node.depth - depth) > 0:
        node = node.ups[min(up.bit_length(), len(node.ups)) - 1]
    return node


def less(a: Node, b: Node) -> bool:
    """Whether the initials of ``a`` come before those of ``b``."""
    shared = min(a.depth, b.depth)
    x, y = ancestor(a, shared), ancestor(b, shared)
    if equal(x, y):
        return a.depth < b.depth
    # The longest common prefix: climb as long as the ancestors differ.
    for j in range(max(len(x.ups), len(y.ups)) - 1, -1, -1):
        if j < len(x.ups) and j < len(y.ups) and not equal(x.ups[j], y.ups[j]):
            x, y = x.ups[j], y.ups[j]
    return x.initial < y.initial


class Best:
    """Cost, edits and the digest of the turns they give."""

    __slots__ = ("cost", "node", "digest")

    def __init__(self, cost: int, node: Node, digest):
        self.cost, self.node, self.digest = cost, node, digest


class Repair:
    """The program over one conversation's rows."""

    def __init__(self):
        self.root = Node(None, "")
        self.settled: list[str] = []
        self.made, self.settle_at = 0, SETTLE_AFTER
        self.states: dict[int, Best] = {NOTHING: Best(0, self.root, hashlib.sha256())}
        self.insert()

    def offer(self, found: dict, state: int, cost: int, old: Best, initial: str, turn: tuple | None,
              first: bool) -> None:
        """Keep an edit after ``old`` if it is the best way to ``state``."""
        have = found.get(state)
        if have is not None and have[0] < cost:
            return
        node = Node(old.node, initial)
        self.made += 1
        if have is None or cost < have[0] or less(node, have[1]):
            found[state] = (cost, node, old.digest, turn, first)

    @staticmethod
    def taken(found: dict) -> dict[int, Best]:
        """The offers as states; a digest is extended only for winners."""
        out = {}
        for state, (cost, node, digest, turn, first) in found.items():
            if turn is not None:
                digest = digest.copy()
                if not first:
                    digest.update(b"\n")
                for part in turn:
                    digest.update(part)
            out[state] = Best(cost, node, digest)
        return out

    def insert(self) -> None:
        """Inserted turns after the edits so far: two at most, because three
        of them come back to a state that was there for less."""
        for to, sources in ((USER, (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            found: dict = {}
            if to in self.states:
                old = self.states[to]
                found[to] = (old.cost, old.node, old.digest, None, False)
            for state in sources:
                old = self.states.get(state)
                if old is not None:
                    self.offer(found, to, old.cost + INSERT_COST, old, INSERT,
                               (NEXT_ROLE[state].encode(), b":"), state == NOTHING)
            self.states |= self.taken(found)

    def row(self, role: str, text: str, fault: str) -> None:
        found: dict = {}
        extra = TRUNCATED_COST if fault == "t" else 0
        for state, old in self.states.items():
            self.offer(found, state, old.cost + DELETE_COST, old, DELETE, None, False)
            if fault in ("b", "d"):
                continue
            body, first = (b":", text.encode("utf-8", "surrogatepass")), state == NOTHING
            to = AFTER.get(role[:1], {}).get(state)
            if to is not None:
                self.offer(found, to, old.cost + extra, old, KEEP,
                           (role.encode("utf-8", "surrogatepass"), *body), first)
            goes = NEXT_ROLE[state]
            self.offer(found, AFTER[goes[0]][state], old.cost + REROLE_COST + extra, old, REROLE,
                       (goes.encode(), *body), first)
        self.states = self.taken(found)
        self.insert()
        costs = {s: b.cost for s, b in self.states.items()}
        for state in list(self.states):
            if any(costs[s] + MIMIC[s][state] < costs[state] for s in costs if s != state):
                del self.states[state]
        if self.made >= self.settle_at:
            self.settle()

    def settle(self) -> None:
        """Write out the prefix that all states share and let its nodes go."""
        heads = [b.node for b in self.states.values()]
        chain = {id(n): n for n in heads}
        while len({id(n) for n in heads}) > 1:
            deepest = max(heads, key=lambda n: n.depth)
            heads = [n.parent if n is deepest else n for n in heads]
            chain |= {id(n): n for n in heads}
        shared = heads[0]
        if shared is not self.root:
            self.settled.append(self.initials(shared))
            kept = sorted((n for n in chain.values() if n is not shared), key=lambda n: n.depth)
            fresh = {id(shared): Node(None, "", shared.depth, shared.hash)}
            for n in kept:
                fresh[id(n)] = Node(fresh[id(n.parent)], n.initial)
            for best in self.states.values():
                best.node = fresh[id(best.node)]
            self.root = fresh[id(shared)]
        # The next search waits until its cost is small against new nodes.
        self.made, self.settle_at = 0, SETTLE_AFTER + 4 * len(chain)

    def initials(self, node: Node) -> str:
        out = []
        while node is not self.root:
            out.append(node.initial)
            node = node.parent
        return "".join(reversed(out))

    def result(self) -> tuple[int, str, str]:
        """Cost, initials and digest of the best edits that end the grammar."""
        ends = [self.states[s] for s in (NOTHING, ASSISTANT) if s in self.states]
        best = min(ends, key=lambda b: b.cost)
        if len(ends) == 2 and ends[0].cost == ends[1].cost:
            best = ends[0] if less(ends[0].node, ends[1].node) else ends[1]
        return best.cost, "".join([*self.settled, self.initials(best.node)]), best.digest.hexdigest()


class Conversation:
    """Counts and repair of one conversation, fed row by row."""

    def __init__(self):
        self.repair = Repair()
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.faults = {"b": 0, "d": 0, "t": 0, "": 0}

    def row(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.last is not None and self.last + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.last = role[:1]
        self.faults[fault] += 1
        self.repair.row(role, text, fault)

    def values(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        f = self.faults
        return (gaps, f["b"], f["d"], f["t"], self.illegal, *self.repair.result())


def columns(conv: str, turn: str, role: str, text: str) -> list[Column]:
    """The four columns, with a null role or text as one space."""
    return [F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")]


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Damages rows by crc32(``conv_id:turn``) mod 20 (nulls: one space).

    Returns ``conv_id, turn, role, text, gone``: 0 marks the row as gone, 1
    empties the text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats the row
    with its turn, 4 sets the role user; others stay as they are.
    """
    part = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")}
    rows = turns.select(*columns(conv, turn, role, text))
    rows = rows.withColumn("kind", F.crc32(F.concat(part["conv_id"], F.lit(":"), part["turn"]).cast("binary")) % 20)
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias("gone"))


def trimmed(text: Column) -> Column:
    """Without the white space at the end."""
    return F.rtrim(text, F.lit(SPACE_CHARS))


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every
    conversation of ``rows(conv_id, turn, role, text[, gone])``.

    Rows are ordered by turn (nulls first), role and text, so ties and repeated
    rows have one order. Rows marked ``gone`` only name their conversation; one
    without other rows has zeros, an empty audit and the hash of the empty
    string. Null conversation ids form one conversation; a null role or text is
    one space; empty texts are blank; long texts are hashed as they stream by.
    An empty table gives no rows; other columns are ignored.

    Texts are shuffled once, by conversation; faults and order come from sorts
    of the partition, which spill. A conversation is folded in its order by one
    task, with rows held one Arrow batch at a time: memory holds the edits that
    are not settled, and the audit, which is one value of the result.
    """
    prepare(rows.sparkSession)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select(*columns("conv_id", "turn", "role", "text"), F.coalesce(gone, F.lit(False)).alias("gone"))
    # Equal turns of a conversation are neighbours here; the shuffle by
    # conversation serves this window too.
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    last = F.right(trimmed(F.col("text")), F.lit(1))
    fault = (F.when(last == "", "b").when(F.col("nth") > 1, "d").when(~last.isin(".", "!", "?"), "t").otherwise(""))
    rows = (rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "gone", "nth",
                        fault.alias("fault"))
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(),
                                  "role", "text", "nth")
            .select("conv_id", "turn", "role", "text", "gone", "fault"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        schema, key, now, done = None, None, None, []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(names)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            if schema is None:
                kinds = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
                schema = pa.schema(list(zip(names, kinds)))
            for conv, turn, role, text, is_gone, what in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != key:
                    if now is not None:
                        done.append((key, *now.values()))
                    key, now = conv, Conversation()
                if not is_gone:
                    now.row(turn, role, text, what)
            if done:
                yield flushed()
                done.clear()
        if now is not None:
            done.append((key, *now.values()))
            yield flushed()

    return rows.mapInArrow(run, OUT.format(kind=kind))
