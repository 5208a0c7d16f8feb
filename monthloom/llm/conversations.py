"""Repair of conversations: the cheapest edits that give an optional system turn, then user and assistant in turn.

The edits of a conversation are paths through a lattice of (rows used, role written last).  Its
cheapest path is found from both ends, with a heap each; every crossing of equal cost is finished,
and of all cheapest edits the least in ASCII is taken, letter by letter.

A conversation is one result, so its edits are found in one task; what that takes is some dozens of
bytes per row, never the texts, which only stream past.
"""

from __future__ import annotations

import heapq
from array import array
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Costs: an edit, and keeping a truncated row.
REROLE, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
#: Written last: nothing, system, user, assistant.  What may be written next by rerole or insert, and after what it may stand.
NEXT = (2, 2, 3, 2)
BEFORE = ((), (), (0, 1, 3), (2,))
#: Role initial -> state it leads to, and the states it may follow.
INITIALS = {"s": 1, "u": 2, "a": 3}
FOLLOWS = ((), (0,), (0, 1, 3), (2,))
SOUND, GONE, CUT = 0, 1, 2
#: Text after which repaired rows are handed on.
SLICE_BYTES = 4_000_000


def _ahead(node, n, leads, fault):
    """Edges out of a node: (letter, target, cost)."""
    i, state = node >> 2, node & 3
    if i < n:
        yield "D", node + 4, DELETE
        if fault[i] != GONE:
            more = TRUNCATED if fault[i] == CUT else 0
            if state in FOLLOWS[leads[i]]:
                yield "K", 4 * i + 4 + leads[i], more
            yield "R", 4 * i + 4 + NEXT[state], REROLE + more
    yield "I", 4 * i + NEXT[state], INSERT


def _behind(node, n, leads, fault):
    """Edges into a node: (source, cost)."""
    i, state = node >> 2, node & 3
    for s in BEFORE[state]:
        yield 4 * i + s, INSERT
    if i:
        yield node - 4, DELETE
        if fault[i - 1] != GONE:
            more = TRUNCATED if fault[i - 1] == CUT else 0
            if leads[i - 1] == state:
                for s in FOLLOWS[state]:
                    yield 4 * i - 4 + s, more
            for s in BEFORE[state]:
                yield 4 * i - 4 + s, REROLE + more


def cheapest(leads: bytes, fault: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation.

    ``leads`` has for each row the state its role's initial leads to (0: a role that cannot be
    kept), ``fault`` whether it is sound, must go, or is cut off.
    """
    n = len(leads)
    nodes, never = 4 * (n + 1), 1 << 60
    ahead, behind = array("q", [never]) * nodes, array("q", [never]) * nodes
    settled, reached = bytearray(nodes), bytearray(nodes)
    ahead[0] = 0
    goals = (4 * n, 4 * n + 3)
    for g in goals:
        behind[g] = 0
    # A heap entry is cost * nodes + a number that prefers, among equals, the node nearest to the other end.
    forward, reverse = [nodes - 1], sorted(goals)
    best = 0 if n == 0 else never
    while forward and reverse:
        f, r = forward[0] // nodes, reverse[0] // nodes
        if f + r > best:  # all crossings at the best cost are finished
            break
        if f <= r:
            node = nodes - 1 - heapq.heappop(forward) % nodes
            if settled[node]:
                continue
            settled[node] = 1
            for _, to, cost in _ahead(node, n, leads, fault):
                if f + cost < ahead[to]:
                    ahead[to] = f + cost
                    heapq.heappush(forward, (f + cost) * nodes + nodes - 1 - to)
                    best = min(best, f + cost + behind[to])
        else:
            node = heapq.heappop(reverse) % nodes
            if reached[node]:
                continue
            reached[node] = 1
            for source, cost in _behind(node, n, leads, fault):
                if r + cost < behind[source]:
                    behind[source] = r + cost
                    heapq.heappush(reverse, (r + cost) * nodes + source)
                    best = min(best, r + cost + ahead[source])

    # Nodes of the forward half that are on a path of the best cost, from the crossings back.  A
    # distance to the end belongs to a path, so where the sum is the best one, the path is.
    joined = bytearray(nodes)
    open_ = []
    for node in range(nodes):
        if settled[node] and (
            ahead[node] + behind[node] == best
            or any(ahead[node] + cost + behind[to] == best for _, to, cost in _ahead(node, n, leads, fault))
        ):
            joined[node] = 1
            open_.append(node)
    while open_:
        node = open_.pop()
        for source, cost in _behind(node, n, leads, fault):
            if settled[source] and not joined[source] and ahead[source] + cost == ahead[node]:
                joined[source] = 1
                open_.append(source)

    # All nodes that one audit leads to are followed together; equal letters cost the same at each.
    audit, at, spent = [], {0}, 0
    while not (spent == best and at & set(goals)):
        steps: dict[str, list] = {}
        for node in at:
            for letter, to, cost in _ahead(node, n, leads, fault):
                through = spent + cost + behind[to] == best or (joined[to] and spent + cost == ahead[to])
                if through:
                    steps.setdefault(letter, []).append((to, cost))
        letter = min(steps)
        audit.append(letter)
        spent += steps[letter][0][1]
        at = {to for to, _ in steps[letter]}
    return best, "".join(audit)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults, by h = crc32(``conv_id:turn``) % 20 (a null is one space, in role and text too).

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets its role to user.
    """
    space = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return (
        rows.select(
            "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
            F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("__copies"),
        )
        .withColumn("__copies", F.explode(F.expr("array_repeat(0, __copies)")))
        .drop("__copies")
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with what they are sorted by: turn (nulls first), role, a hash of role and text."""
    return rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    ).select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(12), "role", "text").alias("h2"))


_ORDER = ("turn", "role", "h1", "h2")


def _runs(batch: pa.RecordBatch, column: str = "conv_id"):
    values = batch.column(column).to_pylist()
    a = 0
    for b in range(1, len(values) + 1):
        if b == len(values) or values[b] != values[a]:
            yield values[a], a, b
            a = b


class _Seen:
    """What has been read of a conversation."""

    def __init__(self):
        self.leads, self.fault, self.counts = bytearray(), bytearray(), [0, 0, 0, 0]
        self.low = self.high = self.last = None
        self.turns, self.initial, self.illegal = 0, None, 0

    def add(self, turn, role, kind):
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.counts[kind] += 1
        self.leads.append(INITIALS.get(initial, 0))
        self.fault.append(SOUND if kind == 0 else CUT if kind == 3 else GONE)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def row(self):
        cost, audit = cheapest(bytes(self.leads), bytes(self.fault))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts[1:], self.illegal, cost, audit)


_PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(rows: DataFrame) -> DataFrame:
    """Per ``conv_id``: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    ``rows`` has ``conv_id``, ``turn`` (a number), ``role``, ``text``; a null role or text is one
    space, a null turn comes first, a null ``conv_id`` is a conversation too.  Rows of one turn
    stand in the order of their role, then of a hash of role and text.  A row's first fault counts: blank (no
    character but spaces, tabs and line ends), duplicate (role and text occurred before), truncated
    (the last such character is none of ``.!?``).  Other columns are not looked at; an empty table
    gives an empty one.  Keeping costs 0, a new role 3, deletion 4 (a must for blank and duplicate
    rows), an inserted empty row 3, a truncated row that stays 3 more.  A role that begins with
    none of s, u, a cannot be kept.  The audit has a letter per edit: D, I, K, R.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    narrow = _ordered(rows).select("conv_id", *_ORDER, blank.alias("blank"), cut.alias("cut"))
    before = F.row_number().over(Window.partitionBy("conv_id", "h1", "h2").orderBy("turn"))
    kind = F.when(F.col("blank"), 1).when(before > 1, 2).when(F.col("cut"), 3).otherwise(0)
    rows = narrow.select("conv_id", *_ORDER, kind.alias("kind")).repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)

    def solve(batches):
        seen, name = None, None

        def out(done):
            columns = list(zip(*done, strict=True))
            kinds = [key] + [pa.int64()] * 6 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        for batch in batches:
            done, key = [], batch.schema.field("conv_id").type
            turn, role, kind = (batch.column(c).to_pylist() for c in ("turn", "role", "kind"))
            for conv, a, b in _runs(batch):
                if seen is None or conv != name:
                    if seen is not None:
                        done.append((name, *seen.row()))
                    seen, name = _Seen(), conv
                for k in range(a, b):
                    seen.add(turn[k], role[k], kind[k])
            if done:
                yield out(done)
        if seen is not None:
            yield out([(name, *seen.row())])

    key = rows.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "turn", "role", "kind").mapInArrow(solve, f"conv_id {key}, {_PLAN}")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id``, ``position``, ``role``, ``text``, ``edit`` of the rows that the audits leave or insert.

    Within a partition the rows of a conversation stand together and in order.  Roles follow from
    the number of rows left: an odd number begins with system.
    """
    null = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in _ordered(rows).schema}
    audits = plans.select("conv_id", *[null[c] for c in ("turn", "role", "text", "h1", "h2")], "audit")
    both = _ordered(rows).withColumn("audit", F.lit(None).cast("string")).unionByName(audits)
    # Conversations are placed once; the audit comes before the rows it edits.
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER)

    def edit(batches):
        name, audit, at, position, odd, out, size, key = None, None, 0, 0, 0, [], 0, pa.int64()

        def role_at(position):
            return "system" if odd and not position else ("user", "assistant")[(position - odd) % 2]

        def inserted():
            nonlocal at, position
            while at < len(audit) and audit[at] == "I":
                out.append((name, position, role_at(position), "", "I"))
                at, position = at + 1, position + 1

        def flush():
            nonlocal out, size
            kinds = [key, pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True))
            out, size = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "position", "role", "text", "edit"]
            )

        for batch in batches:
            key = batch.schema.field("conv_id").type
            conv, role, text, plan = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit"))
            for k in range(batch.num_rows):
                if plan[k] is not None:
                    name, audit, at, position = conv[k], plan[k], 0, 0
                    odd = (len(audit) - audit.count("D")) % 2
                    inserted()
                    continue
                letter = audit[at]
                at += 1
                if letter != "D":
                    out.append((name, position, role[k] if letter == "K" else role_at(position), text[k], letter))
                    position, size = position + 1, size + len(text[k])
                inserted()
                if size > SLICE_BYTES:
                    yield flush()
            if out:
                yield flush()

    key = rows.schema["conv_id"].dataType.simpleString()
    return both.select("conv_id", "role", "text", "audit").mapInArrow(edit, f"conv_id {key}, position long, role string, text string, edit string")


def digests(fixed: DataFrame) -> DataFrame:
    """``conv_id``, ``repaired_sha256`` over ``role:text`` joined by line ends, for rows as ``repaired`` leaves them."""

    def run(batches):
        name, digest = None, None

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], key), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            done, key = [], batch.schema.field("conv_id").type
            role, text = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for conv, a, b in _runs(batch):
                if digest is None or conv != name:
                    if digest is not None:
                        done.append((name, digest.hexdigest()))
                    digest, name, begun = sha256(), conv, False
                for k in range(a, b):
                    digest.update(f"{chr(10) if begun else ''}{role[k]}:{text[k]}".encode())
                    begun = True
            if done:
                yield out(done)
        if digest is not None:
            yield out([(name, digest.hexdigest())])

    key = fixed.schema["conv_id"].dataType.simpleString()
    return fixed.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {key}, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """Every ``conv_id`` of ``rows`` with its faults after ``damage``, the cheapest repair, and a digest of the repaired rows.

    A conversation all of whose rows are lost has zeros, an empty audit and the digest of nothing.
    """
    broken = damage(rows)
    found = plans(broken)
    texts = digests(repaired(broken, found)).withColumnRenamed("conv_id", "__t")
    found = found.withColumnRenamed("conv_id", "__p")
    out = rows.select("conv_id").distinct()
    out = out.join(found, F.col("conv_id").eqNullSafe(F.col("__p")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("__t")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
