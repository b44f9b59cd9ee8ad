"""Conversation repair by shortest paths in a bucket queue.

A conversation's rows and the grammar of roles make a graph: a node for each
row border and grammar state, an arc for each edit. Costs are whole numbers up
to 3, so a ring of four buckets replaces a heap (Dial's method). Distances to
the end are recorded for every node; the audit is then read off by walking
from the start along arcs that lose nothing, the least letter first.

Conversations stream through a task in order. Of one, a byte for each row and
four distances are held, never its texts; its edits then meet the rows in a
second pass.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

# Costs of edits; an undeleted truncated row costs one more.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Arcs cost less than this.
RING = 4

# Grammar of role initials, s?(ua)+ or nothing: where one stands, and where an initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
ENDS = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Where an added or renamed row leads; never to a system row.
NEXT = [USER, USER, ASSISTANT, USER]
#: Conversations of up to this many rows whose audits a task remembers.
REMEMBERED = 64

# A row as one byte: four initials by three conditions, or dropped.
INITIALS, PLAIN, DOOMED, TRUNCATED = "sua?", 0, 1, 2
DROPPED = 255

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# ---------------------------------------------------------------- one conversation

def _arcs(code: int, state: int):
    """(letter, cost, next state) of the edits that take a row up, in order of letters."""
    initial, condition = INITIALS[code % 4], code // 4
    yield "D", DELETE, state
    if condition != DOOMED:
        more = CUT_OFF if condition == TRUNCATED else 0
        if initial in LEADS[state]:
            yield "K", KEEP + more, LEADS[state][initial]
        yield "R", REROLE + more, NEXT[state]


#: For each byte: the arcs from each state, and the arcs into each state, as (letter, cost, state).
OUT = [[list(_arcs(code, q)) for q in range(4)] for code in range(12)]
INTO = [[[(x, c, p) for p in range(4) for x, c, to in OUT[code][p] if to == q] for q in range(4)] for code in range(12)]
#: States from which an added row leads to a state.
ADDED = [[p for p in range(4) if NEXT[p] == q] for q in range(4)]


def distances(codes: bytes) -> np.ndarray:
    """Least cost from each node (row border * 4 + state) to the end of a conversation.

    Nodes are settled in order of cost from a ring of buckets; a node may
    stand in several buckets, and only its cheapest visit counts.
    """
    n = len(codes)
    far = np.full(4 * (n + 1), -1, np.int32)
    ring: list[list[int]] = [[4 * n + q for q in ENDS], *[[] for _ in range(RING - 1)]]
    cost, idle = 0, 0
    while idle < RING:
        bucket = ring[cost % RING]
        idle = 0 if bucket else idle + 1
        # A kept row costs nothing, so the bucket may grow while it is emptied.
        while bucket:
            node = bucket.pop()
            if far[node] >= 0:
                continue
            far[node] = cost
            row, q = divmod(node, 4)
            for p in ADDED[q]:
                if far[4 * row + p] < 0:
                    ring[(cost + INSERT) % RING].append(4 * row + p)
            if row:
                for _, c, p in INTO[codes[row - 1]][q]:
                    if far[4 * row - 4 + p] < 0:
                        ring[(cost + c) % RING].append(4 * row - 4 + p)
        cost += 1
    return far


def audit(codes: bytes) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits: D, I, K or R; of equally cheap ones the least text."""
    far = distances(codes)
    row, q, letters = 0, START, []
    while row < len(codes) or q not in ENDS:
        own = far[4 * row + q]
        steps = [(x, c, 4 * row + 4 + to) for x, c, to in OUT[codes[row]][q]] if row < len(codes) else []
        steps.append(("I", INSERT, 4 * row + NEXT[q]))
        # A letter leads to one node only.
        letter, _, node = min(s for s in steps if far[s[2]] >= 0 and far[s[2]] + s[1] == own)
        letters.append(letter)
        row, q = divmod(node, 4)
    return int(far[START]), "".join(letters)


class Edited(NamedTuple):
    """``audits``: conv_id, the counts and the audit of each conversation; ``rows``: conv_id, n, edit, role, text of its repaired rows in order."""

    audits: DataFrame
    rows: DataFrame


# ---------------------------------------------------------------- streams of sorted rows

def _runs(ids: list):
    """(first, past last) of the runs of equal ids; null equals null."""
    first = 0
    for k in range(1, len(ids) + 1):
        if k == len(ids) or ids[k] != ids[first]:
            yield first, k
            first = k


def _audits(id_type: pa.DataType):
    """Counts and audit of each conversation, from rows that come in order: conv_id, turn, code, fault, initial."""

    def work(batches):
        now, rows = None, None
        brief = lru_cache(1 << 16)(audit)

        def ended():
            cost, letters = (brief if len(rows["codes"]) <= REMEMBERED else audit)(bytes(rows["codes"]))
            gaps = rows["last"] - rows["first"] + 1 - rows["turns"] if rows["turns"] else 0
            return now, gaps, *rows["faults"], rows["illegal"], cost, letters

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            turns, codes, faults, initials = (batch.column(k).to_pylist() for k in range(1, 5))
            for a, b in _runs(ids):
                if rows is None or ids[a] != now:
                    if rows is not None:
                        out.append(ended())
                    now, rows = ids[a], {"codes": bytearray(), "faults": [0, 0, 0], "illegal": 0, "turns": 0, "first": 0, "last": 0, "before": None}
                for k in range(a, b):
                    if codes[k] == DROPPED:
                        continue
                    rows["codes"].append(codes[k])
                    if faults[k]:
                        rows["faults"][faults[k] - 1] += 1
                    rows["illegal"] += rows["before"] is not None and rows["before"] + initials[k] not in ("su", "ua", "au")
                    rows["before"] = initials[k]
                    if turns[k] is not None and (not rows["turns"] or turns[k] != rows["last"]):
                        rows["first"] = rows["first"] if rows["turns"] else turns[k]
                        rows["last"], rows["turns"] = turns[k], rows["turns"] + 1
            if out:
                yield _audit_batch(out, id_type)
        if rows is not None:
            yield _audit_batch([ended()], id_type)

    return work


def _audit_batch(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:-1]], pa.array(columns[-1], pa.string())], names=["conv_id", *COUNTS, "audit"])


def _repaired(id_type: pa.DataType):
    """The repaired rows, from rows that come in order after a row (n = 0) with their conversation's audit."""

    def work(batches):
        now, letters, at, q, n = None, "", 0, START, 0
        for batch in batches:
            ids, numbers, roles, texts = (batch.column(k).to_pylist() for k in range(4))
            out: list[tuple] = []

            def added():
                """Rows that are added before the next one."""
                nonlocal at, q, n
                while at < len(letters) and letters[at] == "I":
                    q, at, n = NEXT[q], at + 1, n + 1
                    out.append((now, n, "I", ROLES[q], ""))

            for k, number in enumerate(numbers):
                if number == 0:
                    added()
                    now, letters, at, q, n = ids[k], texts[k], 0, START, 0
                    continue
                added()
                letter, at = letters[at], at + 1
                if letter != "D":
                    role = roles[k] if letter == "K" else ROLES[NEXT[q]]
                    q, n = LEADS[q][role[:1]], n + 1
                    out.append((now, n, letter, role, texts[k]))
            if out:
                yield _row_batch(out, id_type)
        out = []
        added()
        if out:
            yield _row_batch(out, id_type)

    return work


def _row_batch(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    i, n, e, r, t = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(i, id_type), pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in (e, r, t)]], names=["conv_id", "n", "edit", "role", "text"])


def _digest(id_type: pa.DataType):
    """SHA-256 of each conversation's ``role:text`` lines, fed as they come."""
    import hashlib

    def work(batches):
        now, held = None, None
        for batch in batches:
            ids, roles, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text"))
            done = []
            for k, (i, role, text) in enumerate(zip(ids, roles, texts)):
                if held is None or i != now:
                    if held is not None:
                        done.append((now, held.hexdigest()))
                    now, held = i, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], id_type), pa.array([d[1] for d in done])], names=["conv_id", "sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], id_type), pa.array([held.hexdigest()])], names=["conv_id", "sha256"])

    return work


# ---------------------------------------------------------------- conversations

def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows with faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops one (it stays, marked), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's.

    Null counts as one space in the hashed text, the role and the text;
    conv_id and turn stay null.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text(conv_id), F.lit(":"), text(turn)).cast("binary")) % 20
    held = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return held.select("conv_id", "turn", role.alias("role"), said.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(copies).alias("copy"))


def _is_type(df: DataFrame) -> tuple[pa.DataType, str]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema["conv_id"].dataType
    return to_arrow_type(kind), kind.simpleString()


def repair(rows: DataFrame) -> Edited:
    """Cheapest edits that make each conversation a system row or none, then pairs of user and assistant, or empty.

    ``rows``: conv_id, turn, role, text and, if there is one, ``dropped``,
    which marks rows that are gone but whose conversation is still reported.
    They are taken by turn, nulls first; rows of one turn by role and text.
    Blank rows (nothing but ASCII white space) and those whose role and text
    stood before must go; a row that doesn't end in ``.!?`` is truncated and
    costs one more if it stays. Only the first of these faults counts for a
    row. Null roles and texts are one space. A role counts by its first
    character, so ``User`` or an empty role must be renamed or go. A null
    conv_id is a conversation. An empty table gives empty relations.

    Rows are sorted by Spark, which spills, and stream through a task: of the
    conversation at hand it holds a byte and four distances for each row.
    """
    held = rows.withColumn("dropped", F.lit(False)) if "dropped" not in rows.columns else rows
    held = held.withColumn("copy", F.lit(0)) if "copy" not in held.columns else held
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    held = held.select("conv_id", F.col("turn").try_cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), "dropped", "copy")
    # One shuffle serves the windows below; equal rows stream through them.
    held = held.repartition("conv_id")
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("copy")]
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.asc_nulls_first("turn"), "copy"))
    held = held.withColumn("seen", F.when(~F.col("dropped"), seen).otherwise(1))
    held = held.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long"))
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(F.col("dropped"), 0).when(last == "", 1).when(F.col("seen") > 1, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    held = held.select("conv_id", "n", "turn", "role", "text", initial.alias("initial"), fault.alias("fault"), "dropped")
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    condition = F.when(F.col("fault").isin(1, 2), DOOMED).when(F.col("fault") == 3, TRUNCATED).otherwise(PLAIN)
    held = cut(held.withColumn("code", F.when(F.col("dropped"), DROPPED).otherwise(number + 4 * condition).cast("int")), "turns")

    arrow, kind = _is_type(held)
    sent = held.select("conv_id", "turn", "code", "fault", "initial", "n").repartition("conv_id").sortWithinPartitions("conv_id", "n")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    audits = cut(sent.mapInArrow(_audits(arrow), f"conv_id {kind}, {counts}, audit string"), "audits")
    heads = audits.select("conv_id", F.lit(0).cast("long").alias("n"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(held.where("not dropped").select("conv_id", "n", "role", "text"))
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", "n")
    return Edited(audits, stream.mapInArrow(_repaired(arrow), f"conv_id {kind}, n long, edit string, role string, text string"))


def digests(edited: Edited) -> DataFrame:
    """The audits with repaired_sha256, of the repaired ``role:text`` lines joined by newlines; of the empty text without any."""
    arrow, kind = _is_type(edited.audits)
    # Repaired rows of one conversation follow one another in their partition.
    found = edited.rows.mapInArrow(_digest(arrow), f"conv_id {kind}, sha256 string").select(F.col("conv_id").alias("c"), "sha256")
    met = edited.audits.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return met.withColumn("repaired_sha256", _or_empty(F.col("sha256"))).drop("sha256")


def _or_empty(digest: Column) -> Column:
    return F.coalesce(digest, F.sha2(F.lit("").cast("binary"), 256))
