"""Conversation structure repair: the cheapest edits that give legal turns.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any
length lies over many partitions, and each conversation is cut there into
segments of at most ``SEGMENT`` rows.  Segments are bucketed by length; the costs
of all segments' states go back turn by turn in one NumPy tensor (time first) and
are stored, and edits are traced forward on it for all segments at once.

A conversation of several segments needs what lies beyond each: costs from state
to state of a segment are a small matrix, whose products give the costs behind
every segment; then each segment tells where each entry state leads, which gives
the state it is really entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _arrow_schema, arrow_rows

SEGMENT_BITS = 12  # a segment's rows are at most 2 to this power
BATCH_CELLS = 1 << 18  # rows times segments that one tensor holds at most

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.  Kinds of role: 0 other, 1 system, 2 user, 3 assistant.
OPENED = np.array([2, 2, 3, 2])  # the state after the one role (user or assistant) that an inserted or renamed row may have
KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])  # state, kind: the state after a kept row, -1: not allowed
ENDS = np.array([0, 1 << 28, 1 << 28, 0])  # cost of ending in a state
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
NEVER = 1 << 28
MUST, TRUNCATED, ABSENT = 4, 8, 16  # bits of a row's code beside its kind


def damage(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` of ``turns`` after the fixed damage by
    crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 removes
    ``[.!?]``, 3 repeats it, 4 makes its role user.  ``conv`` is the number as
    text; nulls are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    plain = turns.select(name("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return plain.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _marked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows in order with ``gid`` rising along it, ``fault`` (null, blank,
    duplicate or truncated) and the row's code."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows that agree in the first characters go to one partition; the whole text decides inside.
    order = F.col("turn").asc_nulls_first()
    dealt = rows.repartitionByRange(width, "conv", order, "role", F.left("text", F.lit(64))).sortWithinPartitions("conv", order, "role", "text")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    whole = F.sha2(F.concat("conv", F.lit(":"), F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = scratch.save(dealt.select("*", F.monotonically_increasing_id().alias("gid"), last.alias("last"), whole.alias("whole")), "placed")
    again = placed.groupBy("whole").agg(F.min("gid").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("whole", "first")
    fault = F.when(F.col("last") == "", "blank").when(F.col("gid") > F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    kind = F.coalesce(F.element_at(F.create_map(*map(F.lit, ("s", 1, "u", 2, "a", 3))), F.left("role", F.lit(1))), F.lit(0))
    code = kind + F.when(F.col("fault").isin("blank", "duplicate"), MUST).when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    # 33 low bits of gid count a partition's rows, so its high bits give blocks of neighbours
    return placed.select("conv", "turn", "gid", "last", "whole").join(again, "whole", "left").withColumn("fault", fault).join(placed.select("gid", "role"), "gid").select(
        "conv", "turn", "gid", F.shiftright("gid", SEGMENT_BITS).alias("segment"), "fault", code.cast("byte").alias("code")
    )


def costs_back(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs to go, (time + 1, rows, states), of ``codes`` (time, rows) and the
    costs ``ends`` (rows, states) behind the last one."""
    out = np.empty((len(codes) + 1, *ends.shape), np.int32)

    def settle(x):  # what inserted rows make cheaper
        x[:, 2], x[:, 3] = np.minimum(x[:, 2], x[:, 3] + INSERT), np.minimum(x[:, 3], x[:, 2] + INSERT)
        x[:, :2] = np.minimum(x[:, :2], x[:, 2:3] + INSERT)
        return x

    out[-1] = settle(ends.astype(np.int32))
    for t in range(len(codes) - 1, -1, -1):
        code, after = codes[t], out[t + 1]
        stays, cut = (code & MUST) == 0, np.where(code & TRUNCATED, CUT, 0)
        to = KEPT[:, code & 3].T
        keep = np.where((to >= 0) & stays[:, None], np.take_along_axis(after, np.maximum(to, 0), 1) + cut[:, None], NEVER)
        rename = np.where(stays[:, None], after[:, OPENED] + RENAME + cut[:, None], NEVER)
        now = np.minimum(np.minimum(after + DELETE, keep), np.minimum(rename, NEVER))
        absent = (code & ABSENT) != 0
        now[absent] = after[absent]
        out[t] = settle(now)
    return out


def trace(codes: np.ndarray, back: np.ndarray, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits, ASCII-least among equals, of all rows at once.

    ``state``: where each is entered.  Gives (time + 1, rows, 3) edits as bytes:
    up to two insertions (u, a) and then the row's own (D, K, or U and A for a row
    renamed to user and assistant), 0: none; and the state each ends in.
    """
    n, rows = codes.shape
    edits, state, every = np.zeros((n + 1, rows, 3), np.uint8), state.copy(), np.arange(rows)
    for t in range(n + 1):
        here = back[t]
        code = codes[t] if t < n else np.full(rows, ABSENT, np.uint8)
        after, absent = (back[t + 1] if t < n else ends), (code & ABSENT) != 0
        stays, cut = ((code & MUST) == 0) & ~absent, np.where(code & TRUNCATED, CUT, 0)
        open_ = np.ones(rows, bool)
        for k in range(3):
            now = here[every, state]
            gone = open_ & (after[every, state] + np.where(absent, 0, DELETE) == now)
            edits[t, gone & ~absent, 2] = ord("D")
            open_ &= ~gone
            more = open_ & (here[every, OPENED[state]] + INSERT == now)
            if k < 2:
                state[more] = OPENED[state[more]]
                edits[t, more, k] = np.where(state[more] == 2, ord("u"), ord("a"))
            rest = open_ & ~more
            to = KEPT[state, code & 3]
            keep = rest & stays & (to >= 0) & (after[every, np.maximum(to, 0)] + cut == now)
            edits[t, keep, 2] = ord("K")
            name = rest & ~keep
            edits[t, name, 2] = np.where(OPENED[state[name]] == 2, ord("U"), ord("A"))
            state[keep] = to[keep]
            state[name] = OPENED[state[name]]
            open_ &= more
            if not open_.any():
                break
    return edits, state


def _buckets(lengths: np.ndarray):
    """Places of segments of like length, as many as one tensor may hold."""
    order = np.argsort(lengths, kind="stable")
    size = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(lengths[order], 1))).astype(np.int64))
    for width in np.unique(size).tolist():
        at = order[size == width]
        step = max(1, BATCH_CELLS // width)
        for a in range(0, len(at), step):
            yield at[a : a + step]


def _tensor(parts: list[np.ndarray]) -> np.ndarray:
    """Code lists as (time, rows), the missing ones ABSENT."""
    out = np.full((max(map(len, parts)), len(parts)), ABSENT, np.uint8)
    for j, part in enumerate(parts):
        out[: len(part), j] = part
    return out


def _over_segments(df: DataFrame, columns: list[str], schema: str, solve: Callable) -> DataFrame:
    """``solve(codes, *further columns)`` over buckets of segments of Arrow
    batches; ``codes`` is their tensor, and the result's columns follow ``conv``
    and ``segment``."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            conv, segment, codes, *more = (c.to_pylist() for c in batch.columns)
            parts = [np.frombuffer(c, np.uint8) for c in codes]
            for at in _buckets(np.array(list(map(len, parts)))):
                pick = at.tolist()
                got = solve(_tensor([parts[i] for i in pick]), *([m[i] for i in pick] for m in more))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([conv[i] for i in pick], [segment[i] for i in pick], *got), arrow, strict=True)], schema=arrow)

    return df.select("conv", "segment", "codes", *columns).mapInArrow(run, schema)


def _matrices(codes: np.ndarray):
    """Costs from each state in to each state out."""
    n = codes.shape[1]
    ends = np.where(np.eye(4, dtype=bool), 0, NEVER)
    back = costs_back(np.repeat(codes, 4, axis=1), np.tile(ends, (n, 1)))[0].reshape(n, 4, 4)
    return (back.transpose(0, 2, 1).reshape(n, 16).tolist(),)


def _behind(rows):
    """From a conversation's segments in order: the costs behind each, less their
    smallest."""
    for conv, segments in rows:
        ends = ENDS.astype(np.int64)
        for s in reversed(segments):
            yield conv, s["segment"], (ends - ends.min()).tolist()
            m = np.array(s["costs"], np.int64).reshape(4, 4)
            ends = np.minimum((m + ends).min(axis=1), NEVER)


def _exits(codes: np.ndarray, ends: list):
    """Where each entry state leads."""
    n = codes.shape[1]
    codes, ends = np.repeat(codes, 4, axis=1), np.repeat(np.array(ends, np.int32), 4, axis=0)
    _, state = trace(codes, costs_back(codes, ends), ends, np.tile(np.arange(4), n))
    return (state.reshape(n, 4).tolist(),)


def _entries(rows):
    """From a conversation's segments in order: the state each is entered in, the
    kind of role before it and whether another segment follows."""
    for conv, segments in rows:
        state, before = 0, -1
        for s in segments:
            yield conv, s["segment"], state, before
            state, before = s["exits"][state], s["last"]


_AUDIT = bytes.maketrans(b"uaUA", b"IIRR")


def _plans(codes: np.ndarray, ends: list, state: list, before: list):
    """Each row's edits as text, trailing insertions with the last row's; the
    segment's audit, cost and illegal neighbours."""
    ends = np.array([ENDS.tolist() if e is None else e for e in ends], np.int32)
    edits, _ = trace(codes, costs_back(codes, ends), ends, np.array([s or 0 for s in state]))
    present = (codes & ABSENT) == 0
    own = edits[:-1, :, 2]
    cost = ((own == ord("D")) * DELETE + np.isin(own, (ord("U"), ord("A"))) * RENAME + ((codes & TRUNCATED) != 0) * (own != ord("D")) * CUT) * present
    total = cost.sum(axis=0) + (edits[:, :, :2] != 0).sum(axis=(0, 2)) * INSERT
    kinds = np.vstack([np.array([-1 if b is None else b for b in before])[None], np.where(present, (codes & 3).astype(np.int64), -1)])
    pair = (kinds[:-1] >= 0) & (kinds[1:] >= 0)
    illegal = (pair & ~np.isin(kinds[:-1] * 4 + kinds[1:], (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))).sum(axis=0)
    plans, audits = [], []
    for j, n in enumerate(present.sum(axis=0).tolist()):
        text = [bytes(e[e > 0]).decode() for e in edits[:n, j]]
        text[-1] += "".join(bytes(e[e > 0]).decode() for e in edits[n:, j])
        plans.append(text)
        audits.append("".join(text).encode().translate(_AUDIT).decode())
    return plans, audits, total.tolist(), illegal.tolist()


def _in_order(df: DataFrame, *fields: str) -> DataFrame:
    return df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("segment", *fields))).alias("parts"))


def _lines(rows):
    """sha256 of each conversation's repaired lines, from rows in order."""
    now, digest, some = None, None, False
    for conv, role, text, plan in rows:
        if conv != now:
            if digest is not None:
                yield now, digest.hexdigest()
            now, digest, some = conv, hashlib.sha256(), False
        for edit in plan:
            if edit != "D":
                line = {"u": "user:", "a": "assistant:"}.get(edit) or {"K": role, "U": "user", "A": "assistant"}[edit] + ":" + text
                digest.update(("\n" + line if some else line).encode())
                some = True
    if digest is not None:
        yield now, digest.hexdigest()


def repaired_turns(turns: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, segments, faults) of ``turns`` (conv, turn, role, text).

    rows: ``conv, gid, role, text, plan``; a row's plan has, in order, ``u`` and
    ``a`` for empty rows inserted before it, its own edit (``K`` keep, ``D``
    delete, ``U`` and ``A`` rename to user and assistant), and on the last row
    those inserted behind.  segments: ``conv, segment, audit, cost, illegal``.
    faults: ``conv, turn, fault`` of each row.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    marked = scratch.save(_marked(turns, scratch), "marked")
    listed = marked.groupBy("conv", "segment").agg(F.sort_array(F.collect_list(F.struct("gid", "code"))).alias("rows"))
    # at most 2**SEGMENT_BITS rows are listed together
    codes = F.unhex(F.array_join(F.transform("rows", lambda r: F.lpad(F.hex(r["code"]), 2, "0")), ""))
    segments = scratch.save(listed.select("conv", "segment", F.col("rows")[0]["gid"].alias("first"), (F.element_at("rows", -1)["code"] % 4).alias("last"), codes.alias("codes")), "segments")
    several = segments.groupBy("conv").count().where("count > 1").select("conv")
    cut = scratch.save(segments.join(several, "conv"), "cut")
    costs = _over_segments(cut, [], "conv string, segment long, costs array<int>", _matrices)
    behind = scratch.save(arrow_rows(_in_order(costs, "costs"), ["conv", "parts"], "conv string, segment long, ends array<int>", lambda: _behind), "behind")
    exits = _over_segments(cut.join(behind, ["conv", "segment"]), ["ends"], "conv string, segment long, exits array<int>", _exits)
    entries = arrow_rows(_in_order(exits.join(cut.select("conv", "segment", "last"), ["conv", "segment"]), "exits", "last"), ["conv", "parts"], "conv string, segment long, state int, before int", lambda: _entries)
    placed = segments.join(behind, ["conv", "segment"], "left").join(scratch.save(entries, "entries"), ["conv", "segment"], "left")
    told = scratch.save(_over_segments(placed, ["ends", "state", "before"], "conv string, segment long, plans array<string>, audit string, cost long, illegal long", _plans), "told")
    plans = told.join(segments.select("conv", "segment", "first"), ["conv", "segment"]).select(F.col("first"), F.posexplode("plans").alias("k", "plan")).select((F.col("first") + F.col("k")).alias("gid"), "plan")
    placed_rows = turns.sparkSession.read.parquet(f"{scratch.base}/placed").select("gid", "conv", "role", "text")
    return placed_rows.join(plans, "gid"), told.drop("plans"), marked.select("conv", "turn", "fault")


def repair_report(turns: DataFrame) -> DataFrame:
    """What repairing the damaged ``turns`` finds and does, by conversation:
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.

    Rows of a conversation go by turn (nulls first), equal turns by role, then
    text.  Nulls of role and text are one space, a null conv_id is a conversation
    of its own, a null turn counts in no gap.  Repeated rows are duplicates.  A
    role counts by its first letter.  A conversation without rows after the
    damage has zeros and the hash of nothing; an empty table gives no row.
    Conversations of any length are cut into segments, their text passes through
    the last step row by row.  Columns besides conv_id, turn, role and text are
    ignored.
    """
    scratch = Scratch(turns.sparkSession)
    rows, segments, faults = repaired_turns(damage(turns), scratch)
    named = lambda f: F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = faults.groupBy("conv").agg(gaps.alias("gaps"), named("blank"), named("duplicate"), named("truncated"))
    parts = segments.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = arrow_rows(rows.repartition(width, "conv").sortWithinPartitions("conv", "gid"), ["conv", "role", "text", "plan"], "conv string, repaired_sha256 string", lambda: _lines)
    every = turns.select("conv_id").distinct().select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"))
    out = every.join(counts, "conv", "left").join(parts, "conv", "left").join(hashes, "conv", "left")
    number: Callable[[str], Column] = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
