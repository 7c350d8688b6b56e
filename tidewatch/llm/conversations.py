"""Conversation structure repair by Four-Russians block tables.

A conversation is a word over nine symbols: a row that must go, or one of four kinds of role (system,
user, assistant, other) whose text ends well or is cut off. The cheapest way on from a place of it
depends on the place of the grammar ``(s?(ua)+)?`` only: four costs, which differ by a bounded
amount, so after taking off the least there are finitely many such vectors. For every block of
``WIDTH`` symbols and every vector at its end a table holds the vector at its beginning and the
cost taken off. Blocks are looked up from the end backward; then each block is expanded backward
once more, row by row, and traced forward, where of equally cheap edits the ASCII-least is taken.
No shorter trace can tie with its own extension, as each insertion costs, so the trace is the least.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is cut
into segments, at most one task's share each. A conversation inside one segment is repaired there.
For the others, segments are summarised as maps of vectors in parallel, chained backward and then
traced forward in streams that hold one segment at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import parts, ready, shared_folder

WIDTH = 4
SYMBOLS = 9
SEGMENT_ROWS = 1 << 16
SEGMENT_BYTES = 8 << 20
HELD_BYTES = 4 << 20
#: Costs of the edits; KEPT_TRUNCATED comes on top for each row that stays cut off.
DELETE, REROLE, INSERT, KEPT_TRUNCATED = 4, 3, 3, 3
#: States of the grammar: nothing yet, after a system, a user, an assistant row. The last and the first may end.
AHEAD = (2, 2, 3, 2)
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
KINDS = ("s", "u", "a", "")
NAMES = {2: "user", 3: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)
BLANKS = " \t\n\x0b\f\r"


def symbol(role: str, must_go: bool, cut_off: bool) -> int:
    return 0 if must_go else 1 + 2 * KINDS.index(role[:1] if role[:1] in KINDS else "") + cut_off


def edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """``(edit, cost, next state)`` of the edits that use up a row of this symbol, in ASCII order."""
    out = [("D", DELETE, state)]
    if sym:
        kind, more = KINDS[(sym - 1) // 2], KEPT_TRUNCATED * ((sym - 1) % 2)
        if state in KEEP[kind]:
            out.append(("K", more, KEEP[kind][state]))
        out.append(("R", REROLE + more, AHEAD[state]))
    return out


def before(after: tuple, sym: int) -> list[int]:
    """Least cost from each state in front of a row, given those behind it."""
    cost = [min(c + after[to] for _, c, to in edits(sym, s)) for s in range(4)]
    for _ in range(2):
        cost = [min(cost[s], INSERT + cost[AHEAD[s]]) for s in range(4)]
    return cost


class Tables:
    """Normalised vectors, their transitions by symbol and by block, and the traces of single rows."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.vectors, place, ids, costs = [END], {END: 0}, [], []
        for v in self.vectors:  # grows while new vectors are met
            ids.append([])
            costs.append([])
            for sym in range(SYMBOLS):
                cost = before(v, sym)
                least = min(cost)
                new = tuple(x - least for x in cost)
                if new not in place:
                    place[new] = len(self.vectors)
                    self.vectors.append(new)
                ids[-1].append(place[new])
                costs[-1].append(least)
        self.step, self.step_cost = np.array(ids), np.array(costs)
        block, cost = self.step, self.step_cost
        for _ in range(width - 1):
            block, cost = (np.concatenate([self.step[block, s] for s in range(SYMBOLS)], 1),
                           np.concatenate([cost + self.step_cost[block, s] for s in range(SYMBOLS)], 1))
        self.block, self.block_cost = block, cost
        self.powers = SYMBOLS ** np.arange(width)[::-1]
        self.row = [[[self._trace(v, sym, s) for s in range(4)] for sym in range(SYMBOLS)] for v in range(len(self.vectors))]
        self.steps, self.blocks = self.step.tolist(), self.block.tolist()

    def _trace(self, after: int, sym: int, state: int) -> tuple[str, int]:
        """ASCII-least cheapest edits up to the end of a row, and the state behind it."""
        cost, done = before(self.vectors[after], sym), ""
        while True:
            options = [("I", INSERT + cost[AHEAD[state]], AHEAD[state])] + [(e, c + self.vectors[after][to], to) for e, c, to in edits(sym, state)]
            edit, _, to = min(o for o in options if o[1] == cost[state])
            done, state = done + edit, to
            if edit != "I":
                return done, state

    def codes(self, syms: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The rows in front of the first whole block, and the code of each block."""
        head = len(syms) % self.width
        return syms[:head], (syms[head:].reshape(-1, self.width) @ self.powers).tolist()

    def ends(self, syms: np.ndarray, end: int) -> tuple[list[int], int]:
        """The vector behind each block, last block first, and the one in front of the first row."""
        head, codes = self.codes(syms)
        behind = []
        for code in reversed(codes):
            behind.append(end)
            end = self.blocks[end][code]
        behind.append(end)
        for sym in head[::-1].tolist():
            end = self.steps[end][sym]
        return behind, end

    def map(self, syms: np.ndarray) -> np.ndarray:
        """For every vector behind these rows the one in front of them."""
        head, codes = self.codes(syms)
        now = np.arange(len(self.vectors))
        for code in reversed(codes):
            now = self.block[now, code]
        for sym in head[::-1].tolist():
            now = self.step[now, sym]
        return now

    def trace(self, syms: np.ndarray, end: int, state: int) -> tuple[list[str], int]:
        """The edits of each row (insertions in front of it included) from ``state`` on, and the state behind the last."""
        behind, _ = self.ends(syms, end)
        head = len(syms) % self.width
        said = []
        for k, at in enumerate([0, *range(head, len(syms), self.width)] if head else range(0, len(syms), self.width)):
            block = syms[at:at + (head if head and k == 0 else self.width)].tolist()
            after, now = [], behind[len(behind) - 1 - k - (0 if head else 1)]
            for sym in reversed(block):
                after.append(now)
                now = self.steps[now][sym]
            for sym, v in zip(block, reversed(after), strict=True):
                edit, state = self.row[v][sym][state]
                said.append(edit)
        return said, state


def last_inserts(state: int) -> str:
    return "I" * (END[state] // INSERT)


def damage(rows: DataFrame) -> DataFrame:
    """The stated faults by ``crc32("conv_id:turn") % 20``, as ``role, text`` and ``copies`` (0: dropped); nulls are one space."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.encode(F.concat(said[0], F.lit(":"), said[1]), "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role, text, F.lit(1).alias("copies"))


def key() -> Column:
    """Tells conversations apart, a null one from all others."""
    return F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))


SEGMENT = "key string, part int, seg int, whole boolean, turns array<long>, roles array<string>, texts array<string>"
PLACE_FIELDS = [("key", pa.string()), ("part", pa.int32()), ("seg", pa.int32()), ("whole", pa.bool_()), ("turns", pa.list_(pa.int64()))]
SEGMENT_SCHEMA = pa.schema([*PLACE_FIELDS, ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def segments(most_rows: int, most_bytes: int):
    """Sorted rows to segments of one conversation each; ``whole`` if no other task or segment can hold more of it."""

    def run(batches):
        part = TaskContext.get().partitionId()
        now, seg, first, rows, size, held, held_size = None, 0, True, [], 0, [], 0

        def close(whole):
            nonlocal held_size
            turns, roles, texts = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
            held.append({"key": now, "part": part, "seg": seg, "whole": whole, "turns": turns, "roles": roles, "texts": texts})
            held_size += size + 100

        for batch in batches:
            for k, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "copies")), strict=True):
                if k != now:
                    if now is not None:
                        close(not first and seg == 0)
                        first = False
                    now, seg, rows, size = k, 0, [], 0
                if held_size > HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=SEGMENT_SCHEMA)
                    held, held_size = [], 0
                for _ in range(copies):
                    if len(rows) >= most_rows or size > most_bytes:
                        close(False)
                        seg, rows, size = seg + 1, [], 0
                    rows.append((turn, role, text))
                    size += len(text)
        if now is not None:
            close(False)
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=SEGMENT_SCHEMA)

    return run


def arrange(rows: DataFrame, folder: str, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of all conversations, written to ``folder``. Rows go by turn (nulls first), then role and text."""
    spark = rows.sparkSession
    keyed = rows.select(key().alias("key"), F.col("turn").cast("long").alias("turn"), "role", "text", "copies")
    # Ranges are cut by the first characters of a text only, which keeps the sample small; its order is that of whole texts.
    ranged = keyed.repartitionByRange(parts(spark), "key", "turn", "role", F.substring("text", 1, 32))
    ranged.sortWithinPartitions("key", "turn", "role", "text").mapInArrow(segments(most_rows, most_bytes), SEGMENT).write.parquet(folder)
    return spark.read.parquet(folder)


def faults(roles: list, texts: list, known: list | None) -> list[str]:
    """First fault of each row of a segment: ``blank``, ``duplicate``, ``truncated`` or none. ``known``: the places of copies."""
    seen, copies, out = set(), set(known or ()), []
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        said = text.rstrip(BLANKS)
        if known is None:
            copy = (role, text) in seen
            seen.add((role, text))
        else:
            copy = i in copies
        out.append("blank" if not said else "duplicate" if copy else "truncated" if said[-1] not in ".!?" else "")
    return out


def symbols(roles: list, fault: list[str]) -> np.ndarray:
    return np.array([symbol(r, f in ("blank", "duplicate"), f == "truncated") for r, f in zip(roles, fault, strict=True)], np.int64)


REPAIRED = ("key string, part int, seg int, whole boolean, turns array<long>, was array<string>, audit string, roles array<string>, texts array<string>, "
            "blank long, duplicate long, truncated long, cost long")
REPAIRED_SCHEMA = pa.schema([*PLACE_FIELDS, ("was", pa.list_(pa.string())), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                             *((f, pa.int64()) for f in ("blank", "duplicate", "truncated", "cost"))])


def traced(batches):
    """Segments in order, with ``copies`` (null: found here) and ``behind`` (the vector behind the segment; null: the last one) to repaired rows."""
    t = Tables()
    now, state = None, 0
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["key"] != now:
                now, state = r["key"], 0
            fault = faults(r["roles"], r["texts"], r["copies"])
            syms = symbols(r["roles"], fault)
            last = r["whole"] or r["last"]
            start = state
            edit, state = t.trace(syms, r["behind"] or 0, start)
            if last:
                edit.append(last_inserts(state))
            roles, texts, cost, at = [], [], 0, start
            for i, ops in enumerate(edit):
                for op in ops:
                    if op == "D":
                        cost += DELETE
                        continue
                    cost += {"I": INSERT, "K": 0, "R": REROLE}[op]
                    kind = r["roles"][i][:1] if op == "K" else ""
                    at = KEEP[kind][at] if op == "K" else AHEAD[at]
                    roles.append(r["roles"][i] if op == "K" else NAMES[at])
                    texts.append("" if op == "I" else r["texts"][i])
                    cost += KEPT_TRUNCATED * (op != "I" and fault[i] == "truncated")
            done.append({"key": now, "part": r["part"], "seg": r["seg"], "whole": r["whole"], "turns": r["turns"], "was": [x[:1] for x in r["roles"]],
                         "audit": "".join(edit), "roles": roles, "texts": texts, **{f: fault.count(f) for f in ("blank", "duplicate", "truncated")}, "cost": cost})
        yield pa.RecordBatch.from_pylist(done, schema=REPAIRED_SCHEMA)


def vector_maps(batches):
    t = Tables()
    for batch in batches:
        got = [t.map(symbols(r["roles"], faults(r["roles"], r["texts"], r["copies"]))).astype(np.int16).tobytes() for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("seg"), pa.array(got, pa.binary())],
                                         ["key", "part", "seg", "map"])


def chained_back(batches):
    """Maps of segments, the last of a conversation first, to the vector behind each."""
    now, vector = None, 0
    for batch in batches:
        behind, last = [], []
        for k, m in zip(batch.column("key").to_pylist(), batch.column("map").to_pylist(), strict=True):
            last.append(k != now)
            if k != now:
                now, vector = k, 0
            behind.append(vector)
            vector = int(np.frombuffer(m, np.int16)[vector])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("seg"), pa.array(behind, pa.int32()), pa.array(last, pa.bool_())],
                                         ["key", "part", "seg", "behind", "last"])


def repair(conversations: DataFrame, faulty=undamaged, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Repaired segments: of conversations in one segment, and of the others, these in order within a partition.

    Each has the edits (``audit``), the repaired ``roles`` and ``texts``, counts of faults and the cost. ``faulty`` maps the
    table to ``conv_id, turn, role, text, copies``. Null roles and texts are one space, so a null text is blank and a null
    role can only be changed or deleted; a null conv_id is a conversation of its own; null turns come first. Rows of one
    turn go by role and text, and exact repeats are duplicates. Texts of any length are read whole; an empty
    table gives no segments; other columns are not read.
    """
    spark = ready(conversations.sparkSession)
    cut = arrange(faulty(conversations.select("conv_id", "turn", "role", "text")), shared_folder(spark, "conversations"), most_rows, most_bytes)
    own = cut.where("whole").withColumns({"copies": F.lit(None).cast("array<int>"), "behind": F.lit(None).cast("int"), "last": F.lit(True)})
    several = cut.where("not whole")
    place = ["key", "part", "seg"]
    rows = several.select(*place, F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "r")).select(*place, "pos", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))
    at = F.struct("part", "seg", "pos")
    firsts = rows.groupBy("key", "role", "text").agg(F.min(at).alias("first"), F.max(at).alias("end")).where("first < end").drop("end")
    copies = rows.join(firsts, ["key", "role", "text"]).where(at > F.col("first")).groupBy(*place).agg(F.collect_list("pos").alias("copies"))
    marked = several.join(copies, place, "left").withColumn("copies", F.coalesce("copies", F.array().cast("array<int>"))).checkpoint()
    maps = marked.mapInArrow(vector_maps, "key string, part int, seg int, map binary")
    behind = (maps.repartition(parts(spark), "key").sortWithinPartitions("key", F.desc("part"), F.desc("seg"))
              .mapInArrow(chained_back, "key string, part int, seg int, behind int, last boolean"))
    ordered = marked.join(behind, place).repartition(parts(spark), "key").sortWithinPartitions(*place).select(*own.columns)
    return own.mapInArrow(traced, REPAIRED), ordered.mapInArrow(traced, REPAIRED)


def repaired_turns(conversations: DataFrame, faulty=undamaged) -> DataFrame:
    """``key, part, seg, pos, role, text``: the rows of all repaired conversations; sorted by the first four they are in order.

    ``key`` is ``v`` and the conv_id, or ``n`` for a null one. Odd input as in ``repair``.
    """
    one, more = repair(conversations, faulty)
    return one.unionByName(more).select("key", "part", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "r")).select(
        "key", "part", "seg", "pos", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
DIGEST_SCHEMA = pa.schema([("key", pa.string()), *((f, pa.int64()) for f in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                           ("audit", pa.string()), ("repaired_sha256", pa.string())])
DIGEST = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(batches):
    """Repaired segments, those of a conversation one after the other, to a row for each conversation."""
    counts = ("blank", "duplicate", "truncated", "cost")
    now = None

    def ended():
        gaps = 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)
        return {"key": now, "gaps": gaps, "illegal": illegal, "audit": "".join(audit), "repaired_sha256": sha.hexdigest(), **total}

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["key"] != now:
                if now is not None:
                    done.append(ended())
                now, total, illegal, audit, sha, lines = r["key"], dict.fromkeys(counts, 0), 0, [], hashlib.sha256(), 0
                low = high = role = None
                turns = 0
            for c in counts:
                total[c] += r[c]
            for turn in r["turns"]:
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
            for x in r["was"]:
                illegal += role is not None and (role, x) not in LEGAL
                role = x
            audit.append(r["audit"])
            for x, text in zip(r["roles"], r["texts"], strict=True):
                sha.update(("\n" if lines else "").encode() + f"{x}:{text}".encode())
                lines += 1
        yield pa.RecordBatch.from_pylist(done, schema=DIGEST_SCHEMA)
    if now is not None:
        yield pa.RecordBatch.from_pylist([ended()], schema=DIGEST_SCHEMA)


def repair_summary(conversations: DataFrame, faulty=undamaged, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row for each conv_id: gaps, counts of faults and illegal neighbours, cost, audit and the hash of the repaired rows.

    A conversation without rows has zeros, an empty audit and the hash of nothing. Odd input as in ``repair``.
    """
    one, more = repair(conversations, faulty, most_rows, most_bytes)
    found = one.mapInArrow(digests, DIGEST).unionByName(more.mapInArrow(digests, DIGEST))
    kind = conversations.schema["conv_id"].dataType
    return found.select(F.when(F.col("key") != "n", F.substr("key", F.lit(2))).cast(kind).alias("conv_id"),
                        "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summary(ready(spark).read.parquet(f"{sf_dir}/conversations.parquet"), damage)


OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS said FROM conversations),
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(said, ''), lambda c: CAST(ord(c) AS BIGINT))),
        lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS k FROM named, crc),
harmed AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, E' \t\n\x0b\x0c\r') AS core FROM harmed),
fault AS (SELECT *, CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
    count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM fault GROUP BY conv_id),
ahead AS (SELECT unnest([0, 1, 2, 3]) AS s, unnest([2, 2, 3, 2]) AS next),
ins AS (SELECT s, s AS s2, 0 AS cost, '' AS ops, '' AS said FROM ahead
    UNION ALL SELECT s, next, 3, 'I', chr(10) || CASE next WHEN 2 THEN 'user:' ELSE 'assistant:' END FROM ahead
    UNION ALL SELECT a.s, b.next, 6, 'II', chr(10) || CASE a.next WHEN 2 THEN 'user:' ELSE 'assistant:' END || chr(10)
        || CASE b.next WHEN 2 THEN 'user:' ELSE 'assistant:' END FROM ahead a JOIN ahead b ON b.s = a.next),
conv AS (SELECT DISTINCT conv_id FROM conversations),
way(conv_id, i, s, best) AS (
    SELECT conv_id, CAST(0 AS BIGINT), s2, {'cost': cost, 'ops': ops, 'said': said} FROM conv, ins WHERE ins.s = 0
    UNION ALL
    SELECT conv_id, i, s2, min({'cost': c + ins.cost, 'ops': o || ins.ops, 'said': t || ins.said}) FROM (
        SELECT w.conv_id, r.i, w.s, w.best.cost + 4 AS c, w.best.ops || 'D' AS o, w.best.said AS t
        FROM way w JOIN fault r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
        UNION ALL
        SELECT w.conv_id, r.i, CASE substr(r.role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
            w.best.cost + CASE WHEN f = 't' THEN 3 ELSE 0 END, w.best.ops || 'K', w.best.said || chr(10) || r.role || ':' || r.text
        FROM way w JOIN fault r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
        WHERE f NOT IN ('b', 'd') AND substr(r.role, 1, 1) || w.s IN ('s0', 'u0', 'u1', 'u3', 'a2')
        UNION ALL
        SELECT w.conv_id, r.i, next, w.best.cost + CASE WHEN f = 't' THEN 6 ELSE 3 END, w.best.ops || 'R',
            w.best.said || chr(10) || CASE next WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text
        FROM way w JOIN fault r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN ahead ON ahead.s = w.s
        WHERE f NOT IN ('b', 'd')) step JOIN ins ON ins.s = step.s GROUP BY conv_id, i, s2),
done AS (SELECT w.conv_id, min(best) AS best FROM way w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
    WHERE w.i = coalesce(c.n, 0) AND w.s IN (0, 3) GROUP BY w.conv_id)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.cost AS BIGINT) AS cost,
    best.ops AS audit, sha256(substr(best.said, 2)) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""
