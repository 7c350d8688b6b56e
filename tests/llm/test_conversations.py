"""Conversation repair: block tables against a search over all edits, segments against whole conversations."""

import hashlib
import heapq
import random
import zlib
from itertools import product

import numpy as np
import pytest
import regex

from tidewatch.llm import conversations as c
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\f\r"
GRAMMAR = regex.compile("(s?(ua)+)?")


def search(rows):
    """Least (cost, audit) and the repaired rows by uniform-cost search; rows are (role, text, fault)."""
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        said = "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _ in made)
        if not GRAMMAR.fullmatch(said, partial=True):
            continue
        if i == len(rows) and GRAMMAR.fullmatch(said):
            return cost, audit, made
        if len(made) < len(rows) + 4:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", i, (*made, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, made))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*made, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*made, (new, text))))


def brute(rows, damaged=True):
    """Result rows by conv_id; rows are (conv_id, turn, role, text)."""
    after = {}
    for conv, turn, role, text in rows:
        own = after.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        said = [" " if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(said).encode()) % 20 if damaged else 9
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(x for x in text if x not in ".!?")
        if fault == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, found = set(), []
        for _, role, text in own:
            core = text.strip(BLANK)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            found.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(found, found[1:])]
        cost, audit, made = search(found)
        counts = [sum(f == x for _, _, f in found) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def result(df):
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    return got


def random_rows(rng, convs, most):
    texts = ["Yes.", "No!", "cut off", "", " \n", "Ok?  ", "é."]
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant", "user", "assistant"]
    return [(k, rng.choice([t, t, t + 2, None]), rng.choice(roles), rng.choice([*texts, f"Text {k}-{t}.", f"open {t}", None]))
            for k in range(convs) for t in range(rng.randrange(most + 1))]


def test_tables_by_search():
    """All symbol strings of up to four rows: the trace of the block tables is the least of all cheapest ones."""
    t = c.Tables(2)
    text = {0: ("user", "", "blank")}
    for kind, role in enumerate(("system", "user", "assistant", "tool")):
        text[1 + 2 * kind], text[2 + 2 * kind] = (role, "x.", ""), (role, "x", "truncated")
    for n in range(4):
        for syms in product(range(c.SYMBOLS), repeat=n):
            edits, state = t.trace(np.array(syms, np.int64), 0, 0)
            assert "".join(edits) + c.last_inserts(state) == search([text[s] for s in syms])[1], syms


@pytest.mark.parametrize("width", [1, 3, 4])
def test_widths_agree(width):
    rng = np.random.default_rng(width)
    t, plain = c.Tables(width), c.Tables(2)
    for n in (0, 1, 2, 5, 50, 3001):
        syms = rng.integers(0, c.SYMBOLS, n)
        assert t.trace(syms, 0, 0) == plain.trace(syms, 0, 0)
        assert t.map(syms).tolist() == [plain.ends(syms, v)[1] for v in range(len(t.vectors))]


def test_damaged_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op11_conversation_repair"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("most_rows,most_bytes", [(c.SEGMENT_ROWS, c.SEGMENT_BYTES), (3, c.SEGMENT_BYTES), (100, 12)])
def test_random_conversations_in_segments(spark, most_rows, most_bytes):
    """Short segments: conversations chained over many of them, with copies across segments."""
    rows = random_rows(random.Random(7), 60, 9)
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1000, None, None, None), (1001, 5, "user", "a."), (1001, 5, "user", "a.")]
    made = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seg int, key string").repartition(5)
    assert result(c.repair_summary(made, c.undamaged, most_rows, most_bytes)) == brute(rows, False)
    assert result(c.repair_summary(made, c.damage, most_rows, most_bytes)) == brute(rows)


def test_one_long_conversation(spark):
    """One conversation of a third of the rows is cut into many segments and gives what one segment gives."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Said {t}.", f"cut {t}", "Again."])) for t in range(4000)]
    made = spark.createDataFrame(rows + random_rows(rng, 20, 5), "conv_id long, turn long, role string, text string").repartition(4)
    got = result(c.repair_summary(made, most_rows=200))
    assert got == result(c.repair_summary(made)) and len(got[7][6]) >= 4000


def test_repaired_turns_and_empty_tables(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "cut"), (2, 1, "user", ""), (3, 1, "user", "x" * 300_000 + ".")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in c.repaired_turns(made).orderBy("key", "part", "seg", "pos").select("key", "role", "text").collect()]
    # Deleting both rows of the first costs 8; keeping them needs more.
    assert [r for r in got if r[0] == "v1"] == [("v1", *r) for r in search([("assistant", "Hello.", ""), ("user", "cut", "truncated")])[2]]
    assert [r for r in got if r[0] == "v2"] == []
    assert c.repair_summary(made.where("false")).count() == 0 and c.repaired_turns(made.where("false")).count() == 0
    named = made.selectExpr("concat('c ', conv_id) as conv_id", "turn", "role", "text")
    assert {r.conv_id for r in c.repair_summary(named).collect()} == {"c 1", "c 2", "c 3"}
