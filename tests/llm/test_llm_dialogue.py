"""Conversation repair against all edits, row by row."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest

from flowguard.llm import dialogue, queries

LEGAL = {"": "s u", "s": "u", "u": "a", "a": "u"}


def brute(rows):
    """All roles that may stand at each row, by dynamic programming over whole audits; independent of the agenda."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        if body:
            seen.add((role, text))
    best = {"": (0, "", [])}

    def inserted(states):
        for _ in range(2):
            for last, (cost, audit, out) in list(states.items()):
                for speaker in ("user", "assistant"):
                    if speaker[0] in LEGAL[last].split():
                        new = (cost + 3, audit + "I", [*out, f"{speaker}:"])
                        if speaker[0] not in states or new[:2] < states[speaker[0]][:2]:
                            states[speaker[0]] = new
        return states

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults):
        after = {}

        def offer(last, new):
            if last not in after or new[:2] < after[last][:2]:
                after[last] = new
        for last, (cost, audit, out) in best.items():
            offer(last, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            if role[:1] and role[:1] in LEGAL[last].split():
                offer(role[0], (cost + extra, audit + "K", [*out, f"{role}:{text}"]))
            for speaker in ("user", "assistant"):
                if speaker[0] in LEGAL[last].split():
                    offer(speaker[0], (cost + extra + 3, audit + "R", [*out, f"{speaker}:{text}"]))
        best = inserted(after)
    cost, audit, out = min(best[k] for k in ("", "a") if k in best)
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        show = [" " if v is None else v for v in (conv, turn, role, text)]
        deal = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        if deal == 0:
            continue
        text = "" if deal == 1 else show[3].translate(str.maketrans("", "", ".!?")) if deal == 2 else show[3]
        out[conv] += [(turn, "user" if deal == 4 else show[2], text)] * (2 if deal == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def repaired(frame, slices=None):
    found = dialogue.digests(dialogue.repair(dialogue.damage(frame), slices)).collect()
    assert len({r.conversation for r in found}) == len(found)
    return {r.conversation: tuple(r)[1:] for r in found}


SCHEMA = "conv_id long, turn long, role string, text string, conversation int, `text.x` string, at int, slice string, audit string"
TEXTS = ["Yes.", "No!", "Well", "", None, "  \t\n", "a.\n", "Why?  ", "é", "user", "x" * 50]


def rows_of(seed, conversations, most, hot=0):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "s"]
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randrange(1, most)):
            rows.append((conv, draw.choice([turn, turn, turn, None, turn + 5, 1]), draw.choice(roles), draw.choice(TEXTS)))
    rows += [(None, t % 900, draw.choice(roles), draw.choice([*TEXTS, f"t{t}.", f"u{t}"])) for t in range(hot)]
    return rows


@pytest.mark.parametrize("seed, conversations, most, hot, slices", [(1, 60, 9, 30, 9), (2, 3, 4, 3000, 7), (3, 1, 3, 0, 4), (4, 20, 40, 0, None)])
def test_repair_equals_brute_force(spark, seed, conversations, most, hot, slices):
    """The hot conversation spans all slices and many stretches."""
    rows = rows_of(seed, conversations, most, hot)
    frame = spark.createDataFrame([(*r, 1, "a", 2, "b", "c") for r in rows], SCHEMA)
    assert repaired(frame, slices) == {c: brute(r) for c, r in damaged(rows).items()}


def test_long_conversations_in_pieces(spark):
    """Repeated rows, all turns null: still cut into slices, and the pieces together are the repaired text."""
    rows = [(7, None, "user", "again.")] * 500 + [(7, None, "assistant", f"n{i}.") for i in range(500)] + [(8, 1, "user", "Hi.")]
    found = dialogue.repair(dialogue.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 6)
    pieces = found.pieces.collect()
    assert {p.conversation for p in pieces} == {7} and len({p.slice for p in pieces}) > 1
    want = damaged(rows)
    joined = "".join(p.text for p in sorted(pieces, key=lambda p: (p.slice, p.number)))[1:]
    digest = brute(want[7])[-1]
    assert hashlib.sha256(joined.encode()).hexdigest() == digest
    assert {r.conversation: r.repaired_sha256 for r in dialogue.digests(found).collect()} == {c: brute(r)[-1] for c, r in want.items()}


def test_agenda_settles_in_order_and_stretches_agree():
    draw = random.Random(4)
    rows = [dialogue.Row(i, draw.choice(["system", "user", "assistant", "x"]), f"{i}.", draw.choice([None, None, "blank", "truncated"])) for i in range(700)]
    whole = dialogue.stretch(rows, 0)
    assert dialogue.lightest(rows, 0) == whole
    order = []

    def deduce(item, weight):
        order.append(weight)
        if item[0] < 5:
            yield (item[0] + 1,), (weight[0] + 2, weight[1] + "K")
            yield (item[0] + 2,), (weight[0] + 3, weight[1] + "D")
    dialogue.agenda({(0,): (0, "")}, deduce, lambda item: True)
    assert order == sorted(order)


def test_empty_table_and_dropped_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repaired(spark.createDataFrame([], schema)) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = repaired(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_on_the_given_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversations(spark, folder).collect()}
    assert found == {c: brute(r) for c, r in damaged(rows).items()}
    assert [len(list(g)) for _, g in groupby(sorted(found))] == [1] * len(found)
