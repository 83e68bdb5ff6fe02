"""Repair of conversations: the cheapest edits that give a legal order of roles, found as a lightest derivation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Where a derivation stands after a row of a role (by initial), from nothing yet (0), a system (1), a user (2) or an
#: assistant row (3). From every place exactly one of user and assistant may follow.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
GOALS = (0, 3)
#: Rows that one agenda derives; longer conversations are derived stretch by stretch.
STRETCH = 256
#: Characters of one piece of a long repaired conversation.
PIECE = 1 << 20


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str | None


Weight = tuple[int, str]


def agenda(start: dict, deduce: Callable, final: Callable[[tuple], bool]) -> tuple[dict[tuple, Weight], dict[tuple, tuple]]:
    """Knuth's generalisation of Dijkstra: weights (cost, audit) of the final items, and the item each was concluded from.

    Items wait on the agenda with a weight and are settled in its order. `deduce(item, weight)` gives the conclusions that
    a settled item allows with their weights, which are never below its own: edits only add cost, and an audit only grows.
    Audits of equal cost over the same rows are never prefixes of each other, so what is least stays least when extended.
    """
    waiting: list[tuple[int, str, tuple, tuple | None]] = []
    for item, (cost, audit) in start.items():
        heappush(waiting, (cost, audit, item, None))
    settled: dict[tuple, Weight] = {}
    behind: dict[tuple, tuple] = {}
    while waiting:
        cost, audit, item, before = heappop(waiting)
        if item in settled:
            continue
        settled[item], behind[item] = (cost, audit), before
        for follower, (c, a) in deduce(item, (cost, audit)):
            if follower not in settled:
                heappush(waiting, (c, a, follower, item))
    return {item: weight for item, weight in settled.items() if final(item)}, behind


def stretch(rows: list[Row], place: int) -> dict[int, Weight]:
    """The lightest derivation of rows from a place to every place at their end; items are (rows read, place)."""
    def deduce(item, weight):
        at, here = item
        cost, audit = weight
        after = MOVES[here, NEXT[here][0]]
        yield (at, after), (cost + INSERT, audit + "I")
        if at == len(rows):
            return
        row = rows[at]
        yield (at + 1, here), (cost + DELETE, audit + "D")
        if row.fault in ("blank", "duplicate"):
            return
        extra = CUT_OFF if row.fault == "truncated" else 0
        kept = MOVES.get((here, row.role[:1]))
        if kept is not None:
            yield (at + 1, kept), (cost + extra, audit + "K")
        yield (at + 1, after), (cost + RETYPE + extra, audit + "R")

    ends, _ = agenda({(0, place): (0, "")}, deduce, lambda item: item[0] == len(rows))
    return {end: weight for (_, end), weight in ends.items()}


def join_stretches(parts: list[Callable[[int], dict[int, Weight]]], place: int) -> dict[int, tuple[int, str, list[tuple[int, int]]]]:
    """The lightest derivation over consecutive stretches to every place at the end: cost, audit, and the places between
    which it crosses each stretch. A derivation up to a stretch and one of the stretch itself conclude a longer one."""
    def deduce(item, weight):
        at, here = item
        if at < len(parts):
            for end, (cost, audit) in parts[at](here).items():
                yield (at + 1, end), (weight[0] + cost, weight[1] + audit)

    ends, behind = agenda({(0, place): (0, "")}, deduce, lambda item: item[0] == len(parts))
    found = {}
    for item, (cost, audit) in ends.items():
        path = [item]
        while behind[path[-1]] is not None:
            path.append(behind[path[-1]])
        places = [here for _, here in reversed(path)]
        found[item[1]] = (cost, audit, list(zip(places, places[1:])))
    return found


def lightest(rows: list[Row], place: int = 0) -> dict[int, Weight]:
    """`stretch` for any number of rows."""
    if len(rows) <= STRETCH:
        return stretch(rows, place)
    parts = [lambda here, part=rows[i:i + STRETCH]: stretch(part, here) for i in range(0, len(rows), STRETCH)]
    return {end: (cost, audit) for end, (cost, audit, _) in join_stretches(parts, place).items()}


def apply(rows: list[Row], audit: str, place: int = 0) -> Iterator[tuple[str, str]]:
    """Roles and texts that the edits leave."""
    at = 0
    for edit in audit:
        row = None if edit == "I" else rows[at]
        at += row is not None
        if edit == "D":
            continue
        role, text = (row.role if edit == "K" else NEXT[place]), (row.text if row else "")
        place = MOVES[place, role[:1]]
        yield role, text


COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _counts(rows: list[Row]) -> dict:
    turns = [r.turn for r in rows if r.turn is not None]
    faults = [r.fault for r in rows]
    pairs = zip(rows, rows[1:])
    return {c: faults.count(c) for c in COUNTS[:3]} | {
        "illegal": sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in pairs),
        "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None)}


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Scalar, list[Row]]]:
    """Runs of rows of one (slice, conversation), in order; rows that the input marks as dropped are left out."""
    held, key, first = [], None, None
    for batch in batches:
        column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for i, (slice_, conversation) in enumerate(zip(column["slice"], column["conversation"])):
            if key != (slice_, conversation):
                if key is not None:
                    yield key, first, held
                held, key, first, seen = [], (slice_, conversation), batch.column("conversation")[i], set()
            if column["dropped"][i]:
                continue
            role, text, again = column["role"][i], column["text"][i], column["again"][i]
            if column["blank"][i]:
                fault = "blank"
            else:
                if again is None:
                    again = (role, text) in seen
                    seen.add((role, text))
                fault = "duplicate" if again else "truncated" if column["cut_off"][i] else None
            held.append(Row(column["turn"][i], role, text, fault))
    if key is not None:
        yield key, first, held


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000, characters: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, wide = [], 0
    for row in rows:
        held.append(row)
        wide += sum(len(v) for v in row.values() if isinstance(v, str))
        if len(held) >= size or wide > characters:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, wide = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _finish(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Conversations that lie in one slice."""
    def found() -> Iterator[dict]:
        for _, name, rows in _conversations(batches):
            counts, ends = _counts(rows), lightest(rows)
            cost, audit = min(ends[g] for g in GOALS if g in ends)
            yield {"conversation": name.as_py(), "gaps": _gaps(counts["low"], counts["high"], counts["turns"]), **{c: counts[c] for c in COUNTS}, "cost": cost,
                   "audit": audit, "repaired": "\n".join(f"{role}:{text}" for role, text in apply(rows, audit))}
    return _in_batches(found(), schema)


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What the rest of a conversation must know about its rows in one slice."""
    def found() -> Iterator[dict]:
        for (slice_, _), name, rows in _conversations(batches):
            ways = [{"start": p, "end": q, "cost": cost, "audit": audit} for p in range(4) for q, (cost, audit) in lightest(rows, p).items()]
            yield {"conversation": name.as_py(), "slice": slice_, **_counts(rows), "n": len(rows), "first": rows[0].role[:1] if rows else "",
                   "last": rows[-1].role[:1] if rows else "", "ways": ways}
    return _in_batches(found(), schema)


def _compose(segments: pa.Table, schema: pa.Schema) -> pa.Table:
    """One conversation from its segments: one row per slice, each with the lightest derivations between places."""
    rows = sorted(segments.to_pylist(), key=lambda r: r["slice"])
    parts = [lambda here, ways=r["ways"]: {w["end"]: (w["cost"], w["audit"]) for w in ways if w["start"] == here} for r in rows]
    ends = join_stretches(parts, 0)
    cost, audit, crossed = min(ends[g] for g in GOALS if g in ends)
    total = {c: sum(r[c] for r in rows) for c in [*COUNTS, "turns"]}
    held = [r for r in rows if r["n"]]
    total["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
    turned = [r for r in rows if r["low"] is not None]
    total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:]))
    low, high = (turned[0]["low"], turned[-1]["high"]) if turned else (None, None)
    path = [{"slice": r["slice"], "start": p, "end": q} for r, (p, q) in zip(rows, crossed)]
    return pa.Table.from_pylist([{"conversation": rows[0]["conversation"], "gaps": _gaps(low, high, total["turns"]), **{c: total[c] for c in COUNTS},
                                  "cost": cost, "audit": audit, "path": path}], schema)


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The repaired rows of a segment, each behind a line end, in pieces of bounded length."""
    def found() -> Iterator[dict]:
        ways: dict[tuple, tuple[int, int]] = {}

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = [batch.column(n).to_pylist() for n in ("slice", "conversation", "start", "end")]
                for s, c, p, q in zip(*column):
                    ways[s, c] = (p, q)
                yield batch

        for key, name, rows in _conversations(watched()):
            place, end = ways.pop(key)
            piece, number, wide = [], 0, 0
            for role, text in apply(rows, lightest(rows, place)[end][1], place):
                piece.append(f"\n{role}:{text}")
                wide += len(piece[-1])
                if wide >= PIECE:
                    yield {"conversation": name.as_py(), "slice": key[0], "number": number, "text": "".join(piece)}
                    piece, number, wide = [], number + 1, 0
            if piece:
                yield {"conversation": name.as_py(), "slice": key[0], "number": number, "text": "".join(piece)}
    return _in_batches(found(), schema)


def damage(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`conversation`, `turn`, `role`, `text` and `dropped` of every row after the damage that a hash of its place deals.

    By crc32 of `conversation:turn` modulo 20: 0 drops the row (it stays here, marked), 1 empties its text, 2 takes away
    full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's. Nulls show as one space.
    """
    named = rows.select(F.col(f"`{conversation}`").alias("conversation"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
                        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conversation", "turn")])
    dealt = named.withColumn("deal", F.crc32(place) % 20)
    return dealt.select(
        "conversation", "turn", F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("deal") == 0).alias("dropped"), F.explode(F.when(F.col("deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


class Repaired(NamedTuple):
    """`conversations`: one row each, with the repaired text unless it is in `pieces` (long conversations)."""
    conversations: DataFrame
    pieces: DataFrame


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def repair(rows: DataFrame, slices: int | None = None) -> Repaired:
    """Faults, cheapest edits and repaired text of every conversation of `rows` (as `damage` returns them).

    Rows are taken by turn (nulls first), then role and text; equal rows are interchangeable. A row is blank (nothing but
    ASCII white space), else a duplicate (role and text seen earlier), else truncated (its last character ends no
    sentence). Blank rows and duplicates must be deleted (4); others are kept (0), given the other speaker's role (3) or
    deleted, empty rows of a speaker are inserted anywhere (3), and truncated rows that stay add 3. What stays must be
    at most one system row and then user and assistant in turn, or nothing; of the cheapest edits the least in ASCII
    order is taken. Roles count by their first character; an empty role has none and fits nowhere. Marked rows
    (`dropped`) only name their conversation: one without other rows has zero counts, an empty audit and an empty text.
    Null conversations are one conversation; an empty table gives an empty result. Other columns are ignored.

    The rows are range-sorted once into slices (by default as many as Spark's adaptive execution sees fit), so a conversation of any size is spread over tasks. One that lies in a
    slice is derived there. One that spans slices is derived between all places in each slice, and its few segments
    are joined, after which every slice writes its share of the repaired text.
    """
    spark, order = rows.sparkSession, ["conversation", "turn", "role", "text", "tie"]
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    marked = rows.select("conversation", "turn", "role", "text", "dropped", (trimmed == "").alias("blank"),
                         (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut_off"), F.lit(None).cast("boolean").alias("again"),
                         F.monotonically_increasing_id().alias("tie"))
    ranged = marked.repartitionByRange(*([slices] if slices else []), *order).sortWithinPartitions(*order).drop("tie")
    ranged = cut_lineage(ranged.withColumn("slice", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    kind = ranged.schema["conversation"].dataType
    name = F.struct("conversation")
    edges = ranged.groupBy("slice").agg(F.min(name).alias("low"), F.max(name).alias("high"))  # two rows per slice at most
    spanning = cut_lineage(edges.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("name"))
                           .groupBy("name").count().where("count > 1").select(F.col("name.conversation").alias("long")))
    is_long = F.col("conversation").eqNullSafe(F.col("long"))

    def of(*fields: str) -> tuple[str, pa.Schema]:
        from pyspark.sql.pandas.types import to_arrow_schema
        ddl = ", ".join([f"conversation {kind.simpleString()}", *fields])
        return ddl, to_arrow_schema(spark.createDataFrame([], ddl).schema)

    def through(frame: DataFrame, work: Callable, *fields: str) -> DataFrame:
        ddl, schema = of(*fields)
        return frame.mapInArrow(lambda batches: work(batches, schema), ddl)

    short = through(ranged.join(F.broadcast(spanning), is_long, "left_anti"), _finish, RESULT, "repaired string")
    rest = ranged.join(F.broadcast(spanning), is_long, "left_semi")
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    local = rest.where("not dropped and not blank").groupBy("conversation", said.alias("said"), "slice").agg(F.min("at").alias("at"))
    first = local.withColumn("turn_up", F.row_number().over(Window.partitionBy("conversation", "said").orderBy("slice"))).where("turn_up = 1")
    known = rest.join(first.select("at", F.lit(False).alias("new")), "at", "left").withColumn("again", F.coalesce("new", F.lit(True))).drop("new")
    known = cut_lineage(known.repartition("slice").sortWithinPartitions("slice", "at"))
    segments = through(known, _segments, "slice int", "blank bigint", "duplicate bigint", "truncated bigint", "illegal bigint", "turns bigint", "low bigint", "high bigint",
                       "n bigint", "first string", "last string", "ways array<struct<start:int,end:int,cost:bigint,audit:string>>")
    ddl, schema = of(RESULT, "path array<struct<slice:int,start:int,end:int>>")
    composed = cut_lineage(segments.groupBy("conversation").applyInArrow(lambda part: _compose(part, schema), ddl))
    steps = composed.select(F.col("conversation").alias("long"), F.inline("path")).withColumnRenamed("slice", "of")  # one row per segment
    crossed = known.join(F.broadcast(steps), is_long & (F.col("slice") == F.col("of")))
    pieces = through(crossed, _pieces, "slice int", "number int", "text string")
    whole = short.unionByName(composed.drop("path").withColumn("repaired", F.lit(None).cast("string")))
    return Repaired(whole, pieces)


def digests(found: Repaired) -> DataFrame:
    """The conversations with `repaired_sha256` instead of the text; the pieces of long ones are hashed as they stream by."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, name = None, None
        for batch in batches:
            for i, (value, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if state is None or value != name.as_py():
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], batch.schema.field(0).type), pa.array([state.hexdigest()])], names=["long", "digest"])
                    state, name, text = hashlib.sha256(), batch.column(0)[i], text[1:]
                state.update(text.encode("utf-8", "surrogatepass"))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], name.type), pa.array([state.hexdigest()])], names=["long", "digest"])
    kind = found.pieces.schema["conversation"].dataType.simpleString()
    order = ["conversation", "slice", "number"]
    long = (found.pieces.repartition("conversation").sortWithinPartitions(*order).select("conversation", "text")
            .mapInArrow(hashed, f"long {kind}, digest string"))
    joined = found.conversations.join(F.broadcast(long), F.col("conversation").eqNullSafe(F.col("long")), "left")  # one row per spanning conversation
    digest: Column = F.coalesce("digest", F.sha2(F.coalesce("repaired", F.lit("")), 256))
    return joined.select(*[c for c in found.conversations.columns if c != "repaired"], digest.alias("repaired_sha256"))
