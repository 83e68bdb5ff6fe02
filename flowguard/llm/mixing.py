"""Mixing sources to target weights by pivotal dependent rounding of copy counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.llm.common import attach, copies, key_of, plain_names, small_join, uniform
from flowguard.session import cut_lineage

#: Units that one node of the reduction tree combines.
FAN = 64


def targets(rows: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: `key`, `n` rows, `source_size` and `target`.

    Sources by code point, null last, take the weights in turn and share the size of all rows. A target stops at `cap`
    times its source's size; the excess is shared again by weight until no target is above. That fixed point is
    min(cap * size, level * weight): sources are sorted by cap * size / weight, and the level is what remains for the
    weights behind the first k of them, at the first k whose successor is not below that level.
    """
    grouped = rows.groupBy(key_of(F.col(source)).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(size, F.lit(0))).cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("key") == "n", "key"))  # one row per source
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int"))
    ratio = F.col("most") / F.col("weight")
    sources = cut_lineage(grouped.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap))
    ordered = Window.orderBy(ratio, "key")
    earlier, later = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = sources.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(earlier), F.lit(0)))
                                / F.sum("weight").over(later)).withColumn("ratio", ratio)
    level = F.coalesce(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "key", "level"))).over(everything)["level"], F.lit(0.0))
    return (levels.withColumn("level", level)
            .select("key", "n", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target")))


def mix(rows: DataFrame, source: str = "source", size: str = "size", identity: tuple[str, ...] = ("doc_id",),
        weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, fan: int = FAN) -> DataFrame:
    """Adds `source_size`, `target` and `copies` (0 to cap) to every row; `size` times `copies` is what the mix takes.

    A row of a source whose target is c times its size is taken floor(c) times, and once more with probability c - floor(c).
    The extra copies are rounded dependently: two rows with open mass (probability times size) are paired, and mass
    moves from one to the other, the direction drawn so that each keeps its expectation, until one of them holds none
    or all of its size. The mass of a source is kept exactly, so what it takes misses its target by at most half of one row's size.
    Leaves pair about `fan` rows, largest first; each leaves at most one row open, and the open rows of `fan` nodes meet
    in the next node until one per source is left, which is taken if at least half of its mass remains. All draws are
    hashes, so a rerun or a repeated task decides alike.

    Equal rows are counted first and numbered, and leaves are dealt by identity, size and number, so neither a missing
    identity nor many equal rows fill a leaf.

    Rows of null or zero size hold no mass and get floor(c) copies. Null sources form one source. Rows that agree in
    identity and size are interchangeable. Empty tables give empty results. Existing columns of the added names are
    replaced. Columns must be sortable, and should be slim: rows are written once between leaves and tree.
    """
    rows, names, of = plain_names(rows, ["source_size", "target", "copies"])
    source, size, identity = of[source], of[size], tuple(of[c] for c in identity)
    sources = cut_lineage(targets(rows, source, size, weights, cap))
    drawn = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]
    units = copies(rows, "copy").select(F.struct(*rows.columns).alias("row"), key_of(F.col(source)).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("double").alias("z"),
                                        F.xxhash64(F.lit(seed), *drawn, F.coalesce(F.col(size), F.lit(0)), "copy").alias("h"))
    units = small_join(units, sources, ["key"], ["h"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    leaf = F.pmod(F.col("h"), F.ceil(F.col("n") / fan).cast("long"))
    units = units.withColumn("rate", rate).withColumn("block", leaf).select(
        "key", "block", F.struct((-F.col("z")).alias("largest"), "h", "z", ((F.col("rate") - F.floor("rate")) * F.col("z")).alias("m"),
                                 F.floor("rate").cast("int").alias("whole"), "row", "source_size", "target").alias("unit"))
    level = cut_lineage(_node(units, seed))
    widest = sources.agg(F.max("n")).first()[0] or 0
    blocks, closed = -(-widest // fan), [_closed(level)]
    while blocks > 1:
        level = _node(_open(level).withColumn("block", F.expr(f"block div {fan}")), seed)
        closed.append(_closed(level))
        blocks = -(-blocks // fan)
    last = _open(level)
    closed.append(last.select("unit", (2 * F.col("unit.m") >= F.col("unit.z")).cast("int").alias("more")))
    decided = closed[0]
    for part in closed[1:]:
        decided = decided.unionByName(part)
    return decided.select("unit.row.*", "unit.source_size", "unit.target", (F.col("unit.whole") + F.col("more")).alias("copies")).toDF(
        *names, "source_size", "target", "copies")


def _node(units: DataFrame, seed: int) -> DataFrame:
    """Fold the units of each block; `kept` lists what was decided as (place, more), `left` is the place still open."""
    gathered = units.groupBy("key", "block").agg(F.sort_array(F.collect_list("unit")).alias("u"))
    nothing = F.expr("struct(cast(array() as array<struct<i:int,more:int>>) as kept, -1 as left, 0.0D as m)")
    folded = F.aggregate(F.sequence(F.lit(0), F.size("u") - 1), nothing, lambda state, i: _pair(F.col("u"), state, i, seed))
    return gathered.withColumn("state", folded)


def _pair(u: Column, state: Column, i: Column, seed: int) -> Column:
    """One step: the open unit (a) meets the next one (b)."""
    def let(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def after(done, left, m) -> Column:
        entries = F.array(*[F.struct(place.cast("int").alias("i"), F.lit(more).alias("more")) for place, more in done])
        return F.struct(F.concat(state["kept"], entries).alias("kept"), left.cast("int").alias("left"), m.alias("m"))

    a, none, zero = state["left"], F.lit(-1), F.lit(0.0)

    def meet(x: Column) -> Column:
        into_a, into_b = F.least(x["za"] - x["ma"], x["mb"]), F.least(x["ma"], x["zb"] - x["mb"])
        upward = x["draw"] * (into_a + into_b) < into_b
        full_a, empty_b = into_a == x["za"] - x["ma"], into_a == x["mb"]
        empty_a, full_b = into_b == x["ma"], into_b == x["zb"] - x["mb"]
        return (F.when(upward & full_a & empty_b, after([(a, 1), (i, 0)], none, zero))
                .when(upward & full_a, after([(a, 1)], i, x["mb"] - into_a))
                .when(upward, after([(i, 0)], a, x["ma"] + into_a))
                .when(empty_a & full_b, after([(a, 0), (i, 1)], none, zero))
                .when(empty_a, after([(a, 0)], i, x["mb"] + into_b))
                .otherwise(after([(i, 1)], a, x["ma"] - into_b)))

    b = F.get(u, i)
    return (F.when(b["m"] <= 0, after([(i, 0)], a, state["m"]))
            .when(a < 0, F.struct(state["kept"].alias("kept"), i.cast("int").alias("left"), b["m"].alias("m")))
            .otherwise(let(F.struct(F.get(u, a)["z"].alias("za"), state["m"].alias("ma"), b["z"].alias("zb"), b["m"].alias("mb"),
                                    uniform(seed, F.get(u, a)["h"], b["h"]).alias("draw")), meet)))


def _closed(level: DataFrame) -> DataFrame:
    return (level.select("u", F.explode("state.kept").alias("d"))
            .select(F.get("u", F.col("d.i")).alias("unit"), F.col("d.more").alias("more")))


def _open(level: DataFrame) -> DataFrame:
    unit = F.get("u", F.col("state.left"))
    return level.where("state.left >= 0").select("key", "block", unit.withField("m", F.col("state.m")).alias("unit"))


def repeat_rows(docs: DataFrame, mixed: DataFrame, identity: dict[str, Column]) -> DataFrame:
    """The rows of `docs`, each as often as `mixed` decided for it."""
    decided = attach(docs, mixed, identity, ["copies"])
    return decided.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
