"""What several corpus operators share: tables, stable hashes and joins against tables of checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.session import cut_lineage

#: A side of a join is broadcast only when its measured size is below this many bytes.
BROADCAST_BYTES = 8 << 20
#: Copies of each row of a larger small side, so that one hot key is spread over as many tasks.
SALTS = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the named columns: whatever else the input carries cannot clash with columns made here."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def plain_names(df: DataFrame, made: list[str]) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The columns that an operator keeps, all but those it makes, as c0, c1, ...; their own names in order; and which became which.

    Whatever a column is called, dots and backticks included, it cannot clash with a name used inside.
    """
    kept = [c for c in df.columns if c not in made]
    numbered = {c: f"c{i}" for i, c in enumerate(kept)}
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in numbered.items()]), kept, numbered


def copies(df: DataFrame, name: str, lot: int = 4096) -> DataFrame:
    """The rows with a number, 0 to n - 1 among n equal ones. Equal rows are counted and made again, in lots that are dealt
    to tasks, so no task holds them all; rows should be slim and their columns sortable."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    lots = counted.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__n - 1) div {lot}"))))
    last = F.least(F.col("__n"), (F.col("__lot") + 1) * lot) - 1
    return lots.withColumn(name, F.explode(F.sequence(F.col("__lot") * lot, last))).drop("__n", "__lot")


def key_of(column: Column) -> Column:
    """A text key that is never null, so that rows without a value form a group of their own."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) that depends on nothing but its parts."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def carried(docs: DataFrame, text: str, carry: tuple[str, ...], made: list[str]) -> tuple[DataFrame, int, list[str], list[str]]:
    """The carried columns, then the text where it is not among them; the place of the text; names and types of the carried.

    Columns named like those that the operator makes are replaced, so they are not carried.
    """
    carry = [c for c in carry if c not in made]
    columns = [F.col(f"`{c}`") for c in carry]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    if text in carry:
        return docs.select(*columns), carry.index(text), carry, kinds
    return docs.select(*columns, F.col(f"`{text}`").alias("__text")), len(carry), carry, kinds


def attach(docs: DataFrame, decided: DataFrame, identity: dict[str, Column], columns: list[str]) -> DataFrame:
    """`row` (a struct of all columns of `docs`) with the decided columns.

    `decided` has the columns named by `identity` and must hold the same rows as `docs` by them, null values included;
    rows of one identity take the decisions made for it in turn. One exchange by identity serves join and numbering.
    """
    keys = [f"__k{i}" for i in range(len(identity))]
    grouped = decided.groupBy(*[key_of(F.col(c)).alias(k) for c, k in zip(identity, keys, strict=True)]).agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("__all"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[key_of(v).alias(k) for v, k in zip(identity.values(), keys, strict=True)])
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return packed.join(grouped, keys).withColumn("__one", F.get("__all", turn - 1)).select("row", *[F.col(f"__one.{c}") for c in columns])


def small_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """Left join against a table that is expected to be small.

    Its bytes are measured first. Below `BROADCAST_BYTES` it is broadcast; above, each of its rows is repeated per salt
    and the rows of `big` choose a salt by the hash of `spread`, so no key is left to a single task.
    """
    small = cut_lineage(small)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in small.schema.fields if f.dataType.simpleString() == "string"]
    width = sum(texts, F.lit(24 * len(small.columns)))
    if (small.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, "left")
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    chosen = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(SALTS)).cast("int")
    return big.withColumn("__salt", chosen).join(salted, [*on, "__salt"], "left").drop("__salt")
