"""Dominance counting: for every point, how many points have a smaller slot and a strictly larger level.

Levels are leaves of a binary trie. A level is larger than another exactly if, at the highest bit in which they differ, it has a one where
the other has a zero. So for every bit, points are grouped by the bits above it; in a group, the one-bit points of earlier
slots are summed in the order of slots, and that running sum is credited to the zero-bit points. A point's count is its credit over all bits.

1. Points become cells: one row for each (slot, level) with its number of points and their weight (combined in the tasks that read).
2. Each cell stands once in a group for every bit in which levels differ at all. Groups keep one row for a slot, so a group, and the top bit's
   holds everything, has no more rows than there are slots.
3. Running sums go in two steps, so that no task needs all slots either: within blocks of ``2**BLOCK_BITS`` neighbouring slots, and
   over the blocks' totals.
4. Credits go back to the cells of their zero bits, are added up, and join the points.

Only the least and greatest level come to the driver, and nothing is broadcast (the joins ask for sorted merging, which splits cells that many
points share while it runs).

Edge cases: points without slot or level are above none and have null counts; equal slots or equal levels are not above each other; repeated
points count each; levels may be negative and as far apart as longs are; one level or an empty table needs no trie; other columns are ignored.
Query op11: totals that are NaN, infinite or beyond longs have no level; a null sale_id stands for one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, table

#: Slots of a block of the running sums: 64.
BLOCK_BITS = 6
LOWEST = -(1 << 63)


def _codes(low: int, high: int) -> tuple[Column, int]:
    """The levels' unsigned codes in their order, and the number of low bits in which codes differ."""
    if high - low < 1 << 63:
        return F.col("level") - F.lit(low).cast("long"), (high - low).bit_length()
    return F.col("level").bitwiseXOR(F.lit(LOWEST).cast("long")), 64


def _earlier(keys: list[str], order: str, *names: str) -> list[Column]:
    """Running sums over the rows before this one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"{n}_before") for n in names]


def credits(cells: DataFrame, low: int, high: int) -> DataFrame:
    """cells: slot, level, n, weight (one row a cell) of levels from low to high -> slot, level, n_above, weight_above; cells under nothing are left out."""
    code, bits = _codes(low, high)
    spread = cells.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).withColumn("top", F.call_function("shiftrightunsigned", code, F.col("bit")))
    spread = spread.select("slot", "level", "n", "weight", "bit", F.shiftrightunsigned("top", 1).alias("prefix"), (F.col("top").bitwiseAND(1) == 1).alias("one"))
    ones = [F.sum(F.when(F.col("one"), F.col(c)).otherwise(0)).alias(c) for c in ("n", "weight")]
    nodes = spread.groupBy("bit", "prefix", "slot").agg(*ones).withColumn("block", F.shiftright("slot", BLOCK_BITS))
    inside = nodes.select("bit", "prefix", "block", "slot", *_earlier(["bit", "prefix", "block"], "slot", "n", "weight"))
    blocks = nodes.groupBy("bit", "prefix", "block").agg(F.sum("n").alias("b"), F.sum("weight").alias("bw"))
    blocks = blocks.select("bit", "prefix", "block", *_earlier(["bit", "prefix"], "block", "b", "bw"))
    sums = inside.join(blocks.hint("merge"), ["bit", "prefix", "block"])
    sums = sums.select("bit", "prefix", "slot", (F.col("n_before") + F.col("b_before")).alias("c"), (F.col("weight_before") + F.col("bw_before")).alias("cw")).where("c > 0")
    zeros = spread.where(~F.col("one")).select("bit", "prefix", "slot", "level")
    return zeros.join(sums.hint("merge"), ["bit", "prefix", "slot"]).groupBy("slot", "level").agg(F.sum("c").alias("n_above"), F.sum("cw").alias("weight_above"))


def count_above(points: DataFrame) -> DataFrame:
    """points: id, slot long, level long, weight long -> id, slot, level, n_above, weight_above (long), one row for each point."""
    points = pick(points, "id", "slot", "level", "weight")
    cells = cut(points.where("slot IS NOT NULL AND level IS NOT NULL").groupBy("slot", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("weight", F.lit(0))).alias("weight")))
    low, high = cells.agg(F.min("level"), F.max("level")).first()
    placed = F.col("slot").isNotNull() & F.col("level").isNotNull()
    if low is None or low == high:
        return points.select("id", "slot", "level", *[F.when(placed, F.lit(0)).cast("long").alias(c) for c in ("n_above", "weight_above")])
    found = credits(cells, low, high).withColumn("apart", F.lit(0).cast("long"))
    # points without a place meet nothing: a key of their own spreads them
    spread = points.withColumn("apart", F.when(placed, F.lit(0)).otherwise(F.xxhash64("id")))
    joined = spread.join(found.hint("merge"), ["slot", "level", "apart"], "left")
    return joined.select("id", "slot", "level", *[F.when(placed, F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("n_above", "weight_above")])


def _slot(df: DataFrame, name: str) -> Column:
    """Days since 1970 of a time without zone or, of an instant, in UTC."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.unix_date(F.col(name).cast("date")).cast("long")
    return F.floor(F.unix_seconds(name) / 86400).cast("long")


def _level(total: Column) -> Column:
    """floor(floor(100 * total + 0.5) / 1000) on doubles; null beyond longs."""
    cents = 100 * total.cast("double") + 0.5
    whole = F.when(F.abs(cents) < 2.0**53, F.floor(cents).cast("double")).otherwise(cents) / 1000
    return F.when(F.abs(whole) < 2.0**63, F.floor(whole)).cast("long")


def points_of(sales: DataFrame) -> DataFrame:
    sales = pick(sales, "sale_id", "sold_at", "total")
    copies = F.coalesce(1 + F.crc32(F.col("sale_id").cast("string").cast("binary")) % 3, F.lit(1)).cast("long")
    return sales.select(F.col("sale_id").alias("id"), _slot(sales, "sold_at").alias("slot"), _level(F.col("total")).alias("level"), copies.alias("weight"))


def query(spark, sf_dir: str) -> DataFrame:
    found = count_above(points_of(table(spark, sf_dir, "sales")))
    return found.select(F.col("id").alias("sale_id"), "slot", "level", F.col("n_above").alias("n_sales"), F.col("weight_above").alias("n_rows"))


def oracle() -> str:
    return """
    WITH s AS (SELECT sale_id, floor(epoch_us(sold_at) / 86400000000)::BIGINT AS slot, TRY_CAST(floor(floor(100 * total + 0.5) / 1000) AS BIGINT) AS level,
                      list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(sale_id::VARCHAR, ''),
                                      lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                                  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r
               FROM sales),
    p AS (SELECT sale_id, slot, level, coalesce(1 + (4294967295 - r) % 3, 1) AS m FROM s),
    c AS (SELECT slot, level, count(*) AS n, sum(m) AS m FROM p WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
    a AS (SELECT x.slot, x.level, coalesce(sum(y.n), 0)::BIGINT AS n_sales, coalesce(sum(y.m), 0)::BIGINT AS n_rows
          FROM c x LEFT JOIN c y ON y.slot < x.slot AND y.level > x.level GROUP BY ALL)
    SELECT sale_id, slot, level, n_sales, n_rows FROM p LEFT JOIN a USING (slot, level)"""
