"""Alignment, de-duplication, numbering, sampling and splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..shared import settled, ship


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an order that leaves no ties."""
    # A minimum combines before the shuffle, so a key with most of the rows is no hot task. Only the order is compared: maps can't be.
    least = F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_least")
    return df.groupBy(*keys).agg(least).select(*[F.col(c) if c in keys else F.col("_least")[c].alias(c) for c in df.columns])


def align(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Inner join on keys, the left side reduced to its first row of each key."""
    return keep_first(left, keys, order).join(right, keys)


def number(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """Dense numbers from 0 in a global order.

    A window without partitions would move all rows to one task. Instead rows are range
    partitioned, counted by partition (a row each), and numbered within theirs. Range
    bounds are sampled, so the partitioned rows are settled before two plans read them."""
    spark = df.sparkSession
    ordered = settled(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_p", F.spark_partition_id()))
    within = ordered.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    counts = within.groupBy("_p").agg(F.count("*").alias("_c"))
    base = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(base.select("_p", "_b")), "_p").withColumn(name, (F.col("_k") + F.col("_b") - 1).cast("long")).drop("_p", "_k", "_b")


def follow(df: DataFrame, group: list[str], order: str, label: str, first: str, second: str, value: str) -> DataFrame:
    """Rows labelled first whose next row is labelled second, with both values (a, b)."""
    w = Window.partitionBy(*group).orderBy(order)
    rows = df.select(*group, order, label, F.col(value).alias("a"), F.lead(label).over(w).alias("_next"), F.lead(value).over(w).alias("b"))
    return rows.where((F.col(label) == first) & (F.col("_next") == second)).drop("_next", label)


def zip_arrays(a: Column, b: Column) -> Column:
    """Pairs by position, as many as the shorter array has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))


def shuffled(key: str, seed: int = 42) -> Column:
    """Sort key of a reproducible shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


#: Digits of the shuffle's key that one round of counts tells apart, and rows that are few enough to be looked at.
DIGITS, FEW = 4, 1000


def cut_values(df: DataFrame, value: str, ranks: list[int]) -> dict[int, tuple[str, int, int]]:
    """Of each rank from 0 on: the value there by ascending order, the rows below that value, and the rows that have it.

    value is a column of hexadecimal strings of one length, or empty ones. Rows are counted by
    their first digits; what begins as a rank's value does is counted by the next
    digits, until few rows are left. A round reads the column once and gives at most 65,537 counts for each
    rank, whatever the number of rows. Ranks at the end or after it are left out."""
    found: dict[int, tuple[str, int, int]] = {}
    # By rank: the digits known, and the rows below all values that begin with them.
    open_ = {r: ("", 0) for r in ranks}
    size = {"": df.count()}
    open_ = {r: x for r, x in open_.items() if r < size[""]}
    while open_:
        heads = sorted({head for head, _ in open_.values()})
        small = all(size[h] <= FEW for h in heads)
        depth = max(map(len, heads)) + DIGITS
        rows = df if heads == [""] else df.where(F.substring(value, 1, len(heads[0])).isin(heads))
        # Values that have no more digits than those known stay what they are.
        counted = rows.groupBy((F.col(value) if small else F.substring(value, 1, depth)).alias("v")).agg(F.count("*").alias("n"), F.max(F.length(value)).alias("width")).collect()
        counted.sort(key=lambda r: r["v"])
        onward = {}
        for rank, (head, below) in open_.items():
            for r in counted:
                if r["v"].startswith(head):
                    if below + r["n"] > rank:
                        break
                    below += r["n"]
            if len(r["v"]) == r["width"]:
                found[rank] = (r["v"], below, r["n"])
            else:
                onward[rank] = (r["v"], below)
                size[r["v"]] = r["n"]
        open_ = onward
    return found


def _cut(df: DataFrame, key: str, seed: int, ranks: list[int]) -> tuple[DataFrame, Callable[[int], Column]]:
    """df with columns _cut_s and _cut_t, and the condition that a row comes before a rank of the shuffle's order.

    Rows whose key is the one at a rank, if there are more of them than one, are numbered (_cut_t) among themselves."""
    keyed = df.withColumn("_cut_s", F.coalesce(shuffled(key, seed), F.lit("")))
    at = cut_values(keyed.select("_cut_s"), "_cut_s", ranks)
    tied = sorted({v for rank, (v, below, n) in at.items() if n > 1 and below < rank})
    none = F.lit(None).cast("long")
    if tied:
        apart = settled(keyed.where(F.col("_cut_s").isin(tied)).withColumn("_cut_m", F.monotonically_increasing_id()))
        parts = [number(apart.where(F.col("_cut_s") == v), ["_cut_m"], "_cut_t").drop("_cut_m") for v in tied]
        rows = reduce(DataFrame.unionByName, parts, keyed.where(~F.col("_cut_s").isin(tied)).withColumn("_cut_t", none))
    else:
        rows = keyed.withColumn("_cut_t", none)

    def before(rank: int) -> Column:
        if rank not in at:
            return F.lit(True)
        v, below, _ = at[rank]
        return (F.col("_cut_s") < v) | ((F.col("_cut_s") == v) & (F.coalesce("_cut_t", F.lit(0)) < rank - below))

    return rows, before


def sample(df: DataFrame, key: str, n: int, seed: int = 42, strict: bool = False) -> DataFrame:
    """The first n rows of the shuffle's order; of fewer rows all, or with ``strict`` ValueError.

    The order's cut value is found by counts, and only rows before it are sorted. df is read more than once and must be the same each time."""
    if strict and df.limit(n).count() < n:
        raise ValueError(f"a sample of {n} needs as many rows")
    rows, before = _cut(df, key, seed, [n])
    return rows.where(before(n)).orderBy("_cut_s", key).select(*df.columns)


def split(df: DataFrame, key: str, seed: int = 42, shares: tuple[int, int] = (80, 10)) -> DataFrame:
    """df with ``split``: int(0.8 n) train, int(0.1 n) val, the rest test, by the shuffle's order.

    Two cut values are found by counts, then each row is told by its own key. Rows that repeat the key at a cut
    are numbered, so sizes are exact; a null key comes first. df is read more than once and must be the same each time."""
    n = df.count()
    a = n * shares[0] // 100
    b = a + n * shares[1] // 100
    rows, before = _cut(df, key, seed, sorted({a, b}))
    return rows.select(*df.columns, F.when(before(a), "train").when(before(b), "val").otherwise("test").alias("split"))


class UnequalLengths(ValueError):
    """Two tables that are to be put side by side by position don't have the same number of rows."""

    def __init__(self, left: int, right: int):
        super().__init__(f"{left} rows on the left, {right} on the right")
        self.left, self.right = left, right


def attach(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], name: str = "idx") -> DataFrame:
    """The columns of left and of right, the i-th row of one beside the i-th of the other, with their number from 0.

    Both are numbered by ranges; the last number of each is its length. If they differ, UnequalLengths is raised here,
    before any row is joined. Orders must leave no ties between different rows. Columns of both must have different names."""
    if clash := set(left.columns) & set(right.columns) | {name} & {*left.columns, *right.columns}:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    a, b = number(left, left_order, name), number(right, right_order, name)
    ends = a.agg(F.count("*").alias("n")).unionAll(b.agg(F.count("*").alias("n"))).withColumn("side", F.monotonically_increasing_id())
    n, m = (r["n"] for r in ends.orderBy("side").collect())
    if n != m:
        raise UnequalLengths(n, m)
    return a.join(b, name)


def both_directions(pairs: DataFrame, a: str, b: str, codes: tuple[str, str]) -> DataFrame:
    """Two rows for each pair, the second swapped."""
    way = lambda s, t, x, y: F.struct(F.lit(s).alias("src_lang"), F.lit(t).alias("tgt_lang"), F.col(x).alias("src_text"), F.col(y).alias("tgt_text"))
    others = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(*others, F.explode(F.array(way(codes[0], codes[1], a, b), way(codes[1], codes[0], b, a))).alias("w")).select(*others, "w.*")


#: Aliases that a table of them may have: an automaton of all is held by every task.
MOST_ALIASES = 1_000_000


def undominated(aliases: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Aliases (text, place) that can be a text's first one: none that holds another of a smaller place."""
    best: dict[str, int] = {}
    for text, place in aliases:
        best[text] = min(place, best.get(text, place))
    found = _automaton(list(best.items()))
    return [(text, place) for text, place in best.items() if all(p >= place for _, p in found.iter(text))]


def _automaton(aliases: list[tuple[str, int]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for text, place in aliases:
        out.add_word(text, place)
    out.make_automaton()
    return out


def first_alias(df: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """Each row with the ``canonical`` of the first alias (by place) that its text contains; rows without one go.

    aliases(alias, canonical, place) is a table of at most ``MOST_ALIASES`` rows (more raise ValueError). An
    Aho-Corasick automaton of them reads every text once, whatever their number; repeated rows stay. An
    empty alias is in every text but a null one; of a place that repeats, any row may count."""
    spark = df.sparkSession
    rows = aliases.where("alias is not null").orderBy("place").limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    always = min((i for i, r in enumerate(rows) if r["alias"] == ""), default=len(rows))
    kept = spark.sparkContext.broadcast(undominated([(r["alias"], i) for i, r in enumerate(rows) if r["alias"] and i < always]))
    no_match = always if always < len(rows) else None
    ship(spark)
    at, width = df.columns.index(text), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _automaton(kept.value)
        for b in batches:
            found = []
            for x in b.column(at):
                value = x.as_py()
                place = None if value is None else min((p for _, p in held.iter(value)), default=no_match) if kept.value else no_match
                found.append(place)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], [*b.schema.names, "_alias"])
            yield out.filter(out.column(width).is_valid())

    met = df.mapInArrow(run, StructType([*df.schema.fields, StructField("_alias", IntegerType())]))
    names = StructType([StructField("_alias", IntegerType()), aliases.schema["canonical"]])
    table = spark.createDataFrame([(i, r["canonical"]) for i, r in enumerate(rows)], names)
    return met.join(F.broadcast(table) if len(rows) <= 50_000 else table, "_alias").select(*df.columns, "canonical")


def shared_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def union_numbered(left: DataFrame, right: DataFrame, order: list[str]) -> DataFrame:
    """Union by name with fresh numbers."""
    return number(left.unionByName(right, allowMissingColumns=True), order)


def finished(pairs: DataFrame, book: str, dialect: str, source: str, order: list[str]) -> DataFrame:
    """Numbered rows in the shape of the parallel corpus of pairs(articulo, sub_idx, texto_inga, texto_es): articles as chapters, items as verses."""
    named = pairs.select(F.lit(book).alias("libro"), F.col("articulo").alias("capitulo"), F.col("sub_idx").alias("versiculo"), "texto_inga", "texto_es", F.lit(dialect).alias("dialecto"), F.lit(source).alias("fuente"), *[F.col(c).alias(f"_{c}") for c in order])
    return number(named, [f"_{c}" for c in order]).drop(*[f"_{c}" for c in order])
