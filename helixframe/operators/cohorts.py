"""A cohort's metadata: members, groups in order, nodes, and what tools read of them.

``meta`` has a row a sample with its index (``ix``, 0 to n - 1) and columns such as id, pop, pop_short, country, continent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.trees import group_nodes


def members(meta: DataFrame, column: str, values: str | list[str] | None = None) -> DataFrame:
    """The samples whose ``column`` is among ``values``; all without them."""
    if values is None:
        return meta
    return meta.where(F.col(column).isin([values] if isinstance(values, str) else values))


def nodes(meta: DataFrame, column: str, values: str | list[str] | None = None) -> DataFrame:
    """(value, node): both nodes of each member."""
    return group_nodes(members(meta, column, values), column, "ix").withColumnRenamed(column, "value")


def one_node(meta: DataFrame, seed: int = 1) -> DataFrame:
    """(ix, node): one of a sample's two nodes; which one, the seed decides."""
    side = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ix").cast("string"))), 1, 1), 16, 10).cast("long") % 2
    return meta.select("ix", (2 * F.col("ix") + side).alias("node"))


def groups(meta: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """(value, members, place): each group's indices in order, groups by their first sample, or as ``values`` lists them."""
    got = members(meta, column, values).groupBy(F.col(column).alias("value")).agg(F.array_sort(F.collect_list("ix")).alias("members"))
    if values is None:
        # groups are a dimension
        return got.withColumn("place", F.row_number().over(Window.orderBy(F.get("members", F.lit(0)))) - 1)
    listed = list(dict.fromkeys(values))
    return got.withColumn("place", F.array_position(F.array(*map(F.lit, listed)), F.col("value")).cast("int") - 1)


def subsample(samples: DataFrame, n: int, key: str = "name", seed: int = 1) -> DataFrame:
    """``n`` of the samples without repeats; which ones, the seed decides (n is what the operator is for)."""
    return samples.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def poplabels(samples: DataFrame, meta: DataFrame, pop: str = "pop_short") -> DataFrame:
    """(ord, line): ``id pop pop NA`` of each sample (ord, id); a sample that the metadata lacks is an error."""
    m = meta.select("id", F.col(pop).alias("__pop"))
    s = samples.join(F.broadcast(m), "id", "left")  # a row a sample of the cohort
    p = F.coalesce("__pop", F.raise_error(F.concat(F.lit("no metadata of "), F.col("id"))).cast("string"))
    return s.select("ord", F.concat_ws(" ", "id", p, p, F.lit("NA")).alias("line"))


def chosen_nodes(meta: DataFrame, column: str, n: int, seed: int = 1) -> DataFrame:
    """(value, nodes): of each group ``n`` samples, both nodes of each, joined by commas in order."""
    w = Window.partitionBy(column).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ix").cast("string"))), "ix")
    few = meta.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    both = F.flatten(F.transform(F.array_sort(F.collect_list("ix")), lambda i: F.array(2 * i, 2 * i + 1)))
    return few.groupBy(F.col(column).alias("value")).agg(F.array_join(F.transform(both, lambda i: i.cast("string")), ",").alias("nodes"))


def zip_fields(one: DataFrame, two: DataFrame) -> DataFrame:
    """(ord, line): the first field of a line (ord, line) and the second of the line of the same number in the other."""
    field = lambda c, k: F.get(F.split(F.trim(c), r"\s+"), F.lit(k))
    a, b = one.select("ord", field("line", 0).alias("a")), two.select("ord", field("line", 1).alias("b"))
    return a.join(b, "ord").select("ord", F.concat_ws(" ", "a", "b").alias("line"))


def report_line(counts: DataFrame) -> Column:
    """A one-row table of counters as ``name: value`` lines."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in counts.columns])
