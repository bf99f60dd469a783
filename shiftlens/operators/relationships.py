"""Joins and texts that follow from the declared relationships between tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.plans.sizing import broadcast_if_small
from shiftlens.sources.tables import known_rows


@dataclass(frozen=True)
class Relationship:
    """A join to another table on one or more (left, right) key pairs."""

    table: str
    join_keys: tuple[tuple[str, str], ...]
    join_type: str = "INNER JOIN"


@dataclass(frozen=True)
class TableInfo:
    """What is declared about a table."""

    description: str
    key_columns: tuple[str, ...] = ()
    relationships: tuple[Relationship, ...] = field(default=())


Metadata = Mapping[str, TableInfo]

RELATIONSHIP_SCHEMA = (
    "table_name string, position int, related string, join_type string, "
    "join_keys array<struct<left:string,right:string>>"
)


def find_table(metadata: Metadata, name: str) -> TableInfo | None:
    """Declared info of a table, whatever the letter case of its name."""
    return {k.lower(): v for k, v in metadata.items()}.get(name.lower())


#: Declared join types as Spark knows them, and what each is when the tables are named the other way round.
JOIN_TYPES = {
    "INNER JOIN": "inner", "JOIN": "inner", "LEFT JOIN": "left", "LEFT OUTER JOIN": "left", "RIGHT JOIN": "right",
    "RIGHT OUTER JOIN": "right", "FULL JOIN": "full", "FULL OUTER JOIN": "full",
}
_TURNED = {"left": "right", "right": "left"}


def find_relationship(metadata: Metadata, left: str, right: str) -> tuple[tuple[tuple[str, str], ...], str]:
    """Key pairs and join type between two tables, declared on either of them, as seen from ``left``."""
    for a, b, turned in ((left, right, False), (right, left, True)):
        info = find_table(metadata, a)
        for rel in info.relationships if info else ():
            if rel.table.lower() == b.lower():
                how = JOIN_TYPES.get(" ".join(rel.join_type.upper().split()))
                if how is None:
                    raise ValueError(f"unknown join type {rel.join_type!r} between {left} and {right}")
                return (tuple((r, l) for l, r in rel.join_keys), _TURNED.get(how, how)) if turned else (rel.join_keys, how)
    raise KeyError(f"no relationship declared between {left} and {right}")


def join_by_relationship(
    tables: Mapping[str, DataFrame], metadata: Metadata, left: str, right: str
) -> DataFrame:
    """Join of two tables on all declared key pairs, by the declared type.

    Table names are found whatever their letter case. A right key is dropped; where only the right
    table has a row, its key stands in the left key's column. No join hint: Catalyst picks the strategy
    from the sizes and adaptive execution splits hot keys.
    """
    pairs, how = find_relationship(metadata, left, right)
    named = {name.lower(): df for name, df in tables.items()}
    a, b = named[left.lower()], named[right.lower()]
    renamed = reduce(lambda d, p: d.withColumnRenamed(p[1], f"__key_{p[1]}"), pairs, b)
    condition = reduce(lambda x, y: x & y, [a[l] == renamed[f"__key_{r}"] for l, r in pairs])
    joined = a.join(renamed, condition, how)
    if how in ("right", "full"):
        joined = joined.withColumns({l: F.coalesce(a[l], renamed[f"__key_{r}"]) for l, r in pairs})
    return joined.drop(*[f"__key_{r}" for _, r in pairs])


def relationship_rows(spark: SparkSession, metadata: Metadata) -> DataFrame:
    """The declared relationships, one row each."""
    rows = [
        (table, i, rel.table, rel.join_type, [{"left": l, "right": r} for l, r in rel.join_keys])
        for table, info in metadata.items()
        for i, rel in enumerate(info.relationships)
    ]
    return known_rows(spark, rows, RELATIONSHIP_SCHEMA)


def relationship_lines(relationships: DataFrame) -> DataFrame:
    """``Relationship: a INNER JOIN b ON a.k = b.k``, key pairs joined by AND."""
    pairs = F.transform(
        "join_keys",
        lambda k: F.concat(
            F.col("table_name"), F.lit("."), k["left"], F.lit(" = "), F.col("related"), F.lit("."), k["right"]
        ),
    )
    line = F.concat(
        F.lit("Relationship: "), "table_name", F.lit(" "), "join_type", F.lit(" "), "related",
        F.lit(" ON "), F.array_join(pairs, " AND "),
    )
    return relationships.select("table_name", "position", line.alias("line"))


def relationship_info(routed: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationship text of each query's tables, one line per relationship, table order first.

    ``routed`` has one row per query and table. The lines of a query are bounded by the metadata.
    """
    lines = relationship_lines(relationships).withColumn("__t", F.lower("table_name")).drop("table_name")
    found = routed.withColumn("__t", F.lower("source")).join(broadcast_if_small(lines), "__t")
    ordered = F.sort_array(F.collect_list(F.struct("source", "position", "line")))
    return found.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("relationship_info")
    )


def table_lines(columns: DataFrame, typed: bool = False) -> DataFrame:
    """``Table t: Columns: a, b`` from one row per column, or ``a (int), b (string)`` with types."""
    order = F.struct("ordinal", "column_name", "column_type") if typed else F.struct("ordinal", "column_name")

    def shown(c: Column) -> Column:
        return F.concat(c["column_name"], F.lit(" ("), c["column_type"], F.lit(")")) if typed else c["column_name"]

    names = F.transform(F.sort_array(F.collect_list(order)), shown)
    return columns.groupBy("table_name").agg(
        F.concat(F.lit("Table "), F.col("table_name"), F.lit(": Columns: "), F.array_join(names, ", ")).alias("line")
    )


def table_info(routed: DataFrame, columns: DataFrame, typed: bool = False) -> DataFrame:
    """Table text of each query's tables, one line per table.

    The lines are bounded by the number of declared tables, which is counted before they are
    broadcast; the lines of one query by the same number.
    """
    lines = table_lines(columns, typed).withColumnRenamed("table_name", "source")
    found = routed.select("query_id", "source").join(broadcast_if_small(lines), "source")
    ordered = F.sort_array(F.collect_list(F.struct("source", "line")))
    return found.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("table_info")
    )


def question_inputs(contexts: DataFrame, tables: DataFrame, related: DataFrame) -> DataFrame:
    """What a model is given for each question, in one row: context, table and relationship text.

    A question that lacks one of them has an empty text there.
    """
    joined = contexts.join(tables, "query_id", "full").join(related, "query_id", "full")
    return joined.select("query_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("context", "table_info", "relationship_info")])
