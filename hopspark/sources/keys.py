"""Keys of the engine's tables: what breaks them, and deletes that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopspark.schema import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS
from hopspark.sources.scratch import dealt

_VIOLATIONS = ("table_name", "rule", "column_name", "key", "n_rows")


def violations(tables: dict[str, DataFrame], sizes: dict[str, int] | None = None) -> DataFrame:
    """(table_name, rule, column_name, key, n_rows): null values where none may be, primary keys that come twice, foreign keys that lead nowhere.

    ``tables``: any of papers, chunks, entities and edges; a foreign key into a table that
    isn't given isn't checked.  Null counts are one row with a null key.  ``sizes``:
    how many rows tables have, about; those that aren't given are counted.  Keys are
    dealt by them, so that what a task holds doesn't grow with the tables.
    """
    found = []
    sizes = {name: rows.count() for name, rows in tables.items() if name not in (sizes or {})} | (sizes or {})

    def add(rows: DataFrame, table: str, rule: str, column: str) -> None:
        found.append(rows.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), F.col("key").cast("string").alias("key"), F.col("n").alias("n_rows")))

    for name, rows in tables.items():
        for column in NOT_NULL[name]:
            nulls = rows.agg(F.count_if(F.col(column).isNull()).alias("n")).where("n > 0")
            add(nulls.withColumn("key", F.lit(None).cast("string")), name, "not null", column)
        key = PRIMARY_KEYS.get(name)
        if key:
            add(dealt(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key")), sizes[name], "key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), name, "primary key", key)
        for column, target in FOREIGN_KEYS.get(name, {}).items():
            if target in tables:
                # counted first: a key that many rows have meets the other table once
                n = max(sizes[name], sizes[target])
                used = dealt(rows.where(F.col(column).isNotNull()).select(F.col(column).alias("key")), n, "key").groupBy("key").agg(F.count("*").alias("n"))
                there = dealt(tables[target].select(F.col(PRIMARY_KEYS[target]).alias("key")), n, "key")
                add(used.join(there, "key", "left_anti"), name, "foreign key", column)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(*_VIOLATIONS)


def delete(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The next state of all tables without the rows of ``table`` whose primary key is in ``keys``, and without all that refers to them.

    ``keys``: one column of the key's name.  Deletes go on from papers to their chunks and
    from chunks and entities to edges.
    """
    left, gone = dict(tables), {table: keys.select(PRIMARY_KEYS[table]).distinct()}
    for name in ("papers", "entities", "chunks", "edges"):
        if name not in tables:
            continue
        rows, key, doomed = left[name], PRIMARY_KEYS.get(name), []
        if name in gone:
            doomed.append((key, gone[name]))
        doomed += [(column, gone[target].withColumnRenamed(PRIMARY_KEYS[target], column)) for column, target in FOREIGN_KEYS.get(name, {}).items() if target in gone]
        for column, those in doomed:
            rows = rows.join(those, column, "left_anti")
        left[name] = rows.select(*tables[name].columns)
        if key and doomed:
            lost = [tables[name].join(those, column, "left_semi").select(key) for column, those in doomed]
            out = lost[0]
            for more in lost[1:]:
                out = out.unionByName(more)
            gone[name] = out.distinct()
    return left
