"""Reading tables whose rows cost far more than their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def deal(table: DataFrame) -> DataFrame:
    """``table`` over all cores, where its files give fewer scan tasks than there are cores.

    A file of one row group is read by one task, however many splits it has, and
    work on its texts would stay in that task.  Tables of many files or row
    groups, which is what large tables are, are left as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def spread(table: DataFrame) -> DataFrame:
    """``table`` over all cores whatever its files are, for short rows with costly work on each.

    The number of splits says nothing here: all rows of a file of one row group
    are read by one of them.
    """
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions()))


#: Rows that a task groups at once.
GROUPED_ROWS = 1_000_000


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` over so many tasks that each groups about GROUPED_ROWS of them, however many there are."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // GROUPED_ROWS)), key)
