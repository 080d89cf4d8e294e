"""Tables that are kept in parts by the hash of a key, so that a change rewrites only the parts that it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.rows import settled

#: The column by which folders of parts are named.
PART = "part"


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


class PartedTable:
    """A Parquet table under `path` in `parts` folders by the hash of column `key`; rows of one key lie in one folder.

    A change reads the folders of its keys, settles what they shall hold and overwrites them alone. Spark moves new folders in when the whole write has
    succeeded, so a failed attempt changes nothing and may be made again. Folders that are to be empty are removed after that; until then, and if
    that fails, their old rows are still there, and the change may be made again too. One change at a time, as there is no lock.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, parts: int = 64):
        self.spark, self.path, self.key, self.schema, self.parts = spark, path, key, schema, parts

    def read(self, touched: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some parts, whose folders alone are listed and read."""
        reader = self.spark.read.schema(f"{self.schema}, {PART} int")
        store, root = self._store()
        if not store.exists(root):
            return self.spark.createDataFrame([], self.schema)
        rows = reader.option("basePath", self.path).parquet(self.path)
        rows = rows if touched is None else rows.where(F.col(PART).isin(*touched))
        return rows.drop(PART)

    def replace(self, keys: DataFrame, rows: DataFrame) -> list[int]:
        """Have `rows`, instead of all there are, for the keys (a column named as the key); the parts that were touched. Rows of other keys are refused."""
        changed = settled(keys.select(self.key).distinct())
        stray = rows.join(changed, self.key, "left_anti")
        if not stray.isEmpty():
            raise ValueError(f"rows of a {self.key} that is not replaced")
        numbered = part_of(F.col(self.key), self.parts).alias(PART)
        touched = sorted(r[PART] for r in changed.select(numbered).distinct().collect())  # self.parts rows at most
        if not touched:
            return []
        stays = self.read(touched).join(changed, self.key, "left_anti")
        after = settled(stays.unionByName(rows.select(stays.columns)).withColumn(PART, part_of(F.col(self.key), self.parts)))
        filled = {r[PART] for r in after.select(PART).distinct().collect()}
        after.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        store, root = self._store()
        for part in touched:
            if part not in filled:
                store.delete(self._jvm_path(f"{root}/{PART}={part}"), True)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Remove all rows of the keys; the parts that were touched."""
        return self.replace(keys, self.spark.createDataFrame([], self.schema))

    def _jvm_path(self, path: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _store(self):  # noqa: ANN202
        root = self._jvm_path(self.path)
        return root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), root


def delete_cascade(tables: dict[str, PartedTable], root: str, keys: DataFrame, links: Sequence[tuple[str, str, str]]) -> dict[str, list[int]]:
    """Delete keys of the root table and all rows that refer to what goes; the parts that each table had touched.

    links: (child, parent, column of the child that names the parent's key). A child is parted by its own key; the keys of its rows that go are
    found first, then children are changed before their parents, so that a failure leaves no row that refers to nothing.
    """
    gone = {root: settled(keys.select(tables[root].key).distinct())}
    for child, parent, column in links:
        if parent in gone:
            above = gone[parent].select(F.col(tables[parent].key).alias(column))
            own = tables[child].read().join(above, column, "left_semi").select(tables[child].key)
            gone[child] = settled((gone[child].unionByName(own) if child in gone else own).distinct())
    return {name: tables[name].delete(gone[name]) for name in reversed(list(gone))}
