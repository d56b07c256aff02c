"""Namespaces, tables and attached frames in one session, on Spark's catalog."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """Attached catalogs (dictionaries of frames), namespaces (databases), managed tables and temporary tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._catalogs: dict[str, dict[str, DataFrame]] = {}
        self._catalog: str | None = None

    # catalogs of frames
    def attach_catalog(self, name: str, tables: dict[str, DataFrame]) -> None:
        self._catalogs[name] = dict(tables)
        self._catalog = self._catalog or name

    def detach_catalog(self, name: str) -> None:
        del self._catalogs[name]
        self._catalog = None if self._catalog == name else self._catalog

    def has_catalog(self, name: str) -> bool:
        return name in self._catalogs

    def list_catalogs(self, pattern: str = "*") -> list[str]:
        return sorted(c for c in self._catalogs if fnmatch(c, pattern))

    def set_catalog(self, name: str | None) -> None:
        if name is not None and name not in self._catalogs:
            raise KeyError(name)
        self._catalog = name

    def attach_table(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    create_temp_table = attach_table

    def detach_table(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)

    # namespaces
    def create_namespace(self, name: str, if_not_exists: bool = False) -> None:
        self.spark.sql(f"CREATE DATABASE {'IF NOT EXISTS ' * if_not_exists}`{name}`")

    def drop_namespace(self, name: str, cascade: bool = False) -> None:
        self.spark.sql(f"DROP DATABASE `{name}` {'CASCADE' * cascade}")

    def has_namespace(self, name: str) -> bool:
        return self.spark.catalog.databaseExists(name)

    def list_namespaces(self, pattern: str = "*") -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases() if fnmatch(d.name, pattern))

    def set_namespace(self, name: str | None) -> None:
        self.spark.catalog.setCurrentDatabase(name or "default")

    def current_namespace(self) -> str:
        return self.spark.catalog.currentDatabase()

    def use(self, target: str) -> None:
        """``catalog``, ``catalog.namespace`` or ``namespace``."""
        head, _, tail = target.partition(".")
        if head in self._catalogs:
            self.set_catalog(head)
            if tail:
                self.set_namespace(tail)
        else:
            self.set_namespace(target)

    # tables
    def create_table(self, name: str, df: DataFrame) -> None:
        df.write.saveAsTable(name)

    def write_table(self, name: str, df: DataFrame, mode: str = "append") -> None:
        """append or overwrite; an overwrite may read the table it replaces."""
        if mode == "overwrite" and self.spark.catalog.tableExists(name):
            staged = f"{name}__staged"
            df.write.mode("overwrite").saveAsTable(staged)
            self.spark.sql(f"DROP TABLE {name}")
            self.spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
        else:
            df.write.mode(mode).saveAsTable(name)

    def read_table(self, name: str) -> DataFrame:
        head, _, tail = name.partition(".")
        if head in self._catalogs and tail in self._catalogs[head]:
            return self._catalogs[head][tail]
        if self._catalog and name in self._catalogs[self._catalog]:
            return self._catalogs[self._catalog][name]
        return self.spark.table(name)

    def has_table(self, name: str) -> bool:
        head, _, tail = name.partition(".")
        if tail in self._catalogs.get(head, ()) or (self._catalog and name in self._catalogs[self._catalog]):
            return True
        return self.spark.catalog.tableExists(name)

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")

    def list_tables(self, pattern: str = "*") -> list[str]:
        own = {t.name for t in self.spark.catalog.listTables()}
        own |= set(self._catalogs.get(self._catalog or "", ()))
        return sorted(t for t in own if fnmatch(t, pattern))

    def sql(self, query: str, **frames: DataFrame) -> DataFrame:
        """SQL over tables of the session, temporary tables, frames given as ``{name}``, and the current catalog's frames."""
        for name, df in self._catalogs.get(self._catalog or "", {}).items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(query, **frames)

    @contextmanager
    def namespace(self, name: str) -> Iterator[Workspace]:
        before = self.current_namespace()
        self.set_namespace(name)
        try:
            yield self
        finally:
            self.set_namespace(before)
