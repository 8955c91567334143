"""Tables that are kept: Parquet in parts, rewritten part by part, made visible by a log.

A table is cut into parts by columns that never change for a key (such as a record's kind
and month) and by a hash of its key. An upsert, an insert or a purge writes those parts
anew that its rows fall into and leaves the others where they are. A commit is one file
of the log that names every part of every table: it is written last and is created only
if it does not exist, so what an interrupted job has left is never seen, several tables
change together, and of two commits at once one fails. A commit remembers its batch; a
batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ingest as I

PART = "_part"


class Tables:
    """The tables under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- the log ---

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _listed(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _entry(self, name: str) -> dict:
        fs, where = self._fs(f"{self.path}/log/{name}")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> dict:
        """The last commit: its version, tables, and report."""
        names = [n for n in self._listed(f"{self.path}/log") if n.endswith(".json")]
        return self._entry(names[-1]) if names else {"version": -1, "tables": {}, "report": {}, "batches": []}

    def history(self) -> list[dict]:
        return [self._entry(n) for n in self._listed(f"{self.path}/log") if n.endswith(".json")]

    def _commit(self, before: dict, tables: dict, batch: str | None, report: dict) -> None:
        entry = {
            "version": before["version"] + 1,
            "tables": before["tables"] | tables,
            "batches": before["batches"] + ([batch] if batch is not None else []),
            "report": report,
        }
        fs, where = self._fs(f"{self.path}/log/{entry['version']:012d}.json")
        stream = fs.create(where, False)  # fails where another commit came first
        stream.write(json.dumps(entry).encode())
        stream.close()

    # --- tables ---

    def read(self, name: str, only: Callable[[str], bool] | None = None) -> DataFrame:
        """A table as it was last committed; ``only`` picks parts by name."""
        table = self.latest()["tables"][name]
        return self._read(table, [p for p in table["parts"] if only is None or only(p)])

    def _read(self, table: dict, parts: list[str]) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{table['parts'][p]}" for p in parts])

    def create(self, name: str, schema: StructType, keys: list[str], by: dict[str, str] | None = None, buckets: int = 64) -> None:
        """An empty table: its keys, the expressions that cut it (``by``, each of columns
        that never change for a key), and the buckets of each cut."""
        before = self.latest()
        if name in before["tables"]:
            raise ValueError(f"table {name} exists")
        made = {"schema": schema.jsonValue(), "keys": keys, "by": by or {}, "buckets": buckets, "parts": {}}
        self._commit(before, {name: made}, None, {})

    @staticmethod
    def _part(table: dict) -> Column:
        cuts = [F.regexp_replace(F.coalesce(F.expr(e).cast("string"), F.lit("none")), "[^A-Za-z0-9.-]", "-") for e in table["by"].values()]
        return F.concat_ws("~", *cuts, F.pmod(F.xxhash64(*table["keys"]), F.lit(table["buckets"])).cast("string"))

    def _touched(self, table: dict, rows: DataFrame) -> list[str]:
        return [r[PART] for r in rows.select(self._part(table).alias(PART)).distinct().collect()]  # names of parts

    def _written(self, name: str, table: dict, rows: DataFrame, touched: list[str]) -> dict:
        """The table with ``rows`` in place of what its touched parts hold."""
        at = f"data/{name}/{uuid.uuid4().hex}"
        dealt = rows.select(*StructType.fromJson(table["schema"]).names, self._part(table).alias(PART))
        dealt.repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/{at}")
        new = {d.removeprefix(f"{PART}="): f"{at}/{d}" for d in self._listed(f"{self.path}/{at}") if d.startswith(f"{PART}=")}
        return table | {"parts": {p: d for p, d in table["parts"].items() if p not in touched} | new}

    def _changed(self, name: str, rows: DataFrame, batch: str | None, change: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> dict:
        before = self.latest()
        if batch is not None and batch in before["batches"]:
            return {"parts_written": 0, "parts": len(before["tables"][name]["parts"])}
        table = before["tables"][name]
        rows = rows.where(F.forall(F.array(*[F.col(k).isNotNull() for k in table["keys"]]), lambda x: x))
        touched = self._touched(table, rows)
        held = self._read(table, [p for p in touched if p in table["parts"]])
        after = self._written(name, table, change(held, rows, table["keys"]), touched)
        report = {"table": name, "parts_written": len(touched), "parts": len(after["parts"])}
        self._commit(before, {name: after}, batch, report)
        return report

    def upsert(self, name: str, rows: DataFrame, order: list[str], batch: str | None = None) -> dict:
        """Whole rows replaced by key, the last by ``order`` of the new ones; rows without
        a key are left out."""
        return self._changed(name, rows, batch, lambda held, new, keys: I.upsert(held, new, keys, order))

    def insert_missing(self, name: str, rows: DataFrame, order: list[str], batch: str | None = None) -> dict:
        """Rows whose key the table does not have, the first by ``order`` of equal ones."""
        return self._changed(name, rows, batch, lambda held, new, keys: held.unionByName(I.insert_missing(held, new, keys, order)))

    def purge(self, linked: dict[str, tuple[DataFrame, list[str]]], batch: str | None = None) -> DataFrame:
        """Removes from each table the rows whose columns equal those of a linked row, in
        one commit; its report, ``table, before, after``, is the commit's own."""
        now = self.latest()
        if batch is None or batch not in now["batches"]:
            tables, report = {}, {}
            for name, (rows, on) in linked.items():
                table = now["tables"][name]
                held = self._read(table, [*table["parts"]])
                gone = held.join(rows.select(*on).distinct(), on, "left_semi")
                touched = self._touched(table, gone)
                own = self._read(table, touched)
                left = I.purge(own, rows, on)
                tables[name] = self._written(name, table, left, touched)
                total = held.count()
                report[name] = {"before": total, "after": total - own.count() + self._read(tables[name], [p for p in touched if p in tables[name]["parts"]]).count()}
            self._commit(now, tables, batch, {"purge": report})
            now = self.latest()
        else:
            now = next(e for e in self.history() if batch in e["batches"])
        rows = [(n, r["before"], r["after"]) for n, r in now["report"]["purge"].items()]
        return self.spark.createDataFrame(rows, "table string, before long, after long")

    def tidy(self, keep: int = 1) -> int:
        """Deletes the data that none of the last commits name, and says how many folders.
        Not to be run beside a job that writes."""
        live = {f.rsplit("/", 1)[0] for e in self.history()[-keep:] for t in e["tables"].values() for f in t["parts"].values()}
        gone = [f"data/{n}/{c}" for n in self._listed(f"{self.path}/data") for c in self._listed(f"{self.path}/data/{n}") if f"data/{n}/{c}" not in live]
        for folder in gone:
            fs, where = self._fs(f"{self.path}/{folder}")
            fs.delete(where, True)
        return len(gone)
