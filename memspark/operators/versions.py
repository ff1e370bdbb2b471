"""A drawer store that keeps its versions: appends, upserts and deletes write whole wings or add to them, and a table of what
belongs to each version decides what is read.

Data lie in ``data/batch=<name>/wing=<wing>``; version n's table ``versions/v=<n>`` has a row (folder, wing) for each folder that belongs to
it: as many as there are wings, and one more for each append until `compact`. A version becomes visible when its table is there;
a write that fails before leaves folders that nothing names. An upsert or delete reads and writes the wings that it touches, the
others' folders stand in the next version as they are. A batch with a name of its own (a micro-batch) that runs again either
writes its folder again or, if a version has it, does nothing: it counts once.

One writer at a time: two that make the same version collide, the second one raises an error.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators.drawers import DRAWER, as_drawers, latest_drawers

FOLDERS = "folder string, wing string"


class DrawerStore:
    def __init__(self, spark: SparkSession, path: str, files_per_wing: int = 8):
        self.spark, self.path, self.files_per_wing = spark, path.rstrip("/"), files_per_wing

    def create(self) -> DrawerStore:
        """An empty version 0; a store that is there already stays."""
        self.folder_table([]).write.mode("ignore").parquet(f"{self.path}/versions/v=0")
        return self

    def folder_table(self, folders: list[tuple[str, str]]) -> DataFrame:
        """A version's table from Arrow: rows of a Python list start a Python worker on every core, which then stays."""
        columns = zip(*folders, strict=True) if folders else ([], [])
        return self.spark.createDataFrame(pa.table([pa.array(x, pa.string()) for x in columns], names=["folder", "wing"]), FOLDERS).coalesce(1)

    def versions(self) -> list[int]:
        """The numbers of the versions that are there: each one's table is one file, which is there whole or not at all."""
        rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.path}/versions")
        return sorted(int(r["v"]) for r in rows.select(F.regexp_extract("path", "/v=([0-9]+)/", 1).alias("v")).distinct().collect())

    def folders(self, version: int | None = None) -> list[tuple[str, str]]:
        """(folder, wing) of a version: about one a wing."""
        n = self.versions()[-1] if version is None else version
        return sorted(tuple(r) for r in self.spark.read.schema(FOLDERS).parquet(f"{self.path}/versions/v={n}").collect())

    def rows_of(self, folders: list[tuple[str, str]]) -> DataFrame:
        if not folders:
            return as_drawers(self.spark.range(0).where("false").select())
        paths = [f"{self.path}/data/{folder}" for folder, _ in folders]
        return as_drawers(self.spark.read.schema(DRAWER).option("basePath", f"{self.path}/data").parquet(*paths))

    def read(self, version: int | None = None, wings: list[str] | None = None) -> DataFrame:
        """The drawers of a version, the latest if none is named; of some wings only their folders are read."""
        return self.rows_of([x for x in self.folders(version) if wings is None or x[1] in wings])

    def written(self, rows: DataFrame, name: str) -> list[tuple[str, str]]:
        """The folders of a batch, written anew if it is there already."""
        at = f"{self.path}/data/batch={name}"
        spread = as_drawers(rows).repartition("wing", F.pmod(F.xxhash64("id"), F.lit(self.files_per_wing)))
        spread.write.mode("overwrite").partitionBy("wing").parquet(at)
        made = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(at)
        folders = made.select(F.regexp_extract("path", "/(wing=[^/]*)/", 1).alias("f")).where("f <> ''").distinct().collect()
        names = [(f"batch={name}/{r['f']}", r["f"]) for r in folders]
        wings = {}
        for folder, _ in names:
            wings[folder] = self.rows_of([(folder, "")]).select("wing").first()["wing"]
        return [(folder, wings[folder]) for folder, _ in names]

    def commit(self, folders: list[tuple[str, str]], after: int) -> int:
        self.folder_table(folders).write.mode("error").parquet(f"{self.path}/versions/v={after + 1}")
        return after + 1

    def append(self, rows: DataFrame, name: str | None = None) -> int:
        """The version with the rows added. A batch of a name that a version has already adds nothing."""
        now = self.versions()[-1]
        held = self.folders(now)
        if name is not None and any(folder.startswith(f"batch={name}/") for n in self.versions() for folder, _ in self.folders(n)):
            return now
        return self.commit(held + self.written(rows, name or uuid.uuid4().hex), now)

    def rewritten(self, rows: DataFrame, touched: set[str], now: int) -> int:
        """The version in which the touched wings hold these rows and nothing else."""
        made = self.written(rows, uuid.uuid4().hex)
        return self.commit([x for x in self.folders(now) if x[1] not in touched] + made, now)

    def touched(self, stored: DataFrame, keys: DataFrame, key: str) -> set[str]:
        """The wings that hold rows of these keys."""
        return {r["wing"] for r in stored.join(keys.select(key).distinct(), key, "left_semi").select("wing").distinct().collect()}

    def upsert(self, incoming: DataFrame, key: str = "id", order: str = "filed_at") -> int:
        """Of the rows of one key the newest is kept (`latest_drawers`); a row that changes its wing leaves the old one."""
        now, rows = self.versions()[-1], as_drawers(incoming)
        stored = self.read(now)
        wings = self.touched(stored, rows, key) | {r["wing"] for r in rows.select("wing").distinct().collect()}
        return self.rewritten(latest_drawers(self.read(now, list(wings)), rows, key, order), wings, now) if wings else now

    def delete(self, ids: DataFrame) -> int:
        now = self.versions()[-1]
        wings = self.touched(self.read(now), ids, "id")
        return self.rewritten(self.read(now, list(wings)).join(ids.select("id"), "id", "left_anti"), wings, now) if wings else now

    def compact(self) -> int:
        """The same rows with one folder a wing."""
        now = self.versions()[-1]
        wings = [wing for _, wing in self.folders(now)]
        several = {wing for wing in wings if wings.count(wing) > 1}
        return self.rewritten(self.read(now, list(several)), several, now) if several else now
