"""Versioned tables on Parquet: immutable generations of row groups, zone maps, snapshots and vacuum.

A table's manifests are small JSON files, one per generation, created only if absent; readers take the newest whole
one. The zone map of a generation is a Parquet table with one row per row group, so that it is read, pruned and joined
like any other. Row groups lie ``GROUPS`` to a folder, and a generation that replaces some of them points to the
writes that hold the others. All files go through Hadoop's file system of the root, a local folder or a cluster's store.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltine.operators.order import order_positions
from basaltine.operators.predicates import between
from basaltine.schema import ColumnDef, TableDef, check_evolution, check_name, conform

#: Row groups that share a folder; surviving groups up to which a scan names them as literals, which reach the files.
GROUPS, NAMED = 64, 512
KEYS = {"generation", "write", "row_group_size", "columns", "rows", "groups", "writes"}


class Store:
    """Tables under a root folder. A store keeps the generation it has seen until ``refresh``."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, TableDef]):
        for name in tables:
            check_name(name)
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self._seen: dict[str, dict] = {}
        self._cached: dict[str, DataFrame] = {}
        path = self._path(root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _folder(self, table: str) -> str:
        if table not in self.tables:
            raise KeyError(f"unknown table {table}")
        return f"{self.root}/{table}"

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    # manifests

    def _manifest_of(self, table: str, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self._folder(table)}/manifests/{name}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        manifest = json.loads(text)
        self._check(table, manifest)
        return manifest

    def _check(self, table: str, manifest: dict) -> None:
        if not isinstance(manifest, dict) or set(manifest) != KEYS:
            raise ValueError(f"the manifest of {table} is damaged")
        if not manifest["columns"] or manifest["rows"] < 0 or manifest["write"] not in manifest["writes"] or manifest["groups"] != -(-manifest["rows"] // manifest["row_group_size"]):
            raise ValueError(f"the manifest of {table} contradicts itself")

    def _read_manifest(self, table: str) -> dict:
        """The newest manifest; one that is still being written does not parse, and the one before it holds."""
        names = [n for n in self._names(f"{self._folder(table)}/manifests") if n.endswith(".json") and not n.startswith(".")]
        for name in reversed(names):
            try:
                return self._manifest_of(table, name)
            except json.JSONDecodeError:
                continue
        if names:
            raise ValueError(f"every manifest of {table} is damaged")
        raise FileNotFoundError(f"table {table} has no data")

    def _stored_def(self, manifest: dict) -> TableDef:
        return TableDef({n: ColumnDef(**c) for n, c in manifest["columns"].items()}, manifest["row_group_size"])

    def manifest(self, table: str) -> dict:
        """The manifest in use, read once; stored columns must fit the definition."""
        if table not in self._seen:
            manifest = self._read_manifest(table)
            check_evolution(self._stored_def(manifest), self.tables[table])
            self._seen[table] = manifest
        return self._seen[table]

    def _publish(self, table: str, manifest: dict) -> None:
        """Creates the generation's manifest; of two writers of one generation the second fails."""
        self._check(table, manifest)
        path = self._path(f"{self._folder(table)}/manifests/{manifest['generation']:012d}.json")
        if self._fs.exists(path):
            raise FileExistsError(f"generation {manifest['generation']} of {table} was published by another writer")
        stream = self._fs.create(path, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        self._seen[table] = manifest
        self._cached.pop(table, None)

    # writing

    def replace(self, table: str, df: DataFrame, row_id: str = "row_id") -> int:
        """Writes ``df`` as a new generation; ``row_id`` counts the rows from 0 without gaps. Returns the generation."""
        definition = self.tables[table]
        generation = self._next(table)
        write = self._write_groups(table, generation, conform(df, definition, row_id).withColumnRenamed(row_id, "row_id"))
        return self._finish(table, generation, write, definition, None)

    def update_row_groups(self, table: str, changes: DataFrame, row_id: str = "row_id") -> int:
        """Replaces named columns in whole row groups: ``changes`` has the new values of every row of those groups.

        Lengths are checked before anything is written. Other groups are shared with the generation before.
        """
        manifest, definition = self.manifest(table), self.tables[table]
        columns = [c for c in changes.columns if c != row_id]
        unknown = [c for c in columns if c not in definition.columns]
        if unknown or not columns:
            raise ValueError(f"unknown columns {unknown}" if unknown else "no column is changed")
        if manifest["generation"] + 1 != self._next(table):
            raise FileExistsError(f"table {table} has a newer generation: refresh first")
        size = definition.row_group_size
        zone = self.zone_map(table)
        counted = changes.groupBy(F.floor(F.col(row_id) / size).cast("long").alias("row_group")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(row_id).alias("d"))
        wrong = counted.join(zone.select("row_group", "rows"), "row_group", "left").where("rows is null or n <> rows or d <> rows")
        if not wrong.isEmpty():
            raise ValueError("a row group is changed in part")
        groups = counted.select("row_group")
        old = self._rows(table, zone.join(groups, "row_group", "left_semi")).drop(*columns)
        new = changes.select(F.col(row_id).alias("row_id"), *columns)
        generation = self._next(table)
        write = self._write_groups(table, generation, conform(old.join(new, "row_id"), definition, "row_id"))
        return self._finish(table, generation, write, definition, zone.join(groups, "row_group", "left_anti"))

    def _next(self, table: str) -> int:
        try:
            return self._read_manifest(table)["generation"] + 1
        except FileNotFoundError:
            return 1

    def _write_groups(self, table: str, generation: int, rows: DataFrame) -> str:
        """Writes whole row groups, ``GROUPS`` to a folder, in order; returns the name of the write."""
        write = f"{generation}-{uuid.uuid4().hex[:12]}"
        group = F.floor(F.col("row_id") / self.tables[table].row_group_size).cast("long")
        grouped = rows.select("*", group.alias("row_group"), F.floor(group / GROUPS).cast("long").alias("folder"))
        # rows of a group meet in one task, which holds a group's rows and no more; a folder's files are of its groups
        ordered = grouped.repartition("row_group").sortWithinPartitions("folder", "row_group", "row_id")
        ordered.write.partitionBy("folder").parquet(f"{self._folder(table)}/data/{write}")
        return write

    def _finish(self, table: str, generation: int, write: str, definition: TableDef, kept: DataFrame | None) -> int:
        stats = self._zone_map(table, write, definition.columns, kept)
        rows, groups = stats.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
        # a write a generation at most: few names
        writes = sorted({r["write"] for r in stats.select("write").distinct().collect()} | {write})
        columns = {n: asdict(c) for n, c in definition.columns.items()}
        self._publish(table, {"generation": generation, "write": write, "row_group_size": definition.row_group_size, "columns": columns, "rows": rows, "groups": groups, "writes": writes})
        return generation

    def _zone_map(self, table: str, write: str, columns: dict[str, ColumnDef], kept: DataFrame | None) -> DataFrame:
        """A row per group: rows, write, folder, and of each column min, max, sum, nulls, inversions, first and last."""
        struct = TableDef(columns, self.tables[table].row_group_size).struct().add("row_id", "long").add("row_group", "long").add("folder", "long")
        rows = self.spark.read.schema(struct).parquet(f"{self._folder(table)}/data/{write}")
        order = Window.partitionBy("row_group").orderBy("row_id")
        down = [(F.lag(n).over(order) > F.col(n)).alias(f"down_{n}") for n in columns]
        per = [F.count(F.lit(1)).alias("rows"), F.first("folder").alias("folder")]
        for n, c in columns.items():
            total = F.lit(None).cast("long") if c.kind == "string" else F.coalesce(F.sum(F.col(n).cast("long")), F.lit(0).cast("long"))
            per += [F.min(n).alias(f"min_{n}"), F.max(n).alias(f"max_{n}"), total.alias(f"sum_{n}"), F.count_if(F.col(n).isNull()).alias(f"nulls_{n}")]
            per += [F.count_if(f"down_{n}").alias(f"inversions_{n}"), F.min_by(n, "row_id").alias(f"first_{n}"), F.max_by(n, "row_id").alias(f"last_{n}")]
        stats = rows.select("*", *down).groupBy("row_group").agg(*per).withColumn("write", F.lit(write))
        if kept is not None:
            stats = stats.unionByName(kept, allowMissingColumns=True)
        stats.write.parquet(f"{self._folder(table)}/zones/{write}")
        return self.spark.read.parquet(f"{self._folder(table)}/zones/{write}")

    # reading

    def zone_map(self, table: str) -> DataFrame:
        """The zone map of the generation in use."""
        return self.spark.read.parquet(f"{self._folder(table)}/zones/{self.manifest(table)['write']}")

    def _rows(self, table: str, zone: DataFrame | None) -> DataFrame:
        """The rows of some groups (None: of all), with added columns at their defaults.

        Up to ``NAMED`` groups are named as literals, which prune folders and Parquet row groups; more are joined, by
        write, folder and group, so that no list of them goes through the driver.
        """
        manifest = self.manifest(table)
        definition, stored = self.tables[table], self._stored_def(manifest)
        struct = stored.struct().add("row_id", "long").add("row_group", "long").add("folder", "long")
        reads = [self.spark.read.schema(struct).parquet(f"{self._folder(table)}/data/{w}").withColumn("write", F.lit(w)) for w in manifest["writes"]]
        if zone is None and len(reads) == 1:
            rows = reads[0]
        else:
            zone = self.zone_map(table) if zone is None else zone
            groups = zone.select("write", "folder", "row_group")
            few = groups.limit(NAMED + 1).collect()
            if len(few) <= NAMED:
                by_write = {w: [r for r in few if r["write"] == w] for w in manifest["writes"]}
                named = [r.where(F.col("folder").isin(sorted({g["folder"] for g in gs})) & F.col("row_group").isin(sorted(g["row_group"] for g in gs))) for r, gs in zip(reads, by_write.values(), strict=True) if gs]
                rows = reduce(DataFrame.unionAll, named) if named else reads[0].where(F.lit(False))
            else:
                rows = reduce(DataFrame.unionAll, reads).join(groups, ["write", "folder", "row_group"], "left_semi")
        return rows.select("row_id", *[F.col(n) if n in stored.columns else F.lit(c.default).cast(c.spark).alias(n) for n, c in definition.columns.items()])

    def table(self, table: str) -> DataFrame:
        """All rows with their row ids: a snapshot, since it names the files of one generation."""
        return self._cached.get(table) or self._rows(table, None)

    def range_aggregate(self, table: str, column: str, low: int, high: int) -> DataFrame:
        """count and sum of a numeric column's values in [low, high).

        Groups that lie wholly inside are answered by the zone map; only those that the bounds cut are read.
        """
        c = self.tables[table].columns[column]
        if c.kind == "string":
            raise ValueError("sums are of numeric columns")
        if column not in self.manifest(table)["columns"]:
            raise ValueError("the column is not stored yet")
        lo, hi = F.col(f"min_{column}"), F.col(f"max_{column}")
        zone = self.zone_map(table).where((lo < F.lit(high)) & (hi >= F.lit(low)) if low < high else F.lit(False))
        inside = (lo >= F.lit(low)) & (hi < F.lit(high))
        whole = zone.where(inside).agg(F.sum(F.col("rows") - F.col(f"nulls_{column}")).alias("n"), F.sum(f"sum_{column}").alias("s"))
        cut = self._rows(table, zone.where(~inside)).where(between(column, low, high)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(column).cast("long")).alias("s"))
        zero = F.lit(0).cast("long")
        return whole.unionAll(cut).agg(F.coalesce(F.sum("n"), zero).alias("count"), F.coalesce(F.sum("s"), zero).alias("sum"))

    def order(self, table: str, column: str) -> DataFrame:
        """The column, row_id and position in the stable order: row ids themselves where the stored column ascends."""
        if self.order_facts(table, column)["ascending"]:
            return self.table(table).select(column, "row_id", F.col("row_id").alias("position"))
        return order_positions(self.table(table), column, "row_id")

    def cache(self, table: str) -> DataFrame:
        """Keeps the generation in use in memory until ``uncache`` or a new generation."""
        self._cached[table] = self.table(table).persist()
        return self._cached[table]

    def is_cached(self, table: str) -> bool:
        return table in self._cached

    def uncache(self, table: str) -> None:
        if table in self._cached:
            self._cached.pop(table).unpersist()

    def read_i32(self, table: str, column: str) -> DataFrame:
        """row_id and one stored i32 column; ValueError for nullable, added or other columns."""
        c = self.tables[table].columns[column]
        if c.kind != "i32" or c.nullable or column not in self.manifest(table)["columns"]:
            raise ValueError("only stored i32 columns without nulls are read so")
        return self.table(table).select("row_id", column)

    def order_facts(self, table: str, column: str) -> dict:
        """row_count, ascending, inversions, min, max, range and groups of a u32 column, from the zone map alone."""
        c = self.tables[table].columns[column]
        if c.kind != "u32" or c.nullable:
            raise ValueError("order facts are kept of u32 columns without nulls")
        edge = F.lag(f"last_{column}").over(Window.orderBy("row_group")) > F.col(f"first_{column}")
        z = self.zone_map(table).select("rows", F.col(f"min_{column}").alias("lo"), F.col(f"max_{column}").alias("hi"), F.col(f"inversions_{column}").alias("n"), edge.alias("edge"), F.col(f"first_{column}").alias("first"), F.col(f"last_{column}").alias("last"), "row_group")
        r = z.agg(F.sum("rows").alias("rows"), (F.sum("n") + F.count_if("edge")).alias("inversions"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("groups"), F.min_by("first", "row_group").alias("first"), F.max_by("last", "row_group").alias("last")).first()
        return {"row_count": r["rows"], "ascending": r["inversions"] == 0, "inversions": r["inversions"], "min": r["lo"], "max": r["hi"], "range": r["hi"] - r["lo"] + 1, "groups": r["groups"], "first": r["first"], "last": r["last"]}

    # versions

    def refresh(self, table: str) -> int:
        """Takes up the generation that is published now."""
        self._seen.pop(table, None)
        self.uncache(table)
        return self.manifest(table)["generation"]

    def snapshot(self, table: str) -> str:
        """The generation in use as text, from which ``restore`` reads it again; ``pin`` keeps its files."""
        return json.dumps({"table": table, "manifest": self.manifest(table)})

    def restore(self, text: str) -> DataFrame:
        """The rows that a store saw when it wrote a snapshot. The store's own generation stays as it is."""
        kept = json.loads(text)
        if not isinstance(kept, dict) or set(kept) != {"table", "manifest"} or kept["table"] not in self.tables:
            raise ValueError("not a snapshot of a table of this store")
        self._check(kept["table"], kept["manifest"])
        other = Store(self.spark, self.root, self.tables)
        check_evolution(self._stored_def(kept["manifest"]), self.tables[kept["table"]])
        other._seen[kept["table"]] = kept["manifest"]
        return other.table(kept["table"])

    def pin(self, table: str) -> str:
        """Keeps the files of the generation in use from any process's ``vacuum`` until ``release``."""
        path = f"{self._folder(table)}/pins/{self.manifest(table)['generation']:012d}-{uuid.uuid4().hex}"
        self._fs.create(self._path(path), False).close()
        return path

    def release(self, pin: str) -> None:
        self._fs.delete(self._path(pin), False)

    def vacuum(self, table: str) -> int:
        """Deletes what neither the published generation nor a pinned one needs; returns how many folders of groups.

        What a running write has put down under the next generation's number stays.
        """
        folder = self._folder(table)
        now = self._read_manifest(table)
        live = {now["generation"]} | {int(n[:12]) for n in self._names(f"{folder}/pins") if not n.startswith(".")}
        names = [n for n in self._names(f"{folder}/manifests") if n.endswith(".json") and not n.startswith(".")]
        manifests = [self._manifest_of(table, n) for n in names if int(n[:12]) in live]
        zones = [self.spark.read.parquet(f"{folder}/zones/{m['write']}").select("write", "folder") for m in manifests]
        writes = {w for m in manifests for w in m["writes"]}
        needed: dict[str, set[int]] = {}
        # a row per folder of groups
        for r in reduce(DataFrame.unionAll, zones).distinct().toLocalIterator():
            needed.setdefault(r["write"], set()).add(r["folder"])
        gone = 0
        for write in self._names(f"{folder}/data"):
            if int(write.split("-")[0]) > now["generation"]:
                continue
            for part in self._names(f"{folder}/data/{write}"):
                if part.startswith("folder=") and (write not in writes or int(part[7:]) not in needed.get(write, ())):
                    self._fs.delete(self._path(f"{folder}/data/{write}/{part}"), True)
                    gone += 1
            if write not in writes:
                self._fs.delete(self._path(f"{folder}/data/{write}"), True)
        kept = {m["write"] for m in manifests}
        for write in self._names(f"{folder}/zones"):
            if write not in kept and int(write.split("-")[0]) <= now["generation"]:
                self._fs.delete(self._path(f"{folder}/zones/{write}"), True)
        for name in names:
            if int(name[:12]) not in live and int(name[:12]) < now["generation"]:
                self._fs.delete(self._path(f"{folder}/manifests/{name}"), False)
        return gone
