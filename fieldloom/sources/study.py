"""A study: a manifest and four lazy tables.

``rows``         row BIGINT, one column per key and scalar, [support_ix INT]
``slot_values``  support, location, slot, instance, draw, values, labels
``cells``        support, cell, cell_type, nodes
``categories``   table_name, id, entry

An array's payload is in C order (site, component): the value of a site and
component stands at ``site * components + component``.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.manifest import Key, Manifest, Slot

SLOT_VALUES = "support string, location string, slot string, instance bigint, draw int, values array<double>, labels array<bigint>"
CELLS = "support string, cell bigint, cell_type smallint, nodes array<bigint>"
CATEGORIES = "table_name string, id int, entry string"
MIB = 1 << 20


class StudyError(ValueError):
    """A refusal that names the rule that would be broken."""

    def __init__(self, rule: str, message: str):
        super().__init__(f"{rule}: {message}")
        self.rule = rule


@dataclasses.dataclass
class Study:
    manifest: Manifest
    rows: DataFrame
    slot_values: DataFrame
    cells: DataFrame
    categories: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    # whole columns and slots

    def key_column(self, name: str, begin: int | None = None, end: int | None = None) -> DataFrame:
        """(row, key) for all rows or a half-open range of them."""
        return _range(self.rows.select("row", self.manifest.key(name).name), "row", begin, end)

    def scalar_column(self, name: str, begin: int | None = None, end: int | None = None) -> DataFrame:
        slot = self.manifest.find(f"scalars/{name}")
        return _range(self.rows.select("row", slot.name), "row", begin, end)

    def payload(self, slot: Slot, begin: int | None = None, end: int | None = None) -> DataFrame:
        """(instance, draw, values, labels) of one array slot and a range of its instances."""
        where = (F.col("support") == slot.support) & (F.col("location") == slot.location) & (F.col("slot") == slot.name)
        return _range(self.slot_values.where(where).select("instance", "draw", "values", "labels"), "instance", begin, end)

    def long(self, slot: Slot, begin: int | None = None, end: int | None = None) -> DataFrame:
        """(instance, draw, site, component, value): one column per named dimension."""
        data = "labels" if slot.role == "label" else "values"
        wide = self.payload(slot, begin, end).select("instance", "draw", F.posexplode(data).alias("at", "value"))
        width = F.lit(slot.components or 1)
        return wide.select("instance", "draw", F.floor(F.col("at") / width).cast("bigint").alias("site"), (F.col("at") % width).cast("int").alias("component"), "value")

    def keys_table(self) -> DataFrame:
        """The study's own keys, in key order, as an evaluation table."""
        return self.rows.select("row", *[k.name for k in self.manifest.key_order()])

    def entries(self, table: str) -> DataFrame:
        """(id, entry) of a category table."""
        return self.categories.where(F.col("table_name") == table).select("id", "entry")

    def row_count(self) -> int:
        """From the manifest: opening reads no data."""
        return self.manifest.n_rows

    def header(self) -> Manifest:
        return self.manifest

    def replace(self, **changes) -> Study:
        return dataclasses.replace(self, **changes)

    def with_manifest(self, **changes) -> Study:
        return self.replace(manifest=dataclasses.replace(self.manifest, **changes))

    def materialise(self) -> Study:
        """The same study with its tables kept once they are read."""
        return self.replace(rows=self.rows.cache(), slot_values=self.slot_values.cache(), cells=self.cells.cache(), categories=self.categories.cache())

    def is_materialised(self) -> bool:
        return all(t.storageLevel.useMemory or t.storageLevel.useDisk for t in (self.rows, self.slot_values, self.cells, self.categories))


def _range(frame: DataFrame, column: str, begin: int | None, end: int | None) -> DataFrame:
    if begin is not None:
        frame = frame.where(F.col(column) >= begin)
    if end is not None:
        frame = frame.where(F.col(column) < end)
    return frame


def chunk_rows(bytes_per_row: int, n_rows: int) -> int:
    """Rows of a default chunk: about one MiB, at least 1 and at most all rows."""
    return max(1, min(n_rows, MIB // max(1, bytes_per_row))) if n_rows else 1


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# storage


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _pointers(spark: SparkSession, path: str) -> dict[int, str]:
    """Published versions by number: each is the name of an empty file in ``published``."""
    system, folder = _file_system(spark, f"{path}/published")
    if not system.exists(folder):
        return {}
    names = (p.getPath().getName() for p in system.listStatus(folder))
    return {int(n): v for n, _, v in (x.partition("-") for x in names) if n.isdigit()}


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the version published last."""
    found = _pointers(spark, path)
    if not found:
        raise StudyError("E41", f"no study at {path}")
    return found[max(found)]


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the current one, by one new name: readers see the one before or this one, never none."""
    found = _pointers(spark, path)
    number = max(found, default=0) + 1
    system, pointer = _file_system(spark, f"{path}/published/{number:012d}-{version}")
    if not system.createNewFile(pointer):
        raise OSError(f"could not publish {path}")
    if sum(n == number for n in map(int, (p.getPath().getName().partition("-")[0] for p in system.listStatus(pointer.getParent())))) > 1:
        system.delete(pointer, True)
        raise OSError(f"{path} was published by another writer meanwhile")


def open_study(spark: SparkSession, path: str, strict: bool = True) -> Study:
    """Read the manifest; the tables stay lazy.

    ``strict`` refuses a manifest with structural errors; semantic ones never
    refuse.
    """
    version = current_version(spark, path)
    text = "\n".join(r.value for r in spark.read.text(f"{path}/{version}/manifest.json").collect())
    manifest = Manifest.from_json(text)
    base = f"{path}/{version}"
    shared = {"slot_values": SLOT_VALUES, "cells": CELLS, "categories": CATEGORIES}
    study = Study(manifest, spark.read.parquet(f"{base}/rows"), *(spark.read.schema(kind).parquet(f"{base}/{name}") for name, kind in shared.items()))
    if strict:
        from fieldloom.plans.rules import structural_findings

        bad = structural_findings(study)
        if bad:
            raise StudyError(bad[0].rule, bad[0].message)
    return study


def write_study(study: Study, path: str, check: bool = True, codec: str = "zstd") -> None:
    """Validate, write beside the earlier versions, then publish the new one by one name.

    A failure at any step leaves the earlier version as it was.
    """
    if check:
        from fieldloom.plans.rules import validate

        errors = [r for r in validate(study).collect() if r.severity == "error"]
        if errors:
            raise StudyError(errors[0].rule, f"{errors[0].path}: {errors[0].message}")
    version = f"v-{uuid.uuid4().hex}"
    base = f"{path}/{version}"
    study.rows.write.option("compression", codec).parquet(f"{base}/rows")
    study.slot_values.repartitionByRange(F.col("support"), F.col("slot"), F.col("instance")).sortWithinPartitions("instance").write.option("compression", codec).partitionBy("support", "slot").parquet(f"{base}/slot_values")
    study.cells.write.option("compression", codec).parquet(f"{base}/cells")
    study.categories.coalesce(1).write.option("compression", codec).parquet(f"{base}/categories")
    spark = study.spark
    spark.createDataFrame([(study.manifest.to_json().rstrip("\n"),)], "value string").coalesce(1).write.text(f"{base}/manifest.json")
    _publish(spark, path, version)


class StudyBuilder:
    """Builds a study from a DataFrame with a ``row`` column, or from literals.

    ``values`` may be a column (or its name) of the bound frame, or a list with
    one value per row.
    """

    def __init__(self, spark: SparkSession, frame: DataFrame | None = None, n_rows: int | None = None, created: str | None = "2026-01-01T00:00:00Z", writer: str = "fieldloom"):
        self.spark = spark
        self.n_rows = n_rows if n_rows is not None or frame is None else None
        self.frame = frame if frame is not None else spark.range(n_rows or 0).select(F.col("id").alias("row"))
        self.manifest = Manifest(created=created, writer=writer)
        self.columns: dict[str, object] = {}
        self.lists: dict[str, list] = {}
        self.payloads: list[DataFrame] = []
        self.cell_tables: list[DataFrame] = []
        self.tables: list[DataFrame] = []

    def _bind(self, name: str, values, kind: str | None) -> None:
        if name in self.columns or name in self.lists:
            raise StudyError("E03", f"{name} is there already")
        if isinstance(values, list):
            self.lists[name] = values
            if self.n_rows is not None and len(values) != self.n_rows:
                raise StudyError("E16", f"{name} has {len(values)} values in a study of {self.n_rows} rows")
            self.columns[name] = None if kind is None else F.col(f"__list.{name}").cast(kind)
        else:
            column = F.col(values) if isinstance(values, str) else values
            self.columns[name] = column if kind is None else column.cast(kind)

    def add_key(self, name: str, values, role: str, **attributes) -> StudyBuilder:
        from fieldloom.functions.names import is_legal
        from fieldloom.sources.manifest import KEY_ROLES, TABLE_ROLES, UNIT_ROLES

        if not is_legal(name):
            raise StudyError("E33", f"{name!r} is not a legal name")
        if role not in KEY_ROLES:
            raise StudyError("E02", f"unknown role {role!r}")
        if KEY_ROLES[role] is not None and any(k.role == role for k in self.manifest.keys):
            raise StudyError("E03", f"a second key of role {role}")
        if role in UNIT_ROLES and not attributes.get("units"):
            raise StudyError("E39", f"{name} needs units")
        if role in TABLE_ROLES and not attributes.get("category"):
            raise StudyError("E39", f"{name} needs a category table")
        if role == "time" and not attributes.get("trajectory_group"):
            raise StudyError("E39", f"{name} needs a trajectory_group")
        kind = "double" if role in UNIT_ROLES else "int" if role in TABLE_ROLES else None
        if isinstance(values, list) and kind is None:
            kind = "string" if values and isinstance(values[0], str) else "bigint"
        self._bind(name, values, kind)
        self.manifest.keys.append(Key(name, role, **attributes))
        return self

    def add_scalar(self, name: str, values, units: str, **attributes) -> StudyBuilder:
        self._bind(name, values, "double")
        self.manifest.slots.append(Slot(name, "row", units=units, **attributes))
        return self

    def add_category_table(self, name: str, entries) -> StudyBuilder:
        """``entries``: a list in id order, or a string column of the frame (byte order)."""
        if isinstance(entries, list):
            self.tables.append(self.spark.createDataFrame([(name, i, e) for i, e in enumerate(entries)], CATEGORIES))
        else:
            from fieldloom.operators.joins import category_table

            self.tables.append(category_table(self.frame, entries, name))
        return self

    def encode(self, table: str, column: str) -> StudyBuilder:
        """Replace a bound string column by the ids of its entries; unknown ones are refused."""
        from fieldloom.operators.joins import encode_category

        self.frame = encode_category(self.frame, column, self._categories().where(F.col("table_name") == table), column)
        return self

    def set_generalisation_group(self, name: str) -> StudyBuilder:
        if self.manifest.key(name).role != "group":
            raise StudyError("E18", f"{name} is not a group key")
        self.manifest.generalisation_group = name
        return self

    def add_support(self, name: str, kind: str, n_nodes: int = 0, cells=None, coordinates=None, units: str = "1", varies: str = "none", components: int = 1, support_id: str | None = None) -> StudyBuilder:
        """``cells``: list of (type, nodes) or a frame (cell, cell_type, nodes);
        ``coordinates``: list of instances, each flat, or a frame (instance, values)."""
        from fieldloom.sources.manifest import SUPPORT_KINDS, Support

        if kind not in SUPPORT_KINDS:
            raise StudyError("E02", f"unknown kind {kind!r}")
        if (cells is not None) != (kind == "mesh"):
            raise StudyError("E38", "a mesh has cells, and nothing else has")
        n_cells = 0
        if cells is not None:
            if isinstance(cells, list):
                n_cells = len(cells)
                cells = self.spark.createDataFrame([(i, t, list(n)) for i, (t, n) in enumerate(cells)], "cell bigint, cell_type smallint, nodes array<bigint>")
            else:
                n_cells = cells.count()
            self.cell_tables.append(cells.select(F.lit(name).alias("support"), F.col("cell").cast("bigint"), F.col("cell_type").cast("smallint"), F.col("nodes").cast("array<bigint>")))
        self.manifest.supports.append(Support(name, kind, n_nodes, n_cells, support_id))
        if coordinates is not None:
            self.add_array(name, "node", "coordinates", coordinates, units=units, varies=varies, components=components, role="coordinates")
        return self

    def set_row_support(self, values) -> StudyBuilder:
        self._bind("support_ix", values, "int")
        self.manifest.aligned = False
        return self

    def add_array(self, support: str, location: str, name: str, values, *, role: str = "field", units: str | None = None, varies: str = "row", components: int = 1, **attributes) -> StudyBuilder:
        """``values``: list of flat instances (of draws, for draws), or a frame
        (instance, [draw], values or labels)."""
        from fieldloom.functions.names import varies_group

        slot = Slot(name, location, support, role, units, varies, components, **attributes)
        group = varies_group(varies)
        if group is not None and not any(k.name == group and k.role == "group" for k in self.manifest.keys):
            raise StudyError("E04", f"{slot.path} varies along {group}, which is no group key")
        place = self.manifest.support(support)
        size = (place.n_nodes if location == "node" else place.n_cells) * components
        data = "labels" if role == "label" else "values"
        if isinstance(values, list):
            draws = [(i, d, v) for i, inst in enumerate(values) for d, v in enumerate(inst)] if slot.statistic == "draw" else [(i, None, v) for i, v in enumerate(values)]
            for i, _, v in draws:
                if len(v) != size:
                    raise StudyError("E05", f"{slot.path} has {len(v)} values in instance {i}, its support {size}")
            cast = (lambda v: [int(x) for x in v]) if role == "label" else (lambda v: [float(x) for x in v])
            frame = self.spark.createDataFrame([(i, d, cast(v)) for i, d, v in draws], f"instance bigint, draw int, {data} array<{'bigint' if role == 'label' else 'double'}>")
        else:
            frame = values
        draw = F.col("draw").cast("int") if "draw" in frame.columns else F.lit(None).cast("int")
        made = {"values": F.lit(None).cast("array<double>"), "labels": F.lit(None).cast("array<bigint>")} | {data: F.col(data).cast("array<bigint>" if role == "label" else "array<double>")}
        self.payloads.append(frame.select(F.lit(support).alias("support"), F.lit(location).alias("location"), F.lit(name).alias("slot"), F.col("instance").cast("bigint").alias("instance"), draw.alias("draw"), *(c.alias(n) for n, c in made.items())))
        self.manifest.slots.append(slot)
        return self

    def add_served(self, slot: Slot) -> StudyBuilder:
        """A slot whose values come from a model; its output defaults to its name."""
        slot.output = slot.output or slot.name
        self.manifest.slots.append(slot)
        return self

    def add_model(self, id: str, model) -> StudyBuilder:
        from fieldloom.operators.codec import encode
        from fieldloom.sources.manifest import Model

        self.manifest.models.append(Model(id, model.type, encode(model.to_dict()), repr(model)))
        return self

    def note(self, name: str, value: str) -> StudyBuilder:
        self.manifest.notes[name] = value
        return self

    def _categories(self) -> DataFrame:
        out = empty(self.spark, CATEGORIES)
        for t in self.tables:
            out = out.unionByName(t.select("table_name", F.col("id").cast("int").alias("id"), "entry"))
        return out

    def build(self, bounds: bool = True) -> Study:
        """The study; observed bounds fill in for those not given, in one pass."""
        frame = self.frame
        if self.lists:
            names = list(self.lists)
            listed = self.spark.createDataFrame([(i, *v) for i, v in enumerate(zip(*self.lists.values(), strict=True))] or [], self._list_schema(names))
            frame = frame.join(listed.select(F.col("__row"), F.struct(*names).alias("__list")), F.col("row") == F.col("__row"), "left")
        rows = frame.select(F.col("row").cast("bigint").alias("row"), *(c.alias(n) for n, c in self.columns.items()))
        if self.n_rows is None:
            self.n_rows = rows.count()
        self.manifest.n_rows = self.n_rows
        payload = empty(self.spark, SLOT_VALUES)
        for p in self.payloads:
            payload = payload.unionByName(p)
        cells = empty(self.spark, CELLS)
        for c in self.cell_tables:
            cells = cells.unionByName(c)
        study = Study(self.manifest, rows, payload, cells, self._categories())
        if bounds:
            from fieldloom.operators.statistics import fill_bounds

            fill_bounds(study)
        for s in self.manifest.supports:
            if s.support_id is None:
                from fieldloom.operators.supports import digest_of

                s.support_id = digest_of(study, s.name)
        return study

    def _list_schema(self, names: list[str]) -> str:
        def kind(values: list) -> str:
            first = next((v for v in values if v is not None), None)
            return "string" if isinstance(first, str) else "double" if isinstance(first, float) or any(isinstance(v, float) for v in values) else "bigint"

        return ", ".join(["__row bigint", *(f"{n} {kind(self.lists[n])}" for n in names)])
