"""Registered models: a keys table goes in, predictions come out.

``Affine`` becomes column expressions.  Any other model is a class with
``outputs(keys)`` over pandas columns, which runs once per batch of rows for
all its outputs.
"""

from __future__ import annotations

import dataclasses
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.codec import decode
from fieldloom.sources.manifest import Slot
from fieldloom.sources.study import Study, StudyError

PREDICTION = "mean array<double>, uncertainty array<double>, level double, method string"


class Model(ABC):
    """A registered model.  ``type`` names it; ``to_dict`` and ``from_dict`` store it."""

    type: str

    @abstractmethod
    def names(self) -> list[str]:
        """Its outputs."""

    @abstractmethod
    def to_dict(self) -> dict: ...

    @classmethod
    @abstractmethod
    def from_dict(cls, state: dict) -> Model: ...

    def outputs(self, keys: pd.DataFrame) -> dict[str, dict]:
        """For each output ``mean`` (rows, values) and, with a band, uncertainty, level, method."""
        raise NotImplementedError

    def columns(self, keys: list[str]) -> dict[str, Column] | None:
        """Predictions as column expressions, if the model can be written so."""
        return None


_registry: dict[str, type[Model]] = {}


def register(kind: type[Model]) -> type[Model]:
    """Make a class known by its ``type``; a later one replaces an earlier one."""
    _registry[kind.type] = kind
    return kind


def registered_types() -> list[str]:
    return sorted(_registry)


class Opaque(Model):
    """A model of a type that isn't registered: it is stored again but doesn't run."""

    def __init__(self, type: str, state: dict):
        self.type, self.state = type, state

    def names(self) -> list[str]:
        return []

    def to_dict(self) -> dict:
        return self.state

    @classmethod
    def from_dict(cls, state: dict) -> Opaque:
        return cls("opaque", state)

    def outputs(self, keys):
        raise StudyError("E14", f"no model of type {self.type!r} is registered")


def load(type: str, state: dict) -> Model:
    return _registry[type].from_dict(state) if type in _registry else Opaque(type, state)


def check_prediction(name: str, mean, uncertainty=None, level=None, method=None) -> None:
    """Refuse a band that isn't one: its shape, its sign, its level and method."""
    if uncertainty is None:
        return
    if np.shape(uncertainty) != np.shape(mean):
        raise StudyError("E12", f"{name}: the band's shape differs from the mean's")
    if level is None or not 0 < level < 1 or not method:
        raise StudyError("E12", f"{name}: a band needs a level between 0 and 1 and a method")
    if np.any(np.asarray(uncertainty) < 0):
        raise StudyError("W16", f"{name}: the band is negative")


@register
class Affine(Model):
    """y = A x + b for each output, with an optional constant band.

    The products are added in key order from zero and ``b`` last, so that the
    result is the same to the last bit wherever it is computed.
    """

    type = "affine"

    def __init__(self, keys: list[str], outputs: dict[str, dict]):
        self.keys, self.parts = list(keys), outputs
        for name, part in outputs.items():
            a, b = np.asarray(part["A"], dtype=np.float64), np.asarray(part["b"], dtype=np.float64)
            if a.shape != (len(b), len(self.keys)):
                raise StudyError("E32", f"{name}: A is {a.shape}, b has {len(b)} values and there are {len(self.keys)} keys")
            if int(np.prod(part.get("shape", [len(b)]), dtype=int)) != len(b):
                raise StudyError("E32", f"{name}: the shape doesn't hold {len(b)} values")
            if part.get("uncertainty") is not None:
                check_prediction(name, b, part["uncertainty"], part.get("level"), part.get("method"))

    def names(self) -> list[str]:
        return sorted(self.parts, key=str.encode)

    def to_dict(self) -> dict:
        out = {}
        for name, p in self.parts.items():
            out[name] = {"A": np.asarray(p["A"], dtype=np.float64), "b": np.asarray(p["b"], dtype=np.float64), "shape": np.asarray(p.get("shape", [len(p["b"])]), dtype=np.int64)}
            if p.get("uncertainty") is not None:
                out[name] |= {"uncertainty": np.asarray(p["uncertainty"], dtype=np.float64), "level": float(p["level"]), "method": p["method"]}
        return {"keys": list(self.keys), "outputs": out}

    @classmethod
    def from_dict(cls, state: dict) -> Affine:
        if set(state) != {"keys", "outputs"}:
            raise StudyError("E32", "an affine model holds keys and outputs, and nothing else")
        return cls(state["keys"], state["outputs"])

    def columns(self, keys: list[str]) -> dict[str, Column]:
        if list(keys) != self.keys:
            raise StudyError("E39", f"the model's keys are {self.keys}, the study's {list(keys)}")
        out = {}
        for name, p in self.parts.items():
            values = []
            for row, b in zip(np.asarray(p["A"], dtype=np.float64).tolist(), np.asarray(p["b"], dtype=np.float64).tolist(), strict=True):
                total = F.lit(0.0)
                for a, key in zip(row, self.keys, strict=True):
                    total = total + F.lit(a) * F.col(key)
                values.append(total + F.lit(b))
            band = p.get("uncertainty")
            width = F.array(*(F.lit(float(u)) for u in band)) if band is not None else F.lit(None).cast("array<double>")
            out[name] = F.struct(F.array(*values).alias("mean"), width.alias("uncertainty"), F.lit(p.get("level") if band is not None else None).cast("double").alias("level"), F.lit(p.get("method") if band is not None else None).cast("string").alias("method"))
        return out


def model_of(study: Study, id: str) -> Model:
    for m in study.manifest.models:
        if m.id == id:
            if m.type is None:
                raise StudyError("E15", f"{id} has no type")
            return load(m.type, decode(m.dict))
    raise StudyError("E14", f"no model {id!r}")


def keys_table(study: Study, table: DataFrame) -> DataFrame:
    """The table's columns for the study's keys, in key order, with ``row``."""
    order = [k.name for k in study.manifest.key_order()]
    missing = [k for k in order if k not in table.columns]
    if missing:
        raise StudyError("E39", f"the keys table lacks {', '.join(missing)}")
    roles = {k.name: k.role for k in study.manifest.keys}
    typed = [F.col(k).cast("double" if roles[k] in ("design", "condition", "time") else "int" if roles[k] != "id" else "string").alias(k) for k in order]
    return table.select(F.col("row").cast("bigint").alias("row"), *typed)


def predictions(model: Model, keys: DataFrame, names: list[str]) -> DataFrame:
    """(row, <output> struct<mean, uncertainty, level, method>, ...): the model is called once."""
    order = [c for c in keys.columns if c != "row"]
    native = model.columns(order)
    if native is not None:
        missing = [n for n in names if n not in native]
        if missing:
            raise StudyError("E14", f"the model has no output {missing[0]!r}")
        return keys.select("row", *(native[n].alias(n) for n in names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = model.outputs(batch[order])
            out = {"row": batch["row"]}
            for n in names:
                if n not in found:
                    raise StudyError("E14", f"the model has no output {n!r}")
                p = found[n]
                mean = np.asarray(p["mean"], dtype=np.float64).reshape(len(batch), -1)
                band = p.get("uncertainty")
                if band is not None:
                    band = np.asarray(band, dtype=np.float64).reshape(len(batch), -1)
                    check_prediction(n, mean, band, p.get("level"), p.get("method"))
                out[n] = [{"mean": list(m), "uncertainty": None if band is None else list(band[i]), "level": p.get("level"), "method": p.get("method")} for i, m in enumerate(mean)]
            yield pd.DataFrame(out)

    return keys.mapInPandas(run, ", ".join(["row bigint", *(f"`{n}` struct<{PREDICTION.replace(' ', ':').replace(',:', ',')}>" for n in names)]))


def evaluate(study: Study, table: DataFrame) -> Study:
    """The study that the models make of a keys table: all data stored, no models.

    Each model is called once, whatever the number of slots it serves.  The
    notes stay, private parts go.
    """
    keys = keys_table(study, table)
    manifest = study.manifest
    n_rows = keys.count()
    if not manifest.aligned and n_rows != manifest.n_rows:
        raise StudyError("E16", f"the table has {n_rows} rows; the study, which is not aligned, {manifest.n_rows}")
    served: dict[str, list[Slot]] = {}
    slots = []
    for s in manifest.slots:
        if s.source == "data":
            if s.varies == "row" and n_rows != manifest.n_rows:
                raise StudyError("E16", f"{s.path} has a value for each of {manifest.n_rows} rows, the table {n_rows}")
            slots.append(s)
        else:
            served.setdefault(s.source.removeprefix("callable:"), []).append(s)
    rows, payload = keys, study.slot_values
    kept = [s.name for s in manifest.scalars() if s.source == "data"]
    if kept:
        rows = rows.join(study.rows.select(F.col("row").alias("__row"), *kept), F.col("row") == F.col("__row")).drop("__row")
    for id, group in sorted(served.items()):
        names = sorted({s.output or s.name for s in group})
        made = predictions(model_of(study, id), keys, names)
        for s in group:
            value = F.col(f"`{s.output or s.name}`")
            part = value["mean"] if s.statistic in ("value", "mean") else value["uncertainty"]
            if s.statistic not in ("value", "mean", "band"):
                raise StudyError("E12", f"{s.path}: a model can't serve {s.statistic}")
            extra = {}
            if s.statistic == "band":
                first = made.select(part.isNull().alias("none"), value["level"].alias("level"), value["method"].alias("method")).first()
                if first is not None and first.none:
                    raise StudyError("E12", f"{s.path}: the model gives no band")
                extra = {"level": first.level, "method": first.method} if first is not None else {}
            slots.append(dataclasses.replace(s, source="data", output=None, varies="row", **extra))
            if s.location == "row":
                rows = rows.join(made.select(F.col("row").alias("__row"), part[0].alias(s.name)), F.col("row") == F.col("__row")).drop("__row")
            else:
                place = manifest.support(s.support)
                size = (place.n_nodes if s.location == "node" else place.n_cells) * (s.components or 1)
                checked = F.when(F.size(part) == size, part).otherwise(F.raise_error(F.lit(f"E05: {s.path} needs {size} values")).cast("array<double>"))
                payload = payload.unionByName(made.select(F.lit(s.support).alias("support"), F.lit(s.location).alias("location"), F.lit(s.name).alias("slot"), F.col("row").alias("instance"), F.lit(None).cast("int").alias("draw"), checked.alias("values"), F.lit(None).cast("array<bigint>").alias("labels")))
    new = dataclasses.replace(manifest, n_rows=n_rows, slots=slots, models=[], private={})
    return study.replace(manifest=new, rows=rows, slot_values=payload)


def prediction(study: Study, slot: Slot, table: DataFrame | None = None) -> DataFrame:
    """(row, mean, uncertainty, level, method) of a slot.

    A stored slot gives its values and its stored band; a served one calls its
    model on ``table``, or on the study's own keys.
    """
    if slot.statistic in ("band", "std", "quantile", "draw"):
        raise StudyError("E12", f"{slot.path} is a {slot.statistic}: ask for its base slot")
    if slot.source != "data":
        keys = keys_table(study, table if table is not None else study.keys_table())
        name = slot.output or slot.name
        return predictions(model_of(study, slot.source.removeprefix("callable:")), keys, [name]).select("row", f"`{name}`.*")
    if table is not None:
        raise StudyError("E16", f"{slot.path} is stored: it takes no keys")
    from fieldloom.operators.joins import gather

    band = study.manifest.band_of(slot)
    nothing = F.lit(None).cast("array<double>")
    if slot.location == "row":
        return study.rows.select("row", F.array(slot.name).alias("mean"), F.array(band.name).alias("uncertainty") if band else nothing.alias("uncertainty"), F.lit(band.level if band else None).cast("double").alias("level"), F.lit(band.method if band else None).cast("string").alias("method"))
    base = gather(study, slot).select("row", F.col("values").alias("mean"))
    if band is None:
        return base.select("row", "mean", nothing.alias("uncertainty"), F.lit(None).cast("double").alias("level"), F.lit(None).cast("string").alias("method"))
    side = gather(study, band).select(F.col("row").alias("__row"), F.col("values").alias("uncertainty"))
    return base.join(side, F.col("row") == F.col("__row"), "left").select("row", "mean", "uncertainty", F.lit(band.level).cast("double").alias("level"), F.lit(band.method).cast("string").alias("method"))


def interval(predicted: DataFrame) -> DataFrame:
    """(row, site, mean, lower, upper): mean minus and plus the band."""
    pairs = F.posexplode(F.arrays_zip("mean", "uncertainty")).alias("site", "p")
    return predicted.select("row", pairs).select("row", "site", F.col("p.mean").alias("mean"), (F.col("p.mean") - F.col("p.uncertainty")).alias("lower"), (F.col("p.mean") + F.col("p.uncertainty")).alias("upper"))


def grid(spark, axes: dict[str, list[float]]) -> DataFrame:
    """A keys table of all combinations of a few values per key (a stated grid)."""
    names = list(axes)
    frame = spark.range(int(np.prod([len(v) for v in axes.values()], dtype=int)))
    columns, step = [], 1
    for name in reversed(names):
        values = F.array(*(F.lit(float(v)) for v in axes[name]))
        columns.append(F.get(values, (F.floor(F.col("id") / step) % len(axes[name])).cast("int")).alias(name))
        step *= len(axes[name])
    return frame.select(F.col("id").alias("row"), *reversed(columns))
