"""The validator: every rule is a predicate over the manifest or a query.

Rules on values share their scans: all conditions on rows are counted in one
pass, all on payloads in another, and only rules that fired look for their first
three places.  Rules about a file's bytes have no meaning for Parquet; they are
listed in ``NOT_APPLICABLE`` rather than passed in silence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import units as unit_strings
from fieldloom.functions.names import RESERVED, byte_order, is_legal, varies_group
from fieldloom.functions.numbers import finite
from fieldloom.operators.geometry import CELL_NODES
from fieldloom.operators.joins import decode_category, outside_bounds, unknown_categories, unused_categories
from fieldloom.operators.ordering import BLOCK
from fieldloom.operators.statistics import bound_widths
from fieldloom.operators.trajectory import time_violations
from fieldloom.sources.manifest import ARRAY_ROLES, CONVERGED, FORMAT, KEY_ROLES, STATISTICS, SUPPORT_KINDS, TABLE_ROLES, UNIT_ROLES, Manifest
from fieldloom.sources.study import Study

SCHEMA = "rule string, severity string, path string, count bigint, first_three array<bigint>, message string"
NOT_APPLICABLE = ("E25", "E27", "E29", "E40", "E42", "E43", "W12", "W13")
RETIRED = ("E07", "W09")
STRUCTURAL = ("E01", "E16", "E19", "E26", "E30", "E41")


@dataclass(frozen=True)
class Finding:
    rule: str
    path: str
    message: str
    count: int = 1
    first_three: tuple[int, ...] = ()

    @property
    def severity(self) -> str:
        return "error" if self.rule[0] == "E" else "warning"


def utc_text(text: str) -> bool:
    import datetime

    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|\+00:00)", text):
        return False
    try:
        datetime.datetime.fromisoformat(text[:10])
        return int(text[11:13]) < 24 and int(text[14:16]) < 60
    except ValueError:
        return False


def manifest_findings(m: Manifest) -> list[Finding]:
    """All rules that need no data."""
    out: list[Finding] = []
    say = lambda rule, path, message: out.append(Finding(rule, path, message))
    if m.format is None or m.format.split("/")[0] != FORMAT.split("/")[0] or m.format.split("/")[-1] != FORMAT.split("/")[-1]:
        return [Finding("E01", "/", f"format is {m.format!r}")]
    for name in ("writer", "created"):
        if not getattr(m, name):
            say("E17", "/", f"{name} is missing")
    if m.created and not utc_text(m.created):
        say("W14", "/", f"created is {m.created!r}")
    groups = {k.name for k in m.keys if k.role == "group"}
    if m.generalisation_group is None:
        if groups:
            say("E39", "/", "no unit of generalisation is named")
            if m.private:
                say("E18", "/", "the unit of generalisation is public knowledge, not private")
    elif m.generalisation_group not in groups:
        say("E39", "/", f"{m.generalisation_group} is not a group key")
    for name in m.extra:
        say("W11", f"/{name}", "unknown attribute")
    for k in m.keys:
        path = f"keys/{k.name}"
        if not is_legal(k.name):
            say("E33", path, "illegal name" if not k.name.startswith(RESERVED) else "reserved name")
        if k.role not in KEY_ROLES:
            say("E02", path, f"role is {k.role!r}")
            continue
        if k.role in UNIT_ROLES and not k.units:
            say("E39", path, "units are missing")
        if k.role in TABLE_ROLES and not k.category:
            say("E39", path, "category is missing")
        if k.role == "time" and k.trajectory_group not in groups:
            say("E39", path, "trajectory_group names no group key")
        for bound in ("lower", "upper"):
            value = getattr(k, bound)
            if value is not None and not math.isfinite(value):
                say("E19", path, f"{bound} is not finite")
        if k.units and not unit_strings.parses(k.units):
            say("W10", path, f"units {k.units!r}")
    for role, most in KEY_ROLES.items():
        if most is not None and sum(k.role == role for k in m.keys) > most:
            say("E03", "keys", f"more than {most} key of role {role}")
    names = [s.name for s in m.supports]
    for s in m.supports:
        if s.kind not in SUPPORT_KINDS:
            say("E39", s.name, f"kind is {s.kind!r}")
        if s.kind == "mesh" and s.n_cells == 0 or s.kind in ("axis", "none") and s.n_cells:
            say("E38", s.name, "a mesh has cells, and nothing else has")
        if s.kind in ("mesh", "axis"):
            n = sum(a.role == "coordinates" and a.support == s.name for a in m.arrays())
            if n != 1:
                say("E03", s.name, f"{n} coordinates")
        for role in ("weight", "normal"):
            for location in ("node", "cell"):
                if sum((a.role, a.support, a.location) == (role, s.name, location) for a in m.arrays()) > ARRAY_ROLES["weight"]:
                    say("E03", f"{s.name}/{location}_arrays", f"more than one {role}")
    if m.aligned != (len(m.supports) <= 1):
        say("E37", "/", f"aligned is {m.aligned} with {len(m.supports)} supports")
    if len(names) > 1:
        say("W05", "/", f"{len(names)} supports")
    ids = {c.id for c in m.models}
    for c in m.models:
        if not c.type:
            say("E15", f"callables/{c.id}", "type is missing")
        if c.dict is not None:
            from fieldloom.operators.codec import decode

            try:
                decode(c.dict)
            except (ValueError, KeyError, TypeError):
                say("E32", f"callables/{c.id}", "the dictionary can't be read")
    for s in m.slots:
        if not is_legal(s.name):
            say("E33", s.path, "illegal name")
        if s.location != "row" and s.role not in ARRAY_ROLES:
            say("E02", s.path, f"role is {s.role!r}")
        if s.statistic not in STATISTICS:
            say("E02", s.path, f"statistic is {s.statistic!r}")
        if s.location != "row" and s.support not in names:
            say("E39", s.path, "no such support")
        if s.role == "field" and not s.units:
            say("E11", s.path, "units are missing")
        if s.role == "coordinates" and not s.units:
            say("E39", s.path, "units are missing")
        if s.units and not unit_strings.parses(s.units):
            say("W10", s.path, f"units {s.units!r}")
        need = {"mean": ("of",), "std": ("of",), "band": ("of", "level", "method"), "quantile": ("of", "quantile")}.get(s.statistic, ())
        lacks = [n for n in need if getattr(s, n) is None and not (s.source != "data" and n in ("level", "method"))]
        if lacks:
            say("E12", s.path, f"{s.statistic} without {', '.join(lacks)}")
        for name in ("level", "quantile"):
            value = getattr(s, name)
            if value is not None and not 0 < value < 1:
                say("E19", s.path, f"{name} is {value}")
        served = re.fullmatch(r"callable:(.+)", s.source)
        if s.source != "data" and not served:
            say("E36", s.path, f"source is {s.source!r}")
        if served:
            if served[1] not in ids:
                say("E14", s.path, f"no model {served[1]!r}")
            if s.statistic in ("std", "quantile", "draw"):
                say("E12", s.path, f"a model can't serve {s.statistic}")
            if not s.output:
                say("E39", s.path, "output is missing")
        if s.role == "derived" and not (s.derived_from and s.recipe):
            say("E13", s.path, "derived_from and recipe are missing")
        if s.role in ("weight", "normal") and not s.recomputed:
            say("W06", s.path, "not marked as recomputed")
        if s.location != "row":
            if s.components is None:
                say("E31", s.path, "components is missing")
            try:
                group = varies_group(s.varies)
                if group is not None and group not in groups:
                    say("E04", s.path, f"varies along {group}, which is no group key")
            except ValueError:
                say("E04", s.path, f"varies is {s.varies!r}")
            kind = next((x.kind for x in m.supports if x.name == s.support), None)
            if s.role == "coordinates" and kind == "axis" and s.varies != "none":
                say("E35", s.path, "an axis doesn't vary")
    return out


def schema_findings(study: Study) -> list[Finding]:
    """E16, E20 and E28 from column names and types."""
    out, types = [], dict(study.rows.dtypes)
    for k in study.manifest.keys:
        if k.name not in types:
            out.append(Finding("E16", f"keys/{k.name}", "no such column"))
        else:
            allowed = ("double",) if k.role in UNIT_ROLES else ("int", "bigint") if k.role in TABLE_ROLES else ("bigint", "int", "string")
            if types[k.name] not in allowed:
                out.append(Finding("E20", f"keys/{k.name}", f"type {types[k.name]}"))
    for s in study.manifest.scalars():
        if s.source == "data" and s.name not in types:
            out.append(Finding("E30", s.path, "no such column"))
        elif s.name in types and types[s.name] != "double":
            out.append(Finding("E20", s.path, f"type {types[s.name]}"))
    has = "support_ix" in types
    if has == study.manifest.aligned:
        out.append(Finding("E28", "/", "row supports are there exactly if the study isn't aligned"))
    payload = dict(study.slot_values.dtypes)
    if payload.get("values") != "array<double>":
        out.append(Finding("E20", "slot_values", f"values are {payload.get('values')}"))
    return out


def structural_findings(study: Study) -> list[Finding]:
    return [f for f in [*manifest_findings(study.manifest), *schema_findings(study)] if f.rule in STRUCTURAL]


def _counted(frame: DataFrame, index: str, checks: list[tuple[str, str, str, Column]]) -> list[Finding]:
    """Count all checks (rule, path, message, condition) in one pass over ``frame``."""
    if not checks:
        return []
    counts = frame.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (*_, c) in enumerate(checks))).first()
    out = []
    for i, (rule, path, message, condition) in enumerate(checks):
        if counts[i]:
            first = [r[0] for r in frame.where(condition).select(index).orderBy(index).limit(3).collect()]
            out.append(Finding(rule, path, message, counts[i], tuple(first)))
    return out


def _from(frame: DataFrame, index: str, rule: str, path: str, message: str) -> list[Finding]:
    n = frame.count()
    if not n:
        return []
    first = [r[0] for r in frame.select(index).orderBy(index).limit(3).collect()]
    return [Finding(rule, path, message, n, tuple(first))]


def row_findings(study: Study) -> list[Finding]:
    m, checks = study.manifest, []
    types = dict(study.rows.dtypes)
    for k in m.keys:
        if k.role in UNIT_ROLES and k.name in types:
            checks.append(("W04", f"keys/{k.name}", "outside its bounds", outside_bounds(F.col(k.name), k.lower, k.upper)))
        if types.get(k.name) == "string":
            checks.append(("E26", f"keys/{k.name}", "holds a NUL", F.instr(k.name, "\0") > 0))
    for s in m.scalars():
        if s.source == "data" and s.name in types:
            checks.append(("W03", s.path, "not finite", ~finite(F.col(s.name))))
            if s.statistic == "band":
                checks.append(("W16", s.path, "negative band", F.col(s.name) < 0))
    if "support_ix" in types:
        checks.append(("E06", "row_support", "no such support", (F.col("support_ix") < 0) | (F.col("support_ix") >= len(m.supports)) | F.col("support_ix").isNull()))
    out = _counted(study.rows, "row", checks)
    n = study.rows.count()
    if n != m.n_rows:
        out.append(Finding("E16", "rows", f"{n} rows, {m.n_rows} declared"))
    out04 = {f.path for f in out if f.rule == "W04"}
    for r in bound_widths(study).where("stale").collect() if any(k.role in UNIT_ROLES for k in m.keys) and n else []:
        if f"keys/{r.key}" not in out04:
            out.append(Finding("W08", f"keys/{r.key}", f"bounds are {r.ratio:.6g} times as wide as the values"))
    for k in m.keys:
        if k.role in TABLE_ROLES and k.category and k.name in types:
            entries = study.entries(k.category)
            out += _from(unknown_categories(study.rows, k.name, entries), "row", "E10", f"keys/{k.name}", "not in its category table")
            if k.role == "group":
                out += _from(unused_categories(study.rows, k.name, entries), "id", "W07", f"keys/{k.name}", "entries that no row uses")
        if k.role == "status" and k.category:
            bad = decode_category(study.rows, k.name, study.entries(k.category), "__entry").where(F.col("__entry") != CONVERGED)
            out += _from(bad, "row", "W02", f"keys/{k.name}", "not converged")
        if k.role == "time" and k.trajectory_group in types:
            out += _from(time_violations(study.rows, k.name, k.trajectory_group), "row", "E09", f"keys/{k.name}", "time doesn't grow")
        if k.role == "split" and m.generalisation_group in types:
            leaks = study.rows.groupBy(m.generalisation_group).agg(F.count_distinct(k.name).alias("n")).where("n > 1")
            out += _from(leaks, m.generalisation_group, "W01", f"keys/{k.name}", "units in more than one part")
    if "support_ix" in types:
        used = study.rows.select("support_ix").distinct()
        names = study.spark.createDataFrame([(i, s) for i, s in enumerate(m.support_order())], "ix int, name string")
        for r in names.join(used, F.col("ix") == F.col("support_ix"), "left_anti").collect():
            out.append(Finding("W15", r.name, "no row is on it"))
    return out


def payload_findings(study: Study) -> list[Finding]:
    m, checks, out = study.manifest, [], []
    sv = study.slot_values
    for s in m.arrays():
        here = (F.col("support") == s.support) & (F.col("location") == s.location) & (F.col("slot") == s.name)
        if s.source != "data":
            checks.append(("E30", s.path, "served by a model, but there is data", here))
            continue
        place = next((x for x in m.supports if x.name == s.support), None)
        data = F.col("labels" if s.role == "label" else "values")
        if place is not None and s.components is not None:
            sites = place.n_nodes if s.location == "node" else place.n_cells
            per_site = F.size(data) / F.lit(max(1, sites))
            wrong = F.size(data) != sites * s.components
            as_components = (F.size(data) % max(1, sites) == 0) & (per_site >= 1)
            checks.append(("E31", s.path, "components differ from the data's", here & wrong & as_components))
            checks.append(("E05", s.path, "sites differ from the support's", here & wrong & ~as_components))
        if s.role in ("field", "derived"):
            checks.append(("W03", s.path, "not finite", here & F.exists(data, lambda x: ~finite(x))))
        if s.statistic == "band":
            checks.append(("W16", s.path, "negative band", here & F.exists(data, lambda x: x < 0)))
    out += _counted(sv, "instance", checks)
    stored = {(r.support, r.location, r.slot): r for r in sv.groupBy("support", "location", "slot").agg(F.count_distinct("instance").alias("n"), F.max("instance").alias("top")).collect()}
    on = None
    for s in m.arrays():
        if s.source != "data":
            continue
        got = stored.get((s.support, s.location, s.name))
        if got is None:
            if m.n_rows or s.varies == "none":
                out.append(Finding("E30", s.path, "no data"))
            continue
        group = s.varies.removeprefix("group:") if s.varies.startswith("group:") else None
        if s.varies == "none" and got.n != 1:
            out.append(Finding("E04", s.path, f"doesn't vary, but has {got.n} instances"))
        if s.varies == "row":
            want = m.n_rows
            if not m.aligned and "support_ix" in study.rows.columns:
                if on is None:
                    on = {r.support_ix: r["count"] for r in study.rows.groupBy("support_ix").count().collect()}
                want = on.get(m.support_order().index(s.support), 0) if s.support in m.support_order() else 0
            if got.n != want:
                out.append(Finding("E16", s.path, f"{got.n} instances for {want} rows"))
        if group is not None and any(k.name == group and k.category for k in m.keys):
            n = study.entries(m.key(group).category).count()
            if got.n != n:
                out.append(Finding("E34", s.path, f"{got.n} instances for {n} categories"))
    for s in m.arrays():
        if s.role == "label" and s.category and s.source == "data":
            out += _from(unknown_categories(study.long(s).withColumn("value", F.col("value").cast("int")), "value", study.entries(s.category)), "site", "E10", s.path, "not in its category table")
    return out


def cell_findings(study: Study) -> list[Finding]:
    m, out = study.manifest, []
    known = F.create_map(*(x for code, n in CELL_NODES.items() for x in (F.lit(code), F.lit(n if n is not None else -3))))
    for s in m.supports:
        if s.kind != "mesh":
            continue
        cells = study.cells.where(F.col("support") == s.name)
        need = F.try_element_at(known, F.col("cell_type").cast("int"))
        size = F.size("nodes")
        out += _counted(
            cells,
            "cell",
            [
                ("E21", f"{s.name}/cell_types", "unknown cell type", need.isNull()),
                ("E22", f"{s.name}/cells", "node count differs from the type's", F.when(need < 0, size < -need).otherwise(size != need)),
                ("E24", f"{s.name}/cells", "no such node", F.exists("nodes", lambda n: (n < 0) | (n >= s.n_nodes))),
            ],
        )
    from fieldloom.operators.supports import digest_of

    for s in m.supports:
        if s.support_id is not None and digest_of(study, s.name) != s.support_id:
            out.append(Finding("E08", s.name, "the digest differs"))
    bad = study.categories.where((F.instr("entry", "\0") > 0) | ~F.is_valid_utf8("entry"))
    out += [Finding("E26", f"categories/{r.table_name}", "not legal text", r.n) for r in bad.groupBy("table_name").agg(F.count("*").alias("n")).collect()]
    return out


def check_offsets(offsets: DataFrame, length: int) -> DataFrame:
    """Rows of raw offsets (at, offset) that break E23: not from 0, falling, or a wrong end."""
    from pyspark.sql import Window

    # neighbours inside blocks of the order; across a border, the block before gives its last offset
    held = offsets.withColumn("__block", F.floor(F.col("at") / BLOCK))
    ends = held.groupBy("__block").agg(F.max_by("offset", "at").alias("__tail"), F.max("at").alias("__end"))
    order = Window.orderBy("__block")
    edges = ends.select(F.col("__block").alias("__of"), F.lag("__tail").over(order).alias("__before"), F.when(F.lead("__block").over(order).isNull(), F.col("__end")).alias("__final"))
    inside = Window.partitionBy("__block").orderBy("at")
    met = held.withColumn("__back", F.lag("offset").over(inside)).join(edges, F.col("__block") == F.col("__of"))
    back = F.coalesce("__back", "__before")
    wrong = (back.isNull() & (F.col("offset") != 0)) | (F.col("offset") < back) | ((F.col("at") == F.col("__final")) & (F.col("offset") != length))
    return met.where(wrong).select("at", "offset")


def findings(study: Study) -> list[Finding]:
    out = manifest_findings(study.manifest)
    if any(f.rule == "E01" for f in out):
        return out
    out += schema_findings(study)
    passes: tuple[Callable[[Study], list[Finding]], ...] = (row_findings, payload_findings, cell_findings)
    for each in passes:
        try:
            out += each(study)
        except Exception as e:  # an unreadable table is a finding, and the others are still checked
            if not re.search("UNABLE_TO_INFER|PATH_NOT_FOUND|FAILED_READ|CANNOT_READ|COLUMN|FileNotFound", str(e)):
                raise
            out.append(Finding("E41", each.__name__.removesuffix("_findings"), str(e).splitlines()[0][:200]))
    return out


def validate(study: Study) -> DataFrame:
    """One row per rule and object that breaks it."""
    rows = [(f.rule, f.severity, f.path, f.count, list(f.first_three), f.message) for f in sorted(findings(study), key=lambda f: (f.rule, f.path.encode()))]
    return study.spark.createDataFrame(rows, SCHEMA)


def report_ids(found: list[Finding]) -> tuple[list[str], list[str]]:
    """Distinct ids of errors and of warnings, sorted."""
    ids = byte_order({f.rule for f in found})
    return [i for i in ids if i[0] == "E"], [i for i in ids if i[0] == "W"]


def report_text(found: list[Finding]) -> str:
    """One line per finding and a last line with the counts."""
    lines = []
    for f in found:
        places = ", ".join(map(str, f.first_three))
        more = f" and {f.count - len(f.first_three)} more" if f.count > len(f.first_three) > 0 else ""
        lines.append(f"{f.rule} {f.path}: {f.message}" + (f" ({f.count}: {places}{more})" if f.first_three else ""))
    errors = sum(f.severity == "error" for f in found)
    return "\n".join([*lines, f"{errors} error(s), {len(found) - errors} warning(s)"])


def info_lines(study: Study) -> list[str]:
    """What a study declares, from the manifest alone."""
    m = study.manifest
    out = [f"format {m.format}", f"writer {m.writer}", f"created {m.created}", f"rows {m.n_rows}", f"aligned {str(m.aligned).lower()}", f"unit of generalisation {m.generalisation_group or '-'}"]
    out += [f"key {k.name} {k.role}" + (f" [{k.units}]" if k.units else "") for k in m.key_order()]
    out += [f"support {s.name} {s.kind} {s.n_nodes} nodes {s.n_cells} cells" for s in sorted(m.supports, key=lambda s: s.name.encode())]
    out += [f"slot {s.path} {s.role} {s.statistic}" + (f" [{s.units}]" if s.units else "") for s in sorted(m.slots, key=lambda s: s.path.encode())]
    return out + [f"callable {c.id} {c.type}" for c in m.models]
