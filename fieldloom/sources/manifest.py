"""What a study declares about its tables: keys, slots, supports, models."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

FORMAT = "fieldloom/1"
KEY_ROLES = {"design": None, "condition": None, "time": 1, "categorical": None, "group": None, "split": 1, "id": 1, "status": 1}
UNIT_ROLES = ("design", "condition", "time")
TABLE_ROLES = ("categorical", "group", "split", "status")
ARRAY_ROLES = {"coordinates": 1, "field": None, "label": None, "weight": 1, "normal": 1, "derived": None}
STATISTICS = ("value", "mean", "band", "std", "quantile", "draw")
SUPPORT_KINDS = ("mesh", "axis", "none")
CONVERGED = "converged"


@dataclass
class Key:
    """A column of ``rows`` that locates the row."""

    name: str
    role: str
    units: str | None = None
    category: str | None = None
    lower: float | None = None
    upper: float | None = None
    trajectory_group: str | None = None
    parent: str | None = None


@dataclass
class Slot:
    """A scalar column of ``rows`` (location ``row``) or an array on a support."""

    name: str
    location: str  # row, node or cell
    support: str | None = None
    role: str = "field"
    units: str | None = None
    varies: str = "row"
    components: int | None = 1
    statistic: str = "value"
    of: str | None = None
    level: float | None = None
    method: str | None = None
    quantile: float | None = None
    source: str = "data"
    output: str | None = None
    derived_from: str | None = None
    recipe: str | None = None
    reference: str | None = None
    category: str | None = None
    recomputed: bool | None = None

    @property
    def path(self) -> str:
        return f"scalars/{self.name}" if self.location == "row" else f"{self.support}/{self.location}_arrays/{self.name}"


@dataclass
class Support:
    name: str
    kind: str
    n_nodes: int = 0
    n_cells: int = 0
    support_id: str | None = None


@dataclass
class Model:
    """A registered callable's stored form."""

    id: str
    type: str | None
    dict: str | None = None  # tagged JSON
    repr: str | None = None


@dataclass
class Manifest:
    format: str | None = FORMAT
    writer: str | None = "fieldloom"
    created: str | None = None
    aligned: bool = True
    generalisation_group: str | None = None
    n_rows: int = 0
    keys: list[Key] = field(default_factory=list)
    slots: list[Slot] = field(default_factory=list)
    supports: list[Support] = field(default_factory=list)
    models: list[Model] = field(default_factory=list)
    notes: dict[str, str] = field(default_factory=dict)
    private: dict[str, str] = field(default_factory=dict)  # opaque, base64
    extra: dict[str, str] = field(default_factory=dict)  # attributes that aren't known

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n"

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        known = set(Manifest.__dataclass_fields__)
        extra = raw.get("extra", {}) | {k: str(v) for k, v in raw.items() if k not in known}
        made = {k: v for k, v in raw.items() if k in known}
        for name, kind in (("keys", Key), ("slots", Slot), ("supports", Support), ("models", Model)):
            made[name] = [kind(**x) for x in raw.get(name, [])]
        return Manifest(**made | {"extra": extra})

    # lookups

    def key(self, name: str) -> Key:
        for k in self.keys:
            if k.name == name:
                return k
        raise KeyError(f"no key {name!r}")

    def keys_of(self, role: str) -> list[Key]:
        return [k for k in self.key_order() if k.role == role]

    def key_order(self) -> list[Key]:
        """Keys in the order of their names' UTF-8 bytes."""
        return sorted(self.keys, key=lambda k: k.name.encode())

    def support(self, name: str) -> Support:
        for s in self.supports:
            if s.name == name:
                return s
        raise KeyError(f"no support {name!r}")

    def support_order(self) -> list[str]:
        return sorted((s.name for s in self.supports), key=str.encode)

    def scalars(self) -> list[Slot]:
        return [s for s in self.slots if s.location == "row"]

    def arrays(self) -> list[Slot]:
        return [s for s in self.slots if s.location != "row"]

    def find(self, path: str, support: str | None = None) -> Slot:
        """A slot by ``name``, ``support/name``, ``node_arrays/name`` or its full path."""
        parts = path.split("/")
        found = [s for s in self.slots if s.name == parts[-1] and (support is None or s.support == support)]
        if len(parts) == 3:
            found = [s for s in found if s.path == path]
        elif len(parts) == 2:
            found = [s for s in found if parts[0] in (s.support, f"{s.location}_arrays") or s.path == path]
        if not found:
            raise KeyError(f"no slot {path!r}")
        if len(found) > 1:
            raise KeyError(f"{path!r} is ambiguous: {', '.join(sorted(s.path for s in found))}")
        return found[0]

    def band_of(self, slot: Slot) -> Slot | None:
        """The stored band of a slot at the same place, if there is one."""
        same = [s for s in self.slots if s.statistic == "band" and s.of == slot.name and (s.support, s.location) == (slot.support, slot.location) and s.source == "data"]
        return same[0] if same else None
