"""Nested dictionaries as tagged JSON.

Every value is an object with a tag ``t``, so an integer and an equal float
stay different, and a dictionary is never taken for a leaf.
"""

from __future__ import annotations

import json

import numpy as np

from fieldloom.functions.names import RESERVED
from fieldloom.sources.study import StudyError

# The array types a dictionary may hold.
_KINDS = {np.dtype("bool"): "bool", np.dtype("int32"): "int32", np.dtype("int64"): "int64", np.dtype("float64"): "float64"}


def encode(value: dict) -> str:
    """A dictionary as canonical JSON; what can't be stored is refused (E32)."""
    for taken in ("type", "repr"):
        if taken in value:
            raise StudyError("E32", f"{taken!r} is taken at the top level")
    return json.dumps(_tag(value, "value"), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def decode(text: str) -> dict:
    return _untag(json.loads(text))


def _text(value: str, where: str) -> str:
    if "\0" in value:
        raise StudyError("E32", f"{where} holds a NUL")
    return value


def _tag(value, where: str) -> dict:
    if value is None:
        return {"t": "null"}
    if isinstance(value, dict):
        for key in value:
            if not isinstance(key, str) or key.startswith(RESERVED) or not key:
                raise StudyError("E32", f"{where} has the key {key!r}")
        return {"t": "dict", "v": {_text(k, where): _tag(value[k], f"{where}.{k}") for k in sorted(value, key=str.encode)}}
    if isinstance(value, str):
        return {"t": "str", "v": _text(value, where)}
    if isinstance(value, (bool, np.bool_)):
        return {"t": "bool", "v": bool(value)}
    if isinstance(value, (int, np.int32, np.int64)):
        if not -(1 << 63) <= value < 1 << 63:
            raise StudyError("E32", f"{where} is too large an integer")
        return {"t": "i64", "v": int(value)}
    if isinstance(value, float):
        return {"t": "f64", "v": f"{value:.17e}"}
    if isinstance(value, (list, tuple)):
        return _tag_list(list(value), where)
    if isinstance(value, np.ndarray):
        return _tag_array(value, where)
    raise StudyError("E32", f"{where} is a {type(value).__name__}")


def _tag_list(value: list, where: str) -> dict:
    if not value:
        return _tag_array(np.zeros(0), where)
    if all(isinstance(v, str) for v in value):
        return {"t": "strings", "shape": [len(value)], "data": [_text(v, where) for v in value]}
    flat, kinds = [value], set()
    while flat and all(isinstance(v, list) for v in flat):
        flat = [x for v in flat for x in v]
    for v in flat:
        kinds.add("b" if isinstance(v, (bool, np.bool_)) else "i" if isinstance(v, (int, np.integer)) else "f" if isinstance(v, (float, np.floating)) else "?")
    if len(kinds) > 1 or "?" in kinds:
        raise StudyError("E32", f"{where} is a list of mixed or nested kinds")
    try:
        array = np.array(value, dtype={"b": bool, "i": np.int64, "f": np.float64}[kinds.pop()] if kinds else np.float64)
    except (ValueError, OverflowError) as e:
        raise StudyError("E32", f"{where} isn't rectangular") from e
    return _tag_array(array, where)


def _tag_array(value: np.ndarray, where: str) -> dict:
    if value.dtype not in _KINDS:
        raise StudyError("E32", f"{where} has the type {value.dtype}")
    if value.ndim == 0:
        return _tag(value.item(), where)
    kind = _KINDS[value.dtype]
    data = [f"{x:.17e}" if kind == "float64" else x for x in value.ravel().tolist()]
    return {"t": "array", "dtype": kind, "shape": list(value.shape), "data": data}


def _untag(node: dict):
    tag = node["t"]
    if tag == "dict":
        return {k: _untag(v) for k, v in node["v"].items()}
    if tag == "null":
        return None
    if tag == "f64":
        return float(node["v"])
    if tag == "strings":
        return list(node["data"])
    if tag == "array":
        data = [float(x) for x in node["data"]] if node["dtype"] == "float64" else node["data"]
        return np.array(data, dtype=node["dtype"]).reshape(node["shape"])
    return node["v"]
