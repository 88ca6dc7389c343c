"""A registered model that runs over pandas columns."""

from __future__ import annotations

import pandas as pd

from fieldloom.operators.models import Model, register


@register
class Ratio(Model):
    """Quantity over one plus discount."""

    type = "ratio"

    def names(self) -> list[str]:
        return ["ratio"]

    def to_dict(self) -> dict:
        return {}

    @classmethod
    def from_dict(cls, state: dict) -> Ratio:
        return cls()

    def outputs(self, keys: pd.DataFrame) -> dict[str, dict]:
        return {"ratio": {"mean": (keys["quantity"] / (1.0 + keys["discount"])).to_numpy()}}
