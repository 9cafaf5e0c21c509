"""What the driver's entry adds for this subpackage."""

from __future__ import annotations

from .oracles import ORACLES
from .pipeline import ORACLE_SQL, run
from .queries import QUERIES


def registered() -> dict:
    return QUERIES | {"pipeline": run}


def oracle() -> dict[str, str]:
    return ORACLES | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
