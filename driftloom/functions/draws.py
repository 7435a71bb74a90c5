"""Deterministic draws: uniform numbers from a row's id, a field's path and a role.

A draw depends on nothing else, so batches and streams over the same ids agree, and
so do replays, partitionings and engines.  Draws of different paths or roles are
independent of each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 48


@dataclass(frozen=True)
class Draws:
    """Draws over the ids in ``row_id``.

    "portable" draws are 48 bits of ``md5(seed|path|role|id)``, which any SQL engine
    can compute; "fast" ones are a 64-bit hash inside the JVM's generated code.
    """

    seed: int
    row_id: Column
    mode: str = "fast"
    #: Draws that several branches use; the planner computes them once, a layer below.
    sheet: dict[str, Column] = field(default_factory=dict)

    def shared(self, path: str, role: str = "value") -> Column:
        """A uniform draw that is computed once however often it is used."""
        name = f"__draw_{self._key(path, role)}"
        self.sheet.setdefault(name, self.uniform(path, role))
        return F.col(f"`{name.replace('`', '``')}`")

    def _key(self, path: str, role: str) -> str:
        return f"{self.seed}|{path}|{role}|"

    def uniform(self, path: str, role: str = "value") -> Column:
        """A double in [0, 1)."""
        if self.mode == "portable":
            return F.conv(F.substring(self.digest(path, role), 1, 12), 16, 10).cast("long") / F.lit(float(1 << _BITS))
        bits = F.shiftrightunsigned(F.xxhash64(self.row_id, F.lit(self._key(path, role))), 11)
        return bits / F.lit(float(1 << 53))

    def digest(self, path: str, role: str = "value") -> Column:
        """32 hexadecimal digits."""
        if self.mode == "portable":
            return F.md5(F.concat(F.lit(self._key(path, role)), self.row_id.cast("string")).cast("binary"))
        halves = [F.lower(F.lpad(F.hex(F.xxhash64(self.row_id, F.lit(self._key(path, role) + h))), 16, "0")) for h in "ab"]
        return F.concat(*halves)

    def index(self, n: int, path: str, role: str = "value") -> Column:
        """A whole number in [0, n)."""
        return F.floor(self.uniform(path, role) * F.lit(float(n))).cast("int")


def pick(draw: Column, options: list[Column], weights: tuple[int, ...] = ()) -> Column:
    """One of ``options`` by a draw in [0, 1): equally, or by ``weights``."""
    if len(options) == 1:
        return options[0]
    if not weights:
        return F.element_at(F.array(*options), F.floor(draw * F.lit(float(len(options)))).cast("int") + 1)
    total, below = float(sum(weights)), 0
    out = None
    for option, weight in zip(options[:-1], weights[:-1], strict=True):
        below += weight
        reached = draw < F.lit(below / total)
        out = F.when(reached, option) if out is None else out.when(reached, option)
    return out.otherwise(options[-1])
