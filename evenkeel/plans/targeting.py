"""How many partitions, of how many rows."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.arithmetic import div_ceil, mb_to_bytes, rows_per_partition


@dataclass(frozen=True)
class Target:
    partitions: int
    target_rows: int
    required_by_size: int
    satisfied: bool
    reason: str | None


def target(rows: int, width: int | None, size_mb: int, least: int, most: int) -> Target:
    if width is None:
        return Target(most, rows_per_partition(rows, most), most, False, "estimated_row_width_unavailable")
    size = mb_to_bytes(size_mb)
    required = max(1, div_ceil(rows * width, size))
    n = min(max(required, least), most)
    per = max(1, min(div_ceil(rows, n), max(1, size // width)))
    ok = required <= most
    return Target(n, per, required, ok, None if ok else "required_partitions_exceed_max_partitions")
