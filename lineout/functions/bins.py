"""Right-closed bins whose lowest edge is included.

Bins travel as 1-based ordinals; label text is produced last. Values outside
the edges have no bin (NULL).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def regular_edges(low: float, high: float, width: float) -> list[float]:
    steps = round((high - low) / width)
    return [low + i * width for i in range(steps + 1)]


def regular_bin(value: Column, low: float, high: float, width: float) -> Column:
    """Ordinal of the equal-width bin ``(edge, edge + width]`` holding a value."""
    guess = F.ceil((value - low) / width).cast("int")
    # One step either way if the division rounded across an edge.
    step = F.when(value > low + guess * width, 1).when(value <= low + (guess - 1) * width, -1).otherwise(0)
    return F.when(value == low, 1).when((value > low) & (value <= high), guess + step)


def break_bin(value: Column, breaks: Sequence[float]) -> Column:
    """Ordinal of the bin between consecutive, unevenly spaced breaks."""
    out = F.when((value < breaks[0]) | value.isNull() | F.isnan(value), None)
    for ordinal, upper in enumerate(breaks[1:], start=1):
        out = out.when(value <= upper, ordinal)
    return out.otherwise(None)


def _edge_text(edge: float) -> str:
    return f"{edge:.3g}"


def bin_labels(breaks: Sequence[float]) -> list[str]:
    """``[a,b]`` for the first bin, ``(b,c]`` for the others."""
    pairs = zip(breaks, breaks[1:])
    return [
        f"{'[' if i == 0 else '('}{_edge_text(lo)},{_edge_text(hi)}]"
        for i, (lo, hi) in enumerate(pairs)
    ]


def _pick(ordinal: Column, texts: Sequence[str]) -> Column:
    return F.when(ordinal.isNotNull(), F.try_element_at(F.array(*[F.lit(t) for t in texts]), ordinal))


def bin_label(ordinal: Column, breaks: Sequence[float]) -> Column:
    return _pick(ordinal, bin_labels(breaks))


def bin_bounds(ordinal: Column, breaks: Sequence[float]) -> tuple[Column, Column]:
    """Lower and upper edge of a bin."""
    edges = F.array(*[F.lit(float(b)) for b in breaks])
    known = ordinal.isNotNull()
    return (
        F.when(known, F.try_element_at(edges, ordinal)),
        F.when(known, F.try_element_at(edges, ordinal + 1)),
    )


def round_brackets(label: Column) -> Column:
    """``[0,10]`` and ``(0,10]`` both become ``(0,10)``."""
    return F.translate(label, "[]", "()")


def range_text(label: Column) -> Column:
    """``(0,10]`` becomes ``0 to 10``."""
    return F.replace(F.translate(label, "[]()", ""), F.lit(","), F.lit(" to "))
