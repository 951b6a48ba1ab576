"""Outcome, team, pitch and count labels as Column expressions.

Missing values follow the rules the reports were built with rather than plain
SQL: a missing condition gives a missing label (``if_else``), while a missing
value is simply "not in the list" for membership tests.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineout import schema as S


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that is NULL where the condition is NULL."""
    return F.when(condition.isNull(), None).when(condition, yes).otherwise(no)


def is_in(value: Column, options: Sequence) -> Column:
    """Membership test that is false, not NULL, for a NULL value."""
    return F.coalesce(value.isin(list(options)), F.lit(False))


def hit_flag(events: Column) -> Column:
    """1 when the event text names a hit, else 0 (0 for unknown events)."""
    return F.coalesce(events.rlike("|".join(S.HIT_WORDS)), F.lit(False)).cast("int")


def hit_type(events: Column) -> Column:
    """0 out, 1 single, 2 double, 3 triple, 4 home run; the first match wins."""
    out = F
    for code, word in enumerate(S.HIT_WORDS, start=1):
        out = out.when(events.contains(word), code)
    return out.otherwise(0)


def run_value(kind: Column, weights: Mapping[int, float] = S.RUN_VALUES) -> Column:
    """Linear weight of a hit type; types without a weight are worth 0."""
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    return F.when(kind.isNotNull(), F.coalesce(F.try_element_at(table, kind), F.lit(0.0)))


def fielding_team(half: Column, away: Column, home: Column) -> Column:
    """The away side fields in the bottom half; NULL when the half is unknown."""
    return if_else(half == "bot", away, home)


def horizontal_angle(x: Column, y: Column, fn: str = "tan", digits: int | None = 1) -> Column:
    """Spray angle in degrees from hit coordinates.

    ``fn="tan"`` reproduces the published numbers, ``fn="atan"`` is the
    geometric angle. A ball level with the plate has no angle (NULL).
    """
    if fn not in ("tan", "atan"):
        raise ValueError("fn must be 'tan' or 'atan'")
    ratio = F.try_divide(x - S.PLATE_X, S.PLATE_Y - y)
    angle = getattr(F, fn)(ratio) * F.lit(180.0) / F.pi() * F.lit(S.ANGLE_FACTOR)
    return angle if digits is None else F.bround(angle, digits)


def count_label(balls: Column, strikes: Column) -> Column:
    return F.concat(balls.cast("string"), F.lit("-"), strikes.cast("string"))


def pitch_category(pitch_type: Column) -> Column:
    return F.when(is_in(pitch_type, S.FASTBALLS), "Fastballs").otherwise("Other")


def velocity_range(speed: Column) -> Column:
    """Right-closed speed bands; NULL speed has no band."""
    out = F.when(speed.isNull(), None)
    for edge, label in zip(S.VELOCITY_EDGES, S.VELOCITY_LEVELS):
        out = out.when(speed <= edge, label)
    return out.otherwise(S.VELOCITY_LEVELS[-1])


def recode(value: Column, labels: Mapping[str, str]) -> Column:
    """Replace values by their label; values without a label become NULL."""
    out = F
    for key, label in labels.items():
        out = out.when(value == key, label)
    return out.otherwise(None)


def level_rank(value: Column, levels: Sequence[str]) -> Column:
    """1-based position of a label in its display order, NULL when unknown."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), value)
    return F.when(position > 0, position).cast("int")


def percent_text(share: Column) -> Column:
    """0.334 -> '33.4%'."""
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share * 100))


def season(day: Column) -> Column:
    return F.year(day).cast("int")


def threshold(score: Column, cutoff, inclusive: bool = False) -> Column:
    """1 when the score is above the cutoff (or on it, if inclusive)."""
    return ((score >= cutoff) if inclusive else (score > cutoff)).cast("int")


def outcome_flags(fit: Column, hit: Column) -> dict[str, Column]:
    """Expected and unexpected outs of a prediction, as 0/1 (NULL-propagating)."""
    expected, out = fit == 0, hit == 0
    return {
        "expected_outs": expected.cast("int"),
        "outs": out.cast("int"),
        "expected_outs_made": (expected & out).cast("int"),
        "unexpected_outs_made": (~expected & out).cast("int"),
    }


def correctness_labels(fit: Column, hit: Column) -> dict[str, Column]:
    """Was the prediction right, in the number and text forms the reports use."""
    return {
        "type": (hit == fit).cast("int"),
        "miss": if_else(hit != fit, "Incorrect", "Correct"),
        "hit_label": if_else(hit == 1, "Hit", "Out"),
        "miss_num": (hit == fit).cast("int"),
    }


def field_view_y(y: Column) -> Column:
    """Flip the y coordinate so the plate is at the bottom."""
    return -y
