"""Column functions with pinned semantics: rounding, phases, ranges, export helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phase labels in class order; training data says Fertility where people are told Ovulatory.
PHASES = ("Menstrual", "Follicular", "Fertility", "Luteal")
PUBLIC_NAME = {"Fertility": "Ovulatory"}

# Reference ranges (low, high) per analyte and phase, in the analyte's unit.
PHASE_RANGES = {
    "LH": {"Menstrual": (2.0, 12.0), "Follicular": (2.0, 12.0), "Ovulatory": (20.0, 90.0), "Luteal": (1.0, 12.0)},
    "FSH": {"Menstrual": (3.0, 12.0), "Follicular": (3.0, 12.0), "Ovulatory": (4.0, 20.0), "Luteal": (1.0, 8.0)},
    "Estradiol": {"Menstrual": (20.0, 80.0), "Follicular": (40.0, 200.0), "Ovulatory": (150.0, 400.0), "Luteal": (80.0, 250.0)},
    "Progesterone": {"Menstrual": (0.1, 0.7), "Follicular": (0.1, 1.5), "Ovulatory": (0.5, 3.0), "Luteal": (3.0, 25.0)},
}
# Reference ranges that don't depend on the phase.
GLOBAL_RANGES = {
    "AMH": (1.0, 4.0), "Testosterone": (15.0, 70.0), "DHEA_S": (60.0, 380.0), "Prolactin": (4.0, 23.0),
    "TSH": (0.45, 4.5), "FreeT4": (0.82, 1.77), "Cortisol": (6.0, 23.0),
}


def half_up(x: Column, digits: int) -> Column:
    """Round half away from zero by plain double arithmetic, so that other engines give the same bits."""
    k = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(k) + F.lit(0.5)) / F.lit(k) + F.lit(0.0)


def guarded_ratio(over: Column, under: Column) -> Column:
    """over / under, null where under is 0 or null."""
    return over / F.nullif(under, F.lit(0.0))


def bmi(height_cm: Column, weight_kg: Column) -> Column:
    return F.when(height_cm > 0, weight_kg / F.pow(height_cm / 100.0, F.lit(2.0)))


def cycle_day(date: Column, start: Column, length: Column) -> Column:
    """1-based day of the cycle, also for dates before ``start``."""
    return F.pmod(F.datediff(date, start), length) + 1


def cycle_day_from_anchor(anchor_day: Column, date: Column, anchor: Column, length: Column) -> Column:
    """Cycle day of ``date``, given that ``anchor`` was day ``anchor_day``."""
    return F.pmod(anchor_day + F.datediff(date, anchor) - 1, length) + 1


def phase_of(day: Column, length: Column, luteal: Column) -> Column:
    """Phase by rule: days 1-5, up to two days before ovulation, three days about it, the rest."""
    ovulation = length - luteal
    return (
        F.when(day <= 5, "Menstrual").when(day < ovulation - 1, "Follicular").when(day <= ovulation + 1, "Ovulatory").otherwise("Luteal")
    )


def training_label(phase: Column) -> Column:
    return F.when(phase == "Ovulatory", "Fertility").otherwise(phase)


def public_label(phase: Column) -> Column:
    return F.when(phase == "Fertility", "Ovulatory").otherwise(phase)


def class_index(phase: Column) -> Column:
    """0..3 in class order; null for other labels."""
    out = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(PHASES))):
        out = F.when(phase == name, F.lit(k)).otherwise(out)
    return out


def range_bound(analyte: Column, phase: Column, side: int) -> Column:
    """Low (0) or high (1) bound: of the phase, else of the analyte, else 0."""
    out = F.lit(0.0)
    for name, (bounds) in GLOBAL_RANGES.items():
        out = F.when(analyte == name, F.lit(bounds[side])).otherwise(out)
    for name, by_phase in PHASE_RANGES.items():
        for own, bounds in by_phase.items():
            out = F.when((analyte == name) & (phase == own), F.lit(bounds[side])).otherwise(out)
    return out


def flag(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "L").when(value > high, "H").otherwise("N")


def range_position(value: Column, low: Column, high: Column) -> Column:
    """Percent of the way from half the low bound to 1.2 times the high one, clamped to it."""
    bottom, top = low * 0.5, high * 1.2
    return 100.0 * (F.least(F.greatest(value, bottom), top) - bottom) / F.nullif(top - bottom, F.lit(0.0))


def sleep_minutes(raw: Column) -> Column:
    """Hours up to 24 become minutes."""
    return F.when(raw <= 24, raw * 60).otherwise(raw)


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    shifted = [F.exp(x - top) for x in logits]
    total = sum(shifted[1:], shifted[0])
    return [x / F.when(total == 0, F.lit(1.0)).otherwise(total) for x in shifted]


def json_number(document: Column, path: str) -> Column:
    """A number in strict JSON; null for other text."""
    return F.when(document.rlike(r"^\s*\{.*\}\s*$"), F.get_json_object(document, path)).try_cast("double")


def prune_map(document: Column) -> Column:
    """Entries whose value is neither null, empty nor NaN."""
    return F.map_filter(document, lambda _, v: v.isNotNull() & (v != "") & (F.lower(v) != "nan"))


def first_named(biomarkers: Column, *parts: str) -> Column:
    """Value of the first biomarker (array of name, value structs) whose name holds one of ``parts``."""
    def holds(x):
        test = F.lit(False)
        for part in parts:
            test = test | F.lower(x["name"]).contains(part)
        return test

    return F.get(F.filter(biomarkers, holds), 0)["value"]
