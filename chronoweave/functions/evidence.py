"""Expressions over single observations: decisions, labels, pointer and range states, qualities, topology of leads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the three terminals.
TERMINALS = {
    "t0": "T0", "terminal0": "T0", "leftouter": "T0", "leftend": "T0",
    "t1": "T1", "terminal1": "T1", "middle": "T1", "middletap": "T1", "center": "T1", "centre": "T1",
    "t2": "T2", "terminal2": "T2", "rightouter": "T2", "rightend": "T2",
}
# Words for switch states and for the actions that lead to them.
OPEN_STATES, CLOSED_STATES = ("open", "opened", "off", "disconnected"), ("closed", "close", "on", "connected")
OPEN_ACTIONS, CLOSE_ACTIONS = ("open", "opened", "opening"), ("close", "closed", "closing")
# Motion at the centre of each action.
MOTION = {"wiring": 0.65, "measurement": 0.25, "writing": 0.35, "cleanup": 0.75, "auxiliary": 0.5, "uncertain": 0.5}
# The terminal (of left, middle, right) that a selected range plugs into.
RANGE_TERMINAL = {("ammeter", "0.6"): 2, ("ammeter", "0.6a"): 2, ("ammeter", "3"): 3, ("ammeter", "3a"): 3, ("voltmeter", "3"): 2, ("voltmeter", "3v"): 2, ("voltmeter", "15"): 3, ("voltmeter", "15v"): 3}
CYCLE = "measurement_and_recording_cycle"


def binary(candidates: list[Column], score: Column) -> Column:
    """The first candidate that is pass or fail, else pass for a score of 1, else fail."""
    said = [F.when(c.isin("pass", "fail"), c) for c in candidates]
    return F.coalesce(*said, F.when(score == 1, "pass"), F.lit("fail"))


def token(value: Column) -> Column:
    """Lower case, trimmed, with runs of spaces and dashes as one underscore."""
    return F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_")


def terminal(value: Column) -> Column:
    """T0, T1 or T2 for a known label, whatever its spacing; null otherwise."""
    names = F.create_map(*(F.lit(x) for pair in TERMINALS.items() for x in pair))
    return F.try_element_at(names, F.replace(token(value), F.lit("_"), F.lit("")))


def terminal_set(labels: Column) -> Column:
    """Sorted terminals of an array of labels; null if it is empty or has an unknown or repeated one."""
    found = F.transform(labels, terminal)
    return F.when((F.size(found) > 0) & ~F.exists(found, lambda x: x.isNull()) & (F.size(F.array_distinct(found)) == F.size(found)), F.array_sort(found))


def cells(pair: Column) -> Column:
    """Cells in series that a pair of terminals selects: 2 for the outer ones, 1 for an outer and the middle one."""
    return F.when(pair == F.array(F.lit("T0"), F.lit("T2")), 2).when(pair.isin([F.array(F.lit("T0"), F.lit("T1")), F.array(F.lit("T1"), F.lit("T2"))]), 1)


def relocation(before: Column, after: Column) -> Column:
    """Reason code, from, to and fixed terminal of a change between two terminal sets; only two cells to one is complete."""
    done = (cells(before) == 2) & (cells(after) == 1)
    reason = F.when(done, "completed_outer_to_middle_relocation").when(before.isNull() | after.isNull(), "invalid_terminal_pair").when(F.coalesce(cells(before), F.lit(0)) != 2, "before_state_is_not_two_cells").otherwise("after_state_is_not_one_cell")
    only = lambda x: F.when(done, F.element_at(x, 1))
    return F.struct(reason.alias("reason"), only(F.array_except(before, after)).alias("moved_from"), only(F.array_except(after, before)).alias("moved_to"), only(F.array_intersect(before, after)).alias("fixed"))


def switch_state(state: Column, action: Column, completed: Column) -> Column:
    """open or closed by the state named, else by an action that isn't known to be incomplete; null otherwise."""
    s, a, done = token(F.coalesce(state, F.lit(""))), token(F.coalesce(action, F.lit(""))), F.coalesce(completed, F.lit(True))
    return F.when(s.isin(*OPEN_STATES), "open").when(s.isin(*CLOSED_STATES), "closed").when(done & a.isin(*OPEN_ACTIONS), "open").when(done & a.isin(*CLOSE_ACTIONS), "closed")


def merged_cycle(stage: Column, flags: list[Column], semantics: list[Column]) -> Column:
    """A recording stage that any flag or any semantics calls a cycle of measuring and recording."""
    said = [F.coalesce(f, F.lit(False)) for f in flags] + [F.coalesce(s == CYCLE, F.lit(False)) for s in semantics]
    return F.coalesce(stage.isin("recording_1", "recording_2"), F.lit(False)) & reduce(Column.__or__, said)


def measured(stage: Column, merged: Column, flag: Column, intervals: Column, base: Column, parts: Column) -> Column:
    """Whether a run has a measurement of its own: by stage, or in a merged cycle by flag, intervals, base actions or parts."""
    inside = F.coalesce(flag, F.lit(False)) | F.coalesce(F.size(intervals) > 0, F.lit(False)) | F.coalesce(F.array_contains(base, "measurement"), F.lit(False)) | F.coalesce(F.exists(parts, lambda p: p["action"] == "measurement"), F.lit(False))
    return F.coalesce(stage.isin("measurement_1", "measurement_2"), F.lit(False)) | (merged & inside)


def parts_of(own: Column, parts: Column, action: str) -> Column:
    """Intervals of an action: the list of its own if there is one, else the general list's; those that end after they begin."""
    good = lambda p: p["first_s"] < p["last_s"]
    return F.when(own.isNotNull(), F.filter(own, good)).otherwise(F.filter(F.coalesce(parts, F.array()), lambda p: (p["action"] == action) & good(p)))


def scale_state(zero: Column, full: Column, pointer: Column, sign: int, *, zero_off: float = 1.5, full_off: float = 1.5, pointer_off: float = 0.5, least: float = 0.05) -> Column:
    """Where a pointer stands on a scale that runs from zero to full in the direction of `sign`; null if these don't fit it."""
    sweep, ratio = sign * (full - zero), (pointer - zero) / (full - zero)
    state = (
        F.when(F.abs(pointer - zero) <= zero_off + pointer_off, "zero")
        .when(ratio < 0, "reverse")
        .when(F.abs(pointer - full) <= full_off + pointer_off, "full_scale_band")
        .when(ratio > 1, "overrange")
        .when(ratio < least, "positive_but_too_small")
        .otherwise("normal_positive")
    )
    return F.when(sweep > 0, F.struct(state.alias("state"), ratio.alias("ratio")))


def turn(start: Column, end: Column, direction: int) -> Column:
    """Degrees from start to end, between -180 and 180, counted positive in the direction (1 counter-clockwise, -1 clockwise)."""
    return direction * (F.pmod(end - start + 180, F.lit(360.0)) - 180)


def angle_class(angle: Column, confidence: Column, zero: Column, full: Column, direction: int = -1, *, near_zero: float = 0.05, near_full: float = 0.9, beyond: float = 0.05) -> Column:
    """Class of a calibrated pointer angle."""
    arc = turn(zero, full, direction)
    at = turn(zero, angle, direction) / arc
    return (
        F.when(angle.isNull(), "missing")
        .when(confidence < 0.3, "low_confidence")
        .when(zero.isNull() | full.isNull(), "uncalibrated")
        .when(F.abs(arc) < 20, "arc_too_small")
        .when(at < -near_zero, "reverse")
        .when(F.abs(at) <= near_zero, "zero")
        .when(at >= 1 + beyond, "overrange")
        .when(at >= 1, "at_full_scale")
        .when(at >= near_full, "near_full_scale")
        .otherwise("within_scale")
    )


def tick_state(raw: Column, divisions: int = 30) -> Column:
    """State and nearest tick (half up, within the scale) of a pointer position in divisions."""
    tick = F.least(F.lit(divisions), F.greatest(F.lit(0), F.floor(raw + 0.5).cast("int")))
    inside = (raw >= -0.5) & (raw <= divisions + 0.5)
    state = F.when(raw < -0.5, "reverse").when(raw > divisions + 0.5, "overrange").when(tick == 0, "zero").otherwise("normal_rightward")
    return F.struct(state.alias("state"), F.when(inside, tick).alias("tick"))


def range_fit(state: Column, raw: Column, tick: Column, range_max: Column, small: float, large: float) -> Column:
    """Whether the selected range suits a reading: the small one up to tick 27, the large one above tick 9."""
    is_ = lambda x: F.abs(range_max - x) <= 1e-6
    return (
        F.when(range_max.isNull() | raw.isNull(), "unknown")
        .when(state == "overrange", "too_low")
        .when(is_(small), F.when(raw >= 27, "too_low").when(tick > 0, "appropriate").otherwise("unknown"))
        .when(is_(large), F.when(tick <= 9, "too_high").when(tick.isNotNull(), "appropriate").otherwise("unknown"))
        .otherwise("unknown")
    )


def occupied_range(low: Column, high: Column, least: float = 0.018) -> Column:
    """low or high, the range whose port looks more occupied by `least`; ambiguous otherwise."""
    return F.when(low - high >= least, "low").when(low - high <= -least, "high").otherwise("ambiguous")


def motion_fit(action: Column, motion: Column) -> Column:
    """1 where motion is as an action's centre says, falling to 0 at a distance of 0.75."""
    centre = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in MOTION.items() for x in pair)), action), F.lit(0.5))
    return F.greatest(F.lit(0.0), 1 - F.abs(motion - centre) / 0.75)


def candidate_quality(score: Column, likeness: Column, structure: Column, pointer: Column, sharpness: Column, priority: Column) -> Column:
    """Blend of a candidate's scores; what is missing counts as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.45 * zero(score) + 0.25 * zero(likeness) + 0.15 * zero(structure) + 0.1 * zero(pointer) + 0.05 * F.least(F.lit(1.0), zero(sharpness) / 250) - 0.03 * zero(priority)


def frame_score(candidates: Column, two_faces: Column, priority: Column) -> Column:
    """The best candidate's quality, with bonuses for two distinct faces and for detected pointers."""
    best = F.coalesce(F.array_max(F.transform(candidates, lambda c: c["quality"])), F.lit(0.0))
    pointers = F.size(F.filter(F.coalesce(candidates, F.array()), lambda c: c["pointer"]))
    return best + F.when(two_faces, 0.16).otherwise(0.0) + F.least(F.lit(0.08), 0.02 * pointers) - 0.025 * priority


def range_terminal_agrees(identity: Column, label: Column, occupancy: Column) -> Column:
    """Whether the terminal that the selected range plugs into is the occupied one."""
    key = F.concat_ws("|", identity, F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", ""))
    want = F.try_element_at(F.create_map(*(F.lit(x) for (a, b), k in RANGE_TERMINAL.items() for x in (f"{a}|{b}", k))), key)
    return F.coalesce((F.size(occupancy) == 3) & (F.try_element_at(occupancy, want) == "occupied"), F.lit(False))


def direct(lead: Column) -> Column:
    """A seated lead that runs visibly and directly."""
    return (lead["seat"] == "seated") & (lead["view"] == "continuous") & (lead["path"] == "direct") & (lead["between"] == 0)


def ends(leads: Column, keep, name: str) -> Column:
    """How many different named ends the kept leads have."""
    return F.size(F.array_distinct(F.transform(F.filter(leads, lambda x: keep(x) & x[name].isNotNull()), lambda x: x[name])))


def direct_pairs(leads: Column) -> Column:
    """Two distinct direct leads from the meter to the battery, at two ends on either side."""
    keep = lambda x: direct(x) & (x["device"] == "ammeter") & (x["far"] == "battery_holder") & x["a"].isNotNull() & x["b"].isNotNull()
    return (ends(leads, keep, "a") >= 2) & (ends(leads, keep, "b") >= 2)


def loose_lead(leads: Column) -> Column:
    """A lead seated at the meter whose other end is visibly loose."""
    return F.exists(leads, lambda x: (x["device"] == "ammeter") & x["a"].isNotNull() & (x["seat"] == "seated") & (x["far"] == "loose_plug") & (x["view"] == "continuous"))


def split_claim(leads: Column) -> Column:
    """Two direct meter ends and two battery ends that no pair of direct leads joins: a claim that contradicts itself."""
    meter = ends(leads, lambda x: direct(x) & (x["device"] == "ammeter") & (x["far"] == "battery_holder"), "a")
    return ~direct_pairs(leads) & (meter >= 2) & (ends(leads, lambda x: x["seat"] == "seated", "b") >= 2)


def occluded_pair(leads: Column) -> Column:
    """Both ends of two leads seen, the way between hidden, and none through another component."""
    seated = lambda x: x["seat"] == "seated"
    return F.forall(leads, lambda x: ~seated(x) | ((x["path"] != "via_component") & (x["between"] == 0))) & (ends(leads, seated, "a") >= 2) & (ends(leads, seated, "b") >= 2)


def complete_series(visible: Column, core: list[str], leads: Column) -> Column:
    """All core devices seen and no topology against a single loop."""
    return (F.size(F.array_except(F.array(*map(F.lit, core)), visible)) == 0) & ~direct_pairs(leads) & ~loose_lead(leads) & ~split_claim(leads)
