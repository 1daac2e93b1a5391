"""The detector's stages, what each needs, and the order that a list of them is run in."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Stage:
    """A stage's role, the stages that must be listed and run before it, those that must be listed, and those that it uses if they are."""

    name: str
    role: str
    requires: tuple[str, ...] = ()
    expects: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()


#: The stages' names, their roles and what each needs.
STAGES = {
    s.name: s
    for s in (
        Stage("quantile_floor", "floor"),
        Stage("tail_spread", "spread"),
        Stage("histogram_floor", "floor"),
        Stage("recurring_floor", "floor"),
        Stage("mode_spread", "spread", optional=("histogram_floor", "recurring_floor")),
        Stage("move_ceiling", "ceiling"),
        Stage("in_room_gates", "room_gates"),
        Stage("arrival_bar", "arrival_bar"),
        Stage("run_score", "scorer", optional=("lone_gate_suppression",)),
        Stage("lone_gate_suppression", "suppression"),
        Stage("dwell_class", "gate_class"),
        Stage("portal_class", "gate_class", requires=("dwell_class",)),
        Stage("energy_ceiling", "gate_boundary"),
        Stage("gate_exclusion", "gate_mask"),
        Stage("energy_floor", "entry_filter"),
        Stage("motion_anchor", "entry_filter"),
        Stage("arrival", "entry_filter", requires=("move_ceiling",)),
        Stage("leading_edge", "entry_filter", expects=("run_score",)),
        Stage("retention", "retention"),
        Stage("ownership", "ownership", expects=("run_score",)),
        Stage("crossing_arming", "arming", requires=("ownership",)),
        Stage("score_hold", "hold", optional=("ownership",)),
        Stage("attributed_hold", "hold", requires=("ownership", "crossing_arming")),
        Stage("retention_hold", "hold", requires=("retention", "ownership", "crossing_arming")),
        Stage("nearest_gate_release", "release", requires=("in_room_gates", "motion_anchor")),
        Stage("changepoint_release", "release", requires=("motion_anchor",)),
    )
}

#: The preset with every mechanism but the newer five.
ALL_STAGES = tuple(n for n in STAGES if n not in ("recurring_floor", "in_room_gates", "arrival_bar", "nearest_gate_release", "changepoint_release"))


def order(names: tuple[str, ...], stages: dict[str, Stage] = STAGES) -> list[Stage]:
    """The listed stages with every stage after those that it needs or uses; ValueError names what is wrong."""
    for name in names:
        if name not in stages:
            raise ValueError(f"unknown stage {name!r}")
    if len(set(names)) < len(names):
        raise ValueError("a stage is listed twice")
    listed = [stages[n] for n in names]
    for role in ("floor", "spread"):
        if role not in {s.role for s in listed}:
            raise ValueError(f"no stage gives {role!r}")
    for s in listed:
        for other in (*s.requires, *s.expects):
            if other not in names:
                raise ValueError(f"stage {s.name!r} needs stage {other!r}")
    out, left = [], listed
    while left:
        # in passes over the list: a stage is taken once all that it is built over, of those listed, are there
        waiting = []
        for s in left:
            there = {o.name for o in out}
            (out if all(n in there or n not in names for n in (*s.requires, *s.optional)) else waiting).append(s)
        if len(waiting) == len(left):
            raise ValueError("stages need each other: " + ", ".join(s.name for s in left))
        left = waiting
    return out


def chosen(names: tuple[str, ...], role: str) -> str | None:
    """Of several stages of a role the first listed."""
    return next((n for n in names if STAGES[n].role == role), None)
