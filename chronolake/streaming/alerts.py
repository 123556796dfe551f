"""The alert loop in state: rules on probes, with the delivery of alerts fed back in a later batch.

For each server the state after a probe is settled when the next one comes: rules whose alerts were delivered keep
their new state, each other one goes back to its state before the probe and so fires again, and the count of errors
that a surge is measured from isn't moved on by a surge that nobody has heard of.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolake.streaming.ordered import ROWS, in_order

ROW = "server long, at timestamp, seq long, kind string, reachable boolean, health string, metrics boolean, queue double, queue_max double, errors double, rule string, delivered boolean"
ALERT = "server long, at timestamp, seq long, rule string, level string, state string"
DOWN, FULL, SURGE = "server_down", "queue_saturation", "error_surge"


@dataclass(frozen=True)
class Thresholds:
    queue_ratio: float = 0.8
    surge: float = 10.0
    cooldown_s: float = 1800.0


def load_state(text: str | None) -> dict:
    """A stored state; what is missing or can't be read is an empty one."""
    try:
        state = json.loads(text) if text else {}
    except ValueError:
        return {}
    if not isinstance(state, dict) or not isinstance(state.get("active", {}), dict):
        return {}
    return state


def settle(state: dict) -> dict:
    """The state with what was delivered of the last probe's alerts."""
    open_, before = state.pop("sent", None), state.pop("before", None)
    for rule, delivered in (open_ or {}).items():
        if delivered:
            continue
        state["active"].pop(rule, None)
        if rule in before.get("active", {}):
            state["active"][rule] = before["active"][rule]
        if rule == SURGE:
            state.pop("errors", None)
            if "errors" in before:
                state["errors"] = before["errors"]
    return state


def evaluate(state: dict, probe, now: float, limits: Thresholds) -> tuple[list[tuple[str, str]], dict]:
    """Alerts (rule, level) of a probe and the state if all are delivered. state: active (rule to since and last), errors."""
    before, active, alerts = state.get("active", {}), {}, []

    def rule(name: str, fires: bool, level: str, recovers: bool = True) -> None:
        entry = before.get(name)
        if fires:
            again = entry is None or now - entry.get("last", 0.0) >= limits.cooldown_s
            active[name] = {"since": now if entry is None else entry.get("since", now), "last": now if again else entry["last"]}
            if again:
                alerts.append((name, level))
        elif entry is not None and recovers:
            alerts.append((name, "recovery"))

    new = {"active": active}
    rule(DOWN, not probe.reachable or probe.health != "healthy", "critical")
    if probe.metrics:
        known = probe.queue is not None and probe.queue_max is not None
        rule(FULL, known and probe.queue_max > 0 and probe.queue / probe.queue_max >= limits.queue_ratio, "warning")
        errors = probe.errors if probe.errors is not None else 0.0
        if "errors" in state:  # the first count is what the next one is measured from
            rule(SURGE, errors - state["errors"] >= limits.surge, "warning", recovers=False)
        new["errors"] = errors
    else:
        if FULL in before:
            active[FULL] = before[FULL]
        if "errors" in state:
            new["errors"] = state["errors"]
    return alerts, new


class AlertLoop(StatefulProcessor):
    def __init__(self, limits: Thresholds):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update((json.dumps(load_state(initialState["state"].iloc[0])),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = load_state(self.state.get()[0]) if self.state.exists() else {}
        out = []
        for r in in_order(rows, ["at", "seq"], lambda f: f.astype(object).where(f.notna(), None)):
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=["server", "at", "seq", "rule", "level", "state"])
                out = []
            if r.kind == "delivery":
                if r.rule in state.get("sent", {}):
                    state["sent"][r.rule] = bool(r.delivered)
                continue
            before = settle(state)
            alerts, state = evaluate(before, r, r.at.timestamp(), self.limits)
            if alerts:
                text = json.dumps(state, sort_keys=True)
                state |= {"sent": {name: False for name, _ in alerts}, "before": before}
                out += [(key[0], r.at, r.seq, name, level, text) for name, level in alerts]
        self.state.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out, columns=["server", "at", "seq", "rule", "level", "state"])


def alert_loop(rows: DataFrame, limits: Thresholds = Thresholds(), saved: DataFrame | None = None) -> DataFrame:
    """rows: a stream of ROW rows, in order (at, seq) of a server: probes, and deliveries of the alerts of the last probe.

    ALERT rows: the alerts of each probe, with the state if all of them are delivered. An alert without a delivery counts
    as not delivered. Without metrics queue and errors keep their states. saved: server, state (text) to begin with; texts
    that can't be read are empty states.
    """
    groups: GroupedData = rows.filter(F.col("server").isNotNull()).groupBy("server")
    first = saved.groupBy("server") if saved is not None else None
    return groups.transformWithStateInPandas(AlertLoop(limits), ALERT, "Append", "None", first)
