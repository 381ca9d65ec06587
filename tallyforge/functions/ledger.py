"""A budget ledger of one sequence of calls: what is admitted, what is used, what remains."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

#: Resources in the order in which a completed call is held against their ceilings.
RESOURCES = ("calls", "input", "output", "total", "latency", "cost")


@dataclass(frozen=True)
class Limits:
    """Ceilings; None is no ceiling."""

    calls: int | None = None
    input: int | None = None
    output: int | None = None
    total: int | None = None
    latency: float | None = None
    cost: float | None = None


@dataclass
class Ledger:
    """Usage so far.  ``overrun`` names the resources that a completed call took beyond their ceilings."""

    limits: Limits
    calls: int = 0
    input: int = 0
    output: int = 0
    latency: float = 0.0
    cost: float = 0.0
    unknown: bool = False
    reported: bool = True
    overrun: list[str] = field(default_factory=list)

    @property
    def total(self) -> int:
        return self.input + self.output

    def _left(self, resource: str) -> float | None:
        ceiling = getattr(self.limits, resource)
        return None if ceiling is None else ceiling - getattr(self, resource)

    def admission(self, estimate: int, most_output: int | None) -> tuple[str | None, int | None]:
        """Why a call may not start (None if it may), and the output tokens that it may take (None: any).

        A call's estimated input must fit the input ceiling, leave something of the total one, and no overrun
        or unknown usage may have come before.
        """
        left = {r: self._left(r) for r in RESOURCES}
        free = None if left["total"] is None else left["total"] - estimate
        open_output = [x for x in (free, left["output"]) if x is not None]
        rules = (
            ("unknown_usage", self.unknown), ("calls", left["calls"] is not None and left["calls"] < 1), ("overrun", bool(self.overrun)),
            ("input", left["input"] is not None and estimate > left["input"]), ("total", free is not None and free <= 0),
            ("output", bool(open_output) and min(open_output) <= 0), ("latency", left["latency"] is not None and left["latency"] <= 0),
            ("cost", left["cost"] is not None and left["cost"] < 0), ("output", most_output is not None and most_output <= 0),
        )
        why = next((name for name, holds in rules if holds), None)
        caps = [x for x in (most_output, *open_output) if x is not None]
        return why, None if why or not caps else int(min(caps))

    def complete(self, tokens_in: int | None, tokens_out: int | None, latency: float, cost: float, reported: bool = True) -> list[str]:
        """Account for a call that ran, whatever it took; the resources that are now beyond their ceilings."""
        self.calls += 1
        self.input += tokens_in or 0
        self.output += tokens_out or 0
        self.latency += latency
        self.cost += cost
        self.unknown |= tokens_in is None or tokens_out is None
        self.reported &= reported and not self.unknown
        found = [r for r in RESOURCES if (left := self._left(r)) is not None and left < 0]
        self.overrun += [r for r in found if r not in self.overrun]
        return found

    def remaining(self) -> dict[str, float | None]:
        """What is left of each ceiling, never below 0; None without a ceiling."""
        return {r: None if (left := self._left(r)) is None else max(0, left) for r in RESOURCES}

    def may_call(self) -> bool:
        left = [self._left(r) for r in ("calls", "total", "output")]
        return not self.unknown and not self.overrun and all(x is None or x > 0 for x in left)

    def summary(self) -> dict:
        """Totals; ``exact_total`` only if every call's usage was reported."""
        over = self._left("total")
        return {
            "attempts": self.calls, "used_input": self.input, "used_output": self.output, "used_latency": self.latency, "used_cost": self.cost,
            "exact_total": self.total if self.reported else None, "overrun": self.overrun, "overrun_tokens": int(max(0, -over)) if over is not None and self.overrun else 0,
            "unknown_usage": self.unknown, "may_call": self.may_call(), **{f"left_{r}": x for r, x in self.remaining().items()},
        }


def run(limits: Limits, calls: list[dict]) -> dict:
    """Fold calls (estimate, most_output, input, output, latency, cost, reported) in order into a summary with decisions.

    A rejected call consumes nothing.  A call without usage is charged nothing, and stops what follows.
    """
    ledger, decisions = Ledger(limits), []
    for c in calls:
        why, cap = ledger.admission(c["estimate"], c["most_output"])
        found = [] if why else ledger.complete(c["input"], c["output"], c["latency"], c["cost"], c["reported"])
        decisions.append({"rejected": why, "cap": cap, "violations": found})
    return {**ledger.summary(), "rejected": sum(d["rejected"] is not None for d in decisions), "decisions": decisions}


def state(ledger: Ledger) -> dict:
    """What a stream keeps of a ledger between batches."""
    kept = asdict(ledger)
    kept.pop("limits")
    return kept
