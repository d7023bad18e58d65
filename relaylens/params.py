"""Job parameters and the fixed values the fixtures are read with."""

from __future__ import annotations

from dataclasses import dataclass

# Stand-in roles in the driver's `events` table.
# message sent = 'view', link opened = 'click', registered = 'signup',
# paid = 'purchase'; 'error' is not a funnel step.
DEFAULT_STEPS: tuple[str, ...] = ("view", "click", "signup", "purchase")
DEFAULT_HOURS: int = 72
# The JSON key of events.props that holds the campaign id.
CAMPAIGN_JSON_PATH: str = "$.k"
# Ledger directions.
INFLOW: str = "in"
OUTFLOW: str = "out"
# lineitem.l_returnflag value that marks a returned (refunded) line.
RETURN_FLAG: str = "R"


@dataclass(frozen=True)
class FunnelSpec:
    """An ordered funnel: the send step first, then the steps after it.

    ``hours`` is the conversion window, measured from the send and inclusive
    at its end.  ``split_hours`` is the length of the time slices a user's
    events are cut into before the per-user window runs (see
    ``relaylens.operators.funnel``); events within ``hours`` of a slice
    start are copied into the previous slice, so a copy factor of
    ``1 + hours / split_hours`` applies to step rows only.
    """

    steps: tuple[str, ...] = DEFAULT_STEPS
    hours: int = DEFAULT_HOURS
    split_hours: int | None = None

    def __post_init__(self):
        if len(self.steps) < 2:
            raise ValueError("a funnel needs a send step and at least one later step")
        if len(set(self.steps)) != len(self.steps):
            raise ValueError(f"funnel steps must be distinct: {self.steps}")
        if self.hours <= 0:
            raise ValueError("hours must be positive")
        if self.split_hours is not None and self.split_hours <= 0:
            raise ValueError("split_hours must be positive")

    @property
    def send(self) -> str:
        return self.steps[0]

    @property
    def later(self) -> tuple[str, ...]:
        return self.steps[1:]

    @property
    def window_us(self) -> int:
        return self.hours * 3_600_000_000

    @property
    def split_us(self) -> int:
        return (self.split_hours or 4 * self.hours) * 3_600_000_000
