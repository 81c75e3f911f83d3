"""A reservation service's policy, as a replay of events: leases with expiry, waiting in order, sharing, idle reclaim."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Policy:
    """``ttl``: seconds a lease lasts without renewal; ``idle``: seconds after which an untouched lease may be reclaimed while others wait;
    ``max_share``: most of a device one holder may have while others wait; ``min_grant``: the least worth granting."""

    ttl: float = 60.0
    idle: float = 30.0
    max_share: float = 1.0
    min_grant: int = 1


@dataclass
class Lease:
    holder: str
    amount: int
    renewed: float
    touched: float


@dataclass
class Device:
    """One device's leases and queue. Time only moves by events, so a replay is deterministic."""

    capacity: int
    policy: Policy
    leases: dict[str, Lease] = field(default_factory=dict)
    queue: list[tuple[str, int]] = field(default_factory=list)

    @property
    def free(self) -> int:
        return self.capacity - sum(x.amount for x in self.leases.values())

    def sweep(self, now: float) -> list[tuple[str, str, int]]:
        """Expired leases go; idle ones too, but only while somebody waits."""
        out = []
        for holder, x in list(self.leases.items()):
            reason = "expired" if now - x.renewed > self.policy.ttl else "reclaimed" if self.queue and now - x.touched > self.policy.idle else ""
            if reason:
                out.append((reason, holder, x.amount))
                del self.leases[holder]
        return out

    def _cap(self) -> int:
        return int(self.capacity * self.policy.max_share) if len(self.queue) > 1 else self.capacity

    def grant(self, now: float) -> list[tuple[str, str, int]]:
        """Serve the queue in order; the first that doesn't fit holds up those behind it."""
        out = []
        while self.queue:
            holder, want = self.queue[0]
            amount = min(want, self._cap())
            if amount > self.free or amount < self.policy.min_grant:
                break
            self.queue.pop(0)
            self.leases[holder] = Lease(holder, amount, now, now)
            out.append(("granted", holder, amount))
        return out

    def step(self, now: float, op: str, holder: str, amount: int) -> list[tuple[str, str, int]]:
        out = self.sweep(now)
        if op == "reserve":
            if amount > self.capacity:
                out.append(("refused", holder, amount))
            elif holder not in self.leases and all(h != holder for h, _ in self.queue):
                self.queue.append((holder, amount))
        elif op == "renew" and holder in self.leases:
            self.leases[holder].renewed = now
        elif op == "touch" and holder in self.leases:
            self.leases[holder].touched = self.leases[holder].renewed = now
        elif op in ("release", "cancel"):
            held = self.leases.pop(holder, None)
            self.queue = [q for q in self.queue if q[0] != holder]
            out.append(("released" if held else "cancelled", holder, held.amount if held else 0))
        return out + self.grant(now)


def replay(events: DataFrame, capacity: int, policy: Policy = Policy()) -> DataFrame:
    """What the policy did: ``device, t, outcome, holder, amount``. ``events`` has ``device, t, line, op, holder, amount``; a device's events are one ordered log.

    Each decision depends on the one before, so a device's log is read in order by one task; what is held is the device's leases and
    queue, not its history.
    """
    kind = events.schema["device"].dataType.simpleString()
    names = ["device", "t", "outcome", "holder", "amount"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, device = None, None
        for f in frames:
            out = []
            for e in f.itertuples(index=False):
                if device is None or e.device != name:
                    name, device = e.device, Device(capacity, policy)
                out += [(e.device, float(e.t), *x) for x in device.step(float(e.t), e.op, e.holder, int(e.amount))]
            yield pd.DataFrame(out, columns=names)

    in_order = events.select("device", "t", "line", "op", "holder", "amount").repartition("device").sortWithinPartitions("device", "t", "line")
    return in_order.mapInPandas(run, f"device {kind}, t double, outcome string, holder string, amount long")
