"""Values that steer the metrics: zone, status groups, provider aliases, gift cost, clock."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from zoneinfo import ZoneInfo

# Fixed values.
BUSINESS_ZONE = "Europe/Moscow"
STATUS_GROUPS = {
    "paid": ("paid",),
    "failed": ("failed",),
    "created": ("created",),
    "cancelled": (),
}
PAYMENT_SUCCESS_WORDS = (
    "success",
    "succeeded",
    "confirmed",
    "SUCCESS",
    "SUCCEEDED",
    "CONFIRMED",
)
PROVIDER_ALIASES = {"platega_status": "platega"}
GIFT_DEFAULT_COST = Decimal("60.00")


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Settings:
    """One immutable bundle handed to every plan.

    ``clock`` returns UTC wall time; tests pin it so that audit columns are repeatable.
    """

    zone: str = BUSINESS_ZONE
    statuses: Mapping[str, Iterable[str]] = field(default_factory=lambda: dict(STATUS_GROUPS))
    provider_aliases: Mapping[str, str] = field(default_factory=lambda: dict(PROVIDER_ALIASES))
    gift_default_cost: Decimal = GIFT_DEFAULT_COST
    clock: Callable[[], dt.datetime] = _utc_now

    def __post_init__(self) -> None:
        cost = max(Decimal(str(self.gift_default_cost)), Decimal(0))
        object.__setattr__(self, "gift_default_cost", cost.quantize(Decimal("0.01")))

    def status_group(self, name: str) -> list[str]:
        """Configured statuses without blanks; the group's own name when nothing is left."""
        listed = self.statuses.get(name) or ()
        kept = [str(s) for s in listed if s is not None and str(s).strip()]
        return kept or [name]

    @property
    def paid(self) -> list[str]:
        return self.status_group("paid")

    @property
    def failed(self) -> list[str]:
        return self.status_group("failed")

    @property
    def payment_success(self) -> list[str]:
        listed = self.statuses.get("paid") or ()
        kept = [str(s) for s in listed if s is not None and str(s).strip()]
        return [*kept, *PAYMENT_SUCCESS_WORDS]

    def now(self) -> dt.datetime:
        return self.clock()

    def today(self) -> dt.date:
        """Current calendar day in the business zone."""
        return self.now().replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(self.zone)).date()
