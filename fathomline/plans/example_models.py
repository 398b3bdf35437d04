"""Code models that registered queries check with; workers import them by name."""

from __future__ import annotations

import pydantic


class Move(pydantic.BaseModel):
    """A change and its direction, which must agree."""

    direction: str
    delta: float

    @pydantic.model_validator(mode="after")
    def agrees(self) -> Move:
        if (self.direction == "up") != (self.delta >= 0):
            raise ValueError("direction and delta disagree")
        return self


class Shipment(pydantic.BaseModel):
    """A line of an order, shipped no sooner than it was ordered."""

    l_shipdate: str
    o_orderdate: str

    @pydantic.model_validator(mode="after")
    def in_order(self) -> Shipment:
        if self.l_shipdate < self.o_orderdate:
            raise ValueError("shipped before it was ordered")
        return self
