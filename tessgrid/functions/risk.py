"""Required resolution of a point, and the reason for it, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessgrid.functions.spatial import level_for
from tessgrid.params import DRIVER_OF_PRIORITY, GridParams


@dataclass(frozen=True)
class RiskSettings:
    """The session settings the risk rules read, each a literal or a per-row column."""

    risk_adaptive: Column
    conf_threshold: Column
    hazard_factor: Column

    @classmethod
    def of(cls, params: GridParams, overrides: dict[str, str] | None = None) -> RiskSettings:
        """Literals from `params`; a setting named in `overrides` comes from that column where it is set."""
        named = overrides or {}

        def setting(name: str) -> Column:
            default = F.lit(getattr(params, name))
            return F.coalesce(F.col(named[name]), default) if name in named else default

        return cls(setting("risk_adaptive"), setting("conf_threshold"), setting("hazard_factor"))


def class_id(cls: Column) -> Column:
    """Class ids are one byte; anything outside is clipped, a missing one counts as unknown (0)."""
    return F.least(F.greatest(F.coalesce(cls, F.lit(0)), F.lit(0)), F.lit(255)).cast("int")


def is_hazard(cls: Column, params: GridParams) -> Column:
    return cls.isin(*params.hazard_ids)


def conf_or_default(conf: Column) -> Column:
    """A missing confidence (NaN or null) counts as full confidence."""
    return F.coalesce(F.nanvl(conf, F.lit(1.0)), F.lit(1.0))


def required_level(
    base: Column, cls: Column, conf: Column, params: GridParams, settings: RiskSettings
) -> tuple[Column, Column]:
    """Level and priority (0 range, 2 low confidence, 3 hazard) before the class-boundary rule, from the
    cell size that range alone asks for."""
    risky = settings.risk_adaptive
    low = risky & (conf < settings.conf_threshold)
    hazard = risky & is_hazard(cls, params)
    after_low = F.when(low, F.least(base, base / F.lit(params.lowconf_factor))).otherwise(base)
    target = F.when(hazard, F.least(after_low, base / settings.hazard_factor)).otherwise(after_low)
    priority = F.when(hazard, F.lit(3)).when(low, F.lit(2)).otherwise(F.lit(0))
    return level_for(target, params), priority


def refinement_key(level: Column, priority: Column) -> Column:
    """Orders by level first, then by how specific the reason is."""
    return level * F.lit(8) + priority


def boundary_key(key: Column, params: GridParams, risky: Column) -> Column:
    """Refinement key of the same point if it sits on a class boundary: one level finer up to the cap,
    with reason 1 unless a stronger one already applies."""
    priority = key.bitwiseAND(F.lit(7))
    bumped = refinement_key(key_level(key) + F.lit(1), F.greatest(priority, F.lit(1)))
    return F.when(risky & (key < F.lit(8 * params.boundary_cap)), bumped).otherwise(key)


def key_level(key: Column) -> Column:
    return F.shiftright(key, 3)


def key_driver(key: Column) -> Column:
    drivers = F.array(*[F.lit(d) for d in DRIVER_OF_PRIORITY])
    return F.element_at(drivers, key.bitwiseAND(F.lit(7)) + F.lit(1))
