"""Scalar scoring expressions of the memory query, as Spark Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SECONDS_PER_WEEK

# smallest vector distance used for 1/distance (an exact match would give infinity)
MIN_DISTANCE = 1e-9


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dscore(distance) -> Column:
    """Inverse vector distance, guarded against zero."""
    return F.lit(1.0) / F.greatest(_col(distance).cast("double"), F.lit(MIN_DISTANCE))


def turn_decay(decay, n) -> Column:
    """``decay ** n`` (``0 ** 0 = 1``: with decay 0 only query 0 counts)."""
    return F.pow(_col(decay).cast("double"), _col(n).cast("double"))


def length_factor(length) -> Column:
    """``log2(len)/2 + 0.5``; empty content counts as length 1."""
    return F.log2(F.greatest(_col(length).cast("double"), F.lit(1.0))) / 2.0 + 0.5


def temporal_decay(rate, ts, as_of) -> Column:
    """``exp(-rate * age / one week)``, age in seconds relative to ``as_of``."""
    return F.exp(-_col(rate).cast("double") * (_col(as_of) - _col(ts)).cast("double") / float(SECONDS_PER_WEEK))


def memory_score(best_sim, distance, weight, length, decay_rate, ts, as_of) -> Column:
    """best decayed similarity x distance factor x weight x length factor x time decay."""
    return (_col(best_sim) * (dscore(distance) / 2.0 + 0.5) * _col(weight)
            * length_factor(length) * temporal_decay(decay_rate, ts, as_of))


def derive_speaker(role="role", user_id="user_id", persona_id="persona_id") -> Column:
    return F.when(_col(role) == "user", _col(user_id)).otherwise(_col(persona_id))


def derive_date(ts, time_zone: str = "UTC") -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session zone.

    ``time_zone`` is the session zone the instant is rendered in; shifting by it
    makes the printed wall clock the UTC one.
    """
    instant = F.timestamp_seconds(_col(ts))
    if time_zone not in ("UTC", "Etc/UTC", "Z", "GMT", "+00:00"):
        instant = F.to_utc_timestamp(instant, time_zone)
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss")
