"""Row scopes of the published indicators, by period."""

from __future__ import annotations

from moveatlas import schema as S
from moveatlas.operators.scope import Scope

Period = tuple[str, str]


def hotness_scope(ymd: Period) -> Scope:
    return Scope(ymd, S.DAYTIME_HOURS, S.VISIT_PURPOSES, S.FRI_SAT)


def bedtown_scope(ymd: Period) -> Scope:
    return Scope(ymd, S.EVENING_HOURS, S.ALL_PURPOSES, S.MON_THU)


def visit_scope(ymd: Period) -> Scope:
    """Young-visitor and young shopping indicators: all hours and weekdays."""
    return Scope(ymd, purposes=S.VISIT_PURPOSES)


def women_scope(ymd: Period) -> Scope:
    return Scope(ymd, purposes=S.VISIT_PURPOSES, iso_days=S.FRI_SAT)


def teens_scope(ymd: Period) -> Scope:
    return Scope(ymd, S.EVENING_HOURS, S.VISIT_PURPOSES, S.FRI_SAT)


def tourism_scope(ymd: Period) -> Scope:
    return Scope(ymd, purposes=(S.TOURISM,))
