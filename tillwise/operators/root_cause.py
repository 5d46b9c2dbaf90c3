"""Decomposition of a month-over-month decline by category, product and customer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row, functions as F

from tillwise.fixed_values import DRIVER_DIMENSIONS, DRIVER_METRICS, DRIVER_TEXTS, METRIC_ERROR
from tillwise.functions.numbers import percent, ratio
from tillwise.functions.periods import month_start
from tillwise.functions.text import amount, fill
from tillwise.operators.numbering import number_rows
from tillwise.operators.rollup import RollUp

SUMMARY_TYPE = (
    "status string, drop_detected boolean, metric string, total_change double, pct_change double, "
    "current_month string, previous_month string, current_value double, previous_value double"
)
CONTRIBUTOR_TYPE = (
    "dimension string, member string, previous_value double, current_value double, change double, "
    "pct_change double, abs_change double, contribution_pct double"
)
DRAG_ORDER = ["dimension", "change", "member"]


@dataclass
class RootCause:
    summary: DataFrame
    fallen: DataFrame  # members that fell, unordered
    top: DataFrame
    explanations: DataFrame

    @cached_property
    def contributors(self) -> DataFrame:
        """Members that fell with their rank in their dimension, the largest drag first; ranked when first asked for."""
        return _ranked(self.fallen).orderBy("dimension", "rank")


def analyze_root_cause(sales: DataFrame, metric: str = "Revenue") -> RootCause:
    """Who dragged the metric down from the previous to the latest month present.

    The month totals are computed at once; the frames are lazy. ``contributors`` is a long frame with
    every member that fell and its rank; it is empty unless the total fell.
    """
    if metric not in DRIVER_METRICS:
        raise ValueError(METRIC_ERROR)
    known = F.col("Date").isNotNull() & F.col(metric).isNotNull() if {"Date", metric} <= set(sales.columns) else None
    if known is None:
        return _analysis(sales, None, metric)
    lines = sales.where(known)
    return _analysis(lines, lambda latest: _line_members(lines, latest, metric), metric)


def analyze_rolled_root_cause(rolled: RollUp, metric: str = "Revenue") -> RootCause:
    """What ``analyze_root_cause`` gives for the lines, from their roll-up."""
    if metric not in DRIVER_METRICS:
        raise ValueError(METRIC_ERROR)
    if not {"Date", metric} <= set(rolled.columns):
        return _analysis(rolled.rows, None, metric)
    known = F.col("Date").isNotNull() & F.col(metric).isNotNull()
    return _analysis(rolled.days().where(known), lambda latest: _rolled_members(rolled, latest, metric), metric)


def _analysis(lines: DataFrame, members_of: Callable[[list[Row]], DataFrame | None] | None, metric: str) -> RootCause:
    """``members_of`` gives the members' values in two months; None stands for lines without dates or metric."""
    latest = _latest(lines, metric) if members_of else []
    status = "one_month" if members_of else "no_data"
    if len(latest) == 2:
        status = "decline" if latest[0]["value"] < latest[1]["value"] else "no_decline"
    summary = _summary(lines, latest, metric, status)
    members = members_of(latest) if status == "decline" else None
    if members is None:
        contributors = lines.sparkSession.createDataFrame([], CONTRIBUTOR_TYPE)
    else:
        contributors = _contributors(members, latest)
    top = _top(contributors)
    return RootCause(
        summary=summary,
        fallen=contributors,
        top=top,
        explanations=_explanations(summary, top, metric).orderBy("ord"),
    )


def _latest(lines: DataFrame, metric: str) -> list[Row]:
    """The latest two months (start, value), the newest first: two rows at most for the driver."""
    months = lines.groupBy(month_start(F.col("Date")).alias("start")).agg(F.sum(metric).alias("value"))
    return months.orderBy(F.desc("start")).limit(2).collect()


def _summary(lines: DataFrame, latest: list[Row], metric: str, status: str) -> DataFrame:
    now = latest[0] if latest else None
    before = latest[1] if len(latest) == 2 else None
    change = float(now["value"] - before["value"]) if before else 0.0
    base = float(before["value"]) if before else 0.0
    row = (
        status,
        status == "decline",
        metric,
        change,
        change / base * 100 if base else 0.0,
        f"{now['start']:%Y-%m}" if now else None,
        f"{before['start']:%Y-%m}" if before else None,
        float(now["value"]) if now else None,
        float(before["value"]) if before else None,
    )
    return lines.sparkSession.createDataFrame([row], SUMMARY_TYPE)


def _line_members(lines: DataFrame, latest: list[Row], metric: str) -> DataFrame | None:
    """(dimension, member, before, now); the two months are given as constants so that the filter reaches the scan."""
    dimensions = [name for name in DRIVER_DIMENSIONS if name in lines.columns]
    if not dimensions:
        return None
    now, before = latest
    value = F.col(metric)
    # All lines from the previous month's first day on belong to one of the two months.
    recent = lines.where(F.col("Date") >= F.lit(before["start"])).select(
        *dimensions, (F.col("Date") >= F.lit(now["start"])).alias("is_now"), value
    )
    # All dimensions from one scan and one shuffle; tasks combine their rows per member first.
    sets = recent.groupingSets([[name] for name in dimensions], *dimensions).agg(
        *[F.grouping(name).alias(f"without {name}") for name in dimensions],
        F.sum(F.when(~F.col("is_now"), value)).alias("before"),
        F.sum(F.when(F.col("is_now"), value)).alias("now"),
    )
    dimension, member = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in dimensions:
        here = F.col(f"`without {name}`") == 0
        dimension = F.when(here, F.lit(name)).otherwise(dimension)
        member = F.when(here, F.col(name).cast("string")).otherwise(member)
    return sets.select(dimension.alias("dimension"), member.alias("member"), "before", "now")


def _rolled_members(rolled: RollUp, latest: list[Row], metric: str) -> DataFrame | None:
    """What ``_line_members`` gives, from sums per month and member."""
    if not set(DRIVER_DIMENSIONS) & set(rolled.columns):
        return None
    now, before = latest
    is_now = F.col("Date") >= F.lit(now["start"])
    recent = rolled.members().where((F.col("Date") >= F.lit(before["start"])) & F.col(metric).isNotNull())
    return recent.groupBy("dimension", "member").agg(
        F.sum(F.when(~is_now, F.col(metric))).alias("before"), F.sum(F.when(is_now, F.col(metric))).alias("now")
    )


def _contributors(members: DataFrame, latest: list[Row]) -> DataFrame:
    """The members that fell between the two months."""
    now, before = latest
    zero = F.lit(0).cast(members.schema["now"].dataType)
    earlier, later = F.coalesce("before", zero), F.coalesce("now", zero)
    members = members.select(
        "dimension",
        "member",
        earlier.cast("double").alias("previous_value"),
        later.cast("double").alias("current_value"),
        (later - earlier).cast("double").alias("change"),
    )
    change, drop = F.col("change"), F.lit(float(before["value"] - now["value"]))
    return members.where(F.col("member").isNotNull() & (change < 0)).select(
        "dimension",
        "member",
        "previous_value",
        "current_value",
        "change",
        F.coalesce(percent(change, F.col("previous_value")), F.lit(0.0)).alias("pct_change"),
        F.abs(change).alias("abs_change"),
        (ratio(F.abs(change), drop) * 100).alias("contribution_pct"),
    )


def _ranked(fallen: DataFrame) -> DataFrame:
    """Add ``rank`` per dimension.

    The members are numbered in one order over all dimensions, sorted over many tasks; a dimension's ranks begin after its first number.
    So a dimension with very many members is never sorted by one task. The join has one row per dimension.
    """
    numbered = number_rows(fallen, DRAG_ORDER, "number")
    starts = numbered.groupBy("dimension").agg(F.min("number").alias("start"))
    return numbered.join(F.broadcast(starts), "dimension").select(*fallen.columns, (F.col("number") - F.col("start") + 1).alias("rank"))


def _top(contributors: DataFrame) -> DataFrame:
    """Largest drag per dimension, the first member on ties.

    An aggregate, not a window: a dimension with very many members is reduced in every task.
    """
    fields = ["change", "member", "previous_value", "current_value", "pct_change", "abs_change", "contribution_pct"]
    return (
        contributors.groupBy("dimension")
        .agg(F.min(F.struct(*fields)).alias("worst"))
        .select("dimension", "worst.member", *[f"worst.{name}" for name in fields if name != "member"])
    )


def _explanations(summary: DataFrame, top: DataFrame, metric: str) -> DataFrame:
    """(ord, explanation): a headline, then one sentence per dimension."""
    texts = DRIVER_TEXTS
    headline = (
        F.when(F.col("status") == "no_data", F.lit(texts["no_data"]))
        .when(F.col("status") == "one_month", F.lit(texts["one_month"]))
        .when(
            F.col("status") == "no_decline",
            fill(
                texts["no_decline"],
                metric=F.lit(metric),
                pct=amount(F.col("pct_change"), 1),
                previous=F.col("previous_month"),
                current=F.col("current_month"),
                change=amount(F.col("total_change")),
            ),
        )
        .otherwise(
            fill(
                texts["decline"],
                metric=F.lit(metric),
                pct=amount(F.abs("pct_change"), 1),
                drop=amount(F.abs("total_change")),
                previous=F.col("previous_month"),
                before=amount(F.col("previous_value")),
                current=F.col("current_month"),
                now=amount(F.col("current_value")),
            )
        )
    )
    is_customer = F.col("dimension") == "Customer_ID"
    shown = F.when(is_customer, F.concat(F.lit("Customer '"), F.col("member"), F.lit("'"))).otherwise(F.col("member"))
    place = F.array_position(F.array(*[F.lit(name) for name in DRIVER_DIMENSIONS]), F.col("dimension"))
    sentences = top.select(
        place.cast("int").alias("ord"),
        fill(
            texts["dimension"],
            dimension=F.col("dimension"),
            member=shown,
            metric=F.lit(metric),
            before=amount(F.col("previous_value")),
            now=amount(F.col("current_value")),
            pct=amount(F.abs("pct_change"), 1),
            share=amount(F.col("contribution_pct"), 1),
        ).alias("explanation"),
    )
    return summary.select(F.lit(0).alias("ord"), headline.alias("explanation")).unionByName(sentences)
