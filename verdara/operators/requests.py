"""What an analysis request may ask for: limits, violations as codes, and the reader's words for them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.functions import formatting
from verdara.functions.geo import bbox_area_km2, bbox_problem


@dataclass(frozen=True)
class Limits:
    """The published defaults. Demonstration mode takes the lesser of two ceilings."""

    min_start: date = date(2015, 7, 1)
    max_span_days: int = 3660
    demo_max_span_days: int = 3660
    max_scenes: int = 12
    demo_max_scenes: int = 8
    default_scenes: int = 6
    max_cloud_pct: float = 80.0
    min_area_km2: float = 0.5
    max_area_km2: float = 600.0
    demo_max_area_km2: float = 250.0
    max_custom_area_km2: float = 250.0
    allow_custom: bool = True
    demo: bool = False

    def effective(self) -> Limits:
        """The limits in force: each ceiling the least of those that apply."""
        lesser = lambda a, b: min(a, b) if self.demo else a
        custom = min(self.max_custom_area_km2, self.max_area_km2)
        return Limits(**vars(self) | {"max_span_days": lesser(self.max_span_days, self.demo_max_span_days), "max_scenes": lesser(self.max_scenes, self.demo_max_scenes), "max_area_km2": lesser(self.max_area_km2, self.demo_max_area_km2), "max_custom_area_km2": custom})


def violations(requests: DataFrame, limits: Limits, today: date) -> DataFrame:
    """Adds area_km2, scene_limit in force and problems, the codes of all rules that a request breaks.

    requests: region_id, bbox (array of four; that of the region where one is named), start_date, end_date,
    max_cloud_cover_pct, scene_limit, strategy, target_month.
    """
    m, c = limits.effective(), F.col
    box = [F.get("bbox", F.lit(k)) for k in range(4)]
    custom = c("region_id").isNull()
    shape = bbox_problem(*box)
    area = F.when(shape.isNull(), bbox_area_km2(*box))
    span, scenes = F.datediff("end_date", "start_date"), F.coalesce("scene_limit", F.lit(m.default_scenes))
    code = lambda rule, name: F.when(rule, name)
    rules = [
        code(custom & c("bbox").isNull(), "no_area"),
        code(custom & ~F.lit(m.allow_custom), "custom_areas_disabled"),
        code(c("bbox").isNotNull(), F.concat(F.lit("bbox_"), shape)),
        code(area > F.when(custom, F.lit(m.max_custom_area_km2)).otherwise(F.lit(m.max_area_km2)), "area_above_maximum"),
        code(area < m.min_area_km2, "area_below_minimum"),
        code(c("start_date").isNull() | c("end_date").isNull(), "no_dates"),
        code(c("end_date") < c("start_date"), "end_before_start"),
        code(c("start_date") < F.lit(m.min_start), "start_before_archive"),
        code(c("start_date") > F.lit(today), "start_in_future"),
        code(span > m.max_span_days, "span_too_long"),
        code((scenes < 1) | (scenes > m.max_scenes), "scene_limit"),
        code(~F.coalesce(c("max_cloud_cover_pct"), F.lit(20.0)).between(0, m.max_cloud_pct), "cloud_limit"),
        code(~F.coalesce(c("strategy"), F.lit("temporal")).isin("temporal", "seasonal"), "strategy"),
        code(~c("target_month").between(1, 12), "target_month"),
    ]
    return requests.withColumns({"area_km2": area, "problems": F.array_compact(F.array(*rules)), "scene_limit": scenes})


def one_source(region_id: Column, bbox: Column) -> Column:
    """Whether a request names a region or a bbox, and not both."""
    return region_id.isNull() != bbox.isNull()


def date_range_message(start: Column, end: Column, limits: Limits, today: date) -> Column:
    """The first objection to a pair of dates written YYYY-MM-DD, in words; NULL if there is none."""
    form = r"^\d{4}-\d{2}-\d{2}$"
    day = lambda x: F.when(x.rlike(form), x.try_cast("date"))
    a, b = day(start), day(end)
    span, most = F.datediff(b, a), limits.effective().max_span_days
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    return (
        F.when(blank(start) | blank(end), "Choose both a start and an end date.")
        .when(a.isNull() | b.isNull(), "Dates must use the YYYY-MM-DD format.")
        .when(a > b, "The start date must be on or before the end date.")
        .when(a < F.lit(limits.min_start), f"The start date cannot be before {limits.min_start} (earliest supported observation).")
        .when(b > F.lit(today), "The end date cannot be in the future.")
        .when(span > most, F.concat(F.lit("The date range spans "), F.format_number(span, 0), F.lit(f" days, which exceeds the {most:,}-day limit.")))
    )


def area_message(area_km2: Column, custom: Column, limits: Limits) -> Column:
    """The objection to an area of interest's size, in words; NULL if there is none."""
    most = F.when(custom, F.lit(limits.max_custom_area_km2)).otherwise(F.lit(limits.max_area_km2))
    size, at_most, at_least = formatting.km2(area_km2), formatting.area_limit(most), formatting.area_limit(F.lit(limits.min_area_km2))
    drawn = F.concat(F.lit("Drawn area of "), size, F.lit(" exceeds the maximum of "), at_most, F.lit(" for custom areas. Draw a smaller box, or choose a predefined region to analyse a larger area."))
    region = F.concat(F.lit("This region covers "), size, F.lit(", above the "), at_most, F.lit(" limit for predefined regions."))
    small = F.concat(F.when(custom, "Drawn area of ").otherwise("Region area of "), size, F.lit(" is below the "), at_least, F.lit(" minimum. "), F.when(custom, "Draw a larger box.").otherwise("Choose another region."))
    return F.when(area_km2 > most, F.when(custom, drawn).otherwise(region)).when(area_km2 < limits.min_area_km2, small)
