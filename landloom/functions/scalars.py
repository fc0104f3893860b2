"""Text cleaning, labels and arithmetic with defined results for the awkward inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_period(p: Column) -> Column:
    """``1984-1990`` and ``1984->1990`` both become the latter; applying it again changes nothing."""
    return F.regexp_replace(p, "->?", "->")


def mid_year(p: Column) -> Column:
    ends = F.split(normal_period(p), "->")
    return (ends[0].cast("double") + ends[1].cast("double")) / 2


def number(text: Column, default: float = 0.0) -> Column:
    """Trimmed text without line breaks, thousands commas or a percent sign as a number, else the default."""
    return F.coalesce(F.regexp_replace(F.trim(text), "[,%\n\r]", "").try_cast("double"), F.lit(default))


def whole_number(text: Column) -> Column:
    """Plain decimal text, with white space around it, as the nearest whole number (halves away from 0); else null.

    Only white space is passed over: Spark's own casts skip any control character and know no point."""
    found = F.regexp_extract(text, r"\A[\t-\r ]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))[\t-\r ]*\z", 1)
    return F.round(F.nullif(found, F.lit("")).try_cast("decimal(38,9)")).try_cast("int")


def year_in(text: Column) -> Column:
    """The first four-digit year of 1900 to 2099 that no digit touches, or null."""
    found = F.regexp_extract(text, r"(?<!\d)(19\d{2}|20\d{2})(?!\d)", 1)
    return F.nullif(found, F.lit("")).cast("int")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def angular_cost(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """(180 - angle between two directions that leave a node in degrees) / 90: 0 straight on, 2 back."""
    dot = (ax * bx + ay * by) / (F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
    return (180 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))) / 90


#: Marks of network measures in feature names.
NETWORK_MARKS = ("NACH", "Choice", "Integration", "NAIN", "_NC", "_TD", "_TL", "_MD")
#: The pattern of a feature name and its fine group, earlier ones first.
FINE_GROUPS = (
    ("^cell_", "Cell class"), ("NACH|Choice", "Syntax-NACH/Choice"), ("Integration", "Syntax-Integration"), ("NAIN", "Syntax-NAIN"), ("_NC|_TD|_TL|_MD", "Syntax-NC/TD/TL/MD"),
    ("cluster", "Functional-cluster"), ("^R.*(entropy|purity|boundary|builtup)", "Functional-morphology"), ("neighbor_diversity", "Functional-morphology"),
    ("^nb_.*_class_", "Neighborhood-ratio"), ("shannon", "Neighborhood-shannon"), ("builtup|_road", "Neighborhood-builtup/road"), ("dominant", "Neighborhood-dominant"),
)


def fine_group(name: Column) -> Column:
    """The fine group of a feature name; null for a name of none."""
    return F.coalesce(*(F.when(name.rlike(pattern), group) for pattern, group in FINE_GROUPS))


def slug(city: Column) -> Column:
    """A city's name as part of a path: without the mark of a city, spaces as low lines."""
    return F.replace(F.replace(city, F.lit("市"), F.lit("")), F.lit(" "), F.lit("_"))


def family(name: Column) -> Column:
    """The family of a feature name; earlier rules win."""
    network = F.lit(False)
    for mark in NETWORK_MARKS:
        network = network | F.contains(name, F.lit(mark))
    return F.when(F.startswith(name, F.lit("cell_")), "Cell class").when(F.startswith(name, F.lit("nb_")), "Neighborhood").when(network, "Syntax").otherwise("Functional")


def hex_rgb(color: Column) -> Column:
    at = lambda k: F.conv(F.substring(color, k, 2), 16, 10).cast("int")
    return F.struct(at(2).alias("r"), at(4).alias("g"), at(6).alias("b"))
