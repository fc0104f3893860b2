"""Focal windows over cells.

A box window is separable: a range frame along each row, then one along each column, two shuffles for all classes and
radii together instead of a range join.  Sums stay integers until the last step, so that ties are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import grid_components


def box(cells: DataFrame, columns: Sequence[str], radii: Sequence[int], group: Sequence[str] = ("year",), how=F.sum) -> DataFrame:
    """``{column}_{k}`` for each radius k: the aggregate over the (2k+1) x (2k+1) box; what is off the grid adds nothing."""
    rows, cols = [*group, "r"], [*group, "c"]
    first = {f"{x}_{k}": how(x).over(Window.partitionBy(*rows).orderBy("c").rangeBetween(-k, k)) for k in radii for x in columns}
    across = cells.withColumns(first)
    second = {f"{x}_{k}": how(f"{x}_{k}").over(Window.partitionBy(*cols).orderBy("r").rangeBetween(-k, k)) for k in radii for x in columns}
    return across.withColumns(second)


def entropy(parts: Sequence[Column]) -> Column:
    """Shannon entropy of the normalised parts, with the small constants of the definition."""
    total = sum(parts[1:], parts[0]) + F.lit(1e-9)
    return -sum((p / total * F.ln(p / total + F.lit(1e-9)) for p in parts[1:]), parts[0] / total * F.ln(parts[0] / total + F.lit(1e-9)))


def top_two(parts: Sequence[Column]) -> tuple[Column, Column, Column]:
    """(first position of the largest, largest, second largest)."""
    values = F.array(*parts)
    ordered = F.sort_array(values, asc=False)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int"), ordered[0], ordered[1]


def neighbourhood(cells: DataFrame, radii: Sequence[int], group: Sequence[str] = ("year",), classes: int = 7) -> DataFrame:
    """Per radius: share of each class, built-up share, road share, entropy and the dominant class."""
    names = [f"c{k}" for k in range(classes)]
    hot = cells.select(*group, "r", "c", *((F.col("lu") == k).cast("int").alias(n) for k, n in enumerate(names)))
    summed = box(hot, names, radii, group)
    out: dict[str, Column] = {}
    for k in radii:
        area = float((2 * k + 1) ** 2)
        shares = [F.col(f"{n}_{k}").cast("double") / area for n in names]
        counts = [F.col(f"{n}_{k}") for n in names]
        out |= {f"ratio_{n}_{k}": s for n, s in zip(names, shares, strict=True)}
        out |= {f"built_{k}": (counts[1] + counts[2] + counts[3] + counts[4]).cast("double") / area, f"road_{k}": shares[5], f"entropy_{k}": entropy(shares), f"dominant_{k}": top_two(counts)[0]}
    return summed.select(*group, "r", "c", *(v.alias(n) for n, v in out.items()))


def functional(cells: DataFrame, radii: Sequence[int], rows: int, cols: int, group: str = "year", classes: int = 7) -> DataFrame:
    """Per radius entropy, purity (largest less second share), built-up share and boundary (one less the largest share);
    then the log of one more than the size of the cell's cluster of its class, and its neighbours of another class."""
    names = [f"c{k}" for k in range(classes)]
    hot = cells.select(group, "r", "c", *((F.col("lu") == k).cast("int").alias(n) for k, n in enumerate(names)))
    summed = box(hot, names, radii, (group,))
    out: dict[str, Column] = {}
    for k in radii:
        area = float((2 * k + 1) ** 2)
        counts = [F.col(f"{n}_{k}") for n in names]
        _, most, next_ = top_two(counts)
        out |= {
            f"entropy_{k}": entropy([x.cast("double") / area for x in counts]),
            f"purity_{k}": (most - next_).cast("double") / area,
            f"built_{k}": (counts[1] + counts[2] + counts[3] + counts[4]).cast("double") / area,
            f"boundary_{k}": 1 - most.cast("double") / area,
        }
    windows = summed.select(group, "r", "c", *(v.alias(n) for n, v in out.items()))
    key = (F.col(group).cast("long") * classes + F.col("lu")).alias("kind")  # a class of a group is a mask of its own
    labelled = grid_components(cells.select(key, "r", "c"), rows, cols, group="kind")
    sizes = labelled.groupBy("kind", "comp").agg(F.count("*").alias("n"))
    clusters = labelled.join(sizes, ["kind", "comp"]).select(F.expr(f"kind div {classes}").cast(cells.schema[group].dataType).alias(group), "r", "c", F.log1p("n").alias("cluster_size_log"))
    other = differing_neighbours(cells, rows, cols, (group,)).drop("distinct_classes")
    return windows.join(clusters, [group, "r", "c"]).join(other, [group, "r", "c"])


def differing_neighbours(cells: DataFrame, rows: int, cols: int, group: Sequence[str] = ("year",)) -> DataFrame:
    """Of the eight neighbours (edges repeat), how many have another class, and how many classes they have."""
    steps = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    asked = cells.withColumn("s", F.explode(steps)).select(
        *group, F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("lu").alias("own"),
        F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.col("r") + F.col("s.dr"))).alias("r"),
        F.greatest(F.lit(0), F.least(F.lit(cols - 1), F.col("c") + F.col("s.dc"))).alias("c"),
    )
    met = asked.join(cells, [*group, "r", "c"])
    out = met.groupBy(*group, "r0", "c0").agg(F.count_if(F.col("lu") != F.col("own")).cast("int").alias("diversity"), F.count_distinct("lu").cast("int").alias("distinct_classes"))
    return out.withColumnsRenamed({"r0": "r", "c0": "c"})


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> Mapping[int, float]:
    """Normalised weights of a truncated Gaussian by offset."""
    import math

    reach = int(truncate * sigma + 0.5)
    raw = {d: math.exp(-0.5 * d * d / (sigma * sigma)) for d in range(-reach, reach + 1)}
    total = sum(raw.values())
    return {d: w / total for d, w in raw.items()}


def diffuse(points: DataFrame, values: str | Sequence[str], rows: int, cols: int, sigma: float, group: Sequence[str] = ("year",), floor: float = 1e-9) -> DataFrame:
    """Normalised diffusion G(value) / G(presence) of sparse points with reflected edges, of one value or several in one
    pass; 0 where the weight is at most ``floor``."""
    values = [values] if isinstance(values, str) else list(values)
    kernel = gaussian_kernel(sigma)
    steps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in kernel.items()))

    def smear(df: DataFrame, axis: str, size: int) -> DataFrame:
        other = "c" if axis == "r" else "r"
        # a point is felt at p - d for each source place of the mirrored line; mirrored copies are explicit
        copies = F.explode(F.array(F.col(axis), -F.col(axis) - 1, 2 * size - 1 - F.col(axis))).alias("q")
        spread = df.select(*group, other, copies, *values, "presence").select("*", F.explode(steps).alias("s"))
        at = spread.withColumn(axis, F.col("q") + F.col("s.d")).where(F.col(axis).between(0, size - 1))
        return at.groupBy(*group, "r", "c").agg(*(F.sum(F.col(v) * F.col("s.w")).alias(v) for v in [*values, "presence"]))

    start = points.select(*group, "r", "c", *(F.col(v).cast("double").alias(v) for v in values), F.lit(1.0).alias("presence"))
    out = smear(smear(start, "r", rows), "c", cols)
    return out.select(*group, "r", "c", *(F.when(F.col("presence") > floor, F.col(v) / F.col("presence")).otherwise(0.0).alias(v) for v in values))
