"""Geometry of point groups: extremes without all pairs, principal axes in the JVM, shape."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as fn
from .graph import checkpointed
from .joins import close_points

AXES = ("x", "y", "z")
#: Cells along each side of a group's box.
SIDE = 6
#: Directions in which extreme points are looked for: axes, and diagonals of faces and of the cube.
_DIRECTIONS = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def _length(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def farthest(points: DataFrame, group: str, pos: str | None = None) -> DataFrame:
    """Points (x, y, z) -> group, farthest: the largest distance of two points of the group (of different pos, if named); 0 if
    there are no two.

    Extremes in 13 directions give a distance that is reached. A point whose farthest corner of the group's box is
    nearer goes; so do pairs of cells whose farthest corners are. What is left is compared. On a full ball or a line few
    points are left; where all lie on a sphere, cells keep all but opposite ones apart.
    """
    p = points.select(F.col(group).alias("g"), (F.col(pos) if pos else F.lit(0)).alias("at"), *AXES).dropDuplicates()
    at = F.struct(*AXES, "at")
    along = [sum((F.col(a) * k for a, k in zip(AXES, d, strict=True) if k), F.lit(0.0)) for d in _DIRECTIONS]
    ends = [e for i, a in enumerate(along) for e in (F.min_by(at, a).alias(f"a{i}"), F.max_by(at, a).alias(f"b{i}"))]
    box = p.groupBy("g").agg(*[f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))], *ends)
    meet = (lambda a, b: F.col(a) != F.col(b)) if pos else (lambda a, b: F.lit(True))
    reached = F.greatest(*[F.when(meet(f"a{i}.at", f"b{i}.at"), _length([F.col(f"a{i}.{c}") - F.col(f"b{i}.{c}") for c in AXES])).otherwise(0.0) for i in range(len(along))])
    box = checkpointed(box.select("g", *[f"{n}_{c}" for c in AXES for n in ("lo", "hi")], reached.alias("reached")))
    slack = F.col("reached") * (1 - 1e-12)
    span = _length([F.greatest(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(c)) for c in AXES])
    cell = [F.least(F.lit(SIDE - 1), F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")) * SIDE), F.lit(0))) for c in AXES]
    number = (cell[0] * SIDE + cell[1]) * SIDE + cell[2]
    kept = checkpointed(p.join(box, "g").where(span >= slack).select("g", "at", *AXES, "reached", number.cast("int").alias("cell")))
    cells = kept.groupBy("g", "cell").agg(F.first("reached").alias("reached"), *[f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    other = cells.select("g", F.col("cell").alias("cell2"), *[F.col(f"{n}_{c}").alias(f"{n}2_{c}") for c in AXES for n in ("lo", "hi")])
    apart = _length([F.greatest(F.col(f"hi_{c}") - F.col(f"lo2_{c}"), F.col(f"hi2_{c}") - F.col(f"lo_{c}")) for c in AXES])
    pairs = cells.join(other, "g").where((F.col("cell") <= F.col("cell2")) & (apart >= slack)).select("g", "cell", "cell2")
    far = kept.select("g", F.col("cell").alias("cell2"), F.col("at").alias("at2"), *[F.col(c).alias(f"{c}2") for c in AXES])
    met = pairs.join(kept.select("g", "cell", "at", *AXES), ["g", "cell"]).join(far, ["g", "cell2"]).where(meet("at", "at2"))
    best = met.groupBy("g").agg(F.max(_length([F.col(c) - F.col(f"{c}2") for c in AXES])).alias("d"))
    return box.join(best, "g", "left").select(F.col("g").alias(group), F.greatest("reached", F.coalesce("d", F.lit(0.0))).alias("farthest"))


def clashes(points: DataFrame, group: str, pos: str = "pos", gap: int = 2, near: float = 3.0) -> DataFrame:
    """group, clashes: pairs of points over `gap` places apart that are closer than `near`; points meet within cells of
    that size. Groups without any are absent."""
    found = close_points(points.select(group, F.col(pos).alias("_i"), *AXES).withColumn("_gap", F.col("_i")), "_i", near, [group], gap="_gap", least_gap=gap)
    return found.where(F.col("distance") < near).groupBy(group).agg(F.count("*").alias("clashes"))


#: Points of a group whose pairs are all compared where they meet: more cost less by boxes and cells.
FEW = 64


def pair_extremes(points: DataFrame, group: str, pos: str = "pos", gap: int = 2, near: float = 3.0) -> DataFrame:
    """The largest distance of two points at different places of each group that has such, and its clashes.

    Groups of up to FEW points are compared pair by pair in one join, which shuffles their points and nothing else; boxes, extremes
    and the cells around points would be many times these. Larger groups, if there are any, go by farthest() and clashes().
    """
    p = points.select(F.col(group).alias("g"), F.col(pos).alias("at"), *AXES)
    large = checkpointed(p.groupBy("g").count().where(F.col("count") > FEW).select("g"))
    some = not large.isEmpty()
    few = p.join(large, "g", "left_anti") if some else p
    other = few.select("g", F.col("at").alias("at2"), *[F.col(c).alias(f"{c}2") for c in AXES])
    met = few.join(other.hint("shuffle_merge"), "g").where(F.col("at") < F.col("at2"))
    met = met.select("g", (F.col("at2") - F.col("at")).alias("gap"), _length([F.col(c) - F.col(f"{c}2") for c in AXES]).alias("d"))
    got = met.groupBy("g").agg(F.max("d").alias("farthest"), F.count_if((F.col("gap") > gap) & (F.col("d") < near)).alias("clashes"))
    if some:
        big = p.join(large, "g", "left_semi")
        many = big.groupBy("g").agg(F.min("at").alias("_a"), F.max("at").alias("_b")).where("_a < _b").select("g")
        more = farthest(big, "g", "at").join(many, "g").join(clashes(big, "g", "at", gap, near), "g", "left")
        got = got.unionByName(more.select("g", "farthest", F.coalesce("clashes", F.lit(0)).alias("clashes")))
    return got.withColumnRenamed("g", group)


def _jacobi(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column, steps: int = 30) -> Column:
    """Eigenvalues and vectors of a symmetric 3 x 3 matrix, largest first: array of (value, axis).

    Cyclic Jacobi rotations as a fold: each step turns the first two axes so that their product vanishes, and then names
    the axes anew, second, third, first; ten sweeps. An axis' largest component is positive.
    """
    one = lambda k: F.array(*[F.lit(1.0 if k == i else 0.0) for i in range(3)])
    start = F.struct(xx.alias("a"), yy.alias("b"), zz.alias("c"), xy.alias("d"), xz.alias("e"), yz.alias("f"), one(0).alias("u"), one(1).alias("v"), one(2).alias("w"))

    def turned(s: Column, _: Column) -> Column:
        # The smaller of the two angles: axes aren't swapped, so every pair comes up in each sweep.
        tau = (s["b"] - s["a"]) / (2.0 * s["d"])
        tan = F.when(tau < 0, -1.0).otherwise(1.0) / (F.abs(tau) + F.sqrt(1.0 + tau * tau))
        cos = 1.0 / F.sqrt(1.0 + tan * tan)
        r = F.when(F.abs(s["d"]) < 1e-300, F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s"))).otherwise(F.struct(cos.alias("c"), (tan * cos).alias("s")))

        def step(r: Column) -> Column:
            c, n = r["c"], r["s"]
            a = c * c * s["a"] - 2.0 * n * c * s["d"] + n * n * s["b"]
            b = n * n * s["a"] + 2.0 * n * c * s["d"] + c * c * s["b"]
            e, f = c * s["e"] - n * s["f"], n * s["e"] + c * s["f"]
            u = F.zip_with(s["u"], s["v"], lambda p, q: c * p - n * q)
            v = F.zip_with(s["u"], s["v"], lambda p, q: n * p + c * q)
            return F.struct(b.alias("a"), s["c"].alias("b"), a.alias("c"), f.alias("d"), F.lit(0.0).alias("e"), e.alias("f"), v.alias("u"), s["w"].alias("v"), u.alias("w"))

        return F.transform(F.array(r), step)[0]

    def pairs(s: Column) -> Column:
        def axis(value: Column, v: Column) -> Column:
            size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
            top = F.array_max(F.transform(v, F.abs))
            sign = F.when(F.filter(v, lambda x: F.abs(x) == top)[0] < 0, -1.0).otherwise(1.0)
            return F.struct((-F.greatest(value, F.lit(0.0))).alias("value"), F.transform(v, lambda x: x * sign / size).alias("axis"))

        found = F.array_sort(F.array(axis(s["a"], s["u"]), axis(s["b"], s["v"]), axis(s["c"], s["w"])))
        return F.transform(found, lambda x: F.struct((-x["value"]).alias("value"), x["axis"].alias("axis")))

    return fn.let(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, turned), pairs)


def principal_axes(points: DataFrame, group: list[str]) -> DataFrame:
    """Points (x, y, z) -> for each group: values (variances along the axes, largest first), axes, extents, anisotropy (0 for a ball
    or one point, 1 for a line). Two aggregates: covariances, and the ends of the projections."""
    cov = [F.covar_pop(a, b).alias(f"{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    base = points.groupBy(*group).agg(*[F.avg(c).alias(f"c{c}") for c in AXES], *cov)
    base = checkpointed(base.withColumn("pairs", _jacobi(*[F.col(n) for n in ("xx", "yy", "zz", "xy", "xz", "yz")])))
    dot = [sum((F.col("pairs")[k]["axis"][i] * (F.col(c) - F.col(f"c{c}")) for i, c in enumerate(AXES)), F.lit(0.0)) for k in range(3)]
    ends = points.join(base.select(*group, "pairs", *[f"c{c}" for c in AXES]), group).groupBy(*group).agg(F.array(*[F.max(d) - F.min(d) for d in dot]).alias("extents"))
    v = [F.col("pairs")[k]["value"] for k in range(3)]
    ratio = 1.0 - 3.0 * F.try_divide(v[0] * v[1] + v[1] * v[2] + v[2] * v[0], (v[0] + v[1] + v[2]) * (v[0] + v[1] + v[2]))
    out = base.join(ends, group)
    return out.select(*group, F.array(*v).alias("values"), F.transform("pairs", lambda p: p["axis"]).alias("axes"), "extents", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0)))).alias("anisotropy"))


def geometry(points: DataFrame, group: str, pos: str = "pos", gap: int = 2, near: float = 3.0) -> DataFrame:
    """All measures of each group of points along pos: centroid, radius of gyration, end-to-end distance, largest distance,
    variances, axes and extents, anisotropy, clashes."""
    from .aggregates import geometry as middle

    got = middle(points, [group], pos).join(farthest(points, group), group).join(principal_axes(points, [group]), group)
    return got.join(clashes(points, group, pos, gap, near), group, "left").withColumn("clashes", F.coalesce("clashes", F.lit(0)))
