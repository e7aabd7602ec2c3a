"""Scene and motion summaries: articulation, rigidity, components, assets, body parts, placement scores."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Axis, attach, quantile, spread
from .sequence import first_run, longest_run, runs


def _norm(values) -> Column:
    return F.sqrt(sum((v * v for v in values), F.lit(0.0)))


def body_parts(rows: DataFrame, keys: Sequence[str], arms: dict[str, tuple[Sequence[str], str]], base: Sequence[str], yaw: str, head: Column, row: str, *,
               pos: float = 0.005, rot: float = 0.02, shift: float = 1e-3, turn: float = 0.01) -> DataFrame:
    """Body parts a motion uses and its regime. An arm counts when it leaves its first pose."""
    start = rows.where(F.col(row) == 0)
    firsts = start.select(*keys, *[F.col(c).alias(f"__0_{c}") for place, angle in arms.values() for c in (*place, angle)])
    moved = rows.join(firsts, list(keys))
    aggs = []
    for name, (place, angle) in arms.items():
        aggs += [F.max(_norm([F.col(c) - F.col(f"__0_{c}") for c in place])).alias(f"{name}_p"), F.max(F.abs(F.col(angle) - F.col(f"__0_{angle}"))).alias(f"{name}_r")]
    reach = lambda c: F.max(c) - F.min(c)
    g = moved.groupBy(*keys).agg(*aggs, F.greatest(*[reach(c) for c in base]).alias("base_p"), reach(yaw).alias("base_r"), F.bool_or(head).alias("head"))
    uses = {name: (F.col(f"{name}_p") > pos) | (F.col(f"{name}_r") > rot) for name in arms}
    drives = (F.col("base_p") > shift) | (F.col("base_r") > turn)
    parts = F.array_compact(F.array(*[F.when(u, F.lit(f"{n}_arm")) for n, u in uses.items()], F.when(F.col("head"), F.lit("head")), F.when(drives, F.lit("base"))))
    return g.select(*keys, parts.alias("parts")).withColumn("regime", regime(F.col("parts")))


def regime(parts: Column) -> Column:
    arms = F.exists(parts, lambda p: p.endswith("_arm"))
    return F.when(~F.array_contains(parts, "base"), "tabletop").when(arms, "mobile_manipulation").otherwise("navigation")


def articulation_axis(rows: DataFrame, keys: Sequence[str], row: str, vector: Sequence[str]) -> DataFrame:
    """Displacement along the direction of the largest one, per row, with what is left off that axis."""
    v = [F.col(c) for c in vector]
    best = F.max_by(F.struct(*v, _norm(v).alias("mag")), F.struct(_norm(v), -F.col(row)))
    g = rows.groupBy(*keys).agg(best.alias("k"))
    out = rows.join(g, list(keys))
    axis = [F.col(f"k.{c}") / F.col("k.mag") for c in vector]
    theta = sum((a * b for a, b in zip(v, axis)), F.lit(0.0))
    still = F.col("k.mag") < 1e-6
    off = _norm([a - theta * b for a, b in zip(v, axis)])
    return out.select(*keys, row, F.when(still, F.lit(0.0)).otherwise(theta).alias("theta"), F.when(still, F.lit(0.0)).otherwise(off).alias("off_axis"))


def hinge_fit(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Centre and radius of the circle nearest to planar points, by least squares from sums (one pass, partial sums).

    Minimises the algebraic residual: the normal equations of x^2 + y^2 = 2 a x + 2 b y + c."""
    g0 = attach(rows, keys, {"__mx": F.avg(x), "__my": F.avg(y)})
    u, v = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    s = g0.groupBy(*keys).agg(F.max("__mx").alias("mx"), F.max("__my").alias("my"), F.count(F.lit(1)).alias("n"), F.sum(u * u).alias("suu"), F.sum(v * v).alias("svv"),
                              F.sum(u * v).alias("suv"), F.sum(u * (u * u + v * v)).alias("pu"), F.sum(v * (u * u + v * v)).alias("pv"))
    det = F.col("suu") * F.col("svv") - F.col("suv") * F.col("suv")
    a = (F.col("pu") * F.col("svv") - F.col("pv") * F.col("suv")) / (2.0 * det)
    b = (F.col("pv") * F.col("suu") - F.col("pu") * F.col("suv")) / (2.0 * det)
    r = F.sqrt(a * a + b * b + (F.col("suu") + F.col("svv")) / F.col("n"))
    return s.select(*keys, (F.col("mx") + a).alias("cx"), (F.col("my") + b).alias("cy"), r.alias("radius"))


def held_rigidity(rows: DataFrame, lifted: Column, inside: Sequence[str], axis: Axis, *, least: int = 3, span: float = 0.05) -> DataFrame:
    """Median offset and spread of an object in the hand over the first run of at least ``least`` lifted, held rows
    (only the first run counts)."""
    r = first_run(runs(rows, F.when(lifted, F.lit(1)), axis), list(axis.keys)).where(F.col("stop") - F.col("start") >= least)
    hit = rows.join(r.select(*axis.keys, "start", "stop"), list(axis.keys)).where((F.col(axis.order) >= F.col("start")) & (F.col(axis.order) < F.col("stop")))
    out = hit.groupBy(*axis.keys).agg(F.count(F.lit(1)).alias("frames"), F.min("start").alias("first_frame"), *[(F.max(c) - F.min(c)).alias(f"spread_{c}") for c in inside])
    for c in inside:
        out = out.join(quantile(hit, axis.keys, F.col(c), 0.5, name=f"median_{c}", span=span), list(axis.keys))
    return out


def rigid_track(rows: DataFrame, held: Column, touching: Column, hand: Sequence[str], axis: Axis) -> DataFrame:
    """Object track of a pick: at its first place until contact, then moved with the hand through the longest held
    run, invalid elsewhere. ``hand`` columns are the hand position; ``o<c>`` the object's first place."""
    keys = list(axis.keys)
    marked = rows.withColumns({"__held": held, "__contact": held | touching})
    longest = longest_run(runs(marked, F.when(F.col("__held"), F.lit(1)), axis), keys).select(*keys, "start", "stop")
    contact = marked.where("__contact").groupBy(*keys).agg(F.min(axis.order).alias("__first"))
    start = marked.join(longest, keys).where(F.col(axis.order) == F.col("start")).select(*keys, *[F.col(c).alias(f"__s_{c}") for c in hand])
    out = marked.join(longest, keys).join(contact, keys).join(start, keys)
    row = F.col(axis.order)
    carried = (row >= F.col("start")) & (row < F.col("stop"))
    before = row < F.least(F.col("__first"), F.col("start"))
    place = {f"p{c}": F.when(carried, F.col(f"o{c}") + F.col(c) - F.col(f"__s_{c}")).when(before, F.col(f"o{c}")) for c in hand}
    return out.select(*keys, axis.order, (carried | before).alias("valid"), *[e.alias(n) for n, e in place.items()])


def crop_support(corners: DataFrame, supports: DataFrame, keys: Sequence[str], margin: float) -> DataFrame:
    """Support boxes cropped in x and y to the objects' corners plus a margin, clipped to the box itself."""
    g = corners.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("cx", "cy") for n, f in (("lo", F.min), ("hi", F.max))])
    out = supports.join(g, list(keys))
    made = []
    for c, s in (("x", "cx"), ("y", "cy")):
        lo = F.greatest(F.col(f"lo_{s}") - margin, F.col(f"o{c}") - F.col(f"h{c}"))
        hi = F.least(F.col(f"hi_{s}") + margin, F.col(f"o{c}") + F.col(f"h{c}"))
        made += [((lo + hi) / 2.0).alias(f"center_{c}"), ((hi - lo) / 2.0).alias(f"half_{c}")]
    return out.select(*supports.columns, *made)


def select_components(boxes: DataFrame, path: DataFrame, keys: Sequence[str], tracked: Column, radius: float) -> DataFrame:
    """Scene components to keep: tracked ones, and those whose box comes within ``radius`` of the path."""
    over = [F.greatest(F.abs(F.col(f"w{c}") - F.col(f"o{c}")) - F.col(f"h{c}"), F.lit(0.0)) for c in "xyz"]
    near = boxes.join(path, list(keys)).groupBy(*keys, "object").agg(F.min(_norm(over)).alias("distance"))
    out = boxes.join(near, [*keys, "object"])
    keep = tracked | (F.col("distance") <= radius)
    return out.select(*keys, "object", "distance", keep.alias("kept"), F.when(~keep, F.lit("distance")).alias("rule"))


def thin_path(points: DataFrame, keys: Sequence[str], row: str, most: int) -> DataFrame:
    """Every n-th path point so that about ``most`` remain per group (n = rows // most, at least 1)."""
    out = attach(points, keys, {"__n": F.count(F.lit(1))})
    step = F.greatest(F.floor(F.col("__n") / most), F.lit(1))
    return out.where(F.col(row) % step == 0).drop("__n")


def asset_statistics(refs: DataFrame) -> DataFrame:
    """Referenced and newly written asset bytes per episode: an asset is new where it is first referenced.

    ``refs``: episode, sha256, bytes (repeats allowed)."""
    distinct = refs.groupBy("episode", "sha256").agg(F.max("bytes").alias("bytes"))
    first = refs.groupBy("sha256").agg(F.min("episode").alias("__first"))
    out = distinct.join(first, "sha256")
    new = F.col("episode") == F.col("__first")
    return out.groupBy("episode").agg(F.count(F.lit(1)).alias("assets_referenced"), F.sum("bytes").alias("referenced_bytes"),
                                      F.count_if(new).alias("assets_new"), F.sum(F.when(new, F.col("bytes")).otherwise(F.lit(0))).alias("new_bytes"))


def size_conflicts(refs: DataFrame) -> DataFrame:
    """Digests that were recorded with more than one size: the library is corrupt there."""
    return refs.groupBy("sha256").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where(F.col("least") != F.col("most"))


def independent_counts(episodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact distinct lineage seeds, trajectories and initial states."""
    return episodes.groupBy(*by).agg(F.countDistinct("seed").alias("seeds"), F.countDistinct("trajectory").alias("trajectories"),
                                     F.countDistinct("initial_state").alias("initial_states"))


def duplicates(episodes: DataFrame) -> DataFrame:
    """The earliest episode of the same seed and trajectory, for every later one.

    The first of each (seed, digest) comes from a pre-aggregated minimum, so a digest shared by a third of all
    episodes is no hot task."""
    first = episodes.groupBy("seed", "trajectory").agg(F.min("episode").alias("__first"))
    out = episodes.join(first, ["seed", "trajectory"])
    return out.select("episode", "seed", F.when(F.col("__first") != F.col("episode"), F.col("__first")).alias("duplicate_of"))


def same_sets(built: DataFrame, recorded: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Whether two item sets per group are equal, by a tagged union (no sets gathered).

    An item is in a set or not, however often it is listed: the greatest tags say so, nothing is made distinct first."""
    both = built.select(*keys, *item, F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(
        recorded.select(*keys, *item, F.lit(False).alias("a"), F.lit(True).alias("b")))
    each = spread(both, [*keys, *item]).groupBy(*keys, *item).agg((F.bool_or("a") & F.bool_or("b")).alias("ok"))
    return each.groupBy(*keys).agg(F.bool_and("ok").alias("equal"))


def surface_area(triangles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half the summed lengths of the triangles' edge cross products; columns a*, b*, c* are the corners."""
    e1 = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    e2 = [F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz"]
    n = (e1[1] * e2[2] - e1[2] * e2[1], e1[2] * e2[0] - e1[0] * e2[2], e1[0] * e2[1] - e1[1] * e2[0])
    return triangles.groupBy(*keys).agg((0.5 * F.sum(_norm(n))).alias("area"))


def sides_by_rank(effectors: DataFrame, keys: Sequence[str], effector: str, lateral: Column) -> DataFrame:
    """Left and right of two effectors: by their hints when these are complete and differ, else the one farther to
    the left on average is left; a single effector follows its hint or is right."""
    per = effectors.groupBy(*keys, effector).agg(F.avg(lateral).alias("__lat"), F.max("side_hint").alias("__hint"))
    both = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.col(effector), F.struct(F.col("__lat"), F.col(effector))).alias("__left"),
                                  F.count("__hint").alias("__hints"), F.countDistinct("__hint").alias("__kinds"))
    out = per.join(both, list(keys))
    hinted = (F.col("__hints") == 2) & (F.col("__kinds") == 2)
    side = F.when(F.col("__n") == 1, F.coalesce("__hint", F.lit("right"))).when(hinted, F.col("__hint")) \
        .when(F.col(effector) == F.col("__left"), "left").otherwise("right")
    return out.select(*keys, effector, side.alias("side"))


def placement_scores(targets: DataFrame, keys: Sequence[str], candidates: Sequence[tuple[float, float]], best: int) -> DataFrame:
    """Hinge cost of standing at each candidate offset from every target row; the ``best`` cheapest per group.

    The candidate grid is a fixed list, so it is expanded inside the row."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(candidates)]))
    rows = targets.select(*keys, "x", "y", "z", grid.alias("c"))
    lx, ly = F.col("x") - F.col("c.dx"), F.col("y") - F.col("c.dy")
    zero = F.lit(0.0)
    far = _norm([lx + 0.01, ly - 0.2, F.col("z") - 1.166])
    cost = 10.0 * (F.greatest(far - 0.55, zero) + F.greatest(0.15 - lx, zero) + F.greatest(0.46 - F.col("z"), zero) + F.greatest(F.col("z") - 1.87, zero))
    scored = rows.groupBy(*keys, "c.candidate").agg(F.sum(cost).alias("cost"))
    ranked = scored.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("cost", "candidate"))), 1, best).alias("best"))
    return ranked.select(*keys, F.posexplode("best").alias("rank", "b")).select(*keys, F.col("rank").cast("long").alias("rank"), F.col("b.candidate").alias("candidate"), F.col("b.cost").alias("cost"))


