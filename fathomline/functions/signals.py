"""Shape signals, flags, score and labels of a row as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results must equal: constants, tag values, weights and thresholds.
GOLDEN = 1.618033988749895
GOLDEN_ANGLE = 137.50776405003785
FIBONACCI = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610]
RATIOS = [1.0] + [b / a for a, b in zip(FIBONACCI[1:-1], FIBONACCI[2:])]
WORSHIP = ["church", "cathedral", "chapel", "basilica", "religious", "monastery", "abbey", "priory", "convent", "shrine"]
GOVERNMENT = ["government", "civic", "public", "townhall", "courthouse", "city_hall"]
HISTORIC = ["castle", "manor", "tower", "ruins"]
CIVIC = ["bank", "post_office", "museum", "library"]
WEIGHTS = {
    "golden_ratio": 25.0, "fib_ratio": 15.0, "fib_dimension": 12.0, "right_angle_fraction": 12.0, "reflective_symmetry": 20.0, "rot180_symmetry": 10.0,
    "circularity": 10.0, "rotational_symmetry": 8.0, "cruciform_candidate": 6.0, "golden_angle": 8.0, "angle_108": 3.0, "angle_120": 2.0,
}
THRESHOLDS = {
    "golden_ratio_error_pct": 3.0, "fib_ratio_error_pct": 2.0, "fib_dimension_tolerance_pct": 3.0, "golden_angle_tolerance_deg": 3.0, "regular_angle_tolerance_deg": 3.0,
    "symmetry_flag_iou": 0.85, "reflective_iou_floor": 0.6, "rot180_iou_floor": 0.6, "circularity": 0.85, "cruciform_convexity": 0.97, "cruciform_vertices": 8, "cruciform_area_m2": 200.0,
}
MAX_SCORE = 100.0


def classify(tags: Column) -> Column:
    """Kind of a building from its tags (a map); the first rule that holds wins."""

    def tag(name: str) -> Column:
        return F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit(""))

    building, amenity = tag("building"), tag("amenity")
    return (
        F.when((amenity == "place_of_worship") | building.isin(WORSHIP) | (tag("religion") != ""), "worship")
        .when((tag("office") == "government") | (amenity == "townhall") | building.isin(GOVERNMENT), "government")
        .when(building.isin(CIVIC), "civic")
        .when((tag("historic") != "") | building.isin(HISTORIC) | (tag("man_made") == "tower"), "historic")
        .otherwise("other")
    )


def tag_number(tags: Column, *names: str) -> Column:
    """The first of the named tags that is a finite number of 0 or more once each m is taken out; else 0."""
    values = []
    for name in names:
        x = F.trim(F.replace(F.try_element_at(tags, F.lit(name)), F.lit("m"), F.lit(""))).try_cast("double")
        values.append(F.when((x >= 0) & (x < float("inf")), x))
    return F.coalesce(*values, F.lit(0.0))


def nearest_ratio(aspect: Column) -> Column:
    """Struct of the Fibonacci ratio nearest to aspect by percentage (the first of equals) and that percentage."""
    options = F.array(*(F.struct((F.abs(aspect - r) / r * 100).alias("err"), F.lit(i).alias("i"), F.lit(r).alias("ratio")) for i, r in enumerate(RATIOS)))
    return F.array_min(options)


def dimension(length: Column, percent: float = THRESHOLDS["fib_dimension_tolerance_pct"]) -> Column:
    """The first Fibonacci number from 5 on within percent of length; else 0."""
    out = F
    for f in (x for x in FIBONACCI if x >= 5):
        out = out.when((length > 0) & (F.abs(length - f) / f * 100 <= percent), float(f))
    return out.otherwise(F.lit(0.0))


def golden_error(aspect: Column) -> Column:
    return F.abs(aspect - GOLDEN) / GOLDEN * 100


def near(angle: Column, degrees: float, tolerance: float = THRESHOLDS["regular_angle_tolerance_deg"]) -> Column:
    return F.abs(angle - degrees) <= tolerance


def golden_angle(angle: Column) -> Column:
    return near(angle, GOLDEN_ANGLE, THRESHOLDS["golden_angle_tolerance_deg"])


#: Signals by name, as functions of a row's aspect and angle.
PRIMARY = {
    "golden_angle": lambda: golden_angle(F.col("angle")),
    "golden_ratio": lambda: golden_error(F.col("aspect")) <= 3.0,
    "fib_ratio": lambda: nearest_ratio(F.col("aspect"))["err"] <= 2.0,
}
NEGATIVE = {"has_60": lambda: near(F.col("angle"), 60), "has_120": lambda: near(F.col("angle"), 120)}


def signal(name: str) -> Column:
    """A signal by its name."""
    known = PRIMARY | NEGATIVE
    if name not in known:
        raise ValueError(f"unknown signal: {name}")
    return known[name]()


def _matches(x: dict[str, Column]) -> dict[str, Column]:
    near_ratio = nearest_ratio(x["aspect"])
    t = THRESHOLDS
    return {
        "golden": golden_error(x["aspect"]) <= t["golden_ratio_error_pct"],
        "fib": (near_ratio["err"] <= t["fib_ratio_error_pct"]) & (near_ratio["ratio"] != 1.0),
        "dim": (dimension(x["length_m"]) > 0) | (dimension(x["width_m"]) > 0),
        "cross": (x["convexity"] <= t["cruciform_convexity"]) & (x["vertices"] >= t["cruciform_vertices"]) & (x["area_m2"] >= t["cruciform_area_m2"]),
        "circle": x["circularity"] >= t["circularity"],
    }


def flags(x: dict[str, Column]) -> Column:
    """Comma-joined flags of a shape, in a fixed order."""
    m, iou = _matches(x), THRESHOLDS["symmetry_flag_iou"]
    named = [
        (m["golden"], "golden_ratio"), (m["fib"], "fib_ratio"), (m["dim"], "fib_dimension"), (x["reflect"] >= iou, "reflective_symmetry"), (x["rot180"] >= iou, "rot180_symmetry"),
        (x["rot90"] >= iou, "rot90_symmetry"), (x["rot60"] >= iou, "hexagonal"), (x["rot45"] >= iou, "octagonal"), (x["rot72"] >= iou, "pentagonal"), (m["circle"], "circular"),
        (m["cross"], "cruciform_candidate"), (x["golden_angle"], "golden_angle"), ((x["right_fraction"] >= 0.5) & (x["vertices"] >= 4), "orthogonal"),
    ]
    return F.concat_ws(",", F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in named))))


def score(x: dict[str, Column]) -> Column:
    """Weighted sum of what a shape matches, two places, at most MAX_SCORE."""
    m, w, t = _matches(x), WEIGHTS, THRESHOLDS

    def if_(test: Column, name: str) -> Column:
        return F.when(test, F.lit(w[name])).otherwise(F.lit(0.0))

    def above(value: Column, floor: float, name: str) -> Column:
        return F.lit(w[name]) * F.greatest(F.lit(0.0), value - floor) / (1.0 - floor)

    terms = [
        if_(m["golden"], "golden_ratio"), if_(m["fib"], "fib_ratio"), if_(m["dim"], "fib_dimension"), F.lit(w["right_angle_fraction"]) * x["right_fraction"],
        above(x["reflect"], t["reflective_iou_floor"], "reflective_symmetry"), above(x["rot180"], t["rot180_iou_floor"], "rot180_symmetry"), if_(m["circle"], "circularity"),
        if_(F.greatest(x["rot60"], x["rot45"], x["rot72"]) >= t["symmetry_flag_iou"], "rotational_symmetry"), if_(m["cross"], "cruciform_candidate"),
        if_(x["golden_angle"], "golden_angle"), if_(x["has_108"], "angle_108"), if_(x["has_120"], "angle_120"),
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.least(F.lit(MAX_SCORE), F.round(total, 2))


def golden_band(angle: Column) -> Column:
    """Part of the window around the golden angle that an angle of it lies in."""
    return F.when(angle < 136.5, "octagon-ish").when(angle <= 138.5, "golden-core").otherwise("high-side")


def century(year: Column) -> Column:
    """Name of a year's century; those up to the 17th and from the 21st on are one each."""
    c = F.floor(year / 100) + 1
    suffix = F.when(c.isin(11, 12, 13), "th").when(c % 10 == 1, "st").when(c % 10 == 2, "nd").when(c % 10 == 3, "rd").otherwise("th")
    return F.when(c <= 17, "pre-18th").when(c >= 21, "21st").otherwise(F.concat(c.cast("string"), suffix))


def half_century(year: Column) -> Column:
    base = F.floor(year / 50) * 50
    return F.concat(base.cast("string"), F.lit("-"), (base + 49).cast("string"))


def log_area_bin(area: Column) -> Column:
    return F.floor(F.log10(F.greatest(area, F.lit(1e-6))) * 2)


def density_bin(count: Column) -> Column:
    return F.when(count <= 1, "sparse").when(count <= 5, "low").when(count <= 20, "medium").otherwise("high")


def wanted(tags: Column) -> Column:
    """Whether a building (a map of tags) is one to be studied: of worship, of government, historic, or a tower."""

    def tag(name: str) -> Column:
        return F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit(""))

    building, historic, amenity = tag("building"), tag("historic"), tag("amenity")
    worship = building.isin(WORSHIP) | (amenity == "place_of_worship")
    government = building.isin(GOVERNMENT) | (tag("office") == "government") | (amenity == "townhall")
    old = building.isin(HISTORIC) | ((building != "") & (historic != "")) | historic.isin(HISTORIC)
    return worship | government | old | (tag("man_made") == "tower")


def is_control(tags: Column) -> Column:
    """Whether a building is an ordinary one."""
    return (F.coalesce(F.try_element_at(tags, F.lit("building")), F.lit("")) != "") & ~wanted(tags)
