"""Checks of options. Each returns the value in its type, or raises ValueError."""

from __future__ import annotations


def _fail(what: str, value: object) -> None:
    raise ValueError(f"{what}, not {value!r}")


def positive_int(value: object) -> int:
    n = int(value)
    return n if n > 0 else _fail("a positive whole number is wanted", value)


def positive_float(value: object) -> float:
    x = float(value)
    return x if x > 0 else _fail("a positive number is wanted", value)


def jobs(value: object) -> int:
    """-1 for all CPUs, or a positive number."""
    n = int(value)
    return n if n == -1 or n > 0 else _fail("jobs must be -1 or positive", value)


def split(value: object) -> float:
    x = float(value)
    return x if 0 < x < 1 else _fail("a share must be between 0 and 1", value)


def verbosity(value: object) -> int:
    n = int(value)
    return n if 0 <= n <= 3 else _fail("verbosity must be 0 to 3", value)


def seed(value: object) -> int | None:
    return None if value is None else positive_int(value)


def lower(value: object) -> str:
    return str(value).lower()


def one_of(value: object, allowed: tuple[str, ...]) -> str:
    """A lower-case word of a fixed set."""
    word = lower(value)
    return word if word in allowed else _fail(f"one of {', '.join(allowed)} is wanted", value)


def weighting(value: object) -> str:
    return one_of(value, ("loss", "none"))


def oversampling(value: object) -> str:
    return one_of(value, ("kmeans", "kerneldensity", "none"))


def embedding(value: object, components: int | None = None) -> str:
    """The kinds of operators.embedding; scaling needs 2 or 3 components. t-SNE and LLE aren't built, see README."""
    kind = one_of(value, ("pca", "mds", "polynomial", "none", "kernelpca", "nmf", "mca"))
    if kind == "mds" and components not in (2, 3):
        _fail("mds needs 2 or 3 components", components)
    return kind


def color_scale(low: float, high: float) -> tuple[float, float]:
    return (low, high) if 0 <= low < high else _fail("0 <= low < high is wanted", (low, high))


def neighbours(value: object) -> int:
    n = int(value)
    return n if n > 1 else _fail("more than one neighbour is wanted", value)


def level(value: object) -> float:
    return split(value)


def boosting(objective: str, metric: str, subsample: float) -> tuple[str, str, float]:
    one_of(objective, ("reg:squarederror", "reg:squaredlogerror", "reg:absoluteerror"))
    one_of(metric, ("rmse", "rmsle", "mae", "mape"))
    return objective, metric, subsample if 0 < subsample <= 1 else _fail("subsample must be in (0, 1]", subsample)
