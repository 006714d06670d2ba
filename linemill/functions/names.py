"""Column functions on file names and display units. Case folds in ASCII only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """What follows the last dot; null without a dot or behind a trailing one."""
    return F.when(name.contains(".") & ~name.endswith("."), F.substring_index(name, ".", -1))


def child_path(parent: Column, name: Column) -> Column:
    """Parent and name with one slash between them."""
    return F.concat(F.regexp_replace(parent, "(?<=.)/+$", ""), F.when(parent == "/", F.lit("")).otherwise(F.lit("/")), name)


def relative_path(path: Column, directory: Column | str) -> Column:
    """The path below the directory that holds it; the whole path below ""."""
    directory = F.lit(directory) if isinstance(directory, str) else directory
    return F.when(directory == "", path).otherwise(F.substring(path, F.length(directory) + 2, F.length(path)))


# Units, each with the least value that is shown in it; below the first, it is the first.
COUNTS = [(1.0, ""), (1e3, "K"), (1e6, "M"), (1e9, "B")]
BYTES = [(1.0, " B"), (2.0**10, " KiB"), (2.0**20, " MiB"), (2.0**30, " GiB"), (2.0**40, " TiB")]
TIMES = [(1e-6, "ns"), (1e-3, "µs"), (1.0, "ms"), (1e3, "s")]


def _scaled(value: Column, units: list[tuple[float, str]]) -> Column:
    """In the last unit that isn't above the value: divided, two places, unit."""
    v = value.cast("double")
    out = None
    for size, unit in reversed(units[1:]):
        one = F.format_string(f"%.2f{unit}", v / F.lit(size))
        out = F.when(v >= size, one) if out is None else out.when(v >= size, one)
    return out.otherwise(F.format_string(f"%.2f{units[0][1]}", v / F.lit(units[0][0])))


def format_count(value: Column) -> Column:
    return _scaled(value, COUNTS)


def format_bytes(value: Column) -> Column:
    return _scaled(value, BYTES)


def format_time(ms: Column) -> Column:
    return _scaled(ms, TIMES)


def shown(value: float, units: list[tuple[float, str]]) -> str:
    """``_scaled`` for one number."""
    size, name = next(((s, n) for s, n in reversed(units) if value >= s), units[0])
    return f"{value / size:.2f}{name}"
