"""Keyboards and the keys that touch each other on them.

Three rows, each shifted by half a key against the one above. A key touches the
next ones in its row and those of the rows above and below whose centres are at
most half a key away."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

LAYOUTS: dict[str, tuple[str, str, str]] = {
    name: tuple(rows.split(" "))
    for name, rows in {
        "qwerty": "qwertyuiop asdfghjkl zxcvbnm", "qwertz": "qwertzuiopü asdfghjklöä yxcvbnm", "azerty": "azertyuiop qsdfghjklmù wxcvbn",
        "abnt2": "qwertyuiop asdfghjklç zxcvbnm,.;", "dvorak": "',.pyfgcrl aoeuidhtns ;qjkxbmwvz", "colemak": "qwfpgjluy; arstdhneio zxcvbkm",
    }.items()
}


@cache
def neighbours(layout: str) -> frozenset[tuple[str, str]]:
    """Ordered pairs of touching keys; symmetric, without a key and itself."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; one of {', '.join(LAYOUTS)}")
    at = {key: (row, row + 2 * k) for row, keys in enumerate(LAYOUTS[layout]) for k, key in enumerate(keys)}
    near = lambda a, b: abs(a[0] - b[0]) == 1 and abs(a[1] - b[1]) <= 1 or a[0] == b[0] and abs(a[1] - b[1]) == 2
    return frozenset((x, y) for x, a in at.items() for y, b in at.items() if near(a, b))


def are_neighbours(layout: str, a: str, b: str) -> bool:
    return (a, b) in neighbours(layout)


def neighbours_frame(spark: SparkSession) -> DataFrame:
    """(layout, a, b) of all layouts."""
    return spark.createDataFrame(sorted((n, a, b) for n in LAYOUTS for a, b in neighbours(n)), "layout string, a string, b string")
