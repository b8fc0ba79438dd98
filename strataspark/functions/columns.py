"""Scalar functions as Column expressions. Each accepts a Column or a column name and passes nulls through unless it says otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataspark.contract import CELL_M, SENTINELS, ZONE_BREAKS

ColumnLike = Column | str
_ACCENTED = [chr(c) for c in range(0xC0, 0x180) if len(x := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore")) == 1]
_PLAIN = "".join(unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in _ACCENTED)


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: ColumnLike, n: int = 6) -> Column:
    """Rounded as a double, never negative zero."""
    return F.round(col(c).cast("double"), n) + F.lit(0.0)


def rnd_fast(c: ColumnLike, n: int = 6) -> Column:
    """The same numbers as rnd. Only those near a tie, or large, are made decimals; whole numbers over a power of ten are exact enough for the rest."""
    y = F.abs(col(c).cast("double")) * F.lit(10.0**n)
    plain = (y < 1e12) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(plain, F.signum(col(c).cast("double")) * F.floor(y + 0.5) / F.lit(10.0**n) + F.lit(0.0)).otherwise(rnd(c, n))


def half_even(c: ColumnLike, n: int) -> Column:
    return F.bround(col(c).cast("double"), n)


def missing(c: ColumnLike, sentinels: tuple[float, ...] = SENTINELS) -> Column:
    """Sentinels, NaN and infinities as null."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isin(*sentinels), None).otherwise(c)


def readable(c: ColumnLike, nodata: float) -> Column:
    """Finite and not the no-data value; false for null."""
    c = col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")) & (c != nodata), F.lit(False))


def number(c: ColumnLike) -> Column:
    """A double, null where the text is none."""
    return col(c).try_cast("double")


def circular(angle: ColumnLike) -> tuple[Column, Column]:
    """Sine and cosine of a compass angle in degrees; flat (null or negative) is (0, 0)."""
    a = col(angle)
    return tuple(F.when(a >= 0, f(F.radians(a))).otherwise(0.0) for f in (F.sin, F.cos))


def compass(angle: ColumnLike) -> Column:
    """Compass degrees (clockwise from north) of a mathematical angle (anticlockwise from east); 0 is the code of flat and gives -1."""
    a = col(angle)
    return F.when(a == 0, -1.0).when(a <= 90, 90 - a).otherwise(450 - a)


def zone(score: ColumnLike, breaks: tuple[float, ...] = ZONE_BREAKS) -> Column:
    """Zone 1 to 5 of a score, cast to float first; null scores are zone 0."""
    s = col(score).cast("float").cast("double")
    return F.coalesce(sum((F.when(s >= F.lit(float(b)), 1).when(s.isNotNull(), 0) for b in breaks), F.lit(1)), F.lit(0))


def sigmoid(x: ColumnLike) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def bump(x: ColumnLike, centre: float, width: float) -> Column:
    """A Gaussian bump of height 1."""
    d = (col(x) - centre) / width
    return F.exp(-0.5 * d * d)


def clip(x: ColumnLike, lo: float, hi: float) -> Column:
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi)))


def grid_index(x: ColumnLike, origin: float, size: float) -> Column:
    return F.floor((col(x) - F.lit(origin)) / F.lit(size)).cast("long")


def cell_of(x: ColumnLike, y: ColumnLike, left: float, top: float, size: float = CELL_M) -> tuple[Column, Column]:
    """Row and column of the cell that holds a point; rows run down from top."""
    return F.floor((F.lit(top) - col(y)) / size).cast("long"), grid_index(x, left, size)


def cell_centre(row: ColumnLike, column: ColumnLike, left: float, top: float, size: float = CELL_M) -> tuple[Column, Column]:
    return F.lit(left) + (col(column) + 0.5) * size, F.lit(top) - (col(row) + 0.5) * size


def normalized_difference(a: ColumnLike, b: ColumnLike) -> Column:
    """(a - b) / (a + b), null where the sum is 0."""
    return F.try_divide(col(a) - col(b), col(a) + col(b))


def slug(text: ColumnLike) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def ascii_fold(text: ColumnLike) -> Column:
    """Accents taken off Latin letters, whatever else isn't ASCII dropped."""
    return F.regexp_replace(F.translate(col(text), "".join(_ACCENTED), _PLAIN), r"[^\x00-\x7F]", "")


def html_escape(text: ColumnLike) -> Column:
    out = col(text)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def text_hash(text: ColumnLike) -> Column:
    """SHA-256 with line ends made \\n."""
    return F.sha2(F.replace(col(text), F.lit("\r\n"), F.lit("\n")), 256)


def json_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def snap(x: ColumnLike, lo: float, hi: float, step: float) -> Column:
    """The nearest of lo, lo + step, ... within [lo, hi]."""
    return clip(F.lit(lo) + F.round((col(x) - lo) / step) * step, lo, hi)


def hex_rgb(colour: ColumnLike) -> Column:
    c = col(colour)
    return F.array(*[F.conv(F.substring(c, k, 2), 16, 10).cast("int") for k in (2, 4, 6)])


def cells_km2(n: ColumnLike, size: float = CELL_M) -> Column:
    return col(n) * F.lit(size * size) / F.lit(1e6)


def decimals(x: ColumnLike) -> Column:
    """Digits after the point of a number's shortest text, trailing zeros not counted."""
    return F.length(F.rtrim(F.element_at(F.split(F.concat(col(x).cast("string"), F.lit(".")), r"\."), 2), F.lit("0")))


def percent(share: ColumnLike) -> Column:
    return F.format_string("%.2f%%", col(share) * 100)


def tile_corner(name: ColumnLike) -> tuple[Column, Column]:
    """Latitude and longitude of names like N31E077; south and west are negative, other names null."""
    part = lambda k: F.regexp_extract(col(name), r"^([NS])(\d{2})([EW])(\d{3})$", k)
    value = lambda sign, digits, low: F.when(part(digits) != "", part(digits).try_cast("int") * F.when(part(sign) == low, -1).otherwise(1))
    return value(1, 2, "S"), value(3, 4, "W")


def pearson(a: ColumnLike, b: ColumnLike) -> Column:
    """Correlation over rows where both are known; null if either doesn't vary."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = (F.when(both, col(c).cast("double")) for c in (a, b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def key_hash(c: ColumnLike, seed: int = 12345, multiplier: int = 1103515245) -> Column:
    """A linear congruential hash of an integer key, in whole-number arithmetic that any engine repeats: 0 to 2**31 - 2.

    Keys of any size are reduced first. Keys that differ by a multiple of 2**31 - 1 share a hash, so an order by it needs the key as a tie-break.
    Hashes of one key that differ in the seed alone are near each other; what must be independent needs its own multiplier."""
    return F.pmod(F.pmod(col(c).cast("long"), F.lit(2147483647)) * multiplier + seed, F.lit(2147483647))


def uniform(c: ColumnLike, seed: int = 12345, multiplier: int = 1103515245) -> Column:
    """key_hash as a number in [0, 1)."""
    return key_hash(c, seed, multiplier) / F.lit(2147483647.0)


def independent_uniform(c: ColumnLike, seed: int) -> Column:
    """A number in [0, 1) from a 64-bit hash: independent of those of other seeds."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), col(c)), 11) / F.lit(float(2**53))


def agreement(scores: list[Column], threshold: float = 0.5) -> Column:
    """What several models' scores say together: same class, or how many decide for it."""
    zones = F.array(*[zone(s) for s in scores])
    votes = sum((F.when(s >= threshold, 1).otherwise(0) for s in scores[1:]), F.when(scores[0] >= threshold, 1).otherwise(0))
    return F.concat(F.when(F.size(F.array_distinct(zones)) == 1, "same class").otherwise("different classes"), F.lit(", "), votes.cast("string"), F.lit(f" of {len(scores)} decide for it"))
