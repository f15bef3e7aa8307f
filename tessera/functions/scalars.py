
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
# Month abbreviations, Spanish and English, by month number.
MONTHS = {"ene": 1, "jan": 1, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dic": 12, "dec": 12}
# What counts as true.
TRUE_WORDS = ["true", "1", "yes", "y", "si", "sí", "ok", "valid", "valido", "válido"]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_float(s: Column) -> Column:
    """trimmed number; blank, nan, none, null or anything else is null."""
    t = F.trim(s)
    word = F.lower(t)
    return F.when(t.rlike(NUMBER), t.try_cast("double")).when(word.rlike(r"^[+-]?inf(inity)?$"), F.when(word.startswith("-"), F.lit(-INF)).otherwise(F.lit(INF)))


def finite(x: Column) -> Column:
    """X, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def without_sentinel(x: Column, *sentinels: float) -> Column:
    """F2: null where x is exactly a sentinel (default -111.0)."""
    return F.when(~x.isin(*(sentinels or (-111.0,))), x)


def hms_seconds(s: Column) -> Column:
    """seconds of H:M:S(.f); minutes below 60, seconds below 61, hours unbounded; else null."""
    parts = F.split(F.trim(s), ":")
    h, m, sec = (F.get(parts, i).try_cast("double") for i in range(3))
    fine = (F.size(parts) == 3) & (m >= 0) & (m < 60) & (sec >= 0) & (sec < 61)
    return F.when(fine, h * 3600 + m * 60 + sec)


def parse_float(s: Column) -> Column:
    """like to_float, infinity rejected."""
    return finite(to_float(s))


def safe_int(s: Column) -> Column:
    """integer part of a number, -1 if there is none."""
    return F.coalesce(to_float(s.cast("string")).try_cast("int"), F.lit(-1))


def norm_name(s: Column) -> Column:
    """F6."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), " ", "_"), r"[^\p{L}\p{N}_]", "")


def mid(fecha: Column, lab: Column, archivo: Column) -> Column:
    """fecha_lab_nnn."""
    return F.format_string("%s_%s_%03d", fecha, lab, archivo.cast("int"))


def index_prefix(name: Column) -> Column:
    """F8: number before med, null without one."""
    return F.regexp_extract(name, r"^\s*(\d+)\s*med", 1).try_cast("int")


def colour_token(name: Column) -> Column:
    """token between med and .csv of names with a number."""
    return F.when(F.lower(name).rlike(r"^\d+med.*\.csv$"), F.lower(F.trim(F.regexp_extract(F.lower(name), r"^\d+med(.*)\.csv$", 1))))


def laser_index(name: Column) -> Column:
    """all digits read as one number; below 1 null."""
    n = F.regexp_replace(name, "[^0-9]", "").try_cast("int")
    return F.when(n >= 1, n)


def date_token(s: Column) -> Column:
    """ddMmmYY with Spanish or English months to a date; null if it is none."""
    month = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    m = F.try_element_at(month, F.lower(F.substring(s, 3, 3)))
    day = F.format_string("20%s-%02d-%s", F.substring(s, 6, 2), m, F.substring(s, 1, 2))
    return F.when(s.rlike(r"^\d{2}[A-Za-z]{3}\d{2}$") & m.isNotNull(), day.try_cast("date"))


def mid_number(s: Column) -> Column:
    """number of a <date>_M_<lab>_<nnn> id."""
    return F.regexp_extract(s, r"^\d{2}[A-Za-z]{3}\d{2}_M_[^_]+_(\d{3})$", 1).try_cast("int")


def lab_of_path(path: Column) -> Column:
    """LAB<n> from a path, else LAB_UNK."""
    n = F.regexp_extract(F.lower(path), r"lab[ _-]?(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("LAB"), n)).otherwise(F.lit("LAB_UNK"))


def jkey(*fields: Column) -> Column:
    """fields joined by _, without white space; missing fields are empty."""
    return F.regexp_replace(F.concat_ws("_", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), r"\s+", "")


def file_safe(s: Column, most: int = 64) -> Column:
    """F15."""
    return F.left(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_"), F.lit(most))


def columns_hash(columns: Column) -> Column:
    """F16: md5 of |-joined column names."""
    return F.md5(F.concat_ws("|", columns).cast("binary"))


def clamp(x: Column, low: float, high: float) -> Column:
    """F17, null for null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def snr_db(mean: Column, std: Column) -> Column:
    """+inf for std 0, -inf for mean 0."""
    return F.when(std == 0, F.lit(INF)).when(mean == 0, F.lit(-INF)).otherwise(20 * F.log10(F.try_divide(F.abs(mean), std)))


def cv_pct(mean: Column, std: Column) -> Column:
    """+inf for mean 0."""
    return F.when(mean == 0, F.lit(INF)).otherwise(F.try_divide(std, F.abs(mean)) * 100)


def quality_score(noise: Column, snr: Column, slope: Column, p) -> Column:
    """three clamped factors, weighted and clamped."""
    low, high = p.clamp
    parts = (10 - noise * p.noise_scale, snr / p.snr_divisor, 10 - F.abs(slope) * p.trend_scale)
    total = sum((clamp(x, low, high) * w for x, w in zip(parts, p.weights, strict=True)), F.lit(0.0))
    return clamp(total, low, high)


def bin_index(edges: Column, x: Column) -> Column:
    """right-sided search, clipped to the bins; the last edge belongs to the last bin, NaN too. Edges increase."""

    def search(halves: int) -> Column:
        """How many edges are not above x, by halves; up to 2^halves - 1 edges."""
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(halves))])
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(edges, at + s - 1) <= x, at + s).otherwise(at))

    upto = F.when(F.size(edges) < 32, search(5)).when(F.size(edges) < 512, search(9)).otherwise(F.size(F.filter(edges, lambda e: e <= x)))
    return F.greatest(F.lit(0), F.least(upto - 1, F.size(edges) - 2))


def entropy_term(p: Column, base: float = 2.0, eps: float = 0.0) -> Column:
    """-p log(p + eps) / log(base); 0 for p = 0."""
    return F.when(p > 0, -p * F.log(base, p + F.lit(eps))).otherwise(F.lit(0.0))


def ratio_max_min(high: Column, low: Column) -> Column:
    """null if low is 0."""
    return F.when(low != 0, F.try_divide(high, low))


def is_true(s: Column) -> Column:
    """P6."""
    return F.coalesce(F.lower(F.trim(s.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def redacted(x: Column, blind: bool = True) -> Column:
    """REDACTED where x is not empty."""
    return F.when(F.trim(x) != "", F.lit("REDACTED")).otherwise(x) if blind else x


def latex(s: Column) -> Column:
    """F26."""
    return F.regexp_replace(s, r"([&%$#_{}])", r"\\$1")


def six(x: Column) -> Column:
    """six decimals or NA."""
    return F.coalesce(F.format_string("%.6f", x), F.lit("NA"))


def relative_path(path: Column, root: str) -> Column:
    """F27."""
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(F.substring_index(path, "/", -1))
