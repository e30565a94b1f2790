"""Column functions: file names, times, sizes, vectors, geometry, labels. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MERCATOR_LIMIT = 85.0511
#: Fixed value: marks of a copied file's name.
COPY_MARKERS = ("복사본", "사본", "copy", "복사", "duplicate")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def same_hash(actual: Column, expected: Column) -> Column:
    """Equal but for case; null is equal to nothing."""
    return F.coalesce(F.lower(actual) == F.lower(expected), F.lit(False))


def model_identity(files: Column, shipped: Column, legacy: Column) -> Column:
    """Identity of a model's files, a map of name to hash: the legacy one if they are those shipped, else sha@ and six bytes of the digest of the sorted lines name=hash."""
    lines = F.array_sort(F.transform(F.map_entries(files), lambda e: F.concat(e["key"], F.lit("="), F.lower(e["value"]), F.lit("\n"))))
    same = F.array_sort(F.map_entries(files)) == F.array_sort(F.map_entries(shipped))
    return F.when(same, legacy).otherwise(F.concat(F.lit("sha@"), F.substr(F.sha2(F.array_join(lines, "").cast("binary"), 256), F.lit(1), F.lit(12))))


def manifest_files(json: Column) -> Column:
    """File names and lower-case hashes of a manifest; empty where it has none."""
    files = F.from_json(json, "files MAP<STRING, STRING>")["files"]
    return F.coalesce(F.transform_values(files, lambda k, v: F.lower(v)), F.create_map().cast("map<string,string>"))


def manifest_sizes(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "sizes MAP<STRING, BIGINT>")["sizes"], F.create_map().cast("map<string,bigint>"))


# names


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def origin_rank(name: Column, markers: tuple[str, ...] = COPY_MARKERS) -> Column:
    """A struct that sorts originals before copies: whether the name is marked as a copy, its length, the name."""
    name = F.coalesce(name, F.lit(""))
    low = F.lower(stem(name))
    marked = low.rlike(r"[(\[]\d+[)\]]\s*$")
    for m in markers:
        marked = marked | low.contains(m.lower())
    return F.struct(marked.alias("marked"), F.char_length(name).alias("length"), name.alias("name"))


# times


def taken_time(exif: Column, offset: Column | None = None) -> Column:
    """Epoch seconds of `yyyy:MM:dd HH:mm:ss` in the session's zone, or at an offset such as +09:00; garbage is null."""
    local = F.try_to_timestamp(exif, F.lit("yyyy:MM:dd HH:mm:ss"))
    if offset is not None:
        zoned = F.try_to_timestamp(F.concat(exif, offset), F.lit("yyyy:MM:dd HH:mm:ssXXX"))
        local = F.coalesce(zoned, local)
    return F.unix_seconds(local)


def container_time(raw: Column) -> Column:
    """Epoch seconds of a container's UTC time such as 20240131T101500.000Z; before 2000, or garbage, is null."""
    part = lambda k: F.regexp_extract(raw, r"^\s*(\d{4})-?(\d{2})-?(\d{2})[T ]?(\d{2}):?(\d{2}):?(\d{2})", k)
    at = F.try_to_timestamp(F.concat(part(1), part(2), part(3), part(4), part(5), part(6), F.lit("+00:00")), F.lit("yyyyMMddHHmmssXXX"))
    return F.when(F.year(at) >= 2000, F.unix_seconds(at))


def iso6709(raw: Column) -> Column:
    """struct<lat, lon> of +37.5665+126.9780/; out of range, (0, 0) and garbage are null."""
    part = lambda k: F.regexp_extract(raw, r"^\s*([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)", k).try_cast("double")
    return valid_gps(part(1), part(2))


def valid_gps(lat: Column, lon: Column) -> Column:
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees, negative for S and W."""
    return (degrees + minutes / 60 + seconds / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)


def clock(ms: Column) -> Column:
    """0:05, 2:18 or 1:02:03."""
    s = F.floor(ms / 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def human_size(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n >= 1 << 30, F.format_string("%.1fGB", n / (1 << 30))).when(n >= 1 << 20, F.format_string("%.0fMB", n / (1 << 20))).otherwise(F.format_string("%.0fKB", n / 1024))


def day_label(day: Column, today: Column) -> Column:
    """오늘, 어제, M월 D일 in this year, else with the year; null has no date."""
    return (
        F.when(day.isNull(), F.lit("날짜 미상"))
        .when(day == today, F.lit("오늘"))
        .when(day == F.date_sub(today, 1), F.lit("어제"))
        .when(F.year(day) == F.year(today), F.format_string("%d월 %d일", F.month(day), F.day(day)))
        .otherwise(F.format_string("%d년 %d월 %d일", F.year(day), F.month(day), F.day(day)))
    )


def span_label(oldest: Column, newest: Column, today: Column) -> Column:
    """One day's label, or from and to of days of one month that stand together."""
    year = F.when(F.year(newest) == F.year(today), F.lit("")).otherwise(F.format_string("%d년 ", F.year(newest)))
    several = F.concat(year, F.format_string("%d월 %d일 – %d일", F.month(newest), F.day(oldest), F.day(newest)))
    return F.when(newest.isNull() | (oldest == newest), day_label(newest, today)).otherwise(several)


def count_note(photos: Column, videos: Column) -> Column:
    """How many photos and videos, each in its own counter word."""
    return F.when(videos == 0, F.format_string("%d장", photos)).when(photos == 0, F.format_string("영상 %d개", videos)).otherwise(F.format_string("사진 %d장 · 영상 %d개", photos, videos))


def rounded(x: Column, places: int) -> Column:
    """x at so many decimal places, by the number that the double really is; exact halves go to the even digit.

    The product with a power of ten is split into its double and what that leaves out, which decides
    where the double alone looks like a half.
    """
    ten, split = float(10**places), 134217729.0
    x = x.cast("double")
    whole = x * ten
    high = x * split - (x * split - x)
    ten_high = ten * split - (ten * split - ten)
    low, ten_low = x - high, ten - ten_high
    rest = ((high * ten_high - whole) + high * ten_low + low * ten_high) + low * ten_low
    down = F.floor(whole).cast("double")
    past = (whole - down) - 0.5
    up = F.when(past != 0, past > 0).when(rest != 0, rest > 0).otherwise(F.pmod(down, F.lit(2.0)) == 1)
    return F.when(F.abs(x) < 1e15 / ten, (down + F.when(up, 1.0).otherwise(0.0)) / ten).otherwise(x)


# vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length, which counts as at least 1e-12."""
    size = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / size)


def softmax_over(score: Column, window, scale: float) -> Column:
    """Share of each row among those of the window, by the exponential of scale times score."""
    top = F.max(score * scale).over(window)
    return F.exp(score * scale - top) / F.sum(F.exp(score * scale - top)).over(window)


# pictures as flat arrays


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def mean_brightness(gray: Column) -> Column:
    return F.aggregate(gray, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(gray)


def laplacian_variance(gray: Column, width: int, height: int) -> Column:
    """Population variance of the four-neighbour Laplacian over inner pixels; 0 below three pixels a side."""
    if width < 3 or height < 3:
        return F.lit(0.0)
    inner = F.filter(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: (i % width).between(1, width - 2) & F.floor(i / width).between(1, height - 2))
    at = lambda i: F.get(gray, i).cast("double")
    values = F.transform(inner, lambda i: at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4 * at(i))
    n = float((width - 2) * (height - 2))
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")))
    return sums["q"] / n - (sums["s"] / n) * (sums["s"] / n)


def screen_like(width: Column, height: Column, ratios: tuple[float, ...], tolerance: float) -> Column:
    """Whether the longer side over the shorter is within a relative tolerance of one of the ratios."""
    ratio = F.greatest(width, height) / F.nullif(F.least(width, height), F.lit(0))
    out = F.lit(False)
    for x in ratios:
        out = out | (F.abs(ratio - x) / x <= tolerance)
    return F.coalesce(out, F.lit(False))


# geometry


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def mercator_x(lon: Column, world: float) -> Column:
    return (lon + 180) / 360 * world


def mercator_y(lat: Column, world: float) -> Column:
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(MERCATOR_LIMIT)), F.lit(-MERCATOR_LIMIT))))
    return (0.5 - F.ln((1 + s) / (1 - s)) / (4 * F.pi())) * world


def fit_zoom(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, view: tuple[float, float], pad: float, tile: float, lowest: float, highest: float) -> Column:
    """The zoom at which a box fills a view inside a margin."""

    def zoom(room: float, share: Column) -> Column:
        return F.when(share <= 0, F.lit(highest)).otherwise(F.log2(F.lit(max(1.0, room)) / (tile * share)))

    across = zoom(view[0] - 2 * pad, mercator_x(lon_max, 1.0) - mercator_x(lon_min, 1.0))
    along = zoom(view[1] - 2 * pad, mercator_y(lat_min, 1.0) - mercator_y(lat_max, 1.0))
    return F.greatest(F.least(across, along, F.lit(float(highest))), F.lit(float(lowest)))


# frames


def frame_positions(duration_ms: Column, step: int = 5000, most: int = 96) -> Column:
    """Milliseconds at which to look into a video, evenly from its start to its end; none without a duration."""
    n = F.least(F.greatest(F.floor(duration_ms / step) + 1, F.lit(1)), F.lit(most)).cast("long")
    many = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.floor((duration_ms - 1) * i / F.greatest(n - 1, F.lit(1))).cast("long"))
    one = F.array(F.floor(duration_ms / 2).cast("long"))
    return F.when(F.coalesce(duration_ms, F.lit(0)) <= 0, F.array().cast("array<bigint>")).when(n == 1, one).otherwise(many)


def register(spark: SparkSession) -> None:
    """SQL functions of the same names."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN 2 * {EARTH_KM} * asin(least(sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)), 1.0))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mercator_x(lon DOUBLE, world DOUBLE) RETURNS DOUBLE RETURN (lon + 180) / 360 * world")
