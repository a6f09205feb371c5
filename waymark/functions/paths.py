"""Paths and file names as columns: names carry coordinates, `@east@north@...@.jpg`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the strict pattern of a name with coordinates.
STRICT = r"@(\d+\.?\d*)@(\d+\.?\d*)@.*\.jpg"
#: Metres of a degree, and the corner that pseudo-UTM counts from.
DEGREE, WEST, NORTH = 111320.0, -123.0, 49.0


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def relative(path: Column, folder: str) -> Column:
    """The path below the folder."""
    prefix = folder.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def joined(root: str, path: Column) -> Column:
    """An absolute right side stays as it is."""
    base = root if root.endswith("/") or not root else root + "/"
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base), path))


def _number(value: Column) -> Column:
    return F.nullif(value, F.lit("")).cast("double")


def utm_strict(filename: Column, pattern: str = STRICT) -> Column:
    """struct(utm_east, utm_north); both null where the name does not match."""
    return F.struct(_number(F.regexp_extract(filename, pattern, 1)).alias("utm_east"), _number(F.regexp_extract(filename, pattern, 2)).alias("utm_north"))


def pseudo_utm(lat: Column, lon: Column) -> Column:
    """Metres from a corner, the parallel's circumference taken at the latitude."""
    return F.struct(((lon - WEST) * DEGREE * F.cos(F.radians(lat))).alias("utm_east"), ((lat - NORTH) * DEGREE).alias("utm_north"))


def utm_cascade(path: Column) -> Column:
    """struct(utm_east, utm_north) of the base name: signed fields, else two bare numbers in UTM's range, else latitude and longitude."""
    name = basename(path)
    signed = r"@([+-]?\d+\.?\d*)@([+-]?\d+\.?\d*)@"
    first = F.struct(_number(F.regexp_extract(name, signed, 1)).alias("utm_east"), _number(F.regexp_extract(name, signed, 2)).alias("utm_north"))
    bare = F.regexp_extract_all(name, F.lit(r"(\d{6,7}\.?\d*)"), F.lit(1))
    east, north = F.get(bare, F.lit(0)).cast("double"), F.get(bare, F.lit(1)).cast("double")
    second = F.struct(east.alias("utm_east"), north.alias("utm_north"))
    degrees = r"([+-]?\d+\.?\d*),\s*([+-]?\d+\.?\d*)"
    lat, lon = _number(F.regexp_extract(name, degrees, 1)), _number(F.regexp_extract(name, degrees, 2))
    none = F.struct(F.lit(None).cast("double").alias("utm_east"), F.lit(None).cast("double").alias("utm_north"))
    return (
        F.when(F.regexp_like(name, F.lit(signed)), first)
        .when((F.size(bare) >= 2) & east.between(100000, 1000000) & north.between(0, 10000000), second)
        .when(F.regexp_like(name, F.lit(degrees)), pseudo_utm(lat, lon))
        .otherwise(none)
    )


def utm_fields(path: Column) -> Column:
    """struct(utm_east, utm_north, heading): fields 1, 2 and 9 between the path's @ signs; a field that is no number is null."""
    field = lambda i: F.get(F.split(path, "@"), F.lit(i)).try_cast("double")
    return F.struct(field(1).alias("utm_east"), field(2).alias("utm_north"), field(9).alias("heading"))


def rebased(path: Column, base: str) -> Column:
    """The last part of a path with either separator, below another base; null, empty and 'nan' stay."""
    part = F.element_at(F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: F.trim(x) != ""), -1)
    return F.when(path.isNull() | (F.trim(path) == "") | (F.lower(path) == "nan"), path).otherwise(F.concat(F.lit(base), part))


def path_columns(columns: list[str]) -> list[str]:
    """Columns whose name says path or file; all, if none does."""
    named = [c for c in columns if "path" in c.lower() or "file" in c.lower()]
    return named or list(columns)


def replaced(value: Column, old: str, new: str) -> Column:
    """Every place of old, taken literally."""
    return F.replace(value, F.lit(old), F.lit(new))


def wsl_to_windows(path: Column) -> Column:
    return F.when(path.startswith("/mnt/"), F.replace(F.replace(path, F.lit("/mnt/c/"), F.lit("C:\\")), F.lit("/"), F.lit("\\"))).otherwise(path)


def alternatives(path: Column, folder: str = "/", home: str = "~") -> Column:
    """Where a file may lie, the likeliest first, each once: the Windows form, the path itself, with either separator only, below folder
    if it is relative, with ~ as home, and with spaces escaped. Quotes are left out."""
    windows = F.replace(wsl_to_windows(path), F.lit('"'), F.lit(""))
    plain = F.replace(path, F.lit('"'), F.lit(""))
    expanded = F.when(windows.startswith("~/"), F.concat(F.lit(home), F.substring(windows, 2, 1 << 30))).otherwise(windows)
    forms = [windows, plain, F.translate(plain, "\\", "/"), F.translate(plain, "/", "\\"), joined(folder, windows), expanded, F.replace(windows, F.lit(" "), F.lit("%20"))]
    return F.array_distinct(F.array(*forms))


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot is none."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def compact(path: Column, limit: int = 20) -> Column:
    """The base name without extension, cut to limit with dots."""
    name = stem(basename(path))
    return F.when(F.length(name) > limit, F.concat(F.left(name, F.lit(limit - 3)), F.lit("..."))).otherwise(name)


def shortened(path: Column, limit: int = 15) -> Column:
    """The base name cut to limit, its extension kept where that leaves room."""
    name = basename(path)
    base = stem(name)
    ext = F.substring(name, F.length(base) + 1, F.length(name))
    room = F.lit(limit - 3) - F.length(ext)
    return F.when(F.length(name) <= limit, name).when(room > 0, F.concat(F.left(base, room), F.lit("..."), ext)).otherwise(F.concat(F.left(name, F.lit(limit - 3)), F.lit("...")))


def coco_id(image: Column) -> Column:
    """The number after the last underscore of a name."""
    return F.regexp_extract(image, r"_0*(\d+)\.jpg$", 1).try_cast("int")


def report_name(i: Column) -> Column:
    """Three digits at least."""
    return F.format_string("%03d.jpg", i)


def object_uri(bucket: str, prefix: str, path: Column) -> Column:
    """The object that holds a file: its parent folder and name below a bucket's prefix."""
    return F.concat(F.lit(f"gs://{bucket}/{prefix}"), basename(dirname(path)), F.lit("/"), basename(path))


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    return path.rlike("(?i)(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")
