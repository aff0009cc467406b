"""Scalar functions on file names, EXIF texts, coordinates and sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fotoloom.functions.predicates import RAW_FORMATS

#: Grid size in degrees by zoom level, fixed values.
GRID = {1: 30.0, 2: 20.0, 3: 10.0, 4: 5.0, 5: 2.0, 6: 1.0, 7: 0.5, 8: 0.2, 9: 0.1, 10: 0.05, 11: 0.02, 12: 0.01, 13: 0.005, 14: 0.002, 15: 0.001}


def grid_size(zoom: int) -> float:
    """Beyond the table, the finest grid above zoom 15 and the coarsest below zoom 1."""
    return GRID[min(15, max(1, zoom))]


def cell(c: Column | str, size: float) -> Column:
    """Integer number of the grid cell; exact as a grouping key."""
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def dir_name(path: Column | str) -> Column:
    """Folder with / as separator; empty at the top."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def format_group(ext: Column | str) -> Column:
    """jpg and jpeg as jpg, heic and heif as heic, raw formats as raw, others themselves, none as ''."""
    e = F.regexp_replace(F.lower(F.trim(ext)), r"^\.", "")
    return (
        F.when(e.isNull(), "").when(e.isin("jpg", "jpeg"), "jpg").when(e.isin("heic", "heif"), "heic").when(e.isin(RAW_FORMATS), "raw").otherwise(e)
    )


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds to six decimals, negative in the south and west."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.round(F.when(F.upper(F.trim(ref)).isin("S", "W"), -value).otherwise(value), 6)


def parse_position(text: Column) -> Column:
    """struct(latitude, longitude) of a decimal pair, a pair in degrees, minutes and seconds, or a map link with @lat,lon; else null."""
    num = r"([+-]?\d{1,3}(?:\.\d+)?)"
    pair, link = rf"^\s*{num}\s*[,; ]\s*{num}\s*$", rf"@{num},{num}"
    dms = r"(\d{1,3})\D{1,3}(\d{1,2})\D{1,3}(\d{1,2}(?:\.\d+)?)\D{0,3}([NSns])\W*(\d{1,3})\D{1,3}(\d{1,2})\D{1,3}(\d{1,2}(?:\.\d+)?)\D{0,3}([EWew])"

    def plain(p: str) -> Column:
        a, o = (F.regexp_extract(text, p, i).try_cast("double") for i in (1, 2))
        return F.when(text.rlike(p) & a.between(-90, 90) & o.between(-180, 180), F.struct(a.alias("latitude"), o.alias("longitude")))

    part = lambda i: F.regexp_extract(text, dms, i).try_cast("double")
    side = lambda i: dms_to_decimal(part(i), part(i + 1), part(i + 2), F.regexp_extract(text, dms, i + 3))
    degrees = F.when(text.rlike(dms), F.struct(side(1).alias("latitude"), side(5).alias("longitude")))
    return F.coalesce(plain(pair), degrees, plain(link))


def exif_object(exif: Column | str) -> Column:
    """The JSON text of an EXIF object, read through one level of JSON string; null for what is no object."""
    v = F.try_parse_json(exif)
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.col(exif) if isinstance(exif, str) else exif)
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


#: EXIF tags that hold a date, the most telling first, and the ways they are written; fixed values.
DATE_TAGS = ["DateTimeOriginal", "DateTimeDigitized", "DateTime", "CreateDate", "ModifyDate"]
DATE_FORMATS = ["yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy:MM:dd"]


def exif_date(exif: Column) -> Column:
    """First tag, in order, that one of the formats reads; ``exif`` is a JSON text."""
    tries = []
    for tag in DATE_TAGS:
        value = F.trim(F.get_json_object(exif, f"$.{tag}"))
        tries += [F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def iso_timestamp(text: Column) -> Column:
    """ISO time with its zone dropped, not converted."""
    bare = F.regexp_replace(F.trim(text), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.try_to_timestamp(F.regexp_replace(bare, "T", " ")).cast("timestamp_ntz")


def rotation(exif: Column) -> Column:
    return F.coalesce(F.get_json_object(exif, "$.UserRotation").try_cast("int"), F.lit(0))


def shown_size(width: Column, height: Column, exif: Column, file_format: Column) -> Column:
    """struct(width, height) as shown: orientations 5 to 8 and rotations by 90 or 270 swap the sides; of raw files only the user's rotation counts."""
    orientation = F.get_json_object(exif, "$.Orientation")
    turned = F.coalesce(orientation.try_cast("int").between(5, 8) | orientation.rlike("90|270"), F.lit(False)) & (format_group(file_format) != "raw")
    swap = turned != rotation(exif).isin(90, 270)
    return F.struct(F.when(swap, height).otherwise(width).alias("width"), F.when(swap, width).otherwise(height).alias("height"))


def rotate(old: Column, by: Column) -> Column:
    return F.pmod(old + by, F.lit(360))


def rotated_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, by: int) -> Column:
    """The box in a picture of the given size after turning it clockwise by 90, 180 or 270 degrees."""
    boxes = {0: (x1, y1, x2, y2), 90: (height - y2, x1, height - y1, x2), 180: (width - x2, height - y2, width - x1, height - y1), 270: (y1, width - x2, y2, width - x1)}
    return F.struct(*[c.alias(n) for c, n in zip(boxes[by % 360], ("x1", "y1", "x2", "y2"))])


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: float = 0.2) -> Column:
    """The face box widened by ``pad`` of its sides, inside the picture, in whole pixels."""
    dx, dy = (x2 - x1) * pad, (y2 - y1) * pad
    zero = F.lit(0)
    return F.struct(
        F.greatest(zero, (x1 - dx).cast("int")).alias("left"), F.greatest(zero, (y1 - dy).cast("int")).alias("top"),
        F.least(width, (x2 + dx).cast("int")).alias("right"), F.least(height, (y2 + dy).cast("int")).alias("bottom"),
    )


def fit_inside(width: Column, height: Column, most: int) -> Column:
    """Size scaled down to fit a square, never up."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height).cast("double"))
    return F.struct(F.greatest(F.lit(1), (width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), (height * scale).cast("int")).alias("height"))


def human_size(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    show = lambda by, unit: F.format_string(f"%.1f {unit}", n / by)
    return F.when(n < kb, F.format_string("%d B", n)).when(n < mb, show(kb, "KB")).when(n < gb, show(mb, "MB")).otherwise(show(gb, "GB"))


def tag_name(c: Column | str) -> Column:
    """Trimmed lower case; null if nothing is left."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def approximate_date(c: Column) -> Column:
    """January 1 of a year before 2000 stands for an unsure date."""
    return (F.month(c) == 1) & (F.dayofmonth(c) == 1) & (c < F.lit("2000-01-01").cast("date"))


def content_key(content: Column, digits: int = 16) -> Column:
    return F.substring(F.sha1(content), 1, digits)


def clean_exif_value(value: Column, most: int = 256) -> Column:
    """Without control characters and outer blanks, at most ``most`` characters; null if empty."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(value, r"\p{Cntrl}", "")), 1, most), F.lit(""))


def video_kind(head: Column) -> Column:
    """mov, mp4 or null by the brand after 'ftyp' in a file's first bytes."""
    brand = F.when(F.substring(head, 5, 4).cast("string") == "ftyp", F.trim(F.substring(head, 9, 4).cast("string")))
    return F.when(brand == "qt", "mov").when(brand.isNotNull(), "mp4")


def mapped_path(path: Column, host: str, inside: str) -> Column:
    """A host path under ``host`` (compared without case, \\ as /) moved under ``inside``; other paths unchanged."""
    p, h = F.regexp_replace(path, r"\\", "/"), host.replace("\\", "/").rstrip("/")
    hit = F.lower(p).startswith(h.lower() + "/")
    return F.when(hit, F.concat(F.lit(inside.rstrip("/")), F.substring(p, len(h) + 1, 1 << 30))).otherwise(p)


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; paths elsewhere unchanged."""
    r = root.rstrip("/") + "/"
    return F.when(path.startswith(r), F.substring(path, len(r) + 1, 1 << 30)).otherwise(path)


#: What EXIF readers put before a tag's name, and the names that hold no data; fixed values.
EXIF_PREFIXES = ["EXIF ", "Image ", "GPS ", "Thumbnail "]
EXIF_SKIPPED = ["Thumbnail", "EXIF MakerNote"]


def clean_exif(tags: Column) -> Column:
    """A map of EXIF names and values without reader's prefixes, thumbnails and maker notes, values cleaned; long and empty ones are dropped."""
    skip = lambda k: F.reduce(F.array(*[F.lit(p) for p in EXIF_SKIPPED]), F.lit(False), lambda a, p: a | k.startswith(p))
    kept = F.map_filter(tags, lambda k, v: ~skip(k) & (F.length(F.trim(v)).between(1, 256)))
    bare = F.transform_keys(kept, lambda k, v: F.regexp_replace(k, "^(" + "|".join(EXIF_PREFIXES) + ")", ""))
    return F.transform_values(bare, lambda k, v: F.trim(F.regexp_replace(v, r"\p{Cntrl}", "")))
