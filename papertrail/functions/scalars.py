"""Scalar expressions on columns; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrail import constants as C


def fix(value: Column | str, digits: int) -> Column:
    """Round with exact ties going up, whatever the last bit of the double says."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-9, digits)


def bands(value: Column, floors: list[tuple[str, float]], default: str) -> Column:
    """First label whose floor the value reaches (floors from high to low)."""
    out = None
    for label, floor in floors:
        out = F.when(value >= floor, label) if out is None else out.when(value >= floor, label)
    return out.otherwise(default)


def severity_band(score: Column) -> Column:
    return bands(score, C.SEVERITY_FLOORS, "benign")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in C.SEVERITIES]), severity) - 1


def layer_status(score: Column, explicit: Column | None = None) -> Column:
    derived = bands(score, C.STATUS_FLOORS, "pass")
    return derived if explicit is None else F.coalesce(explicit, derived)


def default_confidence(score: Column, explicit: Column) -> Column:
    return F.coalesce(explicit, 0.6 + 0.3 * score)


def verdict(risk: Column) -> Column:
    return bands(risk, C.VERDICT_FLOORS, "authentic")


def risk_band(risk: Column) -> Column:
    return bands(risk, C.RISK_BANDS, C.DEFAULT_RISK_BAND)


def verdict_label(verdict_col: Column) -> Column:
    return lookup(C.VERDICT_LABELS, verdict_col)


def worker_recommendation(risk: Column) -> Column:
    floors = [(text, floor) for floor, text in C.WORKER_RECOMMENDATIONS if floor is not None]
    return bands(risk, floors, C.WORKER_RECOMMENDATIONS[-1][1])


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Constant-map lookup, folded into the projection (no join)."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def layer_family(layer: Column) -> Column:
    return lookup(C.LAYER_FAMILY, layer, C.DEFAULT_FAMILY)


def finding_family(code: Column) -> Column:
    """Ordered prefixes; NULL when the code belongs to no family."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, family in C.FINDING_FAMILY_PREFIXES:
        out = out.when(code.startswith(prefix), family)
    return out


def calibrate(mass: Column) -> Column:
    logistic = 1 / (1 + F.exp(-C.CALIBRATION_SLOPE * (mass - C.CALIBRATION_MIDPOINT)))
    return F.least(F.lit(C.CALIBRATION_CEILING), F.greatest(F.lit(C.CALIBRATION_FLOOR), logistic))


def risk_of(mass: Column) -> Column:
    return fix(calibrate(mass) * 100, 0).cast("int")


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    overlap_x = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    overlap_y = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    inter = F.greatest(F.lit(0.0), overlap_x) * F.greatest(F.lit(0.0), overlap_y)
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def box_iou(a: str, b: str) -> Column:
    """IoU of two box structs (x, y, width, height)."""
    return iou(*[F.col(f"{p}.{f}") for p in (a, b) for f in ("x", "y", "width", "height")])


def centre_in(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column,
              bh: Column) -> Column:
    """Centre of box a lies in box b, edges included."""
    cx, cy = ax + aw / 2, ay + ah / 2
    return (cx >= bx) & (cx <= bx + bw) & (cy >= by) & (cy <= by + bh)


def normalize_text(text: Column) -> Column:
    """Lower-case words of a-z and 0-9 separated by one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def parse_number(text: Column) -> Column:
    """Number left after dropping everything but digits, point and minus; NULL if none. Texts without a digit are not cast: every
    cast that fails costs an exception."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double"))


def is_amount(text: Column) -> Column:
    return F.trim(text).rlike(r"^[0-9][0-9,.]*%?$")


def label_match(text: Column, names: list[str]) -> Column:
    """Text equals a label or continues it with a non-alphanumeric character."""
    low = F.lower(text)
    hit = F.lit(False)
    for name in names:
        after = F.substring(low, len(name) + 1, 1)
        hit = hit | (low.startswith(name) & ((F.length(low) == len(name)) | ~after.rlike(r"[\p{L}\p{N}]")))
    return hit


def parse_timestamp(text: Column) -> Column:
    """Compact and colon-separated document dates; first 20 characters, optional ``D:``."""
    clean = F.trim(F.substring(F.trim(F.replace(text, F.lit("D:"), F.lit(""))), 1, 20))
    return F.coalesce(F.try_to_timestamp(clean, F.lit("yyyyMMddHHmmss")),
                      F.try_to_timestamp(clean, F.lit("yyyy:MM:dd HH:mm:ss")))


def document_domain(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for domain, tokens in C.DOMAIN_TOKENS:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | low.contains(token)
        out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return out.otherwise("general")


def case_code(sha256: Column, year: int, prefix: str = "SF") -> Column:
    seed = F.conv(F.substring(sha256, 1, 8), 16, 10).cast("bigint")
    return F.format_string(f"{prefix}-{year}-%d", seed % 900000 + 100000)


def extension(name: Column, kind: Column) -> Column:
    last = F.lower(F.element_at(F.split(name, r"\."), -1))
    by_kind = F.when(kind.isin("pdf", "png"), kind).when(kind == "jpeg", "jpg").otherwise("bin")
    return F.when((F.length(last) > 0) & (F.length(last) <= 5) & (last != F.lower(name)), last).otherwise(by_kind)


def format_bytes(size: Column) -> Column:
    return (F.when(size < 1024, F.format_string("%d B", size))
            .when(size < 1024 * 1024, F.concat(F.format_string("%.1f", size / 1024), F.lit(" KB")))
            .otherwise(F.concat(F.format_string("%.2f", size / 1048576), F.lit(" MB"))))


def short_hash(digest: Column, size: int = 10) -> Column:
    return F.concat(F.substring(digest, 1, size), F.lit("…"), F.right(digest, F.lit(6)))


def sniff_kind(content: Column, mime: Column, name: Column) -> Column:
    """Container kind from leading bytes, else from declared type or name."""
    head = F.hex(F.substring(content, 1, 8))
    return (F.when(head.startswith("FFD8"), "jpeg")
            .when(head == "89504E470D0A1A0A", "png")
            .when(head.startswith("25504446"), "pdf")
            .when(mime.startswith("image/") | F.lower(name).rlike(C.RASTER_NAME), "raster")
            .otherwise("unknown"))


def jpeg_quality(table: Column) -> Column:
    """Quality factor from a 64-entry luminance table: upper median of the ratios to
    the standard table over entries above 1, then the usual scale formula, 1 dp."""
    standard = F.array(*[F.lit(v) for v in C.STANDARD_LUMA])
    ratios = F.zip_with(table, standard, lambda q, s: F.when(q > 1, q * F.lit(100.0) / s))
    kept = F.array_sort(F.filter(ratios, lambda r: r.isNotNull()))
    scale = F.try_element_at(kept, F.floor(F.size(kept) / 2).cast("int") + 1)
    quality = F.when(scale < 100, (200 - scale) / 2).otherwise(5000 / scale)
    return F.round(clip(quality, 1, 100), 1)


def jpeg_quality_dc(table: Column) -> Column:
    """Quality factor from the first coefficient alone (integer)."""
    scale = F.element_at(table, 1) * F.lit(100.0) / 16.0
    quality = F.rint(F.when(scale >= 100, 5000 / scale).otherwise((200 - scale) / 2))
    return F.when(F.element_at(table, 1) > 0, clip(quality, 1, 100).cast("int"))


def unit_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Pixel corners to a box in page units: negative origin clamped, size at most 1, 4 dp."""
    zero = F.lit(0)
    return F.struct(
        F.round(F.greatest(zero, left) / width, 4).alias("x"),
        F.round(F.greatest(zero, top) / height, 4).alias("y"),
        F.round(F.least(F.lit(1.0), (right - left) / width), 4).alias("width"),
        F.round(F.least(F.lit(1.0), (bottom - top) / height), 4).alias("height"))


def average_hash(cells: Column) -> Column:
    """64 cells against their mean, first cell = highest bit, as 16 hex digits."""
    mean = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.size(cells)
    bits = F.array_join(F.transform(cells, lambda x: F.when(x > mean, "1").otherwise("0")), "")
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))


def rolling_fingerprint(content: Column, samples: int | None = None) -> Column:
    """16 two-digit block signatures over the bytes, folded as ``acc * 31 + byte`` modulo 2^32 - 1. Every byte counts;
    with ``samples`` a block is read at about that many evenly spaced bytes only."""
    n = F.octet_length(content)
    size = F.greatest(F.lit(1), F.floor(n / 16)).cast("int")

    def block(b: Column) -> Column:
        start = b * size
        end = F.least(n, start + size)
        step = F.lit(1) if samples is None else F.greatest(F.lit(1), F.floor((end - start) / samples)).cast("int")
        picks = F.when(end > start, F.sequence(start, end - 1, step)).otherwise(F.array().cast("array<int>"))
        acc = F.aggregate(picks, F.lit(0).cast("bigint"), lambda a, i: (
            a * 31 + F.conv(F.hex(F.substr(content, i + 1, F.lit(1))), 16, 10).cast("bigint")) % 4294967295)
        return F.lpad(F.lower(F.hex(acc % 256)), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), block), "")


def metric_value(metrics: Column, label: str, default: float = 0.0) -> Column:
    """Number of the first metric with a label; the default if absent or not numeric."""
    hit = F.filter(metrics, lambda m: m["label"] == label)
    return F.coalesce(F.try_element_at(hit, F.lit(1))["value"].try_cast("double"), F.lit(default))
