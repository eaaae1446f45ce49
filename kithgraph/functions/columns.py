"""Column expressions that many operators share; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type names by rank, and the provenance of positions.
TYPES = ("community", "user", "post", "comment")


def epoch() -> Column:
    return F.timestamp_seconds(F.lit(0))


def weight(val: Column | str = "val") -> Column:
    """The number in a node's text value; anything but digits weighs nothing, as does what is too large."""
    c = F.col(val) if isinstance(val, str) else val
    return F.when(c.rlike("^[0-9]+$"), F.coalesce(c.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def by_weight(val: str = "val", key: str = "id") -> list[Column]:
    """The total order of nodes: heaviest first, then by id."""
    return [weight(val).desc(), F.col(key).asc()]


def effective_time(updated: Column, created: Column) -> Column:
    return F.coalesce(updated, created, epoch())


def typed_id(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}_"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def key_of(kind: str, typed: Column) -> Column:
    """The key in a typed id of this kind, else null."""
    return F.when(typed.rlike(f"^{kind}_[0-9]+$"), F.substring(typed, len(kind) + 2, 40).try_cast("bigint"))


def pair(a: str, b: str) -> list[Column]:
    """An undirected pair in canonical order, as u and v."""
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def truncated(text: Column, most: int) -> Column:
    """The first characters (not bytes) of a text; none for a limit of zero or less."""
    return F.left(text, F.lit(most)) if most > 0 else F.lit("")


def label(text: Column, fallback: Column, most: int = 160) -> Column:
    """A one-line label: white space collapsed, cut, and never empty."""
    return F.coalesce(F.nullif(F.trim(F.left(F.regexp_replace(text, r"\s+", " "), F.lit(most))), F.lit("")), fallback)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def mentions(text: Column, prefix: str = "r") -> Column:
    """Names after /prefix/, in any case, lower-cased and without repeats."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)/{prefix}/([a-z0-9_]+)"), F.lit(1)), F.lower))


def links_of(html: Column) -> Column:
    """Targets of the links in a page."""
    return F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+)"'), F.lit(1))


def bare_id(prefixed: Column) -> Column:
    """An id without the t1_ or t3_ in front of it."""
    return F.regexp_replace(prefixed, "^t[13]_", "")


def post_of_permalink(permalink: Column) -> Column:
    """The part behind the first part named comments; empty without one."""
    return F.coalesce(F.nullif(F.regexp_extract(permalink, "(?:^|/)comments/([^/]*)", 1), F.lit("")), F.lit(""))


def known_author(author: Column) -> Column:
    return F.coalesce((author != "") & (author != "[deleted]"), F.lit(False))


def path_segment(text: Column) -> Column:
    """A text as one segment of a URL's path: blanks as %20."""
    return F.regexp_replace(F.url_encode(text), r"\+", "%20")


def next_run(expression: str, now: Column) -> Column:
    """The next run after now: @hourly, @daily, @weekly (Sundays), @monthly, @yearly or @every Nd."""
    unit = {"@hourly": ("hour", "INTERVAL 1 HOUR"), "@daily": ("day", "INTERVAL 1 DAY"), "@monthly": ("month", "INTERVAL 1 MONTH"),
        "@yearly": ("year", "INTERVAL 1 YEAR")}
    if expression in unit:
        part, step = unit[expression]
        return F.date_trunc(part, now) + F.expr(step)
    if expression == "@weekly":
        return F.next_day(now, "Sunday").cast("timestamp")
    if expression.startswith("@every ") and expression.endswith("d") and expression[7:-1].isdigit():
        return now + F.make_dt_interval(days=F.lit(int(expression[7:-1])))
    raise ValueError(f"no schedule: {expression}")


def retry_minutes(attempt: Column) -> Column:
    """Doubling waits, a day at most."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(1440.0))


def retry_delay(attempt: Column, *key: Column, jitter: float = 0.2) -> Column:
    """The wait in minutes, lengthened by up to a fifth by a hash of the key, so reruns agree."""
    part = F.pmod(F.xxhash64(*key), F.lit(10_000)) / 10_000.0
    return retry_minutes(attempt) * (1 + jitter * part)


def shade(colour: Column, position: Column, sureness: Column) -> Column:
    """A colour (#RRGGBB), dimmed to 72 % where nothing is sure, then moved by up to 16 % towards white (position over 0) or black."""
    at = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), position))
    light = 0.72 + 0.28 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), sureness))
    channels = []
    for k in (2, 4, 6):
        c = F.conv(F.substring(colour, k, 2), 16, 10).cast("double") * light
        moved = F.when(at >= 0, c + (255 - c) * at * 0.16).otherwise(c * (1 + at * 0.16))
        channels.append(F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), moved)) + 0.5).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), *channels)


def is_bridge(primary: Column, secondary: Column) -> Column:
    """Whether a community's second macro group is nearly as close as its own."""
    return (secondary >= 0.30) & (primary > 0) & (secondary >= 0.55 * primary)


def distinctiveness(strength: Column) -> Column:
    """How strongly a community's members are tied, from 0 to 1."""
    return F.least(F.lit(1.0), strength / (1 + strength))


def confidence(size: Column) -> Column:
    """Full from twenty members on."""
    return F.least(F.lit(1.0), size / 20.0)
