"""Column functions: routes, masking, buckets, geography, bots, filters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship_package

# Shapes of path segments that stand for an id, and the category of a first path segment.
ID_SHAPES = (
    r"\d+",
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",
    r"[0-9a-fA-F]{24,}",
    r"[A-Z]{2,5}[-_][A-Za-z0-9_-]+",
    r"[A-Za-z0-9_-]{20,}",
)
CATEGORIES = {
    "home": ("",),
    "api": ("api", "graphql"),
    "product": ("products", "product", "items", "p"),
    "browse": ("categories", "category", "search", "browse"),
    "cart": ("cart", "basket"),
    "checkout": ("checkout", "pay", "order", "orders"),
    "account": ("account", "user", "users", "profile", "settings"),
    "auth": ("auth", "login", "signin", "signup", "register", "logout"),
    "admin": ("admin",),
    "asset": ("static", "assets"),
    "content": ("blog", "news", "about", "help", "support", "privacy", "terms", "faq"),
}


def route_path(url: Column, decodes: int = 4) -> Column:
    """Canonical route of a URL, all JVM-side: no query or host, percent-escapes other than %2F undone (at most
    ``decodes`` times), ``.`` and ``..`` resolved, ids as ``*``, lower case."""
    path = F.regexp_replace(F.coalesce(url, F.lit("/")), r"^/{2,}", "/")
    path = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    for _ in range(decodes):
        # %2F stays data, and + is no space in a path.
        guarded = F.regexp_replace(F.regexp_replace(path, r"(?i)%(?=2f)", "%25"), r"\+", "%2B")
        path = F.coalesce(F.try_url_decode(guarded), path)
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))

    def step(stack: Column, part: Column) -> Column:
        up = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(part == "..", up).otherwise(F.concat(stack, F.array(part)))

    parts = F.aggregate(parts, F.array().cast("array<string>"), step)
    shape = "^(?:" + "|".join(ID_SHAPES) + ")$"
    named = F.transform(F.transform(parts, lambda s: F.coalesce(F.try_url_decode(F.regexp_replace(s, r"\+", "%2B")), s)), lambda s: F.when(s.rlike(shape), F.lit("*")).otherwise(F.lower(s)))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def route_category(url: Column) -> Column:
    """Category of a route by its first segment."""
    first = F.split_part(route_path(url), F.lit("/"), F.lit(2))
    out: Column | None = None
    for name, words in CATEGORIES.items():
        hit = first.isin(*words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def normalize_routes(logs: DataFrame, column: str = "url") -> DataFrame:
    """Add route and category, row by row, without a shuffle.  A report that groups by URL anyway does better to count
    first and to name the routes of the counts."""
    return logs.withColumns({"route": route_path(F.col(column)), "category": route_category(F.col(column))})


def mask_ip(ip: Column) -> Column:
    """IPv4 without its last octet; anything else but null and empty is ``[redacted]`` (see :func:`mask_ip_column`)."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4 = rf"^({octet}\.{octet}\.{octet})\.(?:{octet}|xxx)$"
    return F.when(ip.isNull() | (ip == ""), ip).when(ip.rlike(v4), F.concat(F.regexp_extract(ip, v4, 1), F.lit(".xxx"))).otherwise("[redacted]")


def mask_ip_column(df: DataFrame, column: str = "ip", out: str = "masked") -> DataFrame:
    """As :func:`mask_ip`, and IPv6 addresses keep 48 bits; those need a parser, in Arrow batches over the column."""
    import ipaddress

    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def v6(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            def one(x: str) -> str:
                try:
                    return str(ipaddress.IPv6Network((x, 48), strict=False).network_address)
                except ValueError:
                    return "[redacted]"

            yield s.map(one)

    return df.withColumn(out, F.when(F.col(column).contains(":"), v6(F.col(column))).otherwise(mask_ip(F.col(column))))


def redact_pii(value: Column, salt: str | None = None) -> Column:
    """Salted sha-256 of a client id, or ``[redacted]`` without a salt; null and empty stay."""
    kept = F.when(value.isNull() | (value == ""), value)
    return kept.otherwise(F.sha2(F.concat(F.lit(salt), value), 256) if salt is not None else F.lit("[redacted]"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat2) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def ipv4_to_long(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return sum((F.get(parts, F.lit(k)).cast("long") * 256 ** (3 - k) for k in range(1, 4)), F.get(parts, F.lit(0)).cast("long") * 256**3)


def ip_hex(ip: Column) -> Column:
    """An address as text that sorts like it: ``4`` and 8, or ``6`` and 32, hexadecimal digits; null where it is none."""
    parts = F.split(ip, r"\.")
    is_v4 = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    octets = lambda p: F.concat(*[F.lpad(F.lower(F.hex(F.get(p, F.lit(k)).cast("long"))), 2, "0") for k in range(4)])
    low = F.lower(ip)
    # An IPv4 tail becomes two groups.
    tail = F.regexp_extract(low, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    tail_hex = octets(F.split(tail, r"\."))
    whole = F.when(tail != "", F.concat(F.regexp_replace(low, r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(tail_hex, 1, 4), F.lit(":"), F.substring(tail_hex, 5, 4))).otherwise(low)
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    halves = F.split(whole, "::")
    head, rest = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    gap = F.greatest(F.lit(8) - F.size(head) - F.size(rest), F.lit(0))
    filled = F.concat(head, F.array_repeat(F.lit("0"), gap), rest)
    is_v6 = whole.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") & ~whole.rlike(r":::|::.*::|^:[^:]|[^:]:$|[0-9a-f]{5}") & (F.size(filled) == 8) & ((F.size(halves) == 2) | (F.size(head) == 8)) & (F.size(halves) <= 2)
    v6 = F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(is_v4, F.concat(F.lit("4"), octets(parts))).when(is_v6, F.concat(F.lit("6"), v6))


_BINARY = [f"{v:04b}" for v in range(16)]


def cidr_bounds(cidr: Column) -> tuple[Column, Column, Column]:
    """(least address, greatest address, whole hexadecimal digits that all share), as :func:`ip_hex` writes them.

    A range without a length is one address; host bits are ignored.
    """
    base = ip_hex(F.get(F.split(cidr, "/"), F.lit(0)))
    width = F.length(base) - 1
    bits = F.coalesce(F.get(F.split(cidr, "/"), F.lit(1)).try_cast("int"), width * 4)
    digits, left = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    fixed = F.substring(base, F.lit(1), digits + 1)
    # The digit that the range cuts: its first ``left`` bits stay.
    at = F.conv(F.substring(base, digits + 2, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), F.lit(4) - left).cast("int")
    low = F.when(left > 0, F.lower(F.hex((at - at % step).cast("long")))).otherwise(F.lit(""))
    high = F.when(left > 0, F.lower(F.hex((at - at % step + step - 1).cast("long")))).otherwise(F.lit(""))
    sound = (bits >= 0) & (bits <= width * 4)
    pad = lambda end, digit: F.when(sound, F.rpad(F.concat(fixed, end), width + 1, digit))
    return pad(low, "0"), pad(high, "f"), F.when(sound, fixed)


def cidr_join(logs: DataFrame, feeds: DataFrame, ip: str = "ip") -> DataFrame:
    """Rows of ``logs`` with ``feeds``, all feeds whose ``cidr`` holds their address, in order, and ``feed``, the first.

    IPv4 and IPv6 alike, on distinct addresses: ranges and addresses meet by the leading digits that all of a range's addresses share,
    of as many lengths as the feeds have (36 at most), and the bounds are checked among those that meet.
    """
    low, high, shared = cidr_bounds(F.col("cidr"))
    ranges = feeds.select("feed", low.alias("lo"), high.alias("hi"), shared.alias("shared")).filter("lo IS NOT NULL")
    lengths = ranges.select(F.struct(F.substring("shared", 1, 1).alias("v"), F.length("shared").alias("n")).alias("x")).distinct().agg(F.collect_list("x").alias("lengths"))
    ips = logs.select(ip).distinct().withColumn("h", ip_hex(F.col(ip))).filter("h IS NOT NULL").crossJoin(F.broadcast(lengths))
    ips = ips.select(ip, "h", F.explode(F.filter("lengths", lambda x: x["v"] == F.substring("h", 1, 1))).alias("x"))
    hits = ips.withColumn("shared", F.expr("substring(h, 1, x.n)")).join(ranges, "shared").filter("h BETWEEN lo AND hi").groupBy(ip).agg(F.array_sort(F.collect_set("feed")).alias("feeds"))
    return logs.join(hits, ip, "left").withColumn("feed", F.get("feeds", F.lit(0)))


def filter_spec(logs: DataFrame, spec: Mapping[str, Mapping], types: Mapping[str, str] | None = None) -> DataFrame:
    """Rows that meet ``{field: {mode: include|exclude, values: [...]}}``.

    Values are compared as strings; ``*`` is a wildcard (case-insensitive), None matches null; a field that is
    missing matches nothing (include) or excludes nothing; ttl and age are compared rounded.
    """
    keep = F.lit(True)
    for name, rule in spec.items():
        include = rule.get("mode", "include") == "include"
        if name not in logs.columns:
            keep = keep & F.lit(not include)
            continue
        column = F.round(name).cast("int").cast("string") if name in ("ttl", "age") else F.col(name).cast("string")
        hit = F.lit(False)
        plain = [str(v) for v in rule["values"] if v is not None and "*" not in str(v)]
        if plain:
            hit = hit | F.coalesce(column.isin(*plain), F.lit(False))
        for v in (str(v) for v in rule["values"] if v is not None and "*" in str(v)):
            escaped = v.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
            hit = hit | F.coalesce(column.ilike(escaped), F.lit(False))
        if any(v is None for v in rule["values"]):
            hit = hit | column.isNull()
        keep = keep & (hit if include else ~hit)
    return logs.filter(keep)


def time_range(logs: DataFrame, start: str, end: str) -> DataFrame:
    """Closed time filter, with bounds on the partition columns that it implies where the table has them."""
    ts = F.col("timestamp")
    out = logs.filter(ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if "dt" in logs.columns:
        out = out.filter(F.col("dt").cast("string").between(start[:10], end[:10]))
    if "timestamp_hour" in logs.columns:
        out = out.filter(F.col("timestamp_hour").between(start[:13].replace(" ", "-"), end[:13].replace(" ", "-")))
    return out


def exclude_invalid(logs: DataFrame, beacon: str = "/rum-beacon") -> DataFrame:
    out = logs.filter(F.col("ip").isNotNull() & (F.col("ip") != ""))
    return out.filter(F.col("url").isNull() | ~F.col("url").startswith(beacon)) if "url" in logs.columns else out


def csv_contains(column: str, values: Sequence[str]) -> Column:
    items = F.transform(F.split(F.col(column), ","), lambda x: F.trim(x))
    out = F.lit(True)
    for v in values:
        out = out & F.array_contains(items, v)
    return out


def time_bucket(ts: Column, width: str) -> Column:
    return F.window(ts, width).getField("start")


def adaptive_bucket(hours: float) -> str:
    """Bucket width for a time span."""
    for top, width in ((2, "1 minute"), (12, "5 minutes"), (48, "15 minutes"), (24 * 7, "1 hour"), (24 * 31, "4 hours")):
        if hours <= top:
            return width
    return "1 day"


def zero_fill(series: DataFrame, start: str, end: str, width: str = "1 hour", column: str = "bucket") -> DataFrame:
    """All buckets from ``start`` to ``end``, with zeros where ``series`` has none."""
    spine = series.sparkSession.range(1).select(F.explode(F.expr(f"sequence(TIMESTAMP_NTZ '{start}', TIMESTAMP_NTZ '{end}', INTERVAL {width})")).alias(column))
    return spine.join(series, column, "left").fillna(0)


def ensure_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Null columns for those of ``types`` that are missing."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def io_cost(monthly: DataFrame, tiers: DataFrame, column: str = "transforms") -> DataFrame:
    """Cost of a month's count at marginal tier prices; ``tiers`` (lo, hi, price) is a short price list."""
    return monthly.join(F.broadcast(tiers), F.col(column) > F.col("lo")).withColumn("part", (F.least(F.col(column), F.coalesce("hi", column)) - F.col("lo")) * F.col("price")).groupBy(*monthly.columns).agg(F.sum("part").alias("cost"))
