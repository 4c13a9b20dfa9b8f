"""Scalar functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The patterns that inputs must match.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "username": r"^[a-zA-Z0-9_-]{3,30}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "phone": r"^[0][0-9]{9,10}$",
    "mobile": r"^(0|84)(3|5|7|8|9)([0-9]{8})$",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title(text) -> Column:
    """The first 50 characters and an ellipsis, always."""
    return F.concat(F.left(_c(text), F.lit(50)), F.lit("..."))


def message_preview(role, text) -> Column:
    """``ROLE: first 50...``."""
    return F.concat(F.upper(_c(role)), F.lit(": "), title(text))


def tags(text) -> Column:
    """Comma-separated items, trimmed, without the empty ones."""
    return F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def valid(kind: str, value) -> Column:
    """Whether a value passes the validator of a kind: one of PATTERNS, or password."""
    v = _c(value)
    if kind == "password":
        ok = (F.length(v) >= 8) & v.rlike("[A-Z]") & v.rlike("[0-9]") & v.rlike(r"[!@#$%^&*()_+\-=\[\]{}|;:,.<>?]")
    elif kind == "email":
        ok = F.lower(F.trim(v)).rlike(PATTERNS[kind]) & (F.length(F.trim(v)) <= 254)
    elif kind in PATTERNS:
        ok = v.rlike(PATTERNS[kind])
    else:
        raise ValueError(f"no validator for {kind}")
    return F.coalesce(ok, F.lit(False))


def valid_by(kind, value) -> Column:
    """Whether each row's value passes the validator that the row's kind names; null for an unknown kind."""
    k, ok = _c(kind), F.lit(None).cast("boolean")
    for name in (*PATTERNS, "password"):
        ok = F.when(k == name, valid(name, value)).otherwise(ok)
    return ok


def extension(path) -> Column:
    """The extension with its dot, or the empty string."""
    return F.regexp_extract(_c(path), r"(\.[A-Za-z0-9]+)$", 1)


def stem(path) -> Column:
    """The last part of the path without its extension."""
    return F.regexp_extract(_c(path), r"([^/]*?)(\.[A-Za-z0-9]+)?$", 1)


def action(method, path) -> Column:
    """The audit action of an HTTP request."""
    p = F.lower(_c(path))
    post = F.when(p.contains("upload"), "UPLOAD").when(p.contains("create"), "CREATE").when(p.contains("import"), "IMPORT").otherwise("CREATE")
    m = _c(method)
    return F.when(m == "POST", post).when(m.isin("PUT", "PATCH"), "UPDATE").when(m == "DELETE", "DELETE").otherwise("MUTATION")


def _parts(path) -> Column:
    return F.split(F.regexp_replace(F.trim(_c(path), F.lit("/")), r"^(api/)?(v[0-9]+/)?", ""), "/")


def resource(path) -> Column:
    """The resource of an API path, its api and version parts left out."""
    return F.get(_parts(path), F.lit(0))


def resource_id(path) -> Column:
    """The number or UUID after the resource."""
    part = F.get(_parts(path), F.lit(1))
    return F.when(F.lower(part).rlike("^([0-9]+|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$"), part)


def client_ip(forwarded, real, remote) -> Column:
    """The first forwarded address, else the real one, else the remote one (45 characters)."""
    first = F.trim(F.get(F.split(_c(forwarded), ","), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(_c(real), F.lit("")), F.left(_c(remote), F.lit(45)))


#: Words in a folder's name, in order of precedence, and its icon.
ICONS = {"project": "work", "design": "design_services", "technical": "engineering", "hr": "group", "finance": "payments", "report": "assessment"}


def icon(name) -> Column:
    """The icon of a folder by words in its name."""
    out = F.lit("folder")
    for word, sign in reversed(ICONS.items()):
        out = F.when(F.contains(F.lower(_c(name)), F.lit(word)), sign).otherwise(out)
    return out


def initials(name, most: int = 2) -> Column:
    """First letters of the first words, in capitals."""
    return F.upper(F.array_join(F.transform(F.slice(F.split(_c(name), " "), 1, most), lambda x: F.left(x, F.lit(1))), ""))


def human_size(n) -> Column:
    """Bytes with a unit from B to GB and two decimals above B; larger sizes stay GB."""
    v = _c(n).cast("double")
    power = F.least(F.lit(3), F.when(v < 1024, 0).when(v < 1024**2, 1).when(v < 1024**3, 2).otherwise(3))
    unit = F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power)
    return F.when(power == 0, F.concat(_c(n).cast("long").cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.2f", F.round(v / F.pow(F.lit(1024.0), power), 2)), F.lit(" "), unit))


def relative_time(ts, now: str) -> Column:
    """Age in words: just now, hours, days, weeks, else the date; whole seconds of both times count, not the fraction between them."""
    second = lambda c: F.date_trunc("second", c.cast("timestamp"))
    s = F.timestamp_diff("SECOND", second(_c(ts)), second(F.lit(now)))
    count = lambda n, unit: F.concat(F.floor(s / n).cast("long").cast("string"), F.lit(f" {unit}"))
    return F.when(s < 3600, "just now").when(s < 86_400, count(3600, "hours")).when(s < 604_800, count(86_400, "days")).when(s < 2_592_000, count(604_800, "weeks")).otherwise(F.date_format(_c(ts), "yyyy-MM-dd"))


def page_strip(current, total: int, most: int = 5) -> Column:
    """Up to five page numbers around the current one, within 1 to total."""
    first = F.greatest(F.lit(1), F.least(current - most // 2, F.lit(total - most + 1)))
    return F.sequence(first.cast("long"), F.least(first + most - 1, F.lit(total)).cast("long"))
