"""Routes, addresses and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "/$", ""), "/", -1)


def route_matches(route: Column | str, path: Column | str) -> Column:
    """Whether a path has as many segments as a route and each is equal or stands for ``:name`` or ``{name}``."""
    a, b = (_parts(F.col(x) if isinstance(x, str) else x) for x in (route, path))
    fits = lambda s, t: (s == t) | s.rlike(r"^:\w+$") | s.rlike(r"^\{\w+\}$")
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, fits), lambda ok: F.coalesce(ok, F.lit(False)))


def join_route(*parts: Column) -> Column:
    """Parts joined by single slashes, empty ones left out."""
    trimmed = F.transform(F.array(*parts), lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", ""))
    return F.array_join(F.filter(trimmed, lambda p: p != ""), "/")


def contains_path(path: Column, file: Column) -> Column:
    """Whether ``file`` is ``path`` or lies under it; ``.`` holds everything."""
    return (path == ".") | (file == path) | file.startswith(F.concat(path, F.lit("/")))


def url_part(url: Column | str, part: str) -> Column:
    return F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit(part))


def request_url(setting_base: Column, address: Column) -> Column:
    """The address after its base; null unless it is http or https without user information."""
    whole = F.concat(F.coalesce(setting_base, F.lit("")), F.coalesce(address, F.lit("")))
    sound = url_part(whole, "PROTOCOL").isin("http", "https") & url_part(whole, "USERINFO").isNull() & url_part(whole, "HOST").isNotNull()
    return F.when(F.coalesce(sound, F.lit(False)), whole)


def clean_address(address: Column) -> Column:
    """An address without user information, query and fragment; null if it may hold a connection string."""
    bare = F.regexp_replace(F.regexp_replace(address, r"[?#].*$", ""), r"^(\w+://)[^/@]*@", "$1")
    return F.when(~bare.rlike("[=;]"), bare)


def public_endpoint(url: Column | str) -> Column:
    """Whether an address is http or https and has no user information, query or fragment."""
    value = F.col(url) if isinstance(url, str) else url
    plain = url_part(value, "PROTOCOL").isin("http", "https") & url_part(value, "HOST").isNotNull() & url_part(value, "USERINFO").isNull()
    return F.coalesce(plain & ~value.rlike("[?#]."), F.lit(False))
