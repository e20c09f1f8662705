"""Web addresses: canonical form of absolute ones by expressions, of references by a vectorised function."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visitors.
TRACKING_PREFIX, TRACKING = "utm_", ["gclid", "fbclid"]
#: Addresses that are no destinations of a crawl. Of version 6 only 2000::/3 is in use.
NOT_PUBLIC = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3 "
    "2001::/32 2001:2::/48 2001:10::/28 2001:20::/28 2001:db8::/32 2002::/16 3fff::/20"
).split()
#: Suffixes of two labels below which names are registered. A stand-in for the public list, which callers may give whole.
SUFFIXES = "co.uk org.uk ac.uk com.jo net.jo org.jo gov.jo edu.jo com.au com.br com.cn com.eg com.sa com.tr co.jp co.kr co.in co.za".split()
LABEL = r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
HOST = rf"^(?=.{{1,253}}$){LABEL}(\.{LABEL})*$"


def canonical_absolute(url: Column) -> Column:
    """SCA-27 for absolute addresses: scheme and host in lower case, default port, fragment and tracking parameters dropped.

    Null for other schemes, user information, bad hosts and ports. Dot segments are left to ``resolve``.
    """
    s = F.regexp_replace(url, r"^\s+|\s+$", "")
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    scheme, authority = F.lower(F.regexp_extract(s, pattern, 1)), F.regexp_extract(s, pattern, 2)
    path, query = F.regexp_extract(s, pattern, 3), F.substr(F.regexp_extract(s, pattern, 4), F.lit(2))
    host = F.rtrim(F.lower(F.regexp_extract(authority, r"^([^:]*)(:(\d*))?$", 1)), F.lit("."))
    port = F.regexp_extract(authority, r"^([^:]*)(:(\d*))?$", 3)
    number = port.try_cast("int")
    keep = F.filter(F.split(query, "&"), lambda p: ~_tracking(p))
    rest = F.nullif(F.array_join(keep, "&"), F.lit(""))
    default = ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    shown = F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), number.cast("string")))
    good = s.rlike(pattern) & ~s.rlike(r"[\s<>\"{}|\\^`]") & scheme.isin("http", "https") & ~authority.contains("@") & host.rlike(HOST) & ((port == "") | number.between(1, 65535))
    return F.when(good, F.concat(scheme, F.lit("://"), host, shown, path, F.coalesce(F.concat(F.lit("?"), rest), F.lit(""))))


def _tracking(parameter: Column) -> Column:
    raw = F.substring_index(parameter, "=", 1)
    key = F.lower(F.coalesce(F.try_url_decode(raw), raw))
    return key.startswith(TRACKING_PREFIX) | key.isin(*TRACKING)


def ascii_host(host: str | None) -> str | None:
    """SCA-28: lower case, no trailing dot; addresses of version 6 in short form; null if it is no host name."""
    if host is None:
        return None
    h = host.strip().rstrip(".")
    if h.startswith("[") and h.endswith("]"):
        h = h[1:-1]
    if not h or not h.isascii():
        return None
    if ":" in h:
        try:
            return str(ipaddress.IPv6Address(h))
        except ValueError:
            return None
    return h.lower() if re.match(HOST, h.lower()) else None


def resolve_one(page: str | None, reference: str | None) -> str | None:
    """SCA-27: a reference on a page as a canonical address, or null."""
    ref = (reference or "").strip()
    if not page or not ref or ref.startswith("#") or re.search(r"[\s<>\"{}|\\^`]", ref):
        return None
    try:
        parts = urlsplit(urljoin(page, ref))
        scheme, port = parts.scheme.lower(), parts.port
    except ValueError:
        return None
    host = ascii_host(parts.hostname)
    if scheme not in ("http", "https") or "@" in parts.netloc or host is None or port == 0:
        return None
    shown = f"[{host}]" if ":" in host else host
    if port is not None and (scheme, port) not in (("http", 80), ("https", 443)):
        shown = f"{shown}:{port}"
    query = "&".join(p for p in parts.query.split("&") if not _is_tracking(p))
    return f"{scheme}://{shown}{parts.path}" + (f"?{query}" if query else "")


def _is_tracking(parameter: str) -> bool:
    key = unquote_plus(parameter.split("=", 1)[0]).lower()
    return key.startswith(TRACKING_PREFIX) or key in TRACKING


def resolve_pairs(pages: pd.Series, references: pd.Series) -> pd.Series:
    return pd.Series([resolve_one(p, r) for p, r in zip(pages, references, strict=True)], dtype="object")


def resolve(page: Column, reference: Column) -> Column:
    """A reference on a page as a canonical address; a pandas UDF, since dot segments need a loop."""
    return F.pandas_udf(resolve_pairs, "string")(page, reference)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def partition_key(url: Column, is_product: Column) -> Column:
    """SCA-29: the path without a slash at its end; of product pages the parent's."""
    path = F.regexp_replace(url_path(url), "/+$", "")
    parent = F.regexp_replace(path, "/[^/]*$", "")
    return F.coalesce(F.nullif(F.when(is_product, parent).otherwise(path), F.lit("")), F.lit("/"))


def valid_crawl_host(host: Column) -> Column:
    """FLT-12: a bare host name: no scheme, bracket, address of version 4 or port."""
    return ~host.rlike(r"://|[\[\]]|^\d+\.\d+\.\d+\.\d+$|:\d+$") & (F.trim(host) != "")


def safe_link(url: Column) -> Column:
    """FLT-17: an address that browsers may open."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(False))


def host_allowed(host: Column, own: Column, allowed: Column) -> Column:
    """FLT-8: the supplier's host or a host below it, or one allowed by name or below one."""
    below = lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h))
    return below(F.lower(own)) | F.coalesce(F.exists(allowed, lambda a: below(F.lower(a))), F.lit(False))


def address_hex(address: Column) -> Column:
    """Digits of an address, 8 of version 4 and 32 of version 6, which sort as the addresses do; null if it is none."""
    a = F.regexp_replace(F.lower(F.btrim(address, F.lit("[]"))), r"^::ffff:(?=\d+\.\d+\.\d+\.\d+$)", "")
    octets = F.transform(F.split(a, r"\."), lambda x: x.try_cast("int"))
    short = F.array_join(F.transform(octets, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    four = F.when(a.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda x: x <= 255), F.lower(short))
    groups = lambda c: F.filter(F.split(c, ":"), lambda x: x != "")
    left = groups(F.substring_index(a, "::", 1))
    right = F.when(a.contains("::"), groups(F.substring_index(a, "::", -1))).otherwise(F.array().cast("array<string>"))
    left_out = F.when(a.contains("::"), 8 - F.size(left) - F.size(right)).otherwise(0)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(left_out, F.lit(0))), right)
    good = a.contains(":") & ~a.rlike("::.*::|:::|^:[^:]|[^:]:$") & (~a.contains("::") | (left_out > 0)) & (F.size(whole) == 8) & F.forall(whole, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    return F.coalesce(four, F.when(good, F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), "")))


def public_address(address: Column) -> Column:
    """FLT-9: whether an address is one of the public internet; neither are tunnels of version 4 in version 6. False for what is no address."""
    digits = address_hex(address)
    within = F.lit(False)
    for n in map(ipaddress.ip_network, NOT_PUBLIC):
        within = within | ((F.length(digits) == 2 * len(n[0].packed)) & digits.between(n[0].packed.hex(), n[-1].packed.hex()))
    used = (F.length(digits) == 8) | (digits.substr(1, 1).isin("2", "3") & ~digits.substr(17, 8).isin("00005efe", "02005efe"))
    return F.coalesce(used & ~within, F.lit(False))


def registrable_domain(host: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The last two labels, or three below a suffix of two; null for addresses, single labels and suffixes themselves. As exact as ``suffixes`` are complete."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(host.contains(".") & ~host.contains(":") & ~host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.when(~two.isin(*suffixes), two).when(three != two, three))


def fetch_refusal(url: Column, supplier_host: Column, explicit_hosts: Column, addresses: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """FLT-9: why an address may not be fetched, or null if it may: the first reason that holds.

    The supplier's registrable domain and hosts below it are allowed, others only if named exactly in ``explicit_hosts``. ``addresses`` are
    those that the host resolves to; all of them must be public.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    pattern = r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::(\d*))?$"
    port = F.nullif(F.regexp_extract(authority, pattern, 2), F.lit(""))
    tidy = lambda h: F.rtrim(F.lower(F.trim(h)), F.lit("."))
    host, own = tidy(F.regexp_extract(authority, pattern, 1)), tidy(supplier_host)
    is_host = lambda h: F.coalesce(h.rlike(HOST) | (h.startswith("[") & address_hex(h).isNotNull()), F.lit(False))
    domain = registrable_domain(own, suffixes)
    near = F.when(domain.isNull(), host == own).otherwise((host == domain) | host.endswith(F.concat(F.lit("."), domain)))
    named = F.coalesce(F.exists(explicit_hosts, lambda h: tidy(h) == host), F.lit(False))
    bad_port = port.isNotNull() & ~F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False))
    return (
        F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "UNSUPPORTED_SCHEME")
        .when(authority.contains("@") | bad_port | ~is_host(host) | ~is_host(own), "INVALID_HOST")
        .when(~(near | named), "HOST_NOT_ALLOWED")
        .when(F.coalesce(F.size(addresses), F.lit(0)) <= 0, "DNS_RESOLUTION_FAILED")
        .when(~F.forall(addresses, public_address), "NON_PUBLIC_ADDRESS")
    )


def api_evidence(page_url: Column, urls: Column) -> Column:
    """FLT-13: whether a page or one of the addresses in its embedded JSON belongs to an API."""
    pattern = r"/(api|graphql)/"
    return url_path(page_url).rlike(pattern) | F.coalesce(F.exists(urls, lambda u: u.rlike(pattern)), F.lit(False))


def resource_accepted(kind: Column, media_type: Column) -> Column:
    """FLT-18: media types that a rendered page may load, by kind of resource."""
    m = F.lower(F.substring_index(media_type, ";", 1))
    return (
        F.when(kind == "document", m.isin("text/html", "application/xhtml+xml"))
        .when(kind == "script", m.contains("javascript") | m.contains("ecmascript"))
        .when(kind == "stylesheet", m == "text/css")
        .when(kind.isin("xhr", "fetch"), m.isin("application/json", "text/plain", "text/html", "application/xml", "text/xml") | m.endswith("+json") | m.endswith("+xml"))
        .otherwise(False)
    )
