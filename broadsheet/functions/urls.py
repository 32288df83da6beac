"""Canonical URLs, item ids and the fetchable-address predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import trim_space
from broadsheet.session import let

# Query parameters that say nothing about the document, as one pattern.
TRACKING = (
    r"(?i)^(?:utm_.*|ref|ref_.*|fbclid|gclid|mc_cid|mc_eid|igshid|source"
    r"|__twitter_impression|spm)$"
)

# Name endings that only resolve inside a network.
PRIVATE_SUFFIXES = [".local", ".localhost", ".internal", ".intranet", ".home.arpa"]

# scheme, authority, path, query
_WEB = r"(?is)^(https?|ftp|wss?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?"
_OTHER = r"(?is)^([a-z][a-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
_AUTHORITY = r"^(?:[^@]*@)*(\[[0-9A-Fa-f:.]+\]|[^\s:<>\[\]^|%@]+)(?::(\d{0,5}))?$"
_UNSAFE = r"[^\x21-\x7E]|[\"<>`{}^]"


def _encoded_path(path: Column) -> Column:
    """Percent-encode what a URL path may not hold; most paths need nothing."""

    def encode(ch: Column) -> Column:
        escaped = F.regexp_replace(F.url_encode(ch), r"\+", "%20")
        return F.when(ch.rlike(_UNSAFE), escaped).otherwise(ch)

    letters = F.transform(F.split(path, ""), encode)
    return F.when(path.rlike(_UNSAFE), F.array_join(letters, "")).otherwise(path)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    parent = r"(?i)^(?:\.|%2e){2}$"
    here = r"(?i)^(?:\.|%2e)$"

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return (
            F.when(segment.rlike(parent), up)
            .when(segment.rlike(here), done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    segments = F.split(path, "/")
    resolved = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.array(F.lit("")),
        step,
    )
    dotted = path.rlike(r"(?i)(^|/)(?:\.|%2e){1,2}(/|$)")
    return F.when(dotted, F.array_join(resolved, "/")).otherwise(path)


def _clean_query(query: Column) -> Column:
    """Decoded ``k=v`` pairs without tracking parameters, ordered by key then value."""

    def decoded(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), text)

    pairs = F.transform(
        F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda p: p != ""),
        lambda p: F.struct(
            decoded(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
            decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def _v4_part(part: Column) -> Column:
    """A decimal, octal or hexadecimal part of an address; null when it is no number."""
    bare = F.regexp_replace(part, "^0x0*|^0+", "")

    def number(base: int, longest: int) -> Column:
        # A longer number is beyond every address; it would overflow the conversion.
        return F.when(F.length(bare) > longest, F.lit(1 << 40)).otherwise(
            F.conv(F.concat(F.lit("0"), bare), base, 10).cast("bigint")
        )

    return (
        F.when(part.rlike("^0x[0-9a-f]*$"), number(16, 8))
        .when(part.rlike("^0[0-7]*$"), number(8, 11))
        .when(part.rlike("^[1-9][0-9]*$"), number(10, 10))
    )


def _plain_v4(host: Column) -> Column:
    """Every spelling of an IPv4 address as a dotted quad; null when it is a wrong one.

    One to four parts, the last filling the bytes that are left; a stop at the end is
    allowed. Hosts whose last part is no number are names and stay.
    """

    def read(parts: Column) -> Column:
        n = F.size(parts)
        last = F.element_at(parts, -1)
        front = F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))
        right = (n <= 4) & F.forall(front, lambda p: p <= 255) & (last < F.pow(F.lit(256.0), 5 - n))
        whole = last + F.aggregate(
            F.zip_with(front, F.slice(F.array(*(F.lit(1 << s) for s in (24, 16, 8))), 1, F.greatest(n - 1, F.lit(0))), lambda p, w: p * w),
            F.lit(0).cast("bigint"),
            lambda a, b: a + b,
        )
        quad = F.concat_ws(".", *(F.shiftright(whole, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))
        return F.when(F.coalesce(right, F.lit(False)) & F.forall(parts, lambda p: p.isNotNull()), quad)

    parts = F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _v4_part)
    numeric = host.rlike(r"(^|\.)(\d+|0x[0-9a-f]*)\.?$")
    return F.when(numeric, let(parts, read)).otherwise(host)


def _groups_v6(host: Column) -> Column:
    """The eight groups of a bracketed IPv6 address as numbers; null when it is a wrong one."""
    inner = F.regexp_replace(host, r"^\[|\]$", "")
    tail = F.regexp_extract(inner, r"(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    octets = F.transform(F.split(tail, r"\."), lambda p: p.try_cast("int"))
    pair = let(
        octets,
        lambda o: F.concat_ws(
            ":",
            F.lower(F.hex(F.shiftleft(o[0], 8) + o[1])),
            F.lower(F.hex(F.shiftleft(o[2], 8) + o[3])),
        ),
    )
    plain = F.when(tail != "", F.concat(F.regexp_replace(inner, r"\d{1,3}(?:\.\d{1,3}){3}$", ""), pair)).otherwise(inner)

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    def read(halves: Column) -> Column:
        left, right = groups(halves[0]), F.when(F.size(halves) == 2, groups(halves[1])).otherwise(F.array().cast("array<string>"))
        gap = F.when(F.size(halves) == 2, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))).otherwise(F.array().cast("array<string>"))
        return let(
            F.concat(left, gap, right),
            lambda g: F.when(
                (F.size(halves) <= 2) & (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")),
                F.transform(g, lambda x: F.conv(x, 16, 10).cast("int")),
            ),
        )

    return let(F.split(plain, "::", 3), read)


def _parts(url: Column) -> Column:
    """Scheme, host, port, path and query of a trimmed URL; a null host means unparseable."""
    web = url.rlike(r"(?i)^(?:https?|ftp|wss?):")
    other = url.rlike(_OTHER)

    def piece(group: int) -> Column:
        return (
            F.when(web, F.regexp_extract(url, _WEB, group))
            .when(other, F.regexp_extract(url, _OTHER, group))
            .otherwise(F.lit(""))
        )

    authority = piece(2)
    host = F.lower(F.regexp_extract(authority, _AUTHORITY, 1))
    return F.struct(
        F.lower(piece(1)).alias("scheme"),
        F.when(web & (host != ""), F.when(host.startswith("["), F.when(_groups_v6(host).isNotNull(), host)).otherwise(_plain_v4(host)))
        .when(~web & other, host)
        .alias("host"),
        F.regexp_extract(authority, _AUTHORITY, 2).alias("port"),
        F.when(web, F.regexp_replace(piece(3), r"\\", "/")).otherwise(piece(3)).alias("path"),
        piece(4).alias("query"),
        F.contains(authority, F.lit("@")).alias("credentials"),
    )


def canonical_url(url: Column) -> Column:
    """One spelling per document: no scheme, ``www.``, tracking, fragment or end slash.

    Query parameters are ordered by their bytes. Text that is no URL is lowercased.
    """

    def assemble(u: Column) -> Column:
        query = _clean_query(u["query"])
        path = F.regexp_replace(_without_dots(_encoded_path(u["path"])), "/+$", "")
        port = F.when(
            u["port"].rlike(r"[1-9]") & ~u["port"].isin("80", "443"),
            F.concat(F.lit(":"), F.regexp_replace(u["port"], "^0+", "")),
        ).otherwise(F.lit(""))
        return F.concat(
            F.regexp_replace(u["host"], r"^www\.", ""),
            port,
            path,
            let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))),
        )

    trimmed = trim_space(url)
    fallback = F.regexp_replace(F.lower(trimmed), "/+$", "")
    return F.coalesce(
        let(_parts(trimmed), lambda u: F.when(u["host"].isNotNull(), assemble(u))), fallback
    )


def item_id(url: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the canonical URL."""
    return F.substring(F.sha2(canonical_url(url), 256), 1, 16)


def host_name(url: Column) -> Column:
    """Host without ``www.``; the text itself when it is no URL."""
    return F.coalesce(
        let(_parts(trim_space(url)), lambda u: F.regexp_replace(u["host"], r"^www\.", "")), url
    )


def _private_v4(octets: Column) -> Column:
    """Whether four octets lie in a private, local or reserved range."""
    a, b = F.element_at(octets, 1), F.element_at(octets, 2)
    return (
        a.isin(0, 10, 127)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & b.isin(0, 168))
        | ((a == 100) & b.between(64, 127))
        | (a >= 224)
    )


def _dotted_private(host: Column) -> Column:
    """Private test of a dotted quad; false for anything that is not one."""
    octets = F.transform(F.split(host, r"\."), lambda p: p.try_cast("int"))
    valid = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(
        valid,
        let(octets, lambda o: F.forall(o, lambda n: n <= 255) & _private_v4(o)),
    ).otherwise(F.lit(False))


def _private_v6(host: Column) -> Column:
    """Unspecified, loopback, unique local, link-local, or a mapped private IPv4 address."""

    def judge(g: Column) -> Column:
        zeros = F.forall(F.slice(g, 1, 5), lambda x: x == 0)
        high, low = g[6], g[7]
        mapped = F.array(
            F.shiftright(high, 8), high.bitwiseAND(F.lit(255)), F.shiftright(low, 8), low.bitwiseAND(F.lit(255))
        )
        return (
            (zeros & (g[5] == 0) & (high == 0) & (low <= 1))
            | (zeros & (g[5] == 0xFFFF) & _private_v4(mapped))
            | (g[0].bitwiseAND(F.lit(0xFE00)) == 0xFC00)
            | (g[0].bitwiseAND(F.lit(0xFFC0)) == 0xFE80)
        )

    return F.coalesce(let(_groups_v6(host), judge), F.lit(True))


def is_fetchable(url: Column) -> Column:
    """Plain http(s), no credentials, and not addressed at a private network."""

    def judge(u: Column) -> Column:
        host = u["host"]
        inside = (host == "localhost") | host.rlike(
            "(?:" + "|".join(s.replace(".", r"\.") for s in PRIVATE_SUFFIXES) + ")$"
        )
        return (
            u["scheme"].isin("http", "https")
            & ~u["credentials"]
            & host.isNotNull()
            & ~inside
            & F.when(host.startswith("["), ~_private_v6(host))
            .when(host.rlike(r"^[\d.]+$"), ~_dotted_private(host))
            .otherwise(F.lit(True))
        )

    return F.coalesce(let(_parts(trim_space(url)), judge), F.lit(False))
