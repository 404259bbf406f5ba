"""What the DSL's transforms do to a Column."""

from __future__ import annotations

import re
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug"]
FACILITIES = ["kernel", "user-level", "mail", "daemon", "security/authorization", "syslogd", "line printer", "network news", "uucp", "clock", "security/authorization", "ftp", "ntp", "log audit", "log alert", "clock", *[f"local{i}" for i in range(8)]]


def java_pattern(joda: str) -> str:
    """A date pattern for Spark: the letters that differ from Joda's are changed."""
    out, quoted = [], False
    for c in joda:
        quoted ^= c == "'"
        out.append({"Y": "y", "Z": "XX", "x": "Y"}.get(c, c) if not quoted else c)
    return re.sub(r"(XX)+", "XX", "".join(out))


def parse_date(column: Column, formats: list[str], timezone: str | None = None) -> Column:
    """The first format that fits; ISO8601, UNIX and UNIX_MS by name; null if none does."""
    tries = []
    for f in formats:
        if f == "ISO8601":
            tries.append(F.try_to_timestamp(column))
        elif f == "UNIX":
            tries.append(F.timestamp_seconds(column.try_cast("double")))
        elif f == "UNIX_MS":
            tries.append(F.timestamp_millis(column.try_cast("long")))
        else:
            tries.append(F.try_to_timestamp(column, F.lit(java_pattern(f))))
    out = F.coalesce(*tries)
    return F.to_utc_timestamp(out, timezone) if timezone else out


def decode_base64(column: Column, url_safe: bool = False) -> Column:
    plain = F.translate(column, "-_", "+/") if url_safe else column
    return F.decode(F.try_to_binary(plain, F.lit("base64")), "utf-8")


def gsub(column: Column, pattern: str, replacement: str) -> Column:
    r"""All matches replaced; back-references are written \1."""
    safe = re.sub(r"\\(\d)", "\x00\\1", replacement).replace("\\", "\\\\").replace("$", "\\$").replace("\x00", "$")
    return F.regexp_replace(column, pattern, safe)


def number_of_bytes(column: Column) -> Column:
    """10 KB, 3.5MiB and the like as a number of bytes."""
    amount = F.regexp_extract(column, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(column, r"^\s*[0-9.]+\s*([A-Za-z]*)", 1))
    scale = F.lit(1.0)
    for power, letter in enumerate("kmgtp", 1):
        scale = F.when(unit.isin(letter, letter + "b"), F.lit(1000.0**power)).when(unit == letter + "ib", F.lit(1024.0**power)).otherwise(scale)
    return F.floor(amount * scale)


def normal_mac(column: Column) -> Column:
    """Lower-case, two digits between colons."""
    digits = F.lower(F.regexp_replace(column, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(digits) == 12, F.regexp_replace(digits, "(..)(?!$)", "$1:"))


def ip_number(column: Column) -> Column:
    """An IPv4 address as a long; null for anything else."""
    parts = F.split(column, r"\.")
    part = lambda i: F.get(parts, i).try_cast("long")
    ok = column.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*[part(i) for i in range(4)]) <= 255)
    return F.when(ok, part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def ip6_digits(column: Column) -> Column:
    """An IPv6 address as its 32 hexadecimal digits; null for anything else."""
    halves = F.split(F.lower(column), "::")
    parts = lambda i: F.filter(F.split(F.coalesce(F.get(halves, i), F.lit("")), ":"), lambda p: p != "")
    missing = 8 - F.size(parts(0)) - F.size(parts(1))
    padded = lambda a: F.transform(a, lambda p: F.lpad(p, 4, "0"))
    zeros = F.array_repeat(F.lit("0000"), F.greatest(missing, F.lit(0)))
    short = F.size(halves) == 2
    ok = column.rlike(r"^[0-9A-Fa-f:]{2,39}$") & ~column.rlike(r"[0-9A-Fa-f]{5}|:::") & F.when(short, missing >= 1).otherwise((F.size(halves) == 1) & (missing == 0))
    return F.when(ok, F.array_join(F.concat(padded(parts(0)), zeros, padded(parts(1))), ""))


def in_network(column: Column, network: str) -> Column:
    """Whether an address lies in a network such as 10.0.0.0/8 or 2001:db8::/32; a name that is none holds nothing."""
    try:
        held = ip_network(network, strict=False)
    except ValueError:
        return F.lit(False)
    if held.version == 6:
        ends = (f"{int(held.network_address):032x}", f"{int(held.broadcast_address):032x}")
        return F.coalesce(ip6_digits(column).between(*ends), F.lit(False))
    return F.coalesce(ip_number(column).between(int(held.network_address), int(held.broadcast_address)), F.lit(False))


def cut_bytes(column: Column, size: int) -> Column:
    """The first bytes of the text in UTF-8, without a character that would be cut."""
    data = column.cast("binary")
    inside = lambda at: F.hex(F.substring(data, at, 1)).between("80", "BF")
    end = F.lit(size)
    for back in (3, 2, 1, 0):
        end = F.when(~inside(size + 1 - back), F.lit(size - back)).otherwise(end)
    return F.when(F.octet_length(column) <= size, column).otherwise(F.substring(data, F.lit(1), F.greatest(end, F.lit(0))).cast("string"))


def top_level(column: Column) -> Column:
    return F.substring_index(F.regexp_replace(column, r"\.$", ""), ".", -1)


def dissect_regex(mapping: str) -> tuple[str, list[tuple[str, str, int]]]:
    """A dissect template as an anchored regex, and its fields: (kind, name, group). Kinds: plain, append, indirect."""
    parts, fields, at, group = [], [], 0, 0
    found = list(re.finditer(r"%\{([^}]*)\}", mapping))
    for k, m in enumerate(found):
        parts.append(re.escape(mapping[at : m.start()]))
        key, last = m[1], k == len(found) - 1 and m.end() == len(mapping)
        padded = key.endswith("->")
        key = re.sub(r"(->)?(:\w+)?$", "", key.removesuffix("->"))
        body = ".*" if last else ".*?"
        if not key or key.startswith("?"):
            parts.append(f"(?:{body})")
        else:
            group += 1
            parts.append(f"({body})")
            kind = {"+": "append", "&": "indirect"}.get(key[0], "plain")
            fields.append((kind, re.sub(r"/\d+$", "", key.lstrip("+&")), group))
        at = m.end()
        if padded and at < len(mapping):
            follows = mapping[at : found[k + 1].start() if k + 1 < len(found) else len(mapping)]
            parts.append(f"(?:{re.escape(follows)})+")
            at += len(follows)
    parts.append(re.escape(mapping[at:]))
    return "(?s)^" + "".join(parts) + "$", fields
