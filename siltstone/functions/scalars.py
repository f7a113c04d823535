"""Scalar column functions: text, paths, sizes, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"GB": 1 << 30, "MB": 1 << 20, "KB": 1 << 10, "B": 1}


def parse_size(text: str | None) -> int:
    """Bytes of "50MB" and the like; empty is 0 (no limit), no unit or no whole number is an error."""
    s = (text or "").strip().upper()
    if not s:
        return 0
    for unit, factor in UNITS.items():
        if s.endswith(unit):
            number = s[: -len(unit)]
            if not (number.lstrip("+-").isdecimal() and len(number.lstrip("+-")) >= len(number) - 1):
                break
            return int(number) * factor
    raise ValueError(f"invalid file size {text!r}: use a whole number and B, KB, MB or GB")


def size_column(text: Column) -> Column:
    """``parse_size`` on a column; null where it would fail."""
    s = F.upper(trim_space(text))
    number = F.regexp_extract(s, r"^([+-]?[0-9]+)(GB|MB|KB|B)$", 1)
    unit = F.regexp_extract(s, r"^([+-]?[0-9]+)(GB|MB|KB|B)$", 2)
    factor = F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in UNITS.items()])
    return F.when(s == "", F.lit(0).cast("long")).when(number != "", number.cast("long") * factor)


def trim_space(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def cut_bytes(text: Column, most: int) -> Column:
    """The first ``most`` bytes, less those of a character that would be cut."""
    raw = text.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(most, max(-1, most - 4), -1)]
    return F.coalesce(*cuts)


def truncate(text: Column, most: int) -> Column:
    """Trimmed, and shortened with "..." beyond ``most`` bytes."""
    s = trim_space(text)
    return F.when(F.octet_length(s) <= most, s).otherwise(F.concat(cut_bytes(s, most), F.lit("...")))


def base_name(path: Column) -> Column:
    """What follows the last slash; closing slashes don't count."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"[^/]*\z", 0)


def extension(path: Column) -> Column:
    """From the last dot of the base name, in lower case; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"\.[^.]*\z", 0))


def sanitize(path: Column) -> Column:
    """A name that is safe as one path part."""
    return F.regexp_replace(path, r"[/\\:]", "_")


def group_to_path(group: Column) -> Column:
    return F.replace(group, F.lit("."), F.lit("/"))


def path_to_group(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("."))


def join_path(*parts: Column) -> Column:
    """Non-empty parts joined by single slashes."""
    clean = F.transform(F.array(*parts), lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", ""))
    return F.array_join(F.filter(clean, lambda p: p != ""), "/")


def gav(group: Column, artifact: Column, version: Column) -> Column:
    return F.concat_ws(":", group, artifact, version)


def gav_path(group: Column, artifact: Column, version: Column) -> Column:
    return F.concat_ws("/", group_to_path(group), artifact, version)


def interval_text(seconds: Column) -> Column:
    """"one-shot" up to 0; else hours, minutes and seconds like 1h0m0s, without leading zero parts."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return (
        F.when(s <= 0, "one-shot")
        .when(h > 0, F.concat(h, F.lit("h"), m, F.lit("m"), r, F.lit("s")))
        .when(m > 0, F.concat(m, F.lit("m"), r, F.lit("s")))
        .otherwise(F.concat(r, F.lit("s")))
    )


def severity_rank(severity: Column) -> Column:
    """1 (CRITICAL) to 4 (LOW); null for any other text."""
    return F.coalesce(*[F.when(severity == s, i) for i, s in enumerate(("CRITICAL", "HIGH", "MEDIUM", "LOW"), 1)])


def severity_color(severity: Column) -> Column:
    """The severity in terminal colours."""
    codes = {"CRITICAL": "1;31", "HIGH": "31", "MEDIUM": "33", "LOW": "36"}
    shown = [F.when(severity == s, F.concat(F.lit(f"\033[{c}m"), severity, F.lit("\033[0m"))) for s, c in codes.items()]
    return F.coalesce(*shown, severity)


def finding_text(path: Column, line: Column, severity: Column, rule: Column, match: Column) -> Column:
    """path:line [SEVERITY] rule: match."""
    return F.concat(path, F.lit(":"), line.cast("string"), F.lit(" ["), severity, F.lit("] "), rule, F.lit(": "), match)
