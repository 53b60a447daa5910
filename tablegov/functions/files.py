"""Paths, file names and file kinds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of path traversal, characters a name must not hold.
_TRAVERSAL = r"(?i)\.\.|[\\/]|\x00|%2e%2e|%252e%252e"
_FORBIDDEN = r'[<>:"|?*\x00-\x1f]'


def _decoded(name: Column) -> Column:
    """Percent-decoding that leaves malformed escapes and plus signs alone."""
    masked = F.regexp_replace(F.regexp_replace(name, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(masked), name)


def is_unsafe_name(name: Column) -> Column:
    once = _decoded(name)
    twice = _decoded(once)
    return name.rlike(_TRAVERSAL) | once.rlike(r"\.\.|[\\/]") | twice.rlike(r"\.\.|[\\/]")


def safe_name(name: Column, generated: Column) -> Column:
    """Cleaned file name; an empty, unsafe or fully removed name becomes
    ``generated``."""
    clean = F.regexp_replace(name, _FORBIDDEN, "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\.{2,}", "."), r"^[. ]+|[. ]+$", "")
    return F.when((F.coalesce(name, F.lit("")) == "") | is_unsafe_name(name) | (clean == ""), generated).otherwise(clean)


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_parent(path: Column) -> Column:
    """Directory part, "" at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def path_depth(path: Column) -> Column:
    """Number of separators."""
    return F.size(F.split(path, "/")) - 1


def path_extension(path: Column) -> Column:
    """Lower-case extension with its dot, "" when there is none."""
    return F.lower(F.regexp_extract(path_name(path), r"(\.[^.]+)$", 1))


def path_hidden(path: Column) -> Column:
    return path_name(path).startswith(".")


def ancestors_of(path: Column) -> Column:
    """All directories above a path, nearest last; the top is ""."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


# Leading bytes of known kinds (hex), and the office marker.
MAGIC = [("ffd8ff", "image/jpeg"), ("89504e470d0a1a0a", "image/png"), ("474946383761", "image/gif"),
         ("474946383961", "image/gif"), ("504b0304", "application/zip"), ("25504446", "application/pdf"),
         ("d0cf11e0a1b11ae1", "application/msword")]
OFFICE_MARKER = "[Content_Types].xml"
OFFICE_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


def file_kind(head: Column) -> Column:
    """Kind by magic bytes of the first 1000 bytes (binary), null when unknown."""
    out = F.lit(None).cast("string")
    for magic, kind in reversed(MAGIC):
        size = len(magic) // 2
        hit = F.hex(F.substring(head, 1, size)) == magic.upper()
        if kind == "application/zip":
            office = F.contains(F.substring(head, 1, 1000), F.encode(F.lit(OFFICE_MARKER), "UTF-8"))
            out = F.when(hit & office, OFFICE_KIND).when(hit, kind).otherwise(out)
        else:
            out = F.when(hit, kind).otherwise(out)
    return out
