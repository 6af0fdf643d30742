"""Ids: canonical UUID text and ids derived from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a UUID a producer may send: plain, braced, URN, or bare hex.
UUID_PATTERN = (
    r"^(?:[0-9a-fA-F]{32}"
    r"|(?:[uU][rR][nN]:[uU][uU][iI][dD]:)?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|\{[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\})$"
)


def uuid_layout(hex32: Column) -> Column:
    """32 hex digits in the 8-4-4-4-12 layout, lower case."""
    return F.regexp_replace(F.lower(hex32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID_PATTERN)


def canonical_uuid(text: Column) -> Column:
    """Canonical form of any accepted spelling."""
    return uuid_layout(F.regexp_replace(F.lower(text), r"^urn:uuid:|[{}-]", ""))


def content_id(*parts: Column) -> Column:
    """An id that is the same whenever the same input is read again."""
    return uuid_layout(F.md5(F.concat_ws("\u001f", *[p.cast("string") for p in parts])))


def packed_id(text: Column) -> Column:
    """16 or 32 lower-case hex digits, or a UUID in canonical layout, as half as many bytes or fewer; NULL for any other text.

    A 17th byte marks the layout of a UUID, so :func:`unpacked_id` gives the very text again.
    """
    bare = F.unhex(F.regexp_replace(text, "-", ""))
    return (
        F.when(text.rlike("^(?:[0-9a-f]{16}){1,2}$") & F.length(text).isin(16, 32), F.unhex(text))
        .when(text.rlike("^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$") & (F.length(text) == 36), F.concat(bare, F.lit(b"\0")))
    )


def unpacked_id(packed: Column) -> Column:
    """The text of a packed id."""
    digits = F.lower(F.hex(packed))
    return F.when(F.length(packed) == 17, uuid_layout(F.left(digits, F.lit(32)))).otherwise(digits)
