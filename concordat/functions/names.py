"""Names, identifiers and timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: URLs of hosted workspaces; the first group is the workspace id.
WORKSPACE_URL = r"(?:https://)?adb-(\d+)\.\d+\.azuredatabricks\.net"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record(**fields: Column) -> Column:
    """A struct with the given field names."""
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def is_blank(c: str | Column) -> Column:
    """Null, empty or white space only."""
    return col(c).isNull() | col(c).rlike(r"^\s*\z")


def is_empty(c: str | Column) -> Column:
    """Null or the empty string."""
    return col(c).isNull() | (col(c) == "")


def qualified_name(*parts: str | Column) -> Column:
    """``a.b.c``; null as soon as one part is null."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit("."), col(part)]
    return F.concat(*pieces[1:])


def quoted_name(*parts: str | Column) -> Column:
    """The same name with every part in back-ticks, safe inside SQL text."""
    tick = F.lit("`")
    return qualified_name(
        *[F.concat(tick, F.replace(col(p), tick, F.lit("``")), tick) for p in parts]
    )


def quote_identifier(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def template_base_id(template_id: str | Column) -> Column:
    """Template id without its version (the text after the last colon) and quotes."""
    unversioned = F.regexp_replace(col(template_id), r":[^:]*\z", "")
    unquoted = F.replace(unversioned, F.lit('"'), F.lit(""))
    return F.regexp_replace(unquoted, r"^\s+|\s+\z", "")


def canonical_member(value: str | Column, members: Sequence[str]) -> Column:
    """The member equal to ``value`` when case is ignored, else null."""
    pairs = [F.lit(x) for m in members for x in (m.lower(), m)]
    return F.try_element_at(F.create_map(*pairs), F.lower(col(value)))


def workspace_reference(identifier: str | Column, url_pattern: str = WORKSPACE_URL) -> Column:
    """Classify an identifier as a URL (unmanaged, id taken from it) or a name (managed).

    ``url_pattern`` is matched from the start of the text and its first group is the id.
    """
    c = col(identifier)
    anchored = "^(?:" + url_pattern + ")"
    is_url = c.rlike(anchored)
    return F.struct(
        (~is_url).alias("is_managed"),
        F.when(is_url, F.regexp_extract(c, anchored, 1)).alias("workspace_id"),
        F.when(~is_url, c).alias("workspace_name"),
    )


def like_name(candidate: str | Column, wanted: str, escape: bool = False) -> Column:
    """``candidate LIKE wanted``; ``_`` and ``%`` in the wanted name stay wildcards unless escaped."""
    if escape:
        wanted = wanted.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%")
    return F.like(col(candidate), F.lit(wanted))


def iso_millis_utc(ts: str | Column) -> Column:
    """ISO-8601 text with milliseconds and ``Z``, of a moment shown in any session time zone."""
    return F.date_format(F.to_utc_timestamp(col(ts), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
