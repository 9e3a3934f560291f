"""Text expressions: matching, labels, templates, names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from medialake import catalogs as C


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_ci(c: Column | str, query: Column | str) -> Column:
    """Case-insensitive substring test; a missing value does not match."""
    needle = F.lower(F.lit(query) if isinstance(query, str) else query)
    return F.coalesce(F.contains(F.lower(_col(c)), needle), F.lit(False))


def any_contains_ci(arr: Column | str, query: str) -> Column:
    """True when some element of the array contains the query, ignoring case.

    The elements are joined by a character the query does not have, so one compiled substring test
    serves for all of them.
    """
    mark = next(chr(c) for c in range(1, 32) if chr(c) not in query)
    joined = F.array_join(_col(arr), mark)
    found = F.contains(F.lower(joined), F.lower(F.lit(query))) & (F.size(_col(arr)) > 0)
    return F.coalesce(found, F.lit(False))


def capitalise_first(c: Column | str) -> Column:
    """Upper-case the first letter and leave the rest alone (``initcap`` would lower it)."""
    c = _col(c)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def full_name(first: Column | str, last: Column | str) -> Column:
    return F.trim(F.concat_ws(" ", _col(first), _col(last)))


def email_is_valid(c: Column | str) -> Column:
    return _col(c).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def file_name(url: Column | str, default: str = "DSC_0001") -> Column:
    """Last path segment without its query string; the default when that is empty."""
    last = F.element_at(F.split(_col(url), "/"), -1)
    bare = F.substring_index(last, "?", 1)
    return F.when(bare == "", F.lit(default)).otherwise(bare)


def render_name(
    rule: Column | str,
    project: Column,
    date: Column,
    counter: Column,
    tag: Column | None = None,
    original: Column | None = None,
) -> Column:
    """Fill a naming rule. Tokens are replaced one after another, so a project name that itself
    contains a later token has that token filled too."""
    parts = [
        ("{project}", project),
        ("{date}", date),
        ("{tag}", F.coalesce(tag if tag is not None else F.lit(None), F.lit(C.TOKEN_TAG_DEFAULT))),
        ("{counter}", zero_pad(counter)),
        (
            "{original}",
            F.coalesce(
                original if original is not None else F.lit(None), F.lit(C.TOKEN_ORIGINAL_DEFAULT)
            ),
        ),
    ]
    out = F.lit(rule) if isinstance(rule, str) else rule
    for token, value in parts:
        out = F.replace(out, F.lit(token), value)
    return F.concat(out, F.lit(".jpg"))


def zero_pad(n: Column, width: int = 4) -> Column:
    """Pad with zeros on the left; longer numbers keep all their digits."""
    return F.format_string(f"%0{width}d", n)


def trimmed(c: Column | str) -> Column:
    """Text without outer white space of any kind, also tabs, line ends and wide blanks."""
    return F.regexp_replace(_col(c), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def label_map(c: Column | str, labels: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(table, _col(c)), F.lit(default))


def preset_display_name(c: Column | str) -> Column:
    """Display name of a stored preset: cut one file prefix, then look the rest up."""
    c = _col(c)
    first, second = C.PRESET_FILE_PREFIXES
    bare = (
        F.when(F.startswith(c, F.lit(first)), F.substr(c, F.lit(len(first) + 1)))
        .when(F.startswith(c, F.lit(second)), F.substr(c, F.lit(len(second) + 1)))
        .otherwise(c)
    )
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(C.PRESET_DISPLAY_NAMES.items())])
    missing = c.isNull() | (trimmed(c) == "") | (c == "none")
    return F.when(missing, F.lit("None")).otherwise(F.coalesce(F.try_element_at(table, bare), bare))


def formats_label(formats: Column | str) -> Column:
    """Label of a format selection: none, one by name, several by count."""
    formats = _col(formats)
    n = F.coalesce(F.size(formats), F.lit(0))
    return (
        F.when(formats.isNull() | (n <= 0), F.lit(C.FORMAT_DEFAULT))
        .when(n == 1, label_map(F.get(formats, F.lit(0)), C.FORMAT_LABELS, C.FORMAT_DEFAULT))
        .otherwise(F.concat(n.cast("string"), F.lit(" formats selected")))
    )


def mask_secret(key: Column | str, value: Column | str) -> Column:
    """Hide values of lines that mention a password or a secret, in the key or in the value."""
    key, value = _col(key), _col(value)
    secret = F.rlike(key, F.lit("PASSWORD|SECRET")) | F.coalesce(F.rlike(value, F.lit("PASSWORD|SECRET")), F.lit(False))
    return F.when(secret, F.lit(C.HIDDEN)).otherwise(value)


def checksum(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)
