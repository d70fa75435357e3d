"""Column expressions shared by table and stream jobs. All stay inside the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

from hostweave import schemas as S

__all__ = [
    "lenient_long", "status_number", "dash_to_default", "dash_to_null", "zeek_bool", "split_services",
    "user_agent_category", "minute_of_day_circle", "privileged_port_strict", "privileged_port",
    "infer_attr_type", "entropy_bits", "map_entropy_bits", "connection_consistency", "zscore",
    "vocab_fallback", "one_hot", "hot_index", "escape_dot", "unescape_dot", "hash_fraction", "array_of",
    "log_cosh", "activity_score",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_long(c) -> Column:
    """Leading integer of a text; 0 when there is none or it does not fit 64 bits."""
    c = _col(c).cast("string")
    # A failing try_cast builds an exception, so the common misses never get to one.
    prefix = F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit(""))
    plain = F.when(c.rlike(r"^\d{1,18}$"), c.try_cast("bigint"))
    return F.coalesce(plain, prefix.try_cast("bigint"), F.lit(0).cast("bigint"))


def status_number(c) -> Column:
    """Leading integer of a status text; null without one, and for one that does not fit 32 bits."""
    c = _col(c)
    digits = F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit(""))
    return F.when(c != "", digits.try_cast("int"))


def dash_to_default(c, default: str) -> Column:
    """The unset marker ``-`` (or a missing value) replaced by a default."""
    return F.coalesce(F.nullif(_col(c), F.lit("-")), F.lit(default))


def dash_to_null(c) -> Column:
    """Null for the unset marker and for the empty text."""
    return F.nullif(F.nullif(_col(c), F.lit("-")), F.lit(""))


def zeek_bool(c) -> Column:
    """``T`` is true, everything else false."""
    return F.coalesce(_col(c) == F.lit("T"), F.lit(False))


def split_services(c, keep_blank: bool = True) -> Column:
    """Items of a comma list.

    ``keep_blank=True`` is the edge rule: blanks are trimmed, empty items stay, but an empty item
    at the very end of the list does not count. ``keep_blank=False`` is the host rule: any white
    space is trimmed and empty items go.
    """
    items = F.split(_col(c), ",", -1)
    if keep_blank:
        kept = F.when(F.element_at(items, -1) == "", F.slice(items, 1, F.size(items) - 1)).otherwise(items)
        return F.transform(kept, lambda x: F.trim(x, F.lit(" ")))
    return F.filter(F.transform(items, lambda x: F.trim(x, F.lit(" \t\n\r"))), lambda x: x != "")


def user_agent_category(c, scanner_rule: bool = False) -> Column:
    """Browser family of a user-agent text; the first rule that fits wins.

    ``scanner_rule`` adds a category for the port scanner whose marker the default rules ignore.
    """
    low = F.lower(_col(c))
    # Markers and categories, in rule order.
    rules = [
        (["chrome"], "Chrome"),
        (["firefox"], "Firefox"),
        (["safari"], "Safari"),
        (["edge"], "Edge"),
        (["opera", "opr/"], "Opera"),
        (["bot", "crawl", "spider"], "Bot"),
    ]
    if scanner_rule:
        rules.append((["nmap"], "Nmap"))
    out = None
    for markers, name in rules:
        hit = reduce(lambda a, b: a | b, [low.contains(m) for m in markers])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(S.DEFAULT_USER_AGENT)


def minute_of_day_circle(epoch) -> tuple[Column, Column]:
    """Sine and cosine of the UTC minute of the day; (0, 0) for a missing or non-positive time."""
    seconds = _col(epoch).cast("double")
    minute = F.floor(F.pmod(seconds, F.lit(86400.0)) / 60)
    angle = F.lit(2 * math.pi) * (minute / F.lit(1440.0))
    known = F.coalesce(seconds, F.lit(0.0)) > 0
    return (
        F.when(known, F.sin(angle)).otherwise(F.lit(0.0)),
        F.when(known, F.cos(angle)).otherwise(F.lit(0.0)),
    )


def privileged_port_strict(port) -> Column:
    """Log side rule: 1 to 1023."""
    return F.coalesce(_col(port).between(1, 1023), F.lit(False))


def privileged_port(port) -> Column:
    """Snapshot side rule: below 1024, so port 0 counts."""
    return F.coalesce(_col(port) < 1024, F.lit(False))


def infer_attr_type(c) -> Column:
    """The number a text spells, or null. The raw text stays beside it."""
    c = F.trim(_col(c))
    numeric = c.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$")
    return F.when(numeric, c.try_cast("double"))


def entropy_bits(count, total) -> Column:
    """One category's share of a Shannon entropy in bits; sum it over the categories."""
    p = _col(count) / _col(total)
    return F.when((_col(total) > 0) & (_col(count) > 0), -p * F.log2(p)).otherwise(F.lit(0.0))


def map_entropy_bits(counts) -> Column:
    """Shannon entropy in bits of a count map; 0 for an empty map or a zero total."""
    values = F.transform(F.map_values(_col(counts)), lambda v: v.cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    entropy = F.aggregate(
        values,
        F.lit(0.0),
        lambda a, v: a - F.when(v > 0, (v / total) * F.log2(v / total)).otherwise(F.lit(0.0)),
    )
    return F.when(F.coalesce(total, F.lit(0.0)) > 0, entropy).otherwise(F.lit(0.0))


def connection_consistency(n_hours, std) -> Column:
    """1/(1+population std) of hourly counts; 0 when there are fewer than two hours."""
    return F.when(_col(n_hours) >= 2, 1.0 / (1.0 + _col(std))).otherwise(F.lit(0.0))


def zscore(x, mean, std) -> Column:
    return (_col(x) - _col(mean)) / (_col(std) + F.lit(1e-6))


def activity_score(n) -> Column:
    """Closed form of ``a <- 0.9a + 0.1`` applied n times from 0."""
    return F.lit(1.0) - F.pow(F.lit(0.9), _col(n).cast("double"))


def vocab_fallback(value, vocab: list[str], fallback: str = "other") -> Column:
    """The value if the vocabulary has it, else the fallback slot."""
    return F.when(_col(value).isin(vocab), _col(value)).otherwise(F.lit(fallback))


def one_hot(value, vocab: list[str], fallback: str = "other") -> Column:
    """One-hot block over a vocabulary; unknown and missing values take the fallback slot."""
    # The value is looked up once; the block is then one transform over the fixed slots, which keeps
    # the plan small where a vector has many blocks.
    slots = F.array(*[F.lit(v) for v in vocab])
    place = F.array_position(slots, F.coalesce(_col(value), F.lit(fallback)))
    hot = F.when(place > 0, place).otherwise(F.lit(vocab.index(fallback) + 1))
    return F.transform(F.sequence(F.lit(1), F.lit(len(vocab))), lambda i: (i == hot).cast("int").cast("float"))


def hot_index(vector, start: int, size: int) -> Column:
    """0-based position of the 1 in a slice of a vector, -1 if there is none."""
    return (F.array_position(F.slice(_col(vector), start + 1, size), F.lit(1.0).cast("float")) - 1).cast("int")


def escape_dot(c) -> Column:
    """Backslash and double quote escaped for a quoted statement."""
    return F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def unescape_dot(c) -> Column:
    """Inverse of :func:`escape_dot`."""
    return F.regexp_replace(_col(c), r'\\(["\\])', "$1")


def hash_fraction(*cols, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) for a row.

    Used instead of ``rand``: a re-run task gives the same answer whatever the order of its input.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[_col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def array_of(cols, dtype: str = "double") -> Column:
    return F.array(*[_col(c).cast(dtype) for c in cols])


def log_cosh(x) -> Column:
    """log(cosh(x)) without overflow for a large x."""
    a = F.abs(_col(x))
    return a + F.log1p(F.exp(-2 * a)) - F.lit(math.log(2.0))
