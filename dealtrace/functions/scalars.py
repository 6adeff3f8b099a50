"""Column functions: cleaning, classification, ratios and text formats.

Each takes Columns (or names) and returns a Column built from Spark's own
expressions, so everything stays in generated code and no row visits Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

WHITESPACE = " \t\n\r\x0b\x0c"
MICROS_PER_DAY = 86_400_000_000
NUMBER = r"^\s*([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity)))\s*$"
DATE_FORMATS = [
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy h:mm a",
    "M/d/yyyy h:mm:ss a",
    "M-d-yyyy",
]


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# --- text ------------------------------------------------------------------

def trimmed(c) -> Column:
    """Strip every kind of white space at both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def join_key(c) -> Column:
    """Lower-cased, trimmed text for equality on names and domains."""
    return F.lower(trimmed(c))


def null_if_token(c, tokens: Iterable[str] = V.NULL_TOKENS) -> Column:
    """Null when the whole cell is one of the null tokens."""
    c = _col(c)
    return F.when(~c.isin(list(tokens)), c)


def single_line(c) -> Column:
    """Line breaks to blanks, then trimmed."""
    return trimmed(F.regexp_replace(_col(c), "[\n\r]", " "))


def or_unknown(c, default: str = V.UNKNOWN) -> Column:
    return F.coalesce(_col(c), F.lit(default))


def trimmed_or_unknown(c, default: str = V.UNKNOWN) -> Column:
    return trimmed(or_unknown(c, default))


def title_words(c) -> Column:
    """Capitalise every run of letters, also after ``'`` and ``-``."""
    pieces = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, F.initcap), "")


def prefix(c, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def attribute_label(c) -> Column:
    """Column name of a creative attribute as a report heading."""
    words = F.regexp_replace(_col(c), "^_+|copy|design", "")
    return title_words(trimmed(F.regexp_replace(words, "_+", " ")))


def lookup(c, table: Mapping[str, str]) -> Column:
    """Value of a literal map, null when the key is absent or null.

    One set of keys for each value: Spark hashes long sets, while a literal map
    is searched key by key.
    """
    c = _col(c)
    keys: dict[str, list[str]] = {}
    for key, value in table.items():
        keys.setdefault(value, []).append(key)
    found = F.lit(None).cast("string")
    for value, names in reversed(keys.items()):
        found = F.when(c.isin(names), F.lit(value)).otherwise(found)
    return found


# --- parsing ---------------------------------------------------------------

def number(c) -> Column:
    """Text to double; text that is no number becomes null.

    The cast alone also takes forms that a reader would not, such as ``1d`` or a
    hexadecimal one; all of them hold one of a few letters, and only text with
    such a letter is held against the pattern.
    """
    c = _col(c)
    plain = F.translate(c, "dDfFnNxX", "") == c
    return F.when(plain, c.try_cast("double")).otherwise(F.regexp_extract(c, NUMBER, 1).try_cast("double"))


def timestamp(c, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to UTC instant: ISO forms first, then month-first forms.

    The shape chooses the forms to try: by its slash, its number of colons and
    its AM or PM for the given formats, so that a cell is parsed once as a rule.
    """
    c = trimmed(c)
    slash = F.contains(c, F.lit("/"))
    colons = F.length(c) - F.length(F.replace(c, F.lit(":")))
    half_day = F.upper(F.right(c, F.lit(1))) == "M"

    def fits(pattern: str) -> Column:
        shape = colons == pattern.count(":")
        return shape & (half_day if pattern.endswith("a") else ~half_day)

    def parsed(patterns: Sequence[str]) -> Column:
        tries = [F.when(fits(p), F.try_to_timestamp(c, F.lit(p))) for p in patterns]
        return F.coalesce(*tries) if tries else F.lit(None).cast("timestamp")

    with_slash = [f for f in formats if "/" in f]
    others = [f for f in formats if "/" not in f]
    return F.when(slash, parsed(with_slash)).otherwise(F.coalesce(c.try_cast("timestamp"), parsed(others)))


def flag(c, true=V.TRUE_TOKENS, false=V.FALSE_TOKENS) -> Column:
    """Text to boolean by exact token; anything else is null."""
    c = _col(c)
    return F.when(c.isin(list(true)), F.lit(True)).when(c.isin(list(false)), F.lit(False))


def strict_flag(c) -> Column:
    return flag(c, V.TRUE_TOKENS_STRICT, V.FALSE_TOKENS_STRICT)


def zero_if_null(c, to: str = "bigint") -> Column:
    return F.coalesce(_col(c), F.lit(0)).cast(to)


def is_true(c) -> Column:
    """True only where the flag is true; null counts as not true."""
    return F.coalesce(_col(c), F.lit(False))


# --- normalisation ---------------------------------------------------------

def domain(c) -> Column:
    """Host-like key: no protocol, no ``www.``, no trailing slash."""
    d = join_key(c)
    d = F.regexp_replace(d, "^https?://", "")
    d = F.regexp_replace(d, r"^www\.", "")
    d = F.regexp_replace(d, "/+$", "")
    return null_if_token(d, V.EMPTY_DOMAINS)


def not_free_mail(c, denylist: Iterable[str] = V.FREE_MAIL_DOMAINS) -> Column:
    """Predicate that drops free-mail domains and keeps nulls."""
    c = _col(c)
    return c.isNull() | ~c.isin(list(denylist))


def country(c, aliases: Mapping[str, str] = V.COUNTRY_ALIASES) -> Column:
    key = join_key(c)
    return F.coalesce(lookup(key, aliases), title_words(key))


def industry(c, names: Mapping[str, str] = V.INDUSTRY_NAMES) -> Column:
    key = trimmed(c)
    return F.coalesce(lookup(key, names), key)


def channel_of_source(c, channels: Mapping[str, str] = V.LEAD_SOURCE_CHANNELS) -> Column:
    return F.coalesce(lookup(c, channels), F.lit(V.OTHER_CHANNEL))


def is_marketing(channel, marketing: Iterable[str] = V.MARKETING_CHANNELS) -> Column:
    return is_true(_col(channel).isin(list(marketing)))


def tier(c) -> Column:
    c = _col(c)
    return F.coalesce(F.nullif(c, F.lit(V.PENDING_TIER)), F.lit(V.UNASSIGNED_TIER))


def segment_from_revenue(segment, revenue, bands=V.REVENUE_BANDS) -> Column:
    """Keep a given segment, else band the revenue; no revenue, no segment."""
    revenue = _col(revenue)
    banded = None
    for floor, name in bands:
        hit = revenue.isNotNull() if floor is None else revenue >= F.lit(floor)
        banded = F.when(hit, F.lit(name)) if banded is None else banded.when(hit, F.lit(name))
    return F.coalesce(_col(segment), banded)


def lifecycle_stage(c, stages: Mapping[str, str] = V.LIFECYCLE_STAGES) -> Column:
    return F.coalesce(lookup(join_key(c), stages), _col(c))


def segment_category(c, rules=V.SEGMENT_KEYWORDS) -> Column:
    """First keyword group found in the name; null -> Unknown, none -> Other."""
    c = _col(c)
    text = F.lower(c)
    result = F.when(c.isNull(), F.lit(V.UNKNOWN))
    for name, words in rules:
        result = result.when(_contains_any(text, words), F.lit(name))
    return result.otherwise(F.lit(V.OTHER_SEGMENT))


def _contains_any(text: Column, words: Iterable[str]) -> Column:
    hits = None
    for word in words:
        hit = text.contains(word)
        hits = hit if hits is None else hits | hit
    return hits


# --- engagement ------------------------------------------------------------

def engaged(c, kind: str) -> Column:
    return is_true(F.lower(_col(c)) == F.lit(kind))


def source_flags(c) -> dict[str, Column]:
    """Session source flags: exact lists, and a substring for the social one."""
    src = join_key(c)
    return {
        "is_display_traffic": is_true(src.isin(V.DISPLAY_SOURCES)),
        "is_email_traffic": is_true(src.isin(V.EMAIL_SOURCES)),
        "is_social_traffic": is_true(src.contains(V.SOCIAL_MARK)),
        "is_organic": is_true(src.isin(V.ORGANIC_SOURCES)),
    }


def email_touch_type(click, register) -> Column:
    return (
        F.when(is_true(click), F.lit(V.EMAIL_CLICK))
        .when(is_true(register), F.lit(V.EMAIL_REGISTER))
        .otherwise(F.lit(V.EMAIL_OPEN))
    )


def web_touch(source) -> tuple[Column, Column]:
    """(channel, touch type) of a session by ordered substring rules."""
    src = F.coalesce(F.lower(_col(source)), F.lit(""))
    organic, organic_channel, organic_type = V.WEB_TOUCH_ORGANIC
    rules = [(_contains_any(src, words), ch, kind) for words, ch, kind in V.WEB_TOUCH_RULES]
    rules.append((src.isin(organic), organic_channel, organic_type))
    first, *rest = rules
    channel = F.when(first[0], F.lit(first[1]))
    kind = F.when(first[0], F.lit(first[2]))
    for hit, ch, name in rest:
        channel, kind = channel.when(hit, F.lit(ch)), kind.when(hit, F.lit(name))
    return channel.otherwise(V.WEB_TOUCH_OTHER[0]), kind.otherwise(V.WEB_TOUCH_OTHER[1])


def is_closed_stage(stage, words: Sequence[str] = V.CLOSED_STAGE_WORDS) -> Column:
    return is_true(F.lower(_col(stage)).rlike("|".join(words)))


def is_open_deal(won) -> Column:
    return ~is_true(won)


# --- time ------------------------------------------------------------------

def days_between(later, earlier) -> Column:
    """Elapsed days as a double."""
    micros = F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))
    return micros / F.lit(float(MICROS_PER_DAY))


def whole_days_between(later, earlier) -> Column:
    """Elapsed whole days, rounded towards the past (not calendar days)."""
    return F.floor(days_between(later, earlier)).cast("bigint")


def month(c, null_period: str | None = None) -> Column:
    return _period(F.date_format(_col(c), "yyyy-MM"), null_period)


def quarter(c, null_period: str | None = None) -> Column:
    c = _col(c)
    text = F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))
    return _period(text, null_period)


def _period(text: Column, null_period: str | None) -> Column:
    return text if null_period is None else F.coalesce(text, F.lit(null_period))


# --- ratios ----------------------------------------------------------------

def round_to(c, digits: int) -> Column:
    """Round the scaled double to the nearest integer, ties to even."""
    power = F.lit(float(10**digits))
    return F.rint(_col(c) * power) / power


def ratio(num, den, digits: int | None = None, scale: float = 1.0) -> Column:
    """num / den, null where den is zero."""
    value = F.try_divide(_col(num).cast("double"), F.nullif(_col(den).cast("double"), F.lit(0.0)))
    if scale != 1.0:
        value = value * F.lit(scale)
    return value if digits is None else round_to(value, digits)


def click_rate(clicks, impressions, digits: int = 6) -> Column:
    return ratio(clicks, impressions, digits)


def cost_per(spend, units, digits: int = 4) -> Column:
    return ratio(spend, units, digits)


def cost_per_thousand(spend, impressions, digits: int = 4) -> Column:
    return ratio(spend, impressions, digits, scale=1000.0)


def positive_ratio(num, den, digits: int | None = 2) -> Column:
    """num / den where den is positive, else null (returns on spend)."""
    den = _col(den)
    return F.when(den > 0, ratio(num, den, digits))


def win_rate(won, total, digits: int | None = 4) -> Column:
    return positive_ratio(won, total, digits)


def change_ratio(new, old) -> Column:
    new, old = _col(new), _col(old)
    return positive_ratio(new - old, old, None)


def percent_or_zero(c) -> Column:
    return F.coalesce(_col(c), F.lit(0.0)) * F.lit(100.0)


def priority_score(rate, average) -> Column:
    return _col(rate) * _col(average) / F.lit(1000.0)


def coverage_tier(email, display, tiers=V.COVERAGE_TIERS) -> Column:
    email, display = _col(email), _col(display)
    both, email_only, display_only, none = (F.lit(t) for t in tiers)
    return (
        F.when(email & display, both)
        .when(email, email_only)
        .when(display, display_only)
        .otherwise(none)
    )


# --- report text -----------------------------------------------------------

def tenths(c) -> Column:
    """Nearest tenth of the double's exact value (33.15 is a little less than
    that and gives 33.1).

    Ten times the value is 8v + 2v, both exact; what their sum loses settles
    the cases that look like a tie.
    """
    v = _col(c)
    a, b = v * 8.0, v * 2.0
    scaled = a + b
    part = scaled - a
    lost = (a - (scaled - part)) + (b - part)
    is_tie = F.abs(scaled - F.floor(scaled) - 0.5) == 0.0
    settled = (
        F.when(is_tie & (lost < 0), F.floor(scaled).cast("double"))
        .when(is_tie & (lost > 0), F.ceil(scaled).cast("double"))
        .otherwise(F.rint(scaled))
    )
    return settled / 10.0


def percent_text(c) -> Column:
    c = _col(c)
    text = F.format_string("%.1f%%", tenths(c * 100.0))
    return F.when(c.isNull(), F.lit("")).otherwise(text)


def dollar_text(c) -> Column:
    whole = F.rint(F.coalesce(_col(c), F.lit(0.0)))
    return F.concat(F.lit("$"), F.format_number(whole, 0))


def multiple_text(c) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.format_string("%.1fx", tenths(c)))


def compact_money(c) -> Column:
    """$1.2M, $34K or $5; null and zero read $0."""
    c = _col(c)
    return (
        F.when(c.isNull() | (c == 0), F.lit("$0"))
        .when(c >= 1e6, F.format_string("$%.1fM", tenths(c / 1e6)))
        .when(c >= 1e3, F.format_string("$%.0fK", F.rint(c / 1e3)))
        .otherwise(F.format_string("$%.0f", F.rint(c)))
    )


def roi_band(c) -> Column:
    c = _col(c)
    return (
        F.when(c > V.ROI_GOOD, F.lit("good"))
        .when((c < V.ROI_POOR) & (c != 0), F.lit("poor"))
        .otherwise(F.lit(""))
    )


def best_model(first, last, linear, decay) -> Column:
    """Name of the model that credits a channel most, by strict comparison."""
    first, last, linear, decay = map(_col, (first, last, linear, decay))
    return (
        F.when((decay > first) & (decay > last) & (decay > linear), F.lit(V.TIME_DECAY))
        .when((linear > first) & (linear > last), F.lit(V.LINEAR))
        .when(last > first, F.lit(V.LAST_TOUCH))
        .otherwise(F.lit(V.FIRST_TOUCH))
    )
