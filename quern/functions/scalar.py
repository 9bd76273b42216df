"""Column functions: null rules, rounding, normalizers, formats, keys, URLs, hashes.

Everything here is a Catalyst expression. "Empty" means null or ''.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- nulls and rounding


def first_non_empty(*columns: ColumnOrName) -> Column:
    """The first that is neither null nor '' (text columns)."""
    return F.coalesce(*(F.nullif(col(c).cast("string"), F.lit("")) for c in columns))


def first_truthy(*columns: ColumnOrName) -> Column:
    """The first number that is neither null nor 0."""
    return F.coalesce(*(F.nullif(col(c), F.lit(0)) for c in columns))


def half_up(x: ColumnOrName) -> Column:
    """Round half towards plus infinity."""
    return F.floor(col(x).cast("double") + F.lit(0.5))


def half_even(x: ColumnOrName, scale: int = 0) -> Column:
    """Round half to even."""
    return F.bround(col(x).cast("double"), scale)



# ---- phones


def phone_key(raw: ColumnOrName, country_code: ColumnOrName | None = None) -> Column:
    """Canonical phone: ten digits from 6-9 at home, ``+cc`` and 7-12 digits abroad, else null."""
    digits = F.regexp_replace(F.coalesce(col(raw).cast("string"), F.lit("")), r"\D", "")
    cc = F.regexp_replace(F.coalesce(col(country_code).cast("string"), F.lit("")), r"\D", "") if country_code is not None else F.lit("")
    foreign = F.when(F.length(digits).between(7, 12), F.concat(F.lit("+"), cc, digits))
    short = F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).otherwise(digits)
    short = F.when((F.length(short) == 11) & short.startswith("0"), F.substring(short, 2, 10)).otherwise(short)
    home = F.when(short.rlike(r"^[6-9]\d{9}$"), short)
    return F.when((cc != "") & (cc != "91"), foreign).otherwise(home)


def phone_last10(raw: ColumnOrName) -> Column:
    digits = F.regexp_replace(F.coalesce(col(raw).cast("string"), F.lit("")), r"\D", "")
    return F.when(digits != "", F.substring(digits, -10, 10))


# ---- money


def _trim_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"\.?0+$", "")


def format_inr(n: ColumnOrName) -> Column:
    """Rupees: crores with up to two places, whole lakhs, or the number."""
    n = col(n).cast("double")
    crores = F.concat(F.lit("₹"), _trim_zeros(F.format_string("%.2f", n / 1e7)), F.lit(" Cr"))
    lakhs = F.concat(F.lit("₹"), half_up(n / 1e5).cast("long").cast("string"), F.lit(" L"))
    return F.when(n >= 1e7, crores).when(n >= 1e5, lakhs).otherwise(F.concat(F.lit("₹"), n.cast("long").cast("string")))


def format_lakhs(n: ColumnOrName) -> Column:
    """Lakhs: crores from a hundred on."""
    n = col(n).cast("double")
    return F.when(n >= 100, F.concat(F.lit("₹"), _trim_zeros(F.format_string("%.2f", n / 100)), F.lit(" Cr"))).when(n.isNotNull(), F.concat(F.lit("₹"), half_up(n).cast("long").cast("string"), F.lit("L")))


def format_range(low: ColumnOrName, high: ColumnOrName) -> Column:
    """``low - high`` where both are there and not 0."""
    low, high = col(low), col(high)
    return F.when((F.coalesce(low, F.lit(0)) != 0) & (F.coalesce(high, F.lit(0)) != 0), F.concat_ws(" - ", format_inr(low), format_inr(high)))


def number(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, as a number; null without one."""
    return F.regexp_extract(text, pattern, group).try_cast("double")


def parse_price(text: ColumnOrName) -> Column:
    """``struct<min, max, display>`` in lakhs from a range or one price in crores or lakhs."""
    t = F.coalesce(col(text), F.lit(""))
    n = r"(\d+(?:\.\d+)?)"
    cr, lakh = r"\s*(?:cr|crore)s?\b", r"\s*(?:l|lac|lakh)s?\b"
    range_cr, range_l = rf"(?i){n}(?:{cr})?\s*(?:-|–|to)\s*₹?\s*{n}{cr}", rf"(?i){n}(?:{lakh})?\s*(?:-|–|to)\s*₹?\s*{n}{lakh}"
    one_cr, one_l = rf"(?i){n}{cr}", rf"(?i){n}{lakh}"

    def price(pattern: str, high: int, scale: float) -> Column:
        low, top = half_up(number(t, pattern) * scale).cast("long"), half_up(number(t, pattern, high) * scale).cast("long")
        return F.when(t.rlike(pattern), F.struct(low.alias("min"), top.alias("max"), F.regexp_extract(t, pattern, 0).alias("display")))

    return F.coalesce(price(range_cr, 2, 100), price(range_l, 2, 1), price(one_cr, 1, 100), price(one_l, 1, 1))


# ---- configurations


def bhk_list(text: ColumnOrName) -> Column:
    """Distinct ``n BHK`` in order, with shared units ("2 & 3 BHK"); Studio if nothing else."""
    t = F.coalesce(col(text), F.lit(""))
    groups = F.regexp_extract_all(t, F.lit(r"(?i)(\d+(?:\.5)?(?:\s*(?:&|,|/|and)\s*\d+(?:\.5)?)*)\s*-?\s*BHK"), 1)
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+(?:\.5)?"), 0)))
    units = F.array_distinct(F.transform(numbers, lambda n: F.concat(n, F.lit(" BHK"))))
    return F.when(F.size(units) > 0, units).when(t.rlike(r"(?i)\bstudio\b"), F.array(F.lit("Studio"))).otherwise(F.array().cast("array<string>"))


def atomic_configs(values: ColumnOrName) -> Column:
    """Distinct single configurations of an array of compound ones."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(col(values), F.array().cast("array<string>")), bhk_list)))


def bhk_number(configuration: ColumnOrName, bedrooms: ColumnOrName | None = None) -> Column:
    n = F.regexp_extract(F.coalesce(col(configuration), F.lit("")), r"\d+", 0).try_cast("int")
    return n if bedrooms is None else F.coalesce(col(bedrooms).cast("int"), n)


# ---- possession

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def possession_label(text: ColumnOrName) -> Column:
    """Ready to Move, ``Mon YYYY``, ``Qn YYYY`` or a year; '' if none is said."""
    t = F.coalesce(col(text), F.lit(""))
    month = rf"(?i)({MONTHS})[a-z]*\.?\s*(\d{{4}})"
    quarter = r"(?i)q([1-4])\s*[/-]?\s*(\d{4})"
    return (
        F.when(t.rlike(r"(?i)ready to move|immediate possession|move[-\s]?in ready|ready possession"), "Ready to Move")
        .when(t.rlike(month), F.concat(F.regexp_extract(t, month, 1), F.lit(" "), F.regexp_extract(t, month, 2)))
        .when(t.rlike(quarter), F.concat(F.lit("Q"), F.regexp_extract(t, quarter, 1), F.lit(" "), F.regexp_extract(t, quarter, 2)))
        .when(t.rlike(r"(?i)by\s+(20\d\d)"), F.regexp_extract(t, r"(?i)by\s+(20\d\d)", 1))
        .otherwise(F.regexp_extract(t, r"\b(20\d\d)\b", 1))
    )


def possession_year(text: ColumnOrName, as_of: ColumnOrName, date: ColumnOrName | None = None) -> Column:
    """Year of a date's first four digits, the year of ``as_of`` if ready, or the first 20xx."""
    t = F.coalesce(col(text), F.lit(""))
    own = F.substring(col(date), 1, 4).try_cast("int") if date is not None else F.lit(None).cast("int")
    said = F.regexp_extract(t, r"20\d\d", 0).try_cast("int")
    return F.coalesce(own, F.when(t.rlike("(?i)ready"), F.year(col(as_of))), said)


def possession_month(text: ColumnOrName) -> Column:
    """``YYYY-MM`` of a date, a month and year, or null."""
    t = F.coalesce(col(text), F.lit(""))
    iso = F.nullif(F.regexp_extract(t, r"\b(20\d\d-(?:0[1-9]|1[0-2]))", 1), F.lit(""))
    month = rf"(?i)({MONTHS})[a-z]*\.?\s*(20\d\d)"
    name = F.initcap(F.regexp_extract(t, month, 1))
    return F.coalesce(iso, F.date_format(F.try_to_timestamp(F.nullif(F.concat_ws(" ", name, F.nullif(F.regexp_extract(t, month, 2), F.lit(""))), F.lit("")), F.lit("MMM yyyy")), "yyyy-MM"))


def possession_display(month: ColumnOrName) -> Column:
    """``YYYY-MM`` as ``Mon YYYY``."""
    return F.date_format(F.try_to_timestamp(F.concat(col(month), F.lit("-01")), F.lit("yyyy-MM-dd")), "MMM yyyy")


# ---- text


def clean(text: ColumnOrName) -> Column:
    """White space runs to one blank, trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))


def clean_lines(text: ColumnOrName) -> Column:
    """As ``clean``, but line breaks stay (at most two in a row)."""
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[^\S\n]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def title_case(text: ColumnOrName) -> Column:
    return F.initcap(clean(text))


def title_case_keep_caps(text: ColumnOrName) -> Column:
    """Title case, but words of two to five capitals stay."""
    words = F.split(clean(text), " ")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^[A-Z]{2,5}$"), w).otherwise(F.initcap(w))), " ")


def alnum_key(text: ColumnOrName) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]", "")


# Fixed value: words that listing pages add to a project's name.
NAME_NOISE = (
    r"(?i)\bprice(?:\s*sheet|\s*list)?\b|\bphotos?\b|\bfloor\s*plans?\b|\bfaqs?\b|\bbrochure\b|\bpros\s*(?:&|and)?\s*cons\b|\breviews?\b|"
    r"\boverview\b|\bgallery\b|\bamenities\b|\bvideo\s*tour\b|\bmap\b"
)


def core_name_key(name: ColumnOrName) -> Column:
    """Key of a name without page noise."""
    return alnum_key(F.regexp_replace(F.coalesce(col(name), F.lit("")), NAME_NOISE, ""))


def project_name(name: ColumnOrName, portals: str = r"[a-z0-9.]+\.(?:com|in|net)") -> Column:
    """A title without a portal's suffix and a leading count."""
    n = clean(name)
    n = F.regexp_replace(n, rf"(?i)\s*[|\-–]\s*(?:{portals}).*$", "")
    return F.trim(F.regexp_replace(n, r"^\d+\+?\s+", ""))


def name_tokens(text: ColumnOrName, stop: Iterable[str] = (), least: int = 3) -> Column:
    """Distinct lower-case words of at least ``least`` characters, without stop words."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= least))
    stop = list(stop)
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    both, union = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def base_locality(term: ColumnOrName) -> Column:
    """A locality without its direction."""
    return F.trim(F.regexp_replace(F.lower(F.trim(col(term))), r"\s+(east|west|north|south)\.?$", ""))


def contains_any(hay: ColumnOrName, terms: ColumnOrName) -> Column:
    """Whether a lower-case text holds any of an array of terms (substrings)."""
    return F.exists(col(terms), lambda t: F.contains(col(hay), F.lower(t)))


def context_of(text: ColumnOrName, pattern: str, around: int = 25) -> Column:
    """The first match with up to ``around`` characters on both sides, trimmed; null without one."""
    t = F.coalesce(col(text), F.lit(""))
    hit = F.regexp_extract(t, f"(?is){pattern}", 0)
    before = F.length(F.regexp_extract(t, f"(?is)^(.*?)(?:{pattern})", 1))
    start = F.greatest(before - around, F.lit(0))
    return F.when(hit != "", F.trim(F.substring(t, start + 1, before - start + F.length(hit) + around)))


# ---- keys, URLs, hashes


def url_key(url: ColumnOrName) -> Column:
    """URL-safe base64 without padding; on one line, as Spark's own breaks lines of 76 characters."""
    return F.rtrim(F.translate(F.base64(F.encode(col(url), "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def url_host(url: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(col(url), F.lit("HOST"))), r"^www\.", "")


def without_fragment(url: ColumnOrName) -> Column:
    return F.regexp_replace(col(url), "#.*$", "")


def fetchable(url: ColumnOrName) -> Column:
    """A web page: http(s), not a map link, not a file that is no page."""
    u = F.lower(F.coalesce(col(url), F.lit("")))
    path = F.regexp_replace(u, r"[?#].*$", "")
    return u.rlike("^https?://") & ~u.rlike(r"google\.[a-z.]+/maps|maps\.google\.|goo\.gl/maps|maps\.app\.goo\.gl") & ~path.rlike(r"\.(pdf|jpe?g|png|gif|webp|svg|zip|docx?|xlsx?|pptx?|mp4)$")


def candidate_id(rera: ColumnOrName, name: ColumnOrName, location: ColumnOrName, url: ColumnOrName) -> Column:
    """``rera:``, ``nameloc:``, ``url:`` or ``anon:`` key, the first that can be made."""
    r, n, loc = alnum_key(rera), core_name_key(name), alnum_key(location)
    return F.coalesce(
        F.when(r != "", F.concat(F.lit("rera:"), r)),
        F.when((n != "") & (loc != ""), F.concat(F.lit("nameloc:"), n, F.lit("|"), loc)),
        F.when(F.coalesce(col(url), F.lit("")) != "", F.concat(F.lit("url:"), F.substring(url_key(url), 1, 60))),
        F.concat(F.lit("anon:"), F.substring(F.sha1(F.encode(F.concat_ws("|", F.coalesce(col(name), F.lit("")), F.coalesce(col(location), F.lit(""))), "UTF-8")), 1, 16)),
    )


def sha256_norm(text: ColumnOrName) -> Column:
    """Hash of the trimmed lower-case text; null stays null."""
    return F.sha2(F.encode(F.lower(F.trim(col(text))), "UTF-8"), 256)


def hmac_sha256(key: ColumnOrName, text: ColumnOrName) -> Column:
    """HMAC of RFC 2104 in built-in functions (keys of up to 64 bytes)."""
    padded = F.rpad(F.hex(F.encode(col(key), "UTF-8")), 128, "0")

    def pad(byte: int) -> Column:
        nibbles = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.lpad(F.hex(F.conv(F.substring(padded, k * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(byte))), 2, "0"))
        return F.unhex(F.array_join(nibbles, ""))

    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(col(text), "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


# ---- registration numbers

# Fixed value: the shape of a registration number.
RERA = r"(?i)\b(P[A-Z]{0,2}\d{9,13})\b"


def rera_of(text: ColumnOrName) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(col(text), F.lit("")), RERA, 1)), F.lit(""))


def rera_list(text: ColumnOrName) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(RERA), 1), F.upper))


def rera_valid(code: ColumnOrName) -> Column:
    """Has the shape of a real number; placeholders have not."""
    return F.trim(F.coalesce(col(code), F.lit(""))).rlike(r"(?i)^P[A-Z]{0,2}\d{9,13}$")


def rera_entries(text: ColumnOrName) -> Column:
    """``[code|date|phase,...]`` as an array of structs."""
    items = F.filter(F.split(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"^\s*\[|\]\s*$", ""), r"\s*,\s*"), lambda x: F.trim(x) != "")

    def entry(x: Column) -> Column:
        parts = F.split(x, r"\|")
        return F.struct(*(F.trim(F.get(parts, k)).alias(n) for k, n in enumerate(("code", "date", "phase"))))

    return F.transform(items, entry)


# ---- times


def age_label(at: ColumnOrName, now: ColumnOrName) -> Column:
    """``5s``, ``3m``, ``2h`` or ``4d``."""
    s = F.greatest(F.unix_timestamp(col(now)) - F.unix_timestamp(col(at)), F.lit(0))
    label = F.when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h")))
    return label.otherwise(F.concat(F.floor(s / 86400), F.lit("d")))


def day_label(at: ColumnOrName, now: ColumnOrName) -> Column:
    days = F.datediff(F.to_date(col(now)), F.to_date(col(at)))
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").otherwise(F.date_format(col(at), "d MMM yyyy"))


def age_days(at: ColumnOrName, now: ColumnOrName) -> Column:
    return (F.unix_timestamp(col(now)) - F.unix_timestamp(col(at))) / 86400.0


def freshness_label(at: ColumnOrName, now: ColumnOrName) -> Column:
    d = half_up(age_days(at, now))
    return (
        F.when(col(at).isNull(), "Unknown freshness")
        .when(d <= 1, "Seen today")
        .when(d <= 7, F.concat(F.lit("Seen "), d, F.lit("d ago")))
        .when(d <= 30, F.concat(F.lit("Seen "), half_up(d / 7), F.lit("w ago")))
        .otherwise(F.concat(F.lit("Seen "), half_up(d / 30), F.lit("mo ago")))
    )


# ---- places


def haversine_km(lat1: ColumnOrName, lon1: ColumnOrName, lat2: ColumnOrName, lon2: ColumnOrName) -> Column:
    a, b = F.radians(col(lat2) - col(lat1)), F.radians(col(lon2) - col(lon1))
    h = F.pow(F.sin(a / 2), 2) + F.cos(F.radians(col(lat1))) * F.cos(F.radians(col(lat2))) * F.pow(F.sin(b / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def in_box(lat: ColumnOrName, lon: ColumnOrName, south: float, west: float, north: float, east: float) -> Column:
    return col(lat).between(south, north) & col(lon).between(west, east)


# ---- arrays


def filled(*columns: ColumnOrName) -> Column:
    """How many are neither null nor empty."""
    return sum((F.when(F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit(None)).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))


def drop_contained(terms: ColumnOrName) -> Column:
    """Terms that are not inside a longer one of the array."""
    return F.filter(col(terms), lambda a: ~F.exists(col(terms), lambda b: (F.length(b) > F.length(a)) & F.contains(b, a)))


def longest_first(terms: ColumnOrName) -> Column:
    return F.array_sort(col(terms), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def chunks(text: ColumnOrName, size: int = 4000, overlap: int = 200) -> Column:
    """Overlapping pieces of a text; an empty one has none."""
    t = F.coalesce(col(text), F.lit(""))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < F.length(t)))
    return F.when(F.length(t) > 0, F.transform(starts, lambda s: F.substring(t, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
