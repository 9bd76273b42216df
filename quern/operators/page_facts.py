"""Facts of pages by the places of matches.

``facts`` reads each text once. What a single match says is a Catalyst
expression. What depends on where matches stand to each other (the configuration
that a price belongs to, the scope of a feature, the number nearest to a name) is
decided on one axis for a whole Arrow batch: texts lie behind each other with a
gap wider than any window, each pattern gives a sorted array of starts and ends,
and each decision is a binary search of one array in another. Matches are found
by the regular expression engine; nothing else runs by row.

Rules:
* a label (``2 BHK``) owns a value if it is the last one that lies whole within
  100 characters before it, else the first whole one within 100 after it;
* a feature's scope comes from the first word of a unit's scope and the first of a
  building's that lie whole within 60 characters around it: the one there is, or
  the unit's if it is strictly nearer to the feature's start, else the project's;
* of several registration numbers or prices that nearest to the page's name counts
  (to any of its places), of equally near ones the first; the first if there is no name;
* an area is carpet or built-up by the words within 20 characters around it, the
  first of a kind counts.

Defined results: null and empty texts have no facts; a null name is no name; rows
repeat as their texts do; long texts are one piece of memory each; extra columns are
not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import extract
from quern.functions.scalar import ColumnOrName, col

# What is looked for in pages. Those that begin with a set of characters (not with \d+ or \b) are found faster.
BHK = re.compile(r"(\d)\s*bhk", re.I)
RERA = re.compile(r"([Pp](?<!\w[Pp])(?i:[A-Z]{0,2})\d{9,13})\b")
CRORES = re.compile(r"(\d\d*\.?\d*)\s*(?:cr|crore)\b", re.I)
LAKHS = re.compile(r"(\d\d*\.?\d*)\s*(?:l|lakh|lakhs)\b", re.I)
AREA = re.compile(r"(\d(?<![\d,.]\d)\d{2,4})\s*sq\.?\s*\.?\s*ft\.?", re.I)
SCOPED_AREA = re.compile(r"(\d\d{2,4})\s*sq\.?\s*\.?\s*ft\.?", re.I)
SCOPED_PRICE = re.compile(r"(?:₹|rs\.?)\s*(\d+\.?\d*)\s*(cr|crore|l|lakh|lakhs)\b", re.I)
CARPET = re.compile(r"carpet", re.I)
BUILT_UP = re.compile(r"built[\s-]?up|super\s*built", re.I)
FEATURES = {"deck": re.compile(r"\b(?:private\s+)?decks?\b", re.I), "balcony": re.compile(r"\bbalcon(?:y|ies)\b", re.I), "parking": re.compile(r"\bparking\b", re.I)}
UNIT_SCOPE = re.compile(
    r"\bprivate\b|\bpersonal\b|\bown\b|\battached\b|\bin-unit\b|\bin\s+unit\b"
    r"|\beach\s+(?:unit|apartment|home|residence|flat)\b|\bevery\s+(?:unit|apartment|home|residence|flat)\b"
    r"|\bwithin\s+(?:the\s+)?(?:unit|apartment|flat|residence)\b|\d\s*bhk",
    re.I,
)
BUILDING_SCOPE = re.compile(
    r"\blevel\s*\d+\b|\bfloor\s*\d+\b|\d+\s*(?:st|nd|rd|th)\s*(?:level|floor)\b"
    r"|\beco\s*deck\b|\brooftop\b|\bpodium\b|\bclubhouse\b|\bcommon\s+area\b|\bshared\b"
    r"|\btower\b|\bbuilding\b|\bproject\b|\bdevelopment\b|\bcomplex\b|\bamenit",
    re.I,
)
NAME = re.compile(r"([A-Z][A-Za-z0-9&'-]+(?:[ \t]+[A-Z0-9][A-Za-z0-9&'-]*){0,5})")
AMENITIES = [
    "swimming pool", "pool", "gym", "gymnasium", "clubhouse", "club house", "garden", "jogging track", "kids play area", "children's play area", "play area", "security", "power backup",
    "lift", "elevator", "terrace", "yoga", "amphitheatre", "sports court", "tennis court", "badminton court", "indoor games", "party hall", "banquet hall", "senior citizen", "jacuzzi",
    "sauna", "spa", "library", "co-working",
]
LABEL_REACH, SCOPE_REACH, AREA_REACH, SHOWN, SCOPE_SHOWN = 100, 60, 20, 40, 60

FACT = T.ArrayType(T.StructType([*(T.StructField(x, T.StringType()) for x in ("field", "value", "configuration", "scope", "evidence")), T.StructField("place", T.IntegerType())]))
LISTING = T.ArrayType(T.StructType([T.StructField("rera", T.StringType()), T.StructField("name", T.StringType()), T.StructField("configurations", T.ArrayType(T.StringType())), T.StructField("snippet", T.StringType())]))


class Places:
    """Matches of one pattern in all texts of an axis: sorted, whole, not overlapping."""

    def __init__(self, starts: list[int], ends: list[int], found: list[re.Match]) -> None:
        self.starts, self.ends, self.found = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64), found

    def before(self, at: np.ndarray, reach: int) -> np.ndarray:
        """Of each place the last match that lies whole within reach before it; -1 without."""
        k = np.searchsorted(self.ends, at, side="right") - 1
        return np.where((k >= 0) & (self._at(self.starts, k) >= at - reach), k, -1)

    def after(self, at: np.ndarray, reach: np.ndarray | int) -> np.ndarray:
        """Of each place the first match from it on, if that lies whole within reach; -1 without."""
        k = np.searchsorted(self.starts, at, side="left")
        return np.where((k < len(self.starts)) & (self._at(self.ends, k) <= at + reach), k, -1)

    @staticmethod
    def _at(a: np.ndarray, k: np.ndarray) -> np.ndarray:
        return a[np.clip(k, 0, len(a) - 1)] if len(a) else np.zeros(len(k), dtype=np.int64)


class Axis:
    """Texts one behind the other."""

    GAP = 1000

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.base = np.concatenate(([0], np.cumsum([len(x) + self.GAP for x in texts], dtype=np.int64)))
        self.low = [x.lower() for x in texts]

    def places(self, pattern: re.Pattern, hint: str | None = None) -> Places:
        """Matches of a pattern; texts without the ``hint`` (in lower case) are left out."""
        starts, ends, found = [], [], []
        for text, low, base in zip(self.texts, self.low, self.base.tolist(), strict=False):
            if text and (hint is None or hint in low):
                for m in pattern.finditer(text):
                    starts.append(base + m.start())
                    ends.append(base + m.end())
                    found.append(m)
        return Places(starts, ends, found)

    def near(self, pattern: re.Pattern, spots: list[Places], reach: int) -> Places:
        """Matches of a pattern that has no full stop, around some places: what lies whole within reach of one is there.

        From the stop before to the stop after: what is found is what ``places`` finds there.
        """
        spans = sorted(x for p in spots for x in zip(p.starts.tolist(), p.ends.tolist(), strict=True))
        of = self.text_of(np.array([a for a, _ in spans], dtype=np.int64)).tolist()
        starts, ends, found, last, done = [], [], [], -1, 0
        for (a, b), k in zip(spans, of, strict=True):
            text, base = self.texts[k], int(self.base[k])
            if k != last:
                last, done = k, 0
            low = max(text.rfind(".", 0, max(a - base - reach, 0)) + 1, done)
            high = text.find(".", max(b - base + reach, done))
            high = len(text) if high < 0 else high
            for m in pattern.finditer(text, low, high):
                starts.append(base + m.start())
                ends.append(base + m.end())
                found.append(m)
            done = max(done, high)
        return Places(starts, ends, found)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, side="right") - 1

    def around(self, m: re.Match, reach: int) -> str:
        return m.string[max(0, m.start() - reach) : m.end() + reach].strip()

    def nearest(self, p: Places, names: list[str | None]) -> list[int]:
        """Of each text that has matches the one nearest to a place of its name."""
        of, spots = self.text_of(p.starts), []
        for k in np.flatnonzero(np.bincount(of, minlength=len(self.texts)) > 1).tolist() if len(of) else ():
            if names[k]:
                spots += [int(self.base[k]) + m.start() for m in re.finditer(re.escape(names[k]), self.texts[k], re.I)]
        far = np.zeros(len(of), dtype=np.int64)  # without a name all are as near
        if spots:
            spot = np.array(spots, dtype=np.int64)
            home = self.text_of(spot)
            right = np.searchsorted(spot, p.starts)
            gaps = []
            for k in (right - 1, right):
                k = np.clip(k, 0, len(spot) - 1)
                gaps.append(np.where(home[k] == of, np.abs(spot[k] - p.starts), np.iinfo(np.int64).max))
            far = np.where(np.isin(of, home), np.minimum(*gaps), 0)
        order = np.lexsort((p.starts, far, of))
        return order[np.concatenate(([True], of[order][1:] != of[order][:-1]))].tolist() if len(order) else []


def configurations(labels: Places, at: np.ndarray) -> list[str | None]:
    """The label that owns each place."""
    own = labels.before(at, LABEL_REACH)
    own = np.where(own >= 0, own, labels.after(at, LABEL_REACH))
    return [f"{labels.found[k][1]} BHK" if k >= 0 else None for k in own.tolist()]


def scopes(feature: Places, unit: Places, building: Places) -> list[str]:
    low, high = feature.starts - SCOPE_REACH, feature.ends + SCOPE_REACH
    u, b = (x.after(low, high - low) for x in (unit, building))
    nearer = np.abs(Places._at(unit.starts, u) - feature.starts) < np.abs(Places._at(building.starts, b) - feature.starts)
    out = []
    for has, has_too, near in zip(u.tolist(), b.tolist(), nearer.tolist(), strict=True):
        if has < 0 and has_too < 0:
            out.append("unknown")
        elif has_too < 0 or has >= 0 and near:
            out.append("unit")
        elif has >= 0:
            out.append("project")
        else:
            said = building.found[has_too][0].lower()
            out.append("tower" if "tower" in said else "building" if "building" in said else "project")
    return out


def kinds_of_area(axis: Axis, areas: Places) -> list[tuple[int, str]]:
    """(match, field): the carpet and the built-up area of each text."""
    low, reach = areas.starts - AREA_REACH, areas.ends - areas.starts + 2 * AREA_REACH
    carpet, built = (axis.near(p, [areas], AREA_REACH).after(low, reach) >= 0 for p in (CARPET, BUILT_UP))
    out, has = [], set()
    for k, (text, c, b) in enumerate(zip(axis.text_of(areas.starts).tolist(), carpet.tolist(), built.tolist(), strict=True)):
        for field, fits in (("carpet_area", c), ("built_up_area", b), ("carpet_area", True)):
            if fits and (text, field) not in has:
                has.add((text, field))
                out.append((k, field))
                break
    return out


def rows_of(texts: list[str], names: list[str | None]) -> list[tuple]:
    """(text, place, field, value, configuration, scope, evidence) of all that is decided by places."""
    axis = Axis(texts)
    labels, out = axis.places(BHK, "bhk"), []

    def add(p: Places, k: int, field: str, value: str, configuration: str | None = None, scope: str | None = None, evidence: str | None = None) -> None:
        text = int(np.searchsorted(axis.base, p.starts[k], side="right")) - 1
        out.append((text, int(p.starts[k] - axis.base[text]), field, value, configuration, scope, evidence))

    rera = axis.places(RERA)
    for k in axis.nearest(rera, names):
        add(rera, k, "rera_number", rera.found[k][1].upper())
    areas = axis.places(AREA, "sq")
    for k, field in kinds_of_area(axis, areas):
        add(areas, k, field, f"{areas.found[k][1]} sq ft")
    crores, lakhs = axis.places(CRORES, "cr"), axis.places(LAKHS, "l")
    in_crores = set(axis.text_of(crores.starts).tolist())
    for k in axis.nearest(crores, names):
        add(crores, k, "price", f"₹{crores.found[k][1]} Cr")
    for k in axis.nearest(lakhs, names):
        if int(axis.text_of(lakhs.starts[k : k + 1])[0]) not in in_crores:
            add(lakhs, k, "price", f"₹{lakhs.found[k][1]}L")
    for field, p in (("carpet_area", axis.places(SCOPED_AREA, "bhk")), ("price", axis.places(SCOPED_PRICE, "bhk"))):
        for k, own in enumerate(configurations(labels, p.starts)):
            if own:
                m = p.found[k]
                value = f"{m[1]} sq ft" if field == "carpet_area" else f"₹{m[1]} {'Cr' if m[2].lower().startswith('cr') else 'L'}"
                add(p, k, field, value, own, None, axis.around(m, SHOWN))
    features = {f: p for f, p in ((f, axis.places(p, f[:6])) for f, p in FEATURES.items()) if p.found}
    if features:
        unit, building = (axis.near(p, list(features.values()), SCOPE_REACH) for p in (UNIT_SCOPE, BUILDING_SCOPE))
        for feature, p in features.items():
            for k, (scope, own) in enumerate(zip(scopes(p, unit, building), configurations(labels, p.starts), strict=True)):
                add(p, k, feature, p.found[k][0], own, scope, axis.around(p.found[k], SCOPE_SHOWN))
    return out


def _lists(rows: list[tuple], n: int, names: list[str], kinds: list[pa.DataType]) -> pa.ListArray:
    """Rows of (text, place, ...) in this order, as a list for each of n texts of structs of what follows the place."""
    rows.sort(key=lambda r: r[:3])
    ends = np.searchsorted(np.array([r[0] for r in rows], dtype=np.int64), np.arange(n + 1))
    fields = [pa.array([r[k + 2] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=names))


@F.arrow_udf(FACT)
def placed(texts: pa.Array, names: pa.Array) -> pa.Array:
    """The facts of each text that are decided by places, in their order."""
    rows = rows_of([x or "" for x in texts.to_pylist()], names.to_pylist())
    return _lists([(*r, r[1]) for r in rows], len(texts), FACT.elementType.names, [pa.string()] * 5 + [pa.int32()])


def amenities(text: ColumnOrName) -> Column:
    """Words of amenities in a text in lower case; not those inside a longer one that is there too."""
    t = col(text)
    longer = {a: [b for b in AMENITIES if b != a and a in b] for a in AMENITIES}

    def hit(a: str) -> Column:
        out = F.contains(t, F.lit(a))
        for b in (b for b in AMENITIES if b != a and b in a):  # with a longer one the shorter is there, so is looked for first
            out = F.contains(t, F.lit(b)) & out
        for b in longer[a]:
            out = out & ~F.contains(t, F.lit(b))
        return out

    return F.array_compact(F.array(*(F.when(hit(a), F.lit(a)) for a in AMENITIES)))


def single(text: ColumnOrName, low: ColumnOrName, other: ColumnOrName) -> dict[str, Column]:
    """The value of each field that one match tells, null if absent; ``low`` is the text in lower case, ``other`` that without the page's own name."""
    return {
        "price_per_sqft": F.concat(F.lit("₹"), extract.price_per_sqft(text, low=low).cast("string"), F.lit("/sq ft")),
        "possession": extract.possession_in_context(text, low=low),
        "developer": extract.developer(text, low=low),
        "property_type": extract.property_type(text, low=low),
        "total_floors": extract.floors(text, low=low),
        "tower_count": extract.towers(text, low=low).cast("string"),
        "connectivity": extract.connectivity(text, low=low),
        "nearby_landmarks": F.nullif(F.array_join(extract.landmarks(text, low=low), "; "), F.lit("")),
        "amenities": F.nullif(F.array_join(amenities(other), "; "), F.lit("")),
    }


def facts(pages: DataFrame, *, id_col: str = "page_id", text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """``(id, field, value, configuration, scope, evidence, place)``: a row for each fact of each page.

    The text in lower case and the values of single matches are columns of
    projections of their own: in the array of facts they would be computed for each use.
    """
    name = F.col(f"`{name_col}`").cast("string") if name_col else F.lit(None).cast("string")
    ready = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_t"), name.alias("_n"))
    values = single("_t", "_l", "_o")
    ready = ready.withColumn("_l", F.lower(F.coalesce("_t", F.lit(""))))
    ready = ready.withColumn("_o", F.replace("_l", F.lower(F.coalesce("_n", F.lit(""))), F.lit(" ")))  # of an empty name nothing
    found = ready.select("_id", placed("_t", "_n").alias("_placed"), *(v.alias(f"_{f}") for f, v in values.items()))
    none = F.lit(None).cast("string")
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("value"), none.alias("configuration"), none.alias("scope"), none.alias("evidence"), F.lit(None).cast("int").alias("place")) for f in values]
    both = F.concat(F.filter(F.array(*rows), lambda r: r["value"].isNotNull()), "_placed")
    return found.select("_id", F.inline(both)).withColumnRenamed("_id", id_col)


def listings_of(texts: list[str]) -> list[tuple]:
    """(text, place, number, name, configurations, snippet) for each registration number's first place in a text."""
    axis, out, seen = Axis(texts), [], set()
    codes, labels = axis.places(RERA), axis.places(BHK, "bhk")
    names = Axis([RERA.sub(lambda m: "\n" * len(m[0]), x) for x in texts]).places(NAME)  # a number is no part of a name
    of = axis.text_of(codes.starts)
    last = np.concatenate(([0], codes.ends[:-1])) if len(codes.ends) else codes.ends
    low = np.maximum(codes.starts - 200, np.maximum(last, axis.base[of] if len(of) else of))
    noise = re.compile(r"rera|maharera|no\.?|reg\.?|registration", re.I)
    named = Places([], [], [])
    kept = [k for k, m in enumerate(names.found) if not noise.fullmatch(m[0])]
    named.starts, named.ends, named.found = names.starts[kept], names.ends[kept], [names.found[k] for k in kept]
    owner = named.before(codes.starts, 10**9)
    first, end = np.searchsorted(labels.starts, codes.starts - 300, side="left"), np.searchsorted(labels.ends, codes.ends + 300, side="right")
    for k, m in enumerate(codes.found):
        key = (int(of[k]), m[1].upper())
        if key in seen:
            continue
        seen.add(key)
        own = int(owner[k])
        name = named.found[own][0] if own >= 0 and named.starts[own] >= low[k] else None
        around = list(dict.fromkeys(f"{x[1]} BHK" for x in labels.found[int(first[k]) : int(end[k])]))
        out.append((key[0], m.start(), key[1], name, around, axis.around(m, 300)))
    return out


@F.arrow_udf(LISTING)
def sub_listings(texts: pa.Array) -> pa.Array:
    """One entry for each registration number of a page, with the capitalised name before it."""
    rows = listings_of([x or "" for x in texts.to_pylist()])
    return _lists(rows, len(texts), LISTING.elementType.names, [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()])
