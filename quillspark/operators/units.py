"""Quantities written in different units, brought to one unit per kind (problem 3).

A written quantity is a number with text around it. The text is segmented by dynamic
programming over tries: one of scale prefixes (k, M, thousand, millions de), one of unit
roots, one of powers (sq, ², 3). Every segmentation of the whole text into
prefix* power* root power* is scored; what the field holds (an amount, a duration, a
measure, a rate) adds a prior on the dimension, which settles strings such as "m" (metre,
month, million), "min" (minute, milli-inch) or "MMAD" (million dirhams).

Results: ``kind`` and ``value`` in the kind's unit - ``currency:XXX`` (one of that currency),
``day`` (days and what is made of them), ``month``, ``length`` (m), ``area`` (m2), ``volume``
(m3), ``mass`` (kg), ``pressure`` (Pa), ``energy`` (J), ``temperature`` (K), ``ratio`` (1).
Both are null for null or blank text, for a text without a number, and for a number without
any known unit.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roots by dimension, each with its size in the kind's unit. A pair of numbers
# is a factor and an offset. Roots marked "si" take letter prefixes.
ROOTS = {
    "currency:EUR": {"€": 1, "eur": 1, "euro": 1, "euros": 1, "euro cent": 0.01, "euro cents": 0.01, "eurocent": 0.01, "eurocents": 0.01, "centime d'euro": 0.01, "centimes d'euro": 0.01, "centimes d'euros": 0.01, "cent d'euro": 0.01, "cents d'euro": 0.01},
    "currency:USD": {"$": 1, "us$": 1, "$us": 1, "usd": 1, "us dollar": 1, "us dollars": 1, "dollar": 1, "dollars": 1, "dollar us": 1, "dollars us": 1, "dollar américain": 1, "dollars américains": 1, "us cent": 0.01, "us cents": 0.01, "¢": 0.01},
    "currency:MAD": {"mad": 1, "dh": 1, "dhs": 1, "dirham": 1, "dirhams": 1, "moroccan dirham": 1, "moroccan dirhams": 1},
    "currency:GBP": {"£": 1, "gbp": 1, "pound sterling": 1, "pounds sterling": 1, "livres sterling": 1},
    "currency:CHF": {"chf": 1, "swiss franc": 1, "swiss francs": 1, "francs suisses": 1},
    "day": {"d": 1, "day": 1, "days": 1, "calendar day": 1, "calendar days": 1, "j": 1, "jour": 1, "jours": 1, "jour calendaire": 1, "jours calendaires": 1, "h": 1 / 24, "hr": 1 / 24, "hrs": 1 / 24, "hour": 1 / 24, "hours": 1 / 24, "heure": 1 / 24, "heures": 1 / 24, "min": 1 / 1440, "mins": 1 / 1440, "mn": 1 / 1440, "minute": 1 / 1440, "minutes": 1 / 1440, "sec": 1 / 86400, "second": 1 / 86400, "seconds": 1 / 86400, "seconde": 1 / 86400, "secondes": 1 / 86400, "wk": 7, "wks": 7, "week": 7, "weeks": 7, "semaine": 7, "semaines": 7, "sem": 7, "fortnight": 14, "fortnights": 14},
    "month": {"month": 1, "months": 1, "mo": 1, "mos": 1, "mth": 1, "mths": 1, "mois": 1, "quarter": 3, "quarters": 3, "qtr": 3, "qtrs": 3, "trimestre": 3, "trimestres": 3, "semestre": 6, "semestres": 6, "year": 12, "years": 12, "yr": 12, "yrs": 12, "y": 12, "an": 12, "ans": 12, "année": 12, "années": 12, "annum": 12},
    "length": {"in": 0.0254, "inch": 0.0254, "inches": 0.0254, "pouce": 0.0254, "pouces": 0.0254, "ft": 0.3048, "foot": 0.3048, "feet": 0.3048, "pied": 0.3048, "pieds": 0.3048, "yd": 0.9144, "yard": 0.9144, "yards": 0.9144, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344, "micron": 1e-6, "microns": 1e-6},
    "area": {"ha": 1e4, "hectare": 1e4, "hectares": 1e4, "acre": 4046.8564224, "acres": 4046.8564224, "are": 100, "ares": 100},
    "volume": {"gallon": 0.003785411784, "gallons": 0.003785411784, "gal": 0.003785411784, "barrel": 0.158987294928, "barrels": 0.158987294928, "cc": 1e-6},
    "mass": {"tonne": 1000, "tonnes": 1000, "metric ton": 1000, "metric tons": 1000, "metric tonne": 1000, "metric tonnes": 1000, "quintal": 100, "quintaux": 100, "lb": 0.45359237, "lbs": 0.45359237, "pound": 0.45359237, "pounds": 0.45359237, "livre": 0.5, "livres": 0.5, "oz": 0.028349523125, "ounce": 0.028349523125, "ounces": 0.028349523125, "kilo": 1, "kilos": 1},
    "pressure": {"psi": 6894.757293168, "atm": 101325, "mmhg": 133.322387415},
    "energy": {"cal": 4.184, "btu": 1055.05585262},
    "temperature": {"k": (1, 0), "kelvin": (1, 0), "kelvins": (1, 0), "°k": (1, 0)} | {c: (1, 273.15) for c in ("°c", "deg c", "degc", "degree celsius", "degrees celsius", "degré celsius", "degrés celsius", "celsius", "℃", "º c", "° c", "ºc")} | {f: (5 / 9, 459.67 * 5 / 9) for f in ("°f", "deg f", "degf", "degree fahrenheit", "degrees fahrenheit", "degré fahrenheit", "degrés fahrenheit", "fahrenheit", "℉", "° f", "ºf")},
    "ratio": {"%": 0.01, "percent": 0.01, "per cent": 0.01, "pct": 0.01, "pour cent": 0.01, "pourcent": 0.01, "‰": 0.001, "per mille": 0.001, "per mil": 0.001, "permille": 0.001, "pour mille": 0.001, "bp": 1e-4, "bps": 1e-4, "basis point": 1e-4, "basis points": 1e-4, "point de base": 1e-4, "points de base": 1e-4, "pb": 1e-4, "ppm": 1e-6},
}
# Roots that take letter prefixes (case counts), and those that take their names.
LETTER_ROOTS = {"length": {"m": 1}, "mass": {"g": 0.001, "t": 1000}, "volume": {"l": 0.001, "L": 0.001, "ℓ": 0.001}, "pressure": {"Pa": 1, "bar": 1e5}, "energy": {"J": 1, "Wh": 3600}, "day": {"s": 1 / 86400}}
NAMED_ROOTS = {"length": {"metre": 1, "metres": 1, "meter": 1, "meters": 1, "mètre": 1, "mètres": 1}, "mass": {"gram": 0.001, "grams": 0.001, "gramme": 0.001, "grammes": 0.001}, "volume": {"litre": 0.001, "litres": 0.001, "liter": 0.001, "liters": 0.001}, "pressure": {"pascal": 1, "pascals": 1, "bars": 1e5}, "energy": {"joule": 1, "joules": 1, "watt-hour": 3600, "watt-hours": 3600, "watt hour": 3600, "watt hours": 3600, "wattheure": 3600, "wattheures": 3600}}
#: Roots that count only where nothing else does: "2 y 4 m" are months, "3 h 20 m" minutes.
FAINT_ROOTS = {"month": {"m": 1}, "day": {"m": 1 / 1440}}
LETTERS = {"k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "h": 100, "da": 10, "d": 0.1, "c": 0.01, "m": 1e-3, "µ": 1e-6, "μ": 1e-6, "u": 1e-6, "n": 1e-9}
NAMES = {"kilo": 1e3, "mega": 1e6, "méga": 1e6, "giga": 1e9, "hecto": 100, "hect": 100, "deca": 10, "déca": 10, "deci": 0.1, "déci": 0.1, "centi": 0.01, "milli": 1e-3, "micro": 1e-6}
#: Words and letters that multiply an amount; "m" is a million only beside a currency.
SCALES = {"thousand": 1e3, "thousands": 1e3, "thousand of": 1e3, "millier de": 1e3, "milliers de": 1e3, "milliers d'": 1e3, "millier d'": 1e3, "mille": 1e3, "million": 1e6, "millions": 1e6, "millions of": 1e6, "million de": 1e6, "millions de": 1e6, "million d'": 1e6, "millions d'": 1e6, "mio": 1e6, "mn": 1e6, "billion": 1e9, "billions": 1e9, "bn": 1e9, "milliard de": 1e9, "milliards de": 1e9, "milliards d'": 1e9, "milliard": 1e9, "milliards": 1e9, "hundred": 100, "dozen": 12}
MONEY_LETTERS = {"k": 1e3, "K": 1e3, "M": 1e6, "m": 1e6, "G": 1e9, "B": 1e9, "b": 1e9}
POWERS = {"sq": 2, "sq.": 2, "square": 2, "squared": 2, "²": 2, "2": 2, "^2": 2, "carré": 2, "carrés": 2, "cu": 3, "cu.": 3, "cubic": 3, "cubed": 3, "³": 3, "3": 3, "^3": 3, "cube": 3, "cubes": 3}
#: Dimensions that a field is known to hold.
PRIORS = {"amount": "currency", "duration": "day month", "rate": "ratio", "measure": "length area volume mass pressure energy temperature"}
# Numbers that are written as words.
WORDS = {w: n for n, ws in enumerate("zero zéro|one un une|two deux|three trois|four quatre|five cinq|six|seven sept|eight huit|nine neuf|ten dix|eleven onze|twelve douze|thirteen treize|fourteen quatorze|fifteen quinze|sixteen seize|seventeen dix-sept|eighteen dix-huit|nineteen dix-neuf|twenty vingt".split("|")) for w in ws.split()} | {"thirty": 30, "trente": 30, "forty": 40, "quarante": 40, "fifty": 50, "cinquante": 50, "sixty": 60, "soixante": 60, "seventy": 70, "eighty": 80, "ninety": 90}

_SPACES = dict.fromkeys(map(ord, "    \t\r\n"), " ")
_NUMBER = re.compile(r"[-+−]?(?:\d{1,3}(?:[ '’_]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)*|[.,]\d+)(?:[eE][+-]?\d+)?")
_WORD = re.compile(r"^(?:" + "|".join(sorted(WORDS, key=len, reverse=True)) + r")(?=[\s-]*\D)", re.I)


class Trie:
    """Words with values; ``ends`` gives all words that begin at a place of a text."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, value) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append(value)

    def ends(self, text: str, at: int):
        node = self.root
        while True:
            for value in node.get("", ()):
                yield at, value
            if at == len(text) or (node := node.get(text[at])) is None:
                return
            at += 1


@lru_cache(None)
def _tries() -> tuple[Trie, Trie, Trie, Trie]:
    prefixes, words, letters, powers = Trie(), Trie(), Trie(), Trie()
    for kind, names in ROOTS.items():
        for word, size in names.items():
            words.add(word, (kind, size, "money" if kind.startswith("currency") else "none"))
    for kind, names in FAINT_ROOTS.items():
        for word, size in names.items():
            words.add(word, (kind, size, "faint"))
    for kind, names in NAMED_ROOTS.items():
        for word, size in names.items():
            words.add(word, (kind, size, "name"))
    for kind, names in LETTER_ROOTS.items():
        for word, size in names.items():
            letters.add(word, (kind, size, "letter"))
    for table, sort in ((LETTERS, "letter"), (NAMES, "name"), (SCALES, "scale"), (MONEY_LETTERS, "money")):
        for word, factor in table.items():
            for form in {word, word.upper(), word.capitalize()} if sort in ("name", "scale") else {word}:
                prefixes.add(form, (factor, sort))
    for word, power in POWERS.items():
        powers.add(word, power)
    return prefixes, words, letters, powers


def _kept(function):
    """``function`` with its results for short texts kept; long ones are worked out each time."""
    quick = lru_cache(65536)(function)

    @wraps(function)
    def call(text, *others):
        return quick(text, *others) if not text or len(text) <= 200 else function(text, *others)

    return call


@_kept
def parse_unit(text: str, field: str | None = None, only: str | None = None) -> tuple[str, float, float] | None:
    """(kind, factor, offset) of the best segmentation of all of ``text``, of the kind ``only`` if given, or None.

    A state is how far the text is read and what was read: factor, power, root. Fewer and
    longer segments score higher; so does a dimension that the field is known to hold.
    """
    text = " ".join(text.split())
    if not text:
        return None
    prefixes, words, letters, powers = _tries()
    lower = text.lower() if len(text.lower()) == len(text) else text
    wanted = PRIORS.get(field or "", "").split()
    # per position: state (root, factor, power, glued prefix sort, money scale used) -> score
    layers: dict[int, dict] = {0: {(None, 1.0, 1, "", False): 0.0}}

    def put(at: int, state: tuple, score: float) -> None:
        if score > layers.setdefault(at, {}).get(state, -1e9):
            layers[at][state] = score

    for at in range(len(text)):
        if at not in layers:
            if at > max(layers):
                return None  # nothing reads on from here, however long the text is
            continue
        for (root, factor, power, glued, scaled), score in list(layers[at].items()):
            if text[at] in " .·-" and not (glued in ("letter", "name")):
                put(at + 1, (root, factor, power, "", scaled), score)
            if glued in ("", "money"):
                for end, p in powers.ends(text, at):
                    if power == 1 and end > at and (root is None or root[0] == "length") and not (root is None and text[at].isdigit()) and not glued:
                        put(end, (root, factor, p, "", scaled), score - 1)
            if root is None:
                for end, (kind, size, sort) in (*words.ends(lower, at), *letters.ends(text, at)):
                    if end == at or (glued in ("letter", "name") and sort != glued) or (glued == "money" and sort != "money"):
                        continue
                    if end < len(text) and text[end].isalpha() and text[end - 1].isalpha() and sort != "money":
                        continue
                    prior = 3 if any(kind == w or kind.startswith(w + ":") for w in wanted) else -3 * bool(wanted)
                    put(end, ((kind, size), factor, power, "", scaled), score - 1 + prior - 0.5 * (sort == "faint") - 0.1 * (sort == "faint" and kind == "day"))
            for end, (by, sort) in prefixes.ends(text, at):
                if end == at or glued or (sort != "scale" and factor != 1):
                    continue
                if sort in ("letter", "name"):
                    if root is None and end < len(text) and text[end] != " ":
                        put(end, (root, by, power, sort, scaled), score - 1.2)
                elif sort == "scale":
                    if not scaled and (at == 0 or not text[at - 1].isalpha()) and (end == len(text) or not text[end].isalpha() or text[end - 1] == "'"):
                        put(end, (root, factor * by, power, "", True), score - 1)
                elif not scaled and root and root[0].startswith("currency") and end == len(text):
                    put(end, (root, factor * by, power, "", True), score - 1)
                elif not scaled and root is None and end < len(text):
                    put(end, (root, factor * by, power, "money", True), score - 1.1)
    best = None
    for (root, factor, power, glued, _), score in layers.get(len(text), {}).items():
        if root is None or glued or (power != 1 and root[0] != "length"):
            continue
        kind, size = root
        if only and kind != only and not (kind == "length" and power > 1):
            continue
        size, offset = size if isinstance(size, tuple) else (size, 0.0)
        if kind == "length" and power > 1:
            kind, size, factor = {2: "area", 3: "volume"}[power], size**power, factor**power
        if wanted and kind.split(":")[0] in wanted:
            score += 1
        if best is None or score > best[0]:
            best = (score, kind, size * factor, offset)
    return best[1:] if best else None


def parse_number(text: str) -> float | None:
    """The number of a numeral with any usual grouping and decimal sign."""
    mantissa, _, exponent = re.sub(r"[ '’_]", "", text.replace("−", "-")).lower().partition("e")
    signs = re.sub(r"[^.,]", "", mantissa)
    if signs:
        last = signs[-1]
        tail = len(mantissa) - 1 - mantissa.rindex(last)
        grouped = signs.count(last) > 1 or (len(signs) == 1 and tail == 3 and not exponent and not re.search(r"[ '’_]", text) and re.match(r"[-+]?[1-9]\d{0,2}[.,]", mantissa))
        if grouped:
            mantissa = mantissa.replace(last, "") if len(set(signs)) == 1 else mantissa.replace(",", "").replace(".", "")
        else:
            whole, part = mantissa[: -tail - 1] if tail else mantissa[:-1], mantissa[len(mantissa) - tail :] if tail else ""
            mantissa = re.sub(r"[.,]", "", whole) + "." + part
    try:
        value = float(mantissa + ("e" + exponent if exponent else ""))
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def split_quantity(text: str) -> list[tuple[str, float, str]]:
    """(text before, number, text after) of each number of a written quantity."""
    text = text.translate(_SPACES).strip()
    word = _WORD.match(text)
    if word:
        return [("", float(WORDS[word[0].lower()]), text[word.end() :].strip(" -"))]
    found = []
    for m in _NUMBER.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "^") and not found and text[m.start() - 1].isdigit():
            continue
        if found and not text[found[-1][1] : m.start()].strip():
            continue
        if found and text[m.start() - 1 : m.start()].isalpha() and m[0] in "23":
            continue  # a power, as in m2
        found.append((m.start(), m.end(), m[0]))
    out = []
    for k, (a, b, digits) in enumerate(found):
        value = parse_number(digits)
        if value is not None:
            out.append((text[:a].strip() if k == 0 else "", value, text[b : found[k + 1][0] if k + 1 < len(found) else len(text)].strip()))
    return out


@_kept
def parse_quantity(text: str | None, field: str | None = None, unit: str | None = None) -> tuple[str, float] | None:
    """(kind, value) of a written quantity; ``unit`` is used where the text has none."""
    if not text:
        return None
    total, kind = 0.0, None
    for before, value, after in split_quantity(text):
        sign = -1 if before in ("-", "−") else 1
        before = "" if sign < 0 else before
        after = re.sub(r"^(and|et|,)\s|\s(and|et|,)$", "", after).strip()
        label = f"{before} {after}".strip()
        if not label:
            if not unit:
                return None
            label = unit.translate(_SPACES)
        unit_found = parse_unit(label, field)
        if unit_found and kind not in (None, unit_found[0]):
            unit_found = parse_unit(label, field, kind)
        if unit_found is None or kind not in (None, unit_found[0]):
            return None
        kind = unit_found[0]
        total += sign * value * unit_found[1] + unit_found[2]
    return (kind, total) if kind else None


@_kept
def unit_in(note: str | None, field: str | None = None) -> str | None:
    """The unit that a note such as "(figures in kEUR)" or "unit: m2" names: its longest ending that is one."""
    if not note:
        return None
    words = note.translate(_SPACES).strip(" ()[]{}.;:").split(" ")
    for k in range(len(words)):
        text = " ".join(words[k:]).strip(" ()[]:.")
        if parse_unit(text, field):
            return text
    return None


def _has_unit(text: str) -> bool:
    return any(b or a for b, _, a in split_quantity(text))


def with_quantity(df: DataFrame, text: str, field: str | Column, note: str | Column | None = None, spare: str | None = None) -> DataFrame:
    """``df`` with ``kind`` and ``value`` of the quantity written in ``text``.

    ``field``: a column, or a literal, naming what the field holds. ``note``: a column naming
    the unit of numbers that carry none. ``spare``: a column read where ``text`` is null.
    Columns called kind or value are replaced; all others pass unchanged.
    """
    base = df.drop("kind", "value")
    extra = {"q_text": F.col(text) if spare is None else F.coalesce(F.col(text), F.col(spare)), "q_field": F.lit(field) if isinstance(field, str) else field, "q_note": F.lit(None).cast("string") if note is None else F.col(note) if isinstance(note, str) else note}
    kept = [f"c{i}" for i in range(len(base.columns))]
    work = base.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(base.columns, kept)], *[v.alias(k) for k, v in extra.items()])
    schema = T.StructType([*work.select(*kept).schema.fields, T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType())])

    def run(batches):
        for batch in batches:
            got = []
            for t, f, n in zip(*(batch.column(c).to_pylist() for c in ("q_text", "q_field", "q_note"))):
                got.append(parse_quantity(t, f, unit_in(n, f)) or (None, None))
            columns = [batch.column(c) for c in kept] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = schema.names
    return work.mapInArrow(run, schema).toDF(*base.columns, "kind", "value")


#: A number followed by a bracket, as a text states the unit of a bare number.
NUMBER_WITH_NOTE = r"([-−]?\d[\d.,'’eE+\-\s   ]*)\s*[(\[]([^()\[\]]+)[)\]]"


def unit_notes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, note): the bare numbers of a text that a bracket follows, and what is in it."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(NUMBER_WITH_NOTE), 1).alias("number"), F.regexp_extract_all(text, F.lit(NUMBER_WITH_NOTE), 2).alias("note"))
    rows = texts.select(key, F.explode(pairs).alias("p")).select(key, F.trim(F.regexp_replace("p.number", r"[\s   ]+", " ")).alias("number"), F.col("p.note").alias("note"))
    return rows.groupBy(key, "number").agg(F.min("note").alias("note"))


def agreeing_pairs(items: DataFrame, share: float = 0.005, kelvin: float = 0.5) -> DataFrame:
    """Pairs of ``items(scope, item, kind, value)`` of one scope and kind that agree.

    Agree: differ by at most ``share`` of the larger, temperatures by at most ``kelvin``. Values
    fall in bands as wide as the tolerance and meet only values of their own and the two
    neighbouring bands, so a large scope isn't compared with itself. Null kinds are left out.
    """
    width = -math.log1p(-share) * 1.000001
    warm = F.col("kind") == "temperature"
    band = F.when(warm, F.floor(F.col("value") / kelvin)).when(F.col("value") == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs("value")) / width)).cast("long")
    side = F.when(warm, F.lit(0)).otherwise(F.signum("value").cast("int"))
    rows = items.where("kind is not null and value is not null").select("scope", "item", "kind", "value", side.alias("side"), band.alias("band")).distinct()
    left = rows.select("scope", "kind", "side", "band", F.col("item").alias("a"), F.col("value").alias("x"))
    right = rows.select("scope", "kind", "side", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("item").alias("b"), F.col("value").alias("y"))
    gap = F.abs(F.col("x") - F.col("y"))
    near = F.when(F.col("kind") == "temperature", gap <= kelvin + 1e-9).otherwise(gap <= share * F.greatest(F.abs("x"), F.abs("y")) * (1 + 1e-9))
    pairs = left.join(right, ["scope", "kind", "side", "band"]).where((F.col("a") < F.col("b")) & near)
    return pairs.select("scope", F.col("a").alias("left_key"), F.col("b").alias("right_key")).distinct()
