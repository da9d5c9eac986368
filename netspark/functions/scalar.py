"""Scalar functions that Spark has no builtin for, and the road and cost normalisations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fallback speed by road class, km/h.
CLASS_SPEED = {
    "living_street": 20,
    "residential": 30,
    "unclassified": 30,
    "primary": 50,
    "secondary": 50,
    "tertiary": 50,
    "motorway_link": 60,
    "trunk_link": 50,
    "primary_link": 40,
    "secondary_link": 40,
    "tertiary_link": 40,
    "motorway": 120,
    "trunk": 90,
}
OTHER_SPEED = 30
FALLBACK_METRES_PER_SECOND = 13.9


def cot(x: Column) -> Column:
    return F.lit(1.0) / F.tan(x)


def acot(x: Column) -> Column:
    return F.lit(1.5707963267948966) - F.atan(x)


def coth(x: Column) -> Column:
    return F.lit(1.0) / F.tanh(x)


def sgn(x: Column) -> Column:
    return F.signum(x)


def step(x: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(1.0)


def round_half_even(x: Column) -> Column:
    return F.rint(x)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def thousandths(cost: Column) -> Column:
    """Whole thousandths, by which costs are ordered and budgets compared."""
    return F.round(cost * 1000).cast("long")


def oneway(tag: Column) -> tuple[Column, Column]:
    """(directed, reversed) of a ``oneway`` tag."""
    return F.coalesce(tag.isin("yes", "true", "1", "-1"), F.lit(False)), F.coalesce(tag == "-1", F.lit(False))


def speed(maxspeed: Column, road_class: Column) -> Column:
    """Metres a second of a ``maxspeed`` tag, by class where it says nothing usable."""
    text = F.trim(maxspeed)
    # "30 mph" needs its blank, as the tag is written; anything else that is no number says nothing.
    miles = F.regexp_extract(text, r"^(.*) mph$", 1)
    said = F.when(text == "walk", 7.0).when(text == "none", 130.0).when(text.endswith(" mph"), F.trim(miles).try_cast("double") * 1.609344).otherwise(text.try_cast("double"))
    table = F.lit(float(OTHER_SPEED))
    for name, value in CLASS_SPEED.items():
        table = F.when(road_class == name, float(value)).otherwise(table)
    return F.when((said > 0) & ~F.isnan(said), said).otherwise(table) / 3.6


def travel_cost(length: Column, own_speed: Column | None = None, fallback: float = FALLBACK_METRES_PER_SECOND) -> Column:
    """Seconds along a length; the row's own speed where it is finite and positive."""
    if own_speed is None:
        return length / fallback
    usable = (own_speed > 0) & ~F.isnan(own_speed) & (own_speed < float("inf"))
    return length / F.when(usable, own_speed).otherwise(F.lit(fallback))


def pulse(amplitude: Column, front: Column, hops: Column) -> Column:
    """Diffusion pulse over hop distance; null where unreachable."""
    return amplitude * F.exp(-F.pow(front - hops, 2) / 2)


def gradient(source: Column, target: Column, along: Column, low: Column, high: Column) -> Column:
    """Value between two node values, normalised by a range and clamped to 0..1."""
    mixed = source * (1 - along) + target * along
    return F.greatest(F.least((mixed - low) / (high - low), F.lit(1.0)), F.lit(0.0))


def log_or_zero(x: Column, base10: bool = False) -> Column:
    """Logarithm (natural, or to 10) where there is one, else 0."""
    return F.when(x > 0, F.log10(x) if base10 else F.log(x)).otherwise(0.0)


def root(x: Column) -> Column:
    """Square root where there is one, else 0."""
    return F.when(x >= 0, F.sqrt(x)).otherwise(0.0)


#: Functions an expression may name beside the operators + - * / ^ and brackets.
FUNCTIONS = {
    "cos": F.cos, "sin": F.sin, "tan": F.tan, "cot": cot, "abs": F.abs, "sgn": sgn, "sqrt": root, "log": log_or_zero, "exp": F.exp, "asin": F.asin, "acos": F.acos,
    "atan": F.atan, "acot": acot, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "coth": coth, "log10": lambda x: log_or_zero(x, True), "step": step,
}


def expression(text: str, columns: dict[str, Column]) -> Column:
    """The column of an arithmetic expression over named columns; names are read in any case.

    ``^`` binds tightest and to the right, then the sign, ``*`` and ``/``, ``+`` and ``-``.
    """
    import re

    tokens = re.findall(r"[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?|[A-Za-z_][A-Za-z_0-9]*|[-+*/^()]|\S", text)
    names = {k.lower(): v for k, v in columns.items()}
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(wanted: str | None = None) -> str:
        nonlocal at
        token = peek()
        if not token or (wanted is not None and token != wanted):
            raise ValueError(f"'{text}' breaks off at '{token or 'its end'}'")
        at += 1
        return token

    def atom() -> Column:
        token = take()
        if token == "(":
            inner = total()
            take(")")
            return inner
        if token[0].isdigit() or token[0] == ".":
            return F.lit(float(token))
        if token.lower() in FUNCTIONS and peek() == "(":
            take("(")
            inner = total()
            take(")")
            return FUNCTIONS[token.lower()](inner)
        if token.lower() not in names:
            raise ValueError(f"'{text}' names '{token}', which is not known")
        return names[token.lower()].cast("double")

    def power() -> Column:
        base = atom()
        if peek() != "^":
            return base
        take()
        return F.pow(base, signed())

    def signed() -> Column:
        if peek() in ("-", "+"):
            return -signed() if take() == "-" else signed()
        return power()

    def product() -> Column:
        out = signed()
        while peek() in ("*", "/"):
            out = out * signed() if take() == "*" else out / F.nullif(signed(), F.lit(0.0))
        return out

    def total() -> Column:
        out = product()
        while peek() in ("+", "-"):
            out = out + product() if take() == "+" else out - product()
        return out

    found = total()
    if at < len(tokens):
        raise ValueError(f"'{text}' breaks off at '{peek()}'")
    return found
