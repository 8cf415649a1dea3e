"""Functions beyond the evaluator's core: conditional aggregates, lookups, statistics, dates, text, arrays, finance."""

from __future__ import annotations

import calendar
import math
import re
import statistics
from collections.abc import Callable
from datetime import datetime, timedelta
from typing import Any

from quartzgrid.formulas.evaluator import DIV, EPOCH, FUNCTIONS, NA, NUM, REF, VALUE, Error, Grid, Stop, Unknown, _lookup_index, _order, arithmetic, compare, criterion, flat, number, numbers, single, text, truth


def cells(value: Any) -> list[Any]:
    return [x for x, _ in flat([value])]


def rows_of(value: Any) -> Grid:
    return value if isinstance(value, Grid) else Grid([[value]])


# ---- conditional aggregates ----------------------------------------------------------


def _where(pairs: tuple) -> list[bool]:
    """For each cell of the first range, whether all criteria hold; ranges must be of one size."""
    held: list[bool] | None = None
    for k in range(0, len(pairs), 2):
        test = criterion(pairs[k + 1])
        own = [bool(test(x)) for x in cells(pairs[k])]
        if held is not None and len(own) != len(held):
            raise Stop(VALUE)
        held = own if held is None else [a and b for a, b in zip(held, own)]
    return held or []


def _picked(values: Any, pairs: tuple) -> list[float]:
    held, found = _where(pairs), cells(values)
    if len(held) != len(found):
        raise Stop(VALUE)
    return numbers([Grid([[v for v, h in zip(found, held) if h]])])


def _mean(values: list[float]) -> float:
    return arithmetic("/", math.fsum(values), len(values))


# ---- lookups -------------------------------------------------------------------------


def _hlookup(value: Any, grid: Any, row: Any, near: Any = True) -> Any:
    table = rows_of(grid)
    at, r = _lookup_index(value, table[0], 1 if truth(near) else 0), int(number(row))
    if not 1 <= r <= len(table):
        raise Stop(REF if r > 0 else VALUE)
    return table[r - 1][at]


def _near(value: Any, found: list[Any], mode: int) -> int | None:
    """Place of an exact match, or of the next smaller (-1) or larger (1) item; wildcards with mode 2."""
    value = single(value)
    if mode == 2:
        test = criterion(value)
        return next((k for k, x in enumerate(found) if test(x)), None)
    usable = [(k, x) for k, x in enumerate(found) if x is not None and not isinstance(x, (Error, Unknown)) and _order(x)[0] == _order(value)[0]]
    exact = next((k for k, x in usable if compare("=", x, value)), None)
    if exact is not None or mode == 0:
        return exact
    beyond = [(k, x) for k, x in usable if compare("<" if mode < 0 else ">", x, value)]
    pick = max if mode < 0 else min
    return pick(beyond, key=lambda p: _order(p[1]))[0] if beyond else None


def _xmatch(value: Any, found: Any, mode: Any = 0.0, search: Any = 1.0) -> float:
    held = cells(found)
    backwards = int(number(search)) < 0
    at = _near(value, held[::-1] if backwards else held, int(number(mode)))
    if at is None:
        raise Stop(NA)
    return float((len(held) - at) if backwards else at + 1)


def _xlookup(value: Any, found: Any, results: Any, missing: Any = None, mode: Any = 0.0, search: Any = 1.0) -> Any:
    try:
        at = int(_xmatch(value, found, mode, search)) - 1
    except Stop as stop:
        if stop.value == NA and missing is not None:
            return missing
        raise
    grid = rows_of(results)
    if len(rows_of(found)) > 1 or len(grid) == len(cells(found)):
        line = grid[at]
        return line[0] if len(line) == 1 else Grid([line])
    return grid[0][at] if len(grid) == 1 else Grid([[row[at]] for row in grid])


def _lookup(value: Any, found: Any, results: Any = None) -> Any:
    return cells(found if results is None else results)[_lookup_index(value, cells(found), 1)]


# ---- statistics ----------------------------------------------------------------------


def _place(values: tuple, k: Any, largest: bool) -> float:
    held, n = sorted(numbers(values), reverse=largest), int(number(k))
    if not 1 <= n <= len(held):
        raise Stop(NUM)
    return held[n - 1]


def _rank(value: Any, found: Any, ascending: Any = 0.0) -> float:
    held, x = numbers([found]), number(value)
    if x not in held:
        raise Stop(NA)
    return 1.0 + sum(h < x if number(ascending) else h > x for h in held)


def _quantile(values: Any, share: Any) -> float:
    held, p = sorted(numbers([values])), number(share)
    if not held or not 0 <= p <= 1:
        raise Stop(NUM)
    at = p * (len(held) - 1)
    low = math.floor(at)
    return held[low] + (at - low) * (held[min(low + 1, len(held) - 1)] - held[low])


def _mode(*values: Any) -> float:
    held = numbers(values)
    most = max((held.count(x) for x in held), default=0)
    if most < 2:
        raise Stop(NA)
    return next(x for x in held if held.count(x) == most)


def _spread(values: tuple, sample: bool, root: bool) -> float:
    held = numbers(values)
    if len(held) < (2 if sample else 1):
        raise Stop(DIV)
    found = statistics.variance(held) if sample else statistics.pvariance(held)
    return math.sqrt(found) if root else found


# ---- numbers -------------------------------------------------------------------------


def _rounded(x: Any, digits: Any, away: bool | None) -> float:
    """Away from zero, towards it, or (None) truncated; the scaled value is cleaned of its last binary digits first."""
    value, n = number(x), int(number(digits))
    scaled = float(f"{abs(value) * 10.0**n:.12g}")
    return math.copysign((math.ceil if away else math.floor)(scaled) / 10.0**n, value)


def _multiple(x: Any, step: Any, up: bool) -> float:
    value, s = number(x), number(step)
    if s == 0:
        return 0.0
    if value > 0 > s:
        raise Stop(NUM)
    return (math.ceil if up else math.floor)(float(f"{value / s:.12g}")) * s


def _logarithm(x: Any, base: Any) -> float:
    value, b = number(x), number(base)
    if value <= 0 or b <= 0:
        raise Stop(NUM)
    if b == 1:
        raise Stop(DIV)
    return math.log10(value) if b == 10 else math.log(value) / math.log(b)


def _fraction(x: Any) -> float:
    value = number(x)
    if value < 0 or value > 170:
        raise Stop(NUM)
    return float(math.factorial(int(value)))


def _of(function: Callable[[float], float]) -> Callable[[Any], float]:
    def run(x: Any) -> float:
        try:
            return function(number(x))
        except (ValueError, OverflowError):
            raise Stop(NUM) from None

    return run


# ---- dates ---------------------------------------------------------------------------


def day_of(value: Any) -> datetime:
    serial = number(value)
    if serial < 0:
        raise Stop(NUM)
    return EPOCH + timedelta(days=serial)


def serial(day: datetime) -> float:
    return (day - EPOCH) / timedelta(days=1)


def _moved(value: Any, months: Any, to_end: bool) -> float:
    day, n = day_of(math.floor(number(value))), int(number(months))
    year, month = divmod(day.year * 12 + day.month - 1 + n, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return serial(datetime(year, month + 1, last if to_end else min(day.day, last)))


def _weekday(value: Any, kind: Any = 1.0) -> float:
    monday, k = day_of(value).weekday(), int(number(kind))  # Monday 0
    if k == 1:
        return float((monday + 1) % 7 + 1)
    if k == 2:
        return float(monday + 1)
    if k == 3:
        return float(monday)
    raise Stop(NUM)


def _datedif(start: Any, end: Any, unit: Any) -> float:
    a, b, kind = day_of(start), day_of(end), text(unit).upper()
    if a > b:
        raise Stop(NUM)
    months = (b.year - a.year) * 12 + b.month - a.month - (b.day < a.day)
    if kind in ("Y", "M", "D", "YM"):
        return float({"Y": months // 12, "M": months, "D": (b - a).days, "YM": months % 12}[kind])
    raise Stop(NUM)


def _workdays(start: Any, end: Any, holidays: Any = None) -> float:
    a, b = day_of(start), day_of(end)
    free = {day_of(x).date() for x in cells(holidays) if x is not None} if holidays is not None else set()
    sign = 1 if a <= b else -1
    low, high = min(a, b), max(a, b)
    weeks, rest = divmod((high - low).days + 1, 7)
    n = 5 * weeks + sum((low + timedelta(days=7 * weeks + k)).weekday() < 5 for k in range(rest))
    n -= sum(low.date() <= d <= high.date() and d.weekday() < 5 for d in free)
    return float(sign * n)


def _read_number(value: Any) -> float:
    raw = single(value)
    if not isinstance(raw, str):
        return number(raw)
    plain = raw.strip().replace(",", "").replace("$", "")
    try:
        return float(plain.rstrip("%")) / (100 if plain.endswith("%") else 1)
    except ValueError:
        pass
    try:
        return serial(datetime.fromisoformat(raw.strip()))
    except ValueError:
        raise Stop(VALUE) from None


# ---- text ----------------------------------------------------------------------------

_DATE_PARTS = {"yyyy": "%Y", "yy": "%y", "mmmm": "%B", "mmm": "%b", "mm": "%m", "dddd": "%A", "ddd": "%a", "dd": "%d", "hh": "%H", "ss": "%S"}


def _formatted(value: Any, code: Any) -> str:
    """Number and date formats of one section: grouping, decimals, percent, exponent, padding zeros, literal text around them."""
    raw, form = single(value), text(code)
    if isinstance(raw, str):
        return raw
    x = number(raw)
    if re.search(r"[ymdhs]", re.sub(r'"[^"]*"', "", form), re.I) and not re.search("[0#]", form):
        day = day_of(x)

        def part(m: re.Match) -> str:
            key = m[0].lower()
            if key == "mm" and (form[: m.start()].lower().rstrip(":").endswith("h") or form[m.end() :].lower().startswith(":s")):
                return f"{day.minute:02d}"
            return day.strftime(_DATE_PARTS[key]) if key in _DATE_PARTS else str({"m": day.month, "d": day.day, "h": day.hour, "s": day.second, "y": day.year % 100}[key])

        return re.sub(r'"([^"]*)"', r"\1", re.sub(r"yyyy|yy|mmmm|mmm|mm|m|dddd|ddd|dd|d|hh|h|ss|s(?![^\"]*\"[^\"]*$)", part, form, flags=re.I))
    sections = form.split(";")
    if x < 0 and len(sections) > 1:
        form, x = sections[1], -x
    else:
        form = sections[2] if x == 0 and len(sections) > 2 else sections[0]
    found = re.search(r"[0#?][0#?,]*(?:\.[0#?]+)?(?:[eE][+-]?0+)?", form)
    if not found:
        return re.sub(r'"([^"]*)"', r"\1", form) if form and form.lower() != "general" else text(x)
    body = found[0]
    x *= 100 ** form.count("%")
    whole, _, decimals = re.split("[eE]", body)[0].partition(".")
    places = len(decimals)
    if re.search("[eE]", body):
        shown = f"{x:.{places}e}"
        mantissa, exponent = shown.split("e")
        shown = f"{mantissa}E{'+' if int(exponent) >= 0 else '-'}{abs(int(exponent)):02d}"
    else:
        scaled = math.floor(abs(x) * 10**places + 0.5 + 1e-9)
        digits = str(scaled).rjust(places + 1, "0")
        left, right = (digits[:-places], digits[-places:]) if places else (digits, "")
        while right and decimals[len(right) - 1] == "#" and right.endswith("0"):
            right = right[:-1]
        left = left.lstrip("0").rjust(whole.replace(",", "").count("0"), "0")
        if "," in whole:
            left = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", left)
        shown = ("-" if x < 0 and scaled else "") + left + ("." + right if right else "")
    return re.sub(r'"([^"]*)"', r"\1", form[: found.start()]) + shown + re.sub(r'"([^"]*)"', r"\1", form[found.end() :])


def _found(needle: Any, hay: Any, start: Any, exact: bool) -> float:
    a, b, at = text(needle), text(hay), int(number(start)) - 1
    if at < 0 or at > len(b):
        raise Stop(VALUE)
    if exact:
        k = b.find(a, at)
        if k < 0:
            raise Stop(VALUE)
        return float(k + 1)
    rule = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"~(?=[*?~])", "", a)) if "~" not in a else re.escape(re.sub(r"~([*?~])", r"\1", a))
    m = re.compile(rule, re.I | re.S).search(b, at)
    if not m:
        raise Stop(VALUE)
    return float(m.start() + 1)


def _substituted(value: Any, old: Any, new: Any, which: Any = None) -> str:
    source, a, b = text(value), text(old), text(new)
    if not a:
        return source
    if which is None:
        return source.replace(a, b)
    parts, n = source.split(a), int(number(which))
    return a.join(parts[:n]) + b + a.join(parts[n:]) if 1 <= n < len(parts) else source


def _replaced(value: Any, start: Any, count: Any, new: Any) -> str:
    source, at = text(value), int(number(start)) - 1
    return source[:at] + text(new) + source[at + int(number(count)) :]


def _joined(mark: Any, skip: Any, *values: Any) -> str:
    found = [text(x) for x, _ in flat(values)]
    return text(mark).join(x for x in found if x or not truth(skip))


# ---- arrays --------------------------------------------------------------------------


def _transposed(value: Any) -> Grid:
    return Grid([list(line) for line in zip(*rows_of(value))])


def _filtered(value: Any, keep: Any, missing: Any = None) -> Any:
    grid, marks = rows_of(value), [bool(x) and x is not None for x in cells(keep)]
    if len(marks) == len(grid):
        out = Grid([line for line, m in zip(grid, marks) if m])
    else:
        out = Grid([[x for x, m in zip(line, marks) if m] for line in grid]) if any(marks) else Grid()
    if out and out[0]:
        return out
    if missing is None:
        raise Stop(Error("#CALC!"))
    return missing


def _unique(value: Any) -> Grid:
    grid = rows_of(value)
    lines = grid if len(grid) > 1 else _transposed(grid)
    found = Grid(list({tuple(x.lower() if isinstance(x, str) else x for x in line): line for line in reversed(lines)}.values())[::-1])
    kept = Grid([line for line in lines if any(line is f for f in found)])
    return kept if len(grid) > 1 else _transposed(kept)


def _sorted(value: Any, column: Any = 1.0, order: Any = 1.0) -> Grid:
    k = int(number(column)) - 1
    return Grid(sorted(rows_of(value), key=lambda line: _order(line[k]), reverse=number(order) < 0))


def _sequence(rows: Any, columns: Any = 1.0, start: Any = 1.0, step: Any = 1.0) -> Grid:
    r, c, a, s = int(number(rows)), int(number(columns)), number(start), number(step)
    if r < 1 or c < 1 or r * c > 1_000_000:
        raise Stop(VALUE)
    return Grid([[a + s * (i * c + j) for j in range(c)] for i in range(r)])


# ---- finance -------------------------------------------------------------------------


def _payment(rate: Any, periods: Any, present: Any, future: Any = 0.0, due: Any = 0.0) -> float:
    r, n, pv, fv, d = (number(x) for x in (rate, periods, present, future, due))
    if n == 0:
        raise Stop(NUM)
    if r == 0:
        return -(pv + fv) / n
    growth = (1 + r) ** n
    return -(pv * growth + fv) * r / ((growth - 1) * (1 + r * d))


def _future(rate: Any, periods: Any, payment: Any, present: Any = 0.0, due: Any = 0.0) -> float:
    r, n, p, pv, d = (number(x) for x in (rate, periods, payment, present, due))
    if r == 0:
        return -(pv + p * n)
    growth = (1 + r) ** n
    return -(pv * growth + p * (1 + r * d) * (growth - 1) / r)


def _present(rate: Any, periods: Any, payment: Any, future: Any = 0.0, due: Any = 0.0) -> float:
    r, n, p, fv, d = (number(x) for x in (rate, periods, payment, future, due))
    if r == 0:
        return -(fv + p * n)
    growth = (1 + r) ** n
    return -(fv + p * (1 + r * d) * (growth - 1) / r) / growth


def _net_present(rate: Any, *values: Any) -> float:
    r = number(rate)
    return math.fsum(x / (1 + r) ** k for k, x in enumerate(numbers(values), 1))


def _return_rate(values: Any, guess: Any = 0.1) -> float:
    """By bisection between rates at which the present value changes its sign."""
    flows = numbers([values])
    worth = lambda r: math.fsum(x / (1 + r) ** k for k, x in enumerate(flows))
    if not (any(x > 0 for x in flows) and any(x < 0 for x in flows)):
        raise Stop(NUM)
    low, high = -0.9999, 1.0
    while worth(low) * worth(high) > 0 and high < 1e6:
        high *= 2
    if worth(low) * worth(high) > 0:
        raise Stop(NUM)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if worth(low) * worth(middle) <= 0 else (middle, high)
    return (low + high) / 2


def _kind_is(test: Callable[[Any], bool]) -> Callable[[Any], bool]:
    return lambda x: test(x[0][0] if isinstance(x, Grid) and x and x[0] else x)


def register() -> None:
    FUNCTIONS.update({
        "SUMIFS": lambda values, *pairs: math.fsum(_picked(values, pairs)),
        "COUNTIFS": lambda *pairs: float(sum(_where(pairs))),
        "AVERAGEIFS": lambda values, *pairs: _mean(_picked(values, pairs)),
        "MAXIFS": lambda values, *pairs: max(_picked(values, pairs), default=0.0),
        "MINIFS": lambda values, *pairs: min(_picked(values, pairs), default=0.0),
        "HLOOKUP": _hlookup, "XLOOKUP": _xlookup, "XMATCH": _xmatch, "LOOKUP": _lookup,
        "MEDIAN": lambda *v: _quantile(Grid([numbers(v)]), 0.5), "MODE": _mode, "MODE.SNGL": _mode,
        "LARGE": lambda v, k: _place((v,), k, True), "SMALL": lambda v, k: _place((v,), k, False),
        "RANK": _rank, "RANK.EQ": _rank, "PERCENTILE": _quantile, "PERCENTILE.INC": _quantile,
        "QUARTILE": lambda v, q: _quantile(v, number(q) / 4), "QUARTILE.INC": lambda v, q: _quantile(v, number(q) / 4),
        "VAR": lambda *v: _spread(v, True, False), "VAR.S": lambda *v: _spread(v, True, False), "VAR.P": lambda *v: _spread(v, False, False), "VARP": lambda *v: _spread(v, False, False),
        "STDEV": lambda *v: _spread(v, True, True), "STDEV.S": lambda *v: _spread(v, True, True), "STDEV.P": lambda *v: _spread(v, False, True), "STDEVP": lambda *v: _spread(v, False, True),
        "SUMSQ": lambda *v: math.fsum(x * x for x in numbers(v)), "GEOMEAN": lambda *v: math.exp(_mean([math.log(x) if x > 0 else number("x") for x in numbers(v)])),
        "ROUNDUP": lambda x, d=0.0: _rounded(x, d, True), "ROUNDDOWN": lambda x, d=0.0: _rounded(x, d, False), "TRUNC": lambda x, d=0.0: _rounded(x, d, False),
        "CEILING": lambda x, s=1.0: _multiple(x, s, True), "FLOOR": lambda x, s=1.0: _multiple(x, s, False), "MROUND": lambda x, s: math.floor(number(x) / number(s) + 0.5) * number(s) if number(s) else 0.0,
        "LN": _of(math.log), "LOG10": _of(math.log10), "LOG": lambda x, b=10.0: _logarithm(x, b), "FACT": _fraction, "PI": lambda: math.pi,
        "SIN": _of(math.sin), "COS": _of(math.cos), "TAN": _of(math.tan), "ASIN": _of(math.asin), "ACOS": _of(math.acos), "ATAN": _of(math.atan), "RADIANS": _of(math.radians), "DEGREES": _of(math.degrees),
        "QUOTIENT": lambda x, y: float(math.trunc(arithmetic("/", number(x), number(y)))), "GCD": lambda *v: float(math.gcd(*(int(x) for x in numbers(v)))), "LCM": lambda *v: float(math.lcm(*(int(x) for x in numbers(v)))),
        "EVEN": lambda x: math.copysign(2 * math.ceil(abs(number(x)) / 2), number(x)), "ODD": lambda x: math.copysign(2 * math.ceil((abs(number(x)) - 1) / 2) + 1 if number(x) else 1, number(x) or 1),
        "EDATE": lambda d, n: _moved(d, n, False), "EOMONTH": lambda d, n: _moved(d, n, True), "WEEKDAY": _weekday, "DAYS": lambda end, start: float((day_of(end) - day_of(start)).days),
        "DATEDIF": _datedif, "NETWORKDAYS": _workdays, "HOUR": lambda x: float(day_of(x).hour), "MINUTE": lambda x: float(day_of(x).minute), "SECOND": lambda x: float(day_of(x).second),
        "TIME": lambda h, m, s: (number(h) * 3600 + number(m) * 60 + number(s)) / 86400 % 1, "ISOWEEKNUM": lambda x: float(day_of(x).isocalendar()[1]), "DATEVALUE": _read_number, "VALUE": _read_number,
        "TEXT": _formatted, "FIND": lambda a, b, s=1.0: _found(a, b, s, True), "SEARCH": lambda a, b, s=1.0: _found(a, b, s, False), "SUBSTITUTE": _substituted, "REPLACE": _replaced,
        "TEXTJOIN": _joined, "REPT": lambda x, n: text(x) * int(number(n)), "PROPER": lambda x: re.sub(r"[^\W\d_]+", lambda m: m[0].capitalize(), text(x)), "EXACT": lambda a, b: text(a) == text(b),
        "CHAR": lambda n: bytes([int(number(n)) % 256]).decode("cp1252", "replace"), "CODE": lambda x: float((text(x)[:1] or "\0").encode("cp1252", "replace")[0]), "CLEAN": lambda x: re.sub(r"[\0-\x1f]", "", text(x)),
        "T": lambda x: x if isinstance(x, str) else "", "N": lambda x: number(x) if not isinstance(single(x), str) else 0.0, "FIXED": lambda x, d=2.0: _formatted(number(x), "#,##0" + ("." + "0" * int(number(d)) if number(d) else "")),
        "TRANSPOSE": _transposed, "FILTER": _filtered, "UNIQUE": _unique, "SORT": _sorted, "SEQUENCE": _sequence,
        "PMT": _payment, "FV": _future, "PV": _present, "NPV": _net_present, "IRR": _return_rate, "SLN": lambda cost, salvage, life: arithmetic("/", number(cost) - number(salvage), number(life)),
        "ISNUMBER": _kind_is(lambda x: isinstance(x, (int, float, datetime)) and not isinstance(x, bool)), "ISTEXT": _kind_is(lambda x: isinstance(x, str)), "ISLOGICAL": _kind_is(lambda x: isinstance(x, bool)),
        "ISBLANK": _kind_is(lambda x: x is None), "ISNONTEXT": _kind_is(lambda x: not isinstance(x, str)), "ISEVEN": lambda x: int(number(x)) % 2 == 0, "ISODD": lambda x: int(number(x)) % 2 == 1,
        "NA": lambda: NA, "TRUE": lambda: True, "FALSE": lambda: False, "AGGREGATE": _aggregate, "SUBTOTAL": _subtotal,
    })


#: What the first argument of SUBTOTAL and AGGREGATE stands for (fixed values).
_NUMBERED = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV", 8: "STDEVP", 9: "SUM", 10: "VAR", 11: "VARP"}


def _subtotal(kind: Any, *values: Any) -> Any:
    name = _NUMBERED.get(int(number(kind)) % 100)
    if name is None:
        raise Stop(VALUE)
    return FUNCTIONS[name](*values)


def _aggregate(kind: Any, options: Any, *values: Any) -> Any:
    """Options 2, 3, 6 and 7 leave errors out."""
    held = values if int(number(options)) not in (2, 3, 6, 7) else [Grid([[x for x in cells(v) if not isinstance(x, Error)]]) for v in values]
    return _subtotal(kind, *held)


register()
