"""Static analysis and evaluation of formulas."""

import pytest

from quartzgrid.formulas.evaluator import Error, Evaluator, Grid, Unknown
from quartzgrid.formulas.lexer import pattern, tokens
from quartzgrid.formulas.references import Context, Edge, Table, analyse
from quartzgrid.operators.whatif import Model

FLEET = Table("Depot", 3, 20, 3, ("Truck", "Trips", "Fuel Used", "Toll"), totals_rows=1)


def context(**more):
    facts = dict(sheet="Calc", sheets=["Calc", "Actuals", "Depot", "Jan", "Feb", "Mar"], extents={"Actuals": (40, 5), "Calc": (100, 6)}, tables={"Fleet": FLEET}, names={(None, "Rate"): "Actuals!$B$7", ("Calc", "Tax"): "Actuals!$C$1", (None, "Tax"): "Actuals!$C$2", (None, "Loop"): "Loop"})
    return Context(**(facts | more))


def spans(formula, **more):
    return [(e.sheet, e.row_lo, e.row_hi, e.col_lo, e.col_hi) for e in analyse(formula, context(**more))[0]]


def reasons(formula, **more):
    return [g.reason for g in analyse(formula, context(**more))[1]]


def test_tokens_give_the_formula_back():
    text = """IF('My ''Sheet'!$A$1:B2>=1.5E+3,"a""b"&Fleet[[Trips]:[Toll]],#N/A)%"""
    assert "".join(t.text for t in tokens("=" + text)) == text


@pytest.mark.parametrize(
    "formula, want",
    [
        ("=SUM(Actuals!D2:D500)*(1+Actuals!C7)", [("Actuals", 2, 500, 4, 4), ("Actuals", 7, 7, 3, 3)]),
        ("=Actuals!$C:$A", [("Actuals", 1, 40, 1, 3)]),
        ("=Actuals!$2:$3", [("Actuals", 2, 3, 1, 5)]),
        ("=100*Rate", [("Actuals", 7, 7, 2, 2)]),
        ("=Tax", [("Actuals", 1, 1, 3, 3)]),
        ("=SUM(Jan:Mar!B2)", [("Jan", 2, 2, 2, 2), ("Feb", 2, 2, 2, 2), ("Mar", 2, 2, 2, 2)]),
        ("=SUM(Fleet[Toll])", [("Depot", 4, 19, 6, 6)]),
        ("=SUM(Fleet[[Trips]:[Fuel Used]])", [("Depot", 4, 19, 4, 5)]),
        ("=Fleet[[#Headers],[Toll]]", [("Depot", 3, 3, 6, 6)]),
        ("=Fleet[[#Totals],[Toll]]", [("Depot", 20, 20, 6, 6)]),
        ("=Fleet[[#Data],[#Totals],[Toll]]", [("Depot", 4, 20, 6, 6)]),
        ("=COUNTA(Fleet[#All])", [("Depot", 3, 20, 3, 6)]),
        ("=COUNTA(Fleet)", [("Depot", 4, 19, 3, 6)]),
        ("=LET(x,A1,x*2)", [("Calc", 1, 1, 1, 1)]),
    ],
)
def test_edges(formula, want):
    assert spans(formula) == want


def test_this_row_is_the_formulas_own_row_inside_the_table():
    assert spans("=Fleet[@Toll]", sheet="Depot", row=7) == [("Depot", 7, 7, 6, 6)]
    assert spans("=Fleet[@Toll]", sheet="Depot", row=25) == [("Depot", 4, 19, 6, 6)]


@pytest.mark.parametrize(
    "formula, want",
    [('=INDIRECT("A2")', ["indirect"]), ("=OFFSET(A3,1,0)", ["volatile_offset"]), ("=[Other.xlsx]Sheet1!A1", ["external_link"]), ("=Nowhere!A1", ["malformed"]), ("=#REF!+Actuals!#REF!+A1", ["malformed", "malformed"]), ("=_xludf.MINE(A1)", ["unsupported_function"]), ("=Loop", ["malformed"]), ("=Fleet[Missing]", ["malformed"])],
)
def test_gaps(formula, want):
    assert reasons(formula) == want


def test_patterns():
    assert pattern("=$A2*2") == pattern("=$A3*2") and pattern("=B2+100") != pattern("=B3+200")
    assert pattern('="Q1"&A2') != pattern('="Q2"&A3')
    assert pattern('=IF(A2>0,"A2",LOG10(B2))') == '=IF(A#>0,"A2",LOG10(B#))'


def value(formula, cells=None):
    held = cells or {}
    return Evaluator(context(), lambda sheet, r1, r2, c1, c2: Grid([[held.get((r, c)) for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1)])).evaluate(formula)


@pytest.mark.parametrize(
    "formula, want",
    [("=-2^2", 4), ("=2^3^2", 64), ("=50%^2", 0.25), ("=(2000-1.5E+3)/4", 125), ("=0^0", Error("#NUM!")), ("=(-8)^(1/3)", Error("#NUM!")), ("=0^-1", Error("#DIV/0!")), ("=1/0+#N/A", Error("#DIV/0!")), ("=10^308*10", Error("#NUM!")), ('=1+"x"', Error("#VALUE!")), ("=1+TRUE", 2), ('="a"&1', "a1"), ("=IF(1>2,1,3)", 3), ("=IFERROR(1/0,7)", 7), ("=LET(a,2,b,a*3,a+b)", 8), ('="A"="a"', True), ("=ROUND(2.5,0)", 3), ("=YEAR(DATE(2026,1,31))", 2026), ("=1<TRUE", True)],
)
def test_values(formula, want):
    assert value(formula) == want


def test_functions_over_cells():
    cells = {(1, 1): 10.0, (2, 1): "x", (3, 1): True, (4, 1): 5.0, (1, 2): "a", (2, 2): "b", (4, 2): "a"}
    assert value("=SUM(A1:A5)", cells) == 15 and value("=COUNT(A1:A5)", cells) == 2 and value("=COUNTA(A1:A5)", cells) == 4
    assert value('=SUMIF(B1:B4,"a",A1:A4)', cells) == 15 and value('=COUNTIF(A1:A4,">6")', cells) == 1
    assert value("=INDEX(A1:B4,4,2)", cells) == "a" and value('=MATCH("b",B1:B4,0)', cells) == 2 and value('=VLOOKUP(10,A1:B4,2,FALSE)', cells) == "a"
    assert isinstance(value("=NOSUCH(1)"), Unknown) and isinstance(value("=1+"), Unknown)


@pytest.mark.parametrize(
    "formula, want",
    [
        ('=SUMIFS(A1:A4,B1:B4,"a")', 15), ('=COUNTIFS(B1:B4,"a",A1:A4,">6")', 1), ('=XLOOKUP("b",B1:B4,A1:A4)', "x"), ('=XLOOKUP("z",B1:B4,A1:A4,"none")', "none"), ("=SUM({1,2;3,4})", 10), ("=SUMPRODUCT((B1:B4=\"a\")*A1:A4)", Error("#VALUE!")),
        ("=ROUNDUP(-2.11,1)", -2.2), ('=TEXT(0.5,"0%")', "50%"), ("=EOMONTH(DATE(2023,12,15),2)", 45351), ('=IFS(FALSE,1,TRUE,"yes")', "yes"), ("=ROW(A7)", 7), ('=ISNA(MATCH("q",B1:B4,0))', True), ("=MEDIAN(A1:A4)", 7.5), ("=1:2", None),
    ],
)
def test_library_functions(formula, want):
    cells = {(1, 1): 10.0, (2, 1): "x", (3, 1): True, (4, 1): 5.0, (1, 2): "a", (2, 2): "b", (4, 2): "a"}
    got = value(formula, cells)
    assert want is None or got == want


def test_shapes_are_parsed_once():
    from quartzgrid.operators.whatif import template

    assert template("=A1*2+SUM(B1:B9)")[0] == template("=A2*2+SUM(C1:C9)")[0] and template("=A1*2+SUM(B1:B9)")[1] == ("A1", "B1:B9")


def model(cells):
    return Model({("S", r, c): v for (r, c), v in cells.items()}, Context(sheet="S", sheets=["S"]))


def test_what_if():
    cells = {(1, 2): (10.0, None, 10.0), (1, 1): (40.0, "=B1*4", 40.0), (2, 1): (44.0, "=A1*1.1", 44.0), (3, 1): (7.0, "=C9+1", 7.0), (5, 1): (1.0, "=A6", 1.0), (6, 1): (1.0, "=A5+B1", 1.0), (7, 1): (0.0, '=INDIRECT("B1")+B1', 0.0)}
    out = model(cells).calculate({("S", 1, 2): 20.0})
    assert out["S", 1, 1] == ("recalculated", 80) and out["S", 2, 1][1] == pytest.approx(88) and out["S", 3, 1] == ("saved", 7)
    assert out["S", 5, 1][0] == out["S", 6, 1][0] == out["S", 7, 1][0] == "unknown" and out["S", 1, 2] == ("changed", 20)


def test_a_deep_chain():
    cells = {(r, 1): (1.0, None, 1.0) for r in range(1, 3001)} | {(1, 3): (0.0, None, 0.0), (1, 2): (0.0, "=C1+A1", 0.0)} | {(r, 2): (0.0, f"=B{r - 1}+A{r}", 0.0) for r in range(2, 3001)}
    assert model(cells).calculate({("S", 1, 3): 10.0})["S", 3000, 2] == ("recalculated", 3010)


def test_edges_keep_their_kind():
    found, _ = analyse("=Rate+Fleet[Toll]+A1+A1:B2", context())
    assert [e.kind for e in found] == ["named_range", "table_column", "cell", "range"] and isinstance(found[0], Edge)
