import pytest

from lexidim.functions import numbers as nb
from lexidim.functions import text as tx
from lexidim.operators.render import rendered
from lexidim.operators.scan import Patterns, Region, regions, resolved
from lexidim.operators.stem import stem
from lexidim.plans import engine as en


@pytest.fixture(scope="module")
def patterns():
    return Patterns()


GOLDEN = [
    ("tensão de 350 MPa aplicada", "tensão de [QTY value=350 unit=MPa dim=[1,-1,-2,0,0,0,0]] aplicada"),
    ("350 MPa ≥ 200 MPa", "]] ≥ [QTY"),
    ("σ_y do AISI 1045 é 215 MPa", "[SYM:σ_y] do [IDX:aisi-1045]"),
    ("k_B = 1,38 × 10⁻²³ J/K", "[CONST:k_B] = [QTY value=1.38e-23 unit=J/K"),
    ("T = −273,15 °C", "[SYM:T] = [QTY value=-273.15 unit=°C"),
    ("kgf/cm² é clássica", "[QTY unit=kgf/cm²"),
    ("Em 2023 houve 1.234 casos", 'Em [NUM value=2023 r2l="2 023"'),
    ("A 1ª questão", '[NUM value=1 locale=none repr=ordinal original="1ª"]'),
    ("Capacidade de 12500 kN", 'r2l="12 500"'),
    ("g = 10 m s⁻²", "[QTY value=10 unit=m s⁻² dim=[0,1,-2,0,0,0,0]]"),
    ("Onde, largura = comprimento = 5 m", "[SYM:largura] = [SYM:comprimento] = [QTY"),
    ("Tópico 2 A menina", "Tópico [NUM value=2 locale=none"),
    ("O motor de 5 W liga", 'ambig="unit-letter"'),
    ("P = 5 W", "unit=W dim=[1,2,-3,0,0,0,0]]"),
    ("regiões geladas atingem 200 K na noite", "dim=[0,0,0,0,1,0,0]] na noite"),
    ("batata frita ao lado de 5 K de algo", 'ambig="unit-letter"'),
    ("NBR 6118 § 14.2.3", "[IDX:nbr-6118] § [REF:14.2.3]"),
    ("Compare SAE 4140 H com SAE 4140", "[IDX:sae-4140-h] com [IDX:sae-4140]"),
    ("R = ∫₀ˡ q(x) dx", "[SYM:∫₀ˡq(x)dx]"),
    ("dimensões 30 cm × 40 cm", "]] × [QTY value=40 unit=cm"),
    ("quanto à flexão da viga", "quanto à flexão da viga"),
    ("corrente 5-20 mA", "[QTY value=5 unit=mA dim=[0,0,0,1,0,0,0]]-[QTY value=20"),
    ("cota 10 m as vigas", "unit=m dim=[0,1,0,0,0,0,0]] as vigas"),
    ("portanto x² > 0", "portanto [SYM:x²] >"),
    ("razão 5/0 nula", "razão 5/0 nula"),
]


@pytest.mark.parametrize("text,expected", GOLDEN)
def test_golden(patterns, text, expected):
    assert expected in rendered(text, regions(text, patterns))[0]


def test_regions_are_disjoint_and_cover(patterns):
    for text, _ in GOLDEN:
        at = 0
        for r in regions(text, patterns):
            assert r.start >= at and not text[at : r.start].strip()
            at = r.end
        assert not text[at:].strip()


def test_mode_a(patterns):
    found = regions("tensão de 350 MPa", patterns)
    with pytest.raises(NotImplementedError):
        rendered("tensão de 350 MPa", found, "A")
    assert rendered("tensão de 350 MPa", found, "A", lambda p: [len(p)])[0] == "10<QTY><VAL>350000000</VAL><DIM>Pa</DIM><UNC/></QTY>"


def test_containment_and_precedence():
    inner, outer = Region("QTY", 4, 10), Region("IDX", 0, 10)
    assert resolved([inner, outer]) == [outer]
    assert resolved([Region("NUM", 0, 5), Region("QTY", 3, 8)]) == [Region("QTY", 3, 8)]


@pytest.mark.parametrize("word,expected", [("frias", "fri"), ("térmicas", "térm"), ("quentes", "quent"), ("potências", "pot"), ("forças", "forç"), ("voltagem", "volt"), ("geladas", "gel"), ("dissipação", "dissip"), ("temperatura", "temperat"), ("frita", "frit")])
def test_stems(word, expected):
    assert stem(word) == expected


NUMBERS = [("1.234,56", 1234.56), ("1.900", 1900.0), ("1,000", 1.0), ("0.123", 0.123), ("1.234.567", 1234567.0), ("1,234,567.5", 1234567.5), ("−273,15", -273.15), ("10⁶", 1e6), ("-10⁻³", -1e-3), ("1,5×10^(-3)", 1.5e-3), ("3.5e2", 350.0), ("x", None), ("", None)]


def test_numbers_as_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(r, v) for r, v in NUMBERS], "raw string, v double")
    got = df.select("raw", "v", nb.canonical_number(F.col("raw")).alias("x")).collect()
    assert [(r.raw, r.x) for r in got] == [(r.raw, r.v) for r in got]
    for raw, value in NUMBERS:
        if value is None:
            with pytest.raises(nb.NumberError):
                nb.number_value(raw)
        else:
            assert nb.number_value(raw) == value


def test_column_and_plain_functions_agree(spark):
    from pyspark.sql import functions as F

    raws = ["5", "3,5", "3,5%", "3/4", "1ª", "6.022e23", "5,9722×10²⁴", "1.234 × 10⁻²³", "12.345", "1,234.5"]
    for r in spark.createDataFrame([(x,) for x in raws], "raw string").select("raw", nb.number_parsed(F.col("raw")).alias("p")).collect():
        assert (r.p.value, r.p.locale, r.p.kind) == nb.parsed_number(r.raw), r.raw
    values = [0.0, 5.0, 0.5, 1234567.0, 1.5e7, 123456.789, 4e-4, 1.38e-23, -2.5, 1e15, 2e-3, 999.5]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", nb.col_format_value(F.col("v")).alias("t"), nb.r2l_group(F.col("v")).alias("g")).collect():
        assert (r.t, r.g) == (nb.format_value(r.v), nb.grouped(r.v)), r.v
    slugs = ["ABNT NBR 6118:2014", "Niobrás 320", "σ_y", "Ação ½", "x²"]
    for r in spark.createDataFrame([(x,) for x in slugs], "t string").select("t", tx.col_slug(F.col("t")).alias("s")).collect():
        assert r.s == tx.slug(r.t) == tx.slug(tx.slug(r.t)), r.t


def test_engine_rows(spark):
    df = spark.createDataFrame([(1, "P = 5 W"), (2, None), (3, ""), (4, "   "), (5, "5/0")], "id long, text string")
    e = en.Engine()
    got = {r.id: r for r in e.preprocess(df).collect()}
    assert got[1].preprocessed.startswith("[SYM:P] = [QTY") and got[2].preprocessed is None and got[3].preprocessed == "" and got[4].preprocessed == "   "
    assert got[5].preprocessed == "5/0" and got[5].preprocessed_errors == ["division by zero"]
    with pytest.raises(Exception, match="unreadable region"):
        e.preprocess(df, strict=True).collect()
    llm = {r.id: r for r in e.for_llm(df, language="en").collect()}
    assert llm[3].messages is None and [m.role for m in llm[1].messages] == ["system", "user"]
    with pytest.raises(ValueError):
        e.for_llm(df, language="fr")
    with pytest.raises(ValueError):
        en.Engine(symbols=[])
    only = en.Engine(symbols=["m"])
    assert [r.type for r in only.exploded(spark.createDataFrame([("5 m 5 kg",)], "text string")).collect()] == ["QTY", "NUM", "PROSE"]
