import pytest

from lexidim import units


@pytest.mark.parametrize(
    "unit,terms",
    [("MPa", [("MPa", 1)]), ("kgf/cm2", [("kgf", 1), ("cm", -2)]), ("J/(kg·K)", [("J", 1), ("kg", -1), ("K", -1)]), ("a/b·c", [("a", 1), ("b", -1), ("c", 1)]), ("m s⁻²", [("m", 1), ("s", -2)]), ("t/m", [("tf", 1), ("m", -1)]), ("N/mm2", [("N", 1), ("mm", -2)]), ("mmH2O/m", [("mmH2O", 1), ("m", -1)]), ("m^-2", [("m", -2)]), ("W/(m·(K·s))", [("W", 1), ("m", -1), ("K", -1), ("s", -1)])],
)
def test_parse(unit, terms):
    assert units.parse(unit) == terms


@pytest.mark.parametrize("unit", ["", "  ", None, "(m", "m)", "m/", "5", "m^"])
def test_parse_errors(unit):
    with pytest.raises(units.UnitError):
        units.parse(unit)


def test_atoms():
    assert units.ATOMS["Pa"][:2] == ((1, -1, -2, 0, 0, 0, 0), 1.0) and units.ATOMS["MPa"][1] == 1e6 and units.ATOMS["kgf"][1] == 9.80665
    assert units.ATOMS["tf"][1] == 9806.65 and units.ATOMS["cm"][1] == 1e-2 and units.ATOMS["°C"][:2] == ((0, 0, 0, 0, 1, 0, 0), 1.0) and units.ATOMS["cv"][1] == 735.49875
    assert units.ATOMS["KiB"][1] == 8192 and units.ATOMS["GB"][1] == 8e9 and units.ATOMS["kilobyte"][1] == 8000
    assert not {"toneladas", "alunos", "casos", "foobar", "a", "as", "pi"} & units.ATOMS.keys()
    assert len(units.ATOMS) > 500 and len(units.NAMES) >= 15


def test_si_names_and_conversion():
    dim = lambda u: units.combined(units.parse(u))[0]
    assert units.si_unit(dim("kgf/cm²")) == "Pa" and units.si_unit(dim("W/(m·K)")) == "kg·m·s^-3·K^-1" and units.si_unit(dim("rad")) == ""
    assert abs(units.convert(1, "tf", "kN") - 9.80665) < 1e-12 and abs(units.convert(1, "psi", "kPa") - 6.89476) < 1e-5
    with pytest.raises(units.UnitError):
        units.convert(1, "m", "kg")
    assert units.combined(units.parse("foo")) is None


def test_frames_agree_with_plain(spark):
    names = ["MPa", "J/(kg·K)", "foo", "m/", None, "km^2", "%"]
    for r in units.described_units(spark.createDataFrame([(n,) for n in names + names], "unit string")).collect():
        try:
            want = units.combined(units.parse(r.unit))
        except units.UnitError as e:
            assert r.error == str(e) and r.dim is None
            continue
        if want is None:
            assert r.error == "unknown unit" and r.dim is None
        else:
            assert tuple(r.dim) == want[0] and abs(r.factor - want[1]) <= 1e-12 * want[1] and r.si_unit == units.si_unit(want[0]) and r.error is None
