import pytest

from lexidim.lexicons import TYPES
from lexidim.operators import compose
from lexidim.plans import sql as lexi_sql
from lexidim.plans.engine import Engine
from lexidim.sources import config
from lexidim.streaming import regions as st


COMPOSED = [
    ("pl/12", ["pl"]), ("(pl²/32)·∛2", ["pl"]), ("3l/4", ["l"]), ("0,03937pl²", ["pl"]), ("α_p·E", ["E", "α_p"]), ("σ_pa/E", ["E", "σ_pa"]), ("M_max", ["M_max"]), ("M(x)", ["M", "x"]), ("V_c(t)", ["V_c", "t"]), ("dM/dx", ["dM", "dx"]), ("ΔT/R_total", ["R_total", "ΔT"]),
    ("M_max/EI", ["EI", "M_max"]), ("2x²", ["x"]), ("kg/m²", None), ("tf·m", None), ("tf/m", None), ("kgf/cm²", None), ("3/4", None), ("0,75", None), ("metros", None), ("comprimento", None), ("apoio", None), ("x", None), ("p", None), ("", None),
    ("(a)", None), ("(b)", None), ("(i)", None), ("(ii)", None), ("(iii)", None), ("(xx)", None), ("(aa)", None), ("palavra/outra", None), ("a", None), ("e/ou", None), ("apoios/12", None), ("metros²", None),
]


def test_composed(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t, _ in COMPOSED], "t string")
    assert [(r.t, r.n) for r in df.select("t", compose.free_names(F.col("t")).alias("n")).collect()] == COMPOSED
    assert [(t, compose._names(t) or None) for t, _ in COMPOSED] == COMPOSED


def test_expressions_and_tags(spark):
    from pyspark.sql import functions as F

    found = compose.expressions("use $x^2+1$ e 3l ou M(x) na viga")
    assert [n for *_, n in found] == [["x"], ["l"], ["M", "x"]]
    assert compose.expressions("M(x)", [(0, 4)]) == [(0, 4, ["M", "x"])]  # an argument takes in what it holds
    assert compose.expressions("a²/b 5 x²/y", [(5, 6)]) == [(0, 4, ["a", "b"]), (7, 11, ["x", "y"])]
    text = "pl/12+3l/4"
    assert compose.expressions(text, [(5, 6)]) == [(0, 5, ["pl"]), (6, 10, ["l"])]  # parted, not lost
    assert [text[s:e] for text in ["vale = -x²+1 hoje", "soma σ_x + σ_y aqui"] for s, e, _ in compose.expressions(text)] == ["-x²+1", "σ_x + σ_y"]
    rows = spark.createDataFrame([("$p l/12$",), ("palavra",), ("a = b",)], "t string").select(compose.tagged(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["[SYM:pl/12]", "palavra", "[SYM:a = b]"]


def test_clusters(spark):
    rows = [(1, "x · y = z", 0, 1, "SYM"), (1, "x · y = z", 2, 3, "OP"), (1, "x · y = z", 4, 5, "SYM"), (1, "x · y = z", 6, 7, "OP"), (1, "x · y = z", 8, 9, "SYM")]
    rows += [(2, "5 m · 3 m", 0, 3, "QTY"), (2, "5 m · 3 m", 4, 5, "OP"), (2, "5 m · 3 m", 6, 9, "QTY"), (3, "a+b", 0, 1, "SYM"), (3, "a+b", 2, 3, "SYM"), (4, "a", 0, 1, "SYM")]
    atoms = spark.createDataFrame(rows, "k int, text string, start int, `end` int, type string")
    assert sorted(map(tuple, compose.clusters(atoms, ["k"]).collect())) == [(1, 0, 5), (3, 0, 3)]


ONTOLOGY = "version: '1.2'\ntypes:\n" + "".join(f"  {t}: {{composed_of: [{'QTY' if t == 'CONST' else ''}]}}\n" for t in TYPES) + "order: [" + ", ".join(TYPES) + "]\n"


def test_ontology():
    assert config.load_ontology(ONTOLOGY).priority["QTY"] == 0
    for bad in (ONTOLOGY.replace("[QTY]", "[]"), ONTOLOGY.replace("order: [QTY, ", "order: [QTY, QTY, "), ONTOLOGY.replace("order: [QTY, ", "order: ["), ONTOLOGY.replace("'1.2'", "'2.0'"), ONTOLOGY + "more: 1\n", ONTOLOGY.replace("[QTY]", "[QTY, FOO]")):
        with pytest.raises(ValueError):
            config.load_ontology(bad)
    older = config.Ontology("1.0", {t: ("QTY",) if t == "CONST" else () for t in config.VERSIONS["1.0"]}, tuple(t for t in TYPES if t in config.VERSIONS["1.0"]))
    assert "NUM" not in older.priority


def test_order_is_data(spark):
    df = spark.createDataFrame([("12 m",)], "text string")
    older = config.Ontology("1.0", {t: ("QTY",) if t == "CONST" else () for t in config.VERSIONS["1.0"]}, tuple(t for t in TYPES if t in config.VERSIONS["1.0"]))
    assert [r.type for r in Engine(ontology=older).exploded(df).collect()] == ["QTY"]
    assert [r.type for r in Engine(ontology=older).exploded(spark.createDataFrame([("houve 12 casos",)], "text string")).collect()] == ["PROSE"]


def test_yaml_files(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("id: b\ntags: [x, y]\n")
    (tmp_path / "a.yaml").write_text("id: a\n")
    (tmp_path / "c.yaml").write_text("id: [\n")
    good, bad = config.read_yaml(spark, str(tmp_path), "id STRING, tags ARRAY<STRING>")
    assert [(r.id, r.tags) for r in good.collect()] == [("a", None), ("b", ["x", "y"])] and bad.count() == 1


def test_sql(spark):
    lexi_sql.register(spark)
    row = spark.sql("SELECT lexi_convert(1.0D, 'tf', 'N') AS n, lexi_convert(1.0D, 'm', 'kg') AS bad, lexi_number('1.234,5') AS x, lexi_number('x') AS none, lexi_slug('Ação 5') AS slug, lexi_unit_dim('N') AS dim, lexi_preprocess('5 m') AS t").first()
    assert (row.n, row.bad, row.x, row.none, row.slug, row.dim, row.t) == (9806.65, None, 1234.5, None, "acao-5", [1, 1, -2, 0, 0, 0, 0], "[QTY value=5 unit=m dim=[0,1,0,0,0,0,0]]")
    assert spark.sql("SELECT count(*) AS n FROM (SELECT '5 m e 6 kg' AS t), LATERAL lexi_regions(t) r WHERE r.type = 'QTY'").first().n == 2


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 3}:00:00", f"{k} kN") for k in range(9)]
    df = spark.createDataFrame(rows, "id long, at string, text string").selectExpr("id", "to_timestamp(at) AS ts", "text")
    df.union(df).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    counts = st.counts_by_window(stream, Engine(), "ts", id_col="id")
    q = counts.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n_regions for r in spark.table("windows").collect() if r.type == "QTY") == [3, 3, 3]


def test_format_value_gives_what_the_operator_gives(spark, tmp_path):
    from lexidim import queries as core
    from lexidim.functions import numbers as nb

    prices = [0.0, 7.0, 999.0, 1013.0, 499993.0, 999999.0, 1234567.0, 123456789.0, 987654321012.0]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r for r in core.format_value(spark, str(tmp_path)).collect()}
    for k, p in enumerate(prices):
        want = tuple(nb.format_value(v) for v in (p, p + 0.5, p * 1e12, p * 1e-12))
        assert (got[k].whole, got[k].half, got[k].large, got[k].small) == want
    assert (got[6].half, got[2].large) == ("1.23457e+06", "999000000000000")


def test_nothing_far_away_is_lost():
    """Context and units are read however far they reach."""
    from lexidim.operators import scan as sc

    found = lambda t: [(r.type, t[r.start : r.end]) for r in sc.regions(t, sc.Patterns())]
    unit = " ".join(["kN"] * 40) + "·m"
    assert ("QTY", unit) in found("medida " + unit)
    assert ("QTY", "5 W") not in found("tópico" + " " * 300 + "5 W liga")
    assert ("SYM", "razao") in found("0" * 60 + " = razao")
    assert sc.balanced("a(b[c)d]e)f") == "a(b[c)d]e" and sc.balanced("(a[b)c]") == "(a[b)c]" and sc.balanced(")x") == "x" and sc.balanced("") == ""


def test_unit_files(spark, tmp_path):
    import json

    from lexidim import units

    (tmp_path / "main.json").write_text(json.dumps({"atoms": {"zorb": {"dim": [0, 1, 0, 0, 0, 0, 0], "factor": 2.0, "prefixes": True}, "%": {"dim": [0] * 7, "factor": 0.5}}}))
    (tmp_path / "more.json").write_text(json.dumps({"atoms": {"%": {"factor": 0.01, "category": "ratio"}, "blip": {"factor": 3.0, "category": "information"}}}))
    (tmp_path / "alias.json").write_text(json.dumps({"string_aliases": {"zz": "zorb"}}))
    atoms = units.load_atoms(spark, f"{tmp_path}/main.json", (f"{tmp_path}/none.json", f"{tmp_path}/more.json"))
    assert atoms["%"] == ((0,) * 7, 0.5, "si") and atoms["blip"] == ((0,) * 7, 3.0, "information") and atoms["kzorb"][1] == 2000.0
    with pytest.raises(FileNotFoundError):
        units.load_atoms(spark, f"{tmp_path}/none.json")
    assert units.load_aliases(spark, f"{tmp_path}/alias.json") == {"zz": "zorb"}
    row = Engine(atoms=atoms).preprocess(spark.createDataFrame([("5 zorb e 3 kg",)], "text string")).first()
    assert row.preprocessed.startswith("[QTY value=5 unit=zorb dim=[0,1,0,0,0,0,0]] e [NUM value=3")
    both = Engine(encode=lambda p: [ord(c) for c in p], decode=lambda ids: "".join(map(chr, ids)))
    from pyspark.sql import functions as F

    assert spark.createDataFrame([([97, 98],)], "ids array<int>").select(both.decoded(F.col("ids")).alias("t")).first().t == "ab"


def test_quantity_struct(spark):
    from pyspark.sql import functions as F

    from lexidim.plans.engine import quantity_of

    df = spark.createDataFrame([("350 ± 10 MPa",), ("5-20 mA",), ("kgf/cm²",), ("?",), (None,)], "t string")
    rows = [r.q for r in df.select(quantity_of(F.col("t")).alias("q")).collect()]
    (q,) = rows[0].quantities
    assert (q.value, q.uncertainty, q.unit, q.dim, q.factor, q.si_unit, q.si_value, q.si_uncertainty) == (350.0, 10.0, "MPa", [1, -1, -2, 0, 0, 0, 0], 1e6, "Pa", 3.5e8, 1e7)
    assert [x.value for x in rows[1].quantities] == [5.0, 20.0] and rows[2].quantities[0].value is None
    assert rows[3].quantities is None and rows[3].error and rows[4] is None


def test_lexicon_files(spark, tmp_path):
    import json

    from lexidim.functions import text as tx
    from lexidim.lexicons import Lexicons

    files = {
        "constants": {"constantes": [{"simbolo": "c", "nome": "light", "grandeza_associada": "m/s", "valor_si": 3e8, "requer_contexto": True}, {"simbolo": "q_e", "nome": "charge", "grandeza_associada": "C", "valor_si": 1.6e-19}]},
        "operators": {"operadores": [{"simbolo": "+", "aridade": 2, "categoria": "aritmetico"}]},
        "connectives": {"en": [{"forma": "Because", "funcao": "causal"}]},
        "identifiers": {"padroes": [{"classe": "x", "regex": r"\\bCP[ -]?190\\b", "canonical_slug": "cp-190"}, {"_gone": 1, "regex": "a"}]},
        "expressions": {"classes": [{"classe": "at", "regex": r"@\\w+@"}]},
    }
    paths = {}
    for name, data in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data).replace("\\\\\\\\", "\\\\"))
        paths[name] = f"{tmp_path}/{name}.json"
    lexicons = config.load_lexicons(spark, **paths)
    df = spark.createDataFrame([("vale c = 5 + q_e because CP 190 c @x_1@",)], "text string")
    rows = [(r.type, r.content, r.tag) for r in Engine(lexicons=lexicons).exploded(df).where("type <> 'PROSE'").collect()]
    assert ("CONST", "c", "[CONST:c]") in rows and ("CONST", "q_e", "[CONST:q_e]") in rows and sum(t == "CONST" for t, *_ in rows) == 2
    assert ("IDX", "CP 190", "[IDX:cp-190]") in rows and ("REL", "because", "because") in rows and ("OP", "+", "+") in rows and ("SYM", "@x_1@", "[SYM:@x_1@]") in rows
    (tmp_path / "identifiers.json").write_text(json.dumps({"padroes": [{"classe": "x", "regex": "("}]}))
    with pytest.raises(ValueError, match="identifiers: x"):
        config.load_lexicons(spark, identifiers=paths["identifiers"])
    kinds = lambda e: [r.type for r in e.exploded(spark.createDataFrame([("o Re da NBR 6118",)], "text string")).collect()]
    assert kinds(Engine()).count("IDX") == 2 and kinds(Engine(lexicons=Lexicons(without=("grandeza_adimensional",)))).count("IDX") == 1
    assert tx.identifier_slug("CP190 RB", "cp-190-rb") == "cp-190-rb" and tx.identifier_slug("f_ptk") == "fptk"
    with pytest.raises(ValueError):
        tx.identifier_slug("--")
