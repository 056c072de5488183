import json

from lexidim.plans.engine import Engine
from lexidim.sources import cases as cs


def case(i, **more):
    answers = [{"name": str(k), "value": 1.0, "unit": "m", "tolerance": 0.1} for k in range(4)]
    return {"id": f"solids-{i}", "title": "t", "discipline": "solids", "source_id": "r1", "tags": ["risky", "ctx"], "prompt": "cota de 5 mm", "norms": ["r1"], "answers": answers, "n_answers": 4, "review_status": "validated", "assets": [{"path": "a.svg", "inline": True}], **more}


def test_read_validate_compile(spark, tmp_path):
    folder = tmp_path / "solids"
    folder.mkdir()
    rows = [case(1), case(2, tags=["other", "ctx", "ctx"]), case(3, source_id="zz", norms=["qq"]), case(4, answers=[], n_answers=2), case(5, review_status=None), case(1, title="z")]
    (folder / "cases.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n")
    good, bad = cs.read_cases(spark, str(folder))
    assert good.count() == 6 and bad.count() == 1
    checked = cs.validated(good.drop("file"), ["r1"], ["risky"], ["ctx"])
    by = {(r.id, r.title): r for r in checked.collect()}
    assert by["solids-1", "t"].errors == [] and by["solids-1", "z"].errors == ["id twice"]
    assert by["solids-2", "t"].errors == ["no high-risk tag", "unknown tags other", "tag twice"]
    assert by["solids-3", "t"].errors == ["unknown reference zz", "unknown norms qq"]
    assert by["solids-4", "t"].errors == ["fewer than 4 answers", "wrong number of answers"] and by["solids-5", "t"].warnings == ["not validated"]
    lines = cs.compiled(checked, Engine())
    assert [r.id for r in lines.collect()] == ["solids-1"] and cs.compiled(checked, Engine(), require_validated=False).count() == 2
    made = json.loads(lines.first().line)
    assert "[QTY value=5 unit=mm" in made["arms"]["marked"] and made["arms"]["messages"][1]["role"] == "user"
    m = cs.manifest(lines, checked).first()
    assert (m.n_compiled, m.n_cases, m.n_valid, m.n_invalid) == (1, 6, 2, 4) and len(m.checksum) == 64
    cs.write_lines(lines, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 1
    assert [(r.tag, r.n) for r in cs.tag_histogram(good).collect()] == [("ctx", 7), ("other", 1), ("risky", 5)]


def test_assets_are_embedded(spark):
    cases = spark.createDataFrame([case(1), case(2, assets=None)], cs.CASE)
    assets = spark.createDataFrame([("a.svg", '<?xml version="1.0"?>\n<svg/>')], "path string, body string")
    got = {r.id: r.prompt for r in cs.embedded(cases, assets).collect()}
    assert got == {"solids-1": "cota de 5 mm\n\n<svg/>", "solids-2": "cota de 5 mm"}


def test_lines_hold_every_arm_and_the_metadata(spark):
    from lexidim.plans.engine import activation_prompt

    cases = spark.createDataFrame([case(1, language="en"), case(2, language="pt-br", tags=["risky"]), case(3, language="fr"), case(4, answers=[], n_answers=0)], cs.CASE)
    checked, marked = cs.validated(cases, ["r1"], ["risky"], ["ctx"]), "cota de [QTY value=5 unit=mm dim=[0,1,0,0,0,0,0]]"
    lines = cs.compiled(checked, Engine())
    made = {r.id: json.loads(r.line) for r in lines.collect()}
    assert set(made) == {"solids-1", "solids-2", "solids-3"}
    for i, language in (("solids-1", "en"), ("solids-2", "pt-br"), ("solids-3", "pt-br")):
        told, arms = activation_prompt(language).rstrip(), made[i]["arms"]
        assert arms["plain"] == "cota de 5 mm" and arms["marked"] == marked
        assert arms["prompted"] == f"{told}\n\n{marked}" and arms["control"] == f"{told}\n\ncota de 5 mm"
        assert arms["messages"] == [{"role": "system", "content": told}, {"role": "user", "content": marked}]
        assert arms["control_messages"] == [{"role": "system", "content": told}, {"role": "user", "content": "cota de 5 mm"}]
        assert (made[i]["norms"], made[i]["source_id"], made[i]["discipline"], made[i]["n_answers"]) == (["r1"], "r1", "solids", 4)
    assert [made[f"solids-{k}"]["language"] for k in (1, 2, 3)] == ["en", "pt-br", "fr"]
    assert cs.manifest(lines, checked).first().tags == {"ctx": 2, "risky": 3}


def test_a_figure_without_a_drawing_is_a_warning(spark):
    asset = lambda kind: [{"path": "a", "inline": False, "type": kind}]
    rows = [case(1, has_figure=True, assets=asset("pdf")), case(2, has_figure=True, assets=asset("png")), case(3, has_figure=True, assets=asset("pdf") + asset("svg")), case(4, has_figure=True, assets=None)]
    rows += [case(5, has_figure=False, assets=[]), case(6, assets=None), case(7, has_figure=True, assets=asset(None), review_status="draft")]
    checked = cs.validated(spark.createDataFrame(rows, cs.CASE), ["r1"], ["risky"], ["ctx"])
    lost = "figure without svg or png asset"
    assert {r.id[-1]: r.warnings for r in checked.collect()} == {"1": [lost], "2": [], "3": [], "4": [lost], "5": [], "6": [], "7": ["not validated", lost]}
    made = {r.id[-1]: json.loads(r.line) for r in cs.compiled(checked, Engine()).collect()}
    assert sorted(made) == ["1", "2", "3", "4", "5", "6"] and made["1"]["has_figure"] is True
