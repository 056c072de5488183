import hashlib
import json

import pytest

from lexidim.sources import benchmark as bm
from lexidim.sources import cases as cs


def case(i, **more):
    answers = [{"name": str(k), "value": 1.0, "unit": "m", "tolerance_relative": 0.1} for k in range(4)]
    about = {"discipline_folder": "solids", "language": "en", "n_subgrandezas": 4}
    return {"schema_version": "1.0", "id": f"solids-{i}", "title": "t", "metadata": about, "reference": {"source_id": "r1"}, "tags": ["risky", "ctx"], "prompt_baseline": "a cota da viga tem 5 mm", "gabarito": answers, "review_status": "validated", **more}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "bench"
    (root / "solids" / "cases" / "figs").mkdir(parents=True)
    (root / "references.yaml").write_text("schema_version: '1'\nsources:\n- {id: r1, type: book, full_citation: a long citation, short_citation: s}\n")
    (root / "tags_vocabulary.yaml").write_text("schema_version: '1'\nhigh_risk_tags: {x: [risky]}\ncontextual_tags: [ctx]\n")
    (root / "manifest.yaml").write_text("schema_version: '1'\nbenchmark_version: '2.0'\nname: n\ndescription: d\ncreated: '2020-01-01'\n")
    (root / "solids" / "cases" / "figs" / "a.svg").write_text('<?xml version="1.0"?>\n<svg/>')
    return root


def write(root, **cases):
    for name, c in cases.items():
        (root / "solids" / "cases" / f"{name}.yaml").write_text(json.dumps(c))


def test_compile(spark, folder):
    inline = [{"id": "f", "type": "svg", "path": "../cases/figs/a.svg", "description": "x", "embed_inline": True}]
    write(folder, b=case(1, assets=inline), a=case(2), c=case(3, tags=["ctx"]), d=case(4, review_status="draft"), e=case(2, title="again"))
    made = bm.compile_all(spark, str(folder))
    data = (folder / "generated" / "cases_v2.0.jsonl").read_bytes()
    lines = [json.loads(x) for x in data.decode().splitlines()]
    assert data.endswith(b"\n") and [x["id"] for x in lines] == ["solids-2", "solids-1"]
    manifest = json.loads((folder / "generated" / "cases_v2.0_manifest.json").read_text())
    assert manifest == made.manifest and manifest["jsonl_sha256"] == hashlib.sha256(data).hexdigest()
    assert (manifest["n_cases_total"], manifest["n_cases_compiled"], manifest["n_cases_rejected"]) == (5, 2, 3) and manifest["tags_stratification"] == {"ctx": 2, "risky": 2}
    first = lines[1]
    assert first["prompts"]["baseline"] == "a cota da viga tem 5 mm\n\n<svg/>" and "[QTY value=5 unit=mm" in first["prompts"]["modo_b"]
    told = first["messages_for_api"]["modo_d_activated"][0]["content"]
    assert first["prompts"]["modo_d_activated"] == f"{told}\n\n{first['prompts']['baseline']}" and first["prompts"]["modo_b_activated"] == f"{told}\n\n{first['prompts']['modo_b']}"
    assert [m["role"] for m in first["messages_for_api"]["modo_b_activated"]] == ["system", "user"] and first["memoria_calculo"] == {} and first["metadata"]["language"] == "en"
    report = cs.report_text(made.checked)
    assert report.startswith("Total: 5 casos\n  Válidos: 3\n  Inválidos: 2\n\nCasos com erro:\n") and "  [solids-3]\n    ERR: no high-risk tag" in report
    with pytest.raises(Exception, match="is invalid"):
        cs.strict(made.checked).collect()
    assert bm.compile_all(spark, str(folder), str(folder / "all"), require_validated=False).manifest["n_cases_compiled"] == 3


def test_empty_and_broken(spark, folder):
    write(folder, a=case(1, review_status="draft"))
    made = bm.compile_all(spark, str(folder))
    assert (folder / "generated" / "cases_v2.0.jsonl").read_bytes() == b"" and made.manifest["jsonl_sha256"] == hashlib.sha256(b"").hexdigest()
    write(folder, z=case(9, prompt_baseline="short", foo=1), y={**case(8), "gabarito": [{"name": "x"}]})
    (folder / "solids" / "cases" / "x.yaml").write_text("id: [")
    with pytest.raises(ValueError, match="unknown fields foo; prompt too short") as e:
        bm.compile_all(spark, str(folder))
    assert "malformed answer" in str(e.value) and "x.yaml" in str(e.value)
    good, wrong = bm.load_cases(spark, str(folder))
    assert good.count() == 1 and wrong.count() == 3


def test_missing_asset(spark, folder):
    write(folder, a=case(1, assets=[{"id": "f", "type": "svg", "path": "no.svg", "description": "x", "embed_inline": True}]))
    with pytest.raises(FileNotFoundError, match="no.svg"):
        bm.compile_all(spark, str(folder))


def test_configuration(spark, folder):
    (folder / "references.yaml").write_text("schema_version: '1'\nsources:\n- {id: r1}\n- {id: r1}\n")
    with pytest.raises(ValueError, match="twice"):
        bm.load_references(spark, str(folder))
    (folder / "manifest.yaml").write_text("name: n\n")
    with pytest.raises(ValueError):
        bm.load_manifest(spark, str(folder))
