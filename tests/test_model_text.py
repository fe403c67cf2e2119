"""Model texts in a loose dialect, and what stays broken."""

import json

from pyspark.sql import functions as F

from specloom.sources import tables

WHOLE = {"V": ["a"], "E": [], "Vdata": {"a": {"vals": ["None", ".5,]"], "parents": None, "cprob": [0.5, 0.5]}}}


def test_loose_text_is_repaired_outside_literals(spark):
    cases = {
        "[.5, -.5, 5., 1.5, 10.25, +2, 1.e3]": "[0.5, -0.5, 5.0, 1.5, 10.25, 2, 1.0e3]", "{\"a\": None, \"None\": True,}": "{\"a\": null, \"None\": true}", "[False, Nonesuch, \".5 \\\" None\", .5]": "[false, Nonesuch, \".5 \\\" None\", 0.5]",
        "[\"open .5": "[\"open 0.5", "": "", "\"" + "x\\\\" * 50000 + "\"": "\"" + "x\\\\" * 50000 + "\"", "[1, 2 , \n ]": "[1, 2  \n ]",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", tables.repaired_json(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases | {None: None}


def test_whole_repaired_and_broken_files(spark, tmp_path):
    loose = json.dumps(WHOLE).replace("null", "None").replace("[0.5, 0.5]", "[.5, .5,]")
    texts = {"w": json.dumps(WHOLE, indent=1), "l": loose, "cut": loose[:-2], "number": "7", "no_v": "{}", "types": '{"V": 3}', "empty": ""}
    got = {r.model_id: r for r in tables.parsed_models(spark.createDataFrame([*texts.items(), ("null", None)], "model_id string, text string")).collect()}
    assert {k: r.state for k, r in got.items()} == {"w": "whole", "l": "repaired"} | dict.fromkeys(["cut", "number", "no_v", "types", "empty", "null"], "broken")
    assert got["w"].V == got["l"].V == ["a"] and got["w"].Vdata["a"].vals == got["l"].Vdata["a"].vals == ["None", ".5,]"] and got["l"].Vdata["a"].parents is None
    assert json.loads(got["l"].Vdata["a"].cprob) == [0.5, 0.5] and got["cut"].V is None and got["cut"].text == texts["cut"]
    assert not tables.parsed_models(spark.createDataFrame([], "model_id string, text string")).count()
    (tmp_path / "m").mkdir()
    for k, text in texts.items():
        (tmp_path / "m" / k).write_text(text)
    models = tables.read_loose_model_files(spark, f"file://{tmp_path}/m", f"file://{tmp_path}/bad")
    assert sorted(r.model_id for r in models.collect()) == ["l", "w"] and [(v.model_id, v.vertex) for v in tables.skeleton(models)[0].orderBy("model_id").collect()] == [("l", "a"), ("w", "a")]
    assert {r.model_id: r.text for r in spark.read.parquet(f"file://{tmp_path}/bad").collect()} == {k: texts[k] for k in ("cut", "number", "no_v", "types")}  # Spark's readers pass over the file of no bytes
