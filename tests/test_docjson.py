"""Documentation JSON cut into items: what an item carries, and what its text keeps."""

import json

import pytest

from symloom.sources import docjson


def documents(spark, index, paths=None):
    text = json.dumps({"root": 0, "index": index, "paths": paths or {}}) if isinstance(index, dict) else index
    return spark.createDataFrame([("shop", text)], "package string, json string")


def test_an_item_carries_no_names_of_others(spark):
    index = {str(i): {"id": i, "name": f"n{i}", "inner": {"module": {"items": []}}} for i in range(3000)}
    rows = docjson.items(documents(spark, index)).select("id", "item", "body").collect()
    assert len(rows) == 3000
    assert max(len(x.metadata) for r in rows for x in (r["item"], r["body"])) < 200


def test_texts_are_kept(spark):
    docs = 'say "é"\n\t\\ \x01 \U0001f600 </x>'
    index = {"1": {"id": 1, "name": None, "docs": docs, "inner": {"constant": {"n": 18446744073709551615, "x": 0.25}}}, "2": {"id": 2, "inner": "extern_type"}, "3": None}
    rows = {r["id"]: r for r in docjson.items(documents(spark, index)).selectExpr("id", "tag", "to_json(item) AS text").collect()}
    assert json.loads(rows["1"]["text"]) == index["1"] and rows["1"]["tag"] == "constant"
    assert rows["2"]["tag"] is None and json.loads(rows["2"]["text"]) == index["2"] and rows["3"]["tag"] is None
    paths = {"7": {"crate_id": 0, "kind": "module", "path": ["shop", "é"]}, "8": {"kind": "struct", "path": []}}
    found = {r["id"]: (r["path"], r["kind"]) for r in docjson.paths(documents(spark, {}, paths)).collect()}
    assert found == {"7": ("shop::é", "module"), "8": ("", "struct")}


def test_sections_may_be_absent_and_ids_stand_once(spark):
    assert docjson.items(documents(spark, '{"root":0}')).count() == 0 and docjson.paths(documents(spark, '{"index":null,"paths":null}')).count() == 0
    for bad in ('{"index":{"1":{"id":1},"1":{"id":1}}}', '{"index":{"1":{"id":1}', "no JSON"):
        with pytest.raises(Exception, match="DUPLICATE|MALFORMED"):
            docjson.items(documents(spark, bad)).collect()
