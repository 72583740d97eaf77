from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from modlens.sources import archive, catalog, jsfacts
from modlens.streaming import ingest

BASIC = """__d("Sender",["Core","Util"],(function(t,n,r,o,a,i){"use strict";function send(){return n("Core")}i.go=send}),66);
__d("Core",[],function(t,n,r,o,a,i){i.x=1},1);"""


def test_basic_facts():
    got = {f.name: (f.deps, f.exports, f.functions) for f in jsfacts.facts(BASIC)}
    assert got == {"Sender": (["Core", "Util"], ["go"], ["send"]), "Core": ([], ["x"], [])}


def test_hostile_text():
    src = '''var s='__d("No",[],f)'; // __d("No2",[],f)
    /* __d("No3",[],f) */ var r=/\\)\\(__d\\("/g, t=`${"}"} __d("No4",[],f)`;
    __d("Tricky",[],function(){return a/b/c}); __d("After",["x",1,y,"z"],function(a,b,c,d,m,e){m.exports=1;m.exports.k=2;e["q"]=3},2)'''
    assert [f.name for f in jsfacts.facts(src)] == ["Tricky", "After"]
    after = jsfacts.facts(src)[1]
    assert after.deps == ["x", "z"] and after.exports == ["default", "k", "q"]


def test_functions_at_top_level_only():
    src = '__d("M",[],function(){function outer(){function inner(){}} const arrow=()=>1, n=3, o={f(){}}; class Thing{} var called=function(){return 1}(), gen=async function(){}; if(x){var no=1}},1)'
    assert jsfacts.facts(src)[0].functions == ["Thing", "arrow", "gen", "outer"]


@pytest.mark.parametrize("src", ["__d('x',[],f", "a='x\n'", "/* x", "`${a", "f(]"])
def test_failures(src):
    with pytest.raises(jsfacts.ParseFailure):
        jsfacts.facts(src)


def test_nested_and_dynamic():
    src = '__d("Outer",[],function(){__d("Inner",[],f,1)},1); __d(name,[],f,1); x.__d("Not",[],f); __d("Two",[])'
    assert [f.name for f in jsfacts.facts(src)] == ["Outer", None]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.js").write_text(BASIC)
    (tmp_path / "in/deep/b.js").write_text('__d("Core",["Extra"],function(t,n,r,o,a,i){i.x=1;i.longer=2},1);')
    (tmp_path / "in/bad.js").write_text("__d('x',[],f")
    (tmp_path / "in/latin.js").write_bytes(b"\xff\xfe")
    (tmp_path / "in/readme.txt").write_text("no")
    return tmp_path


def test_ingest(spark, folder):
    records, sources, told = archive.ingest(archive.definitions(archive.chunks(spark, str(folder / "in"))))
    got = {r["name"]: r for r in records.collect()}
    assert set(got) == {"Sender", "Core"} and got["Core"]["exports"] == ["longer", "x"] and got["Core"]["dependents"] == ["Sender"]
    assert got["Core"]["variants"][0]["deps_removed"] == ["Extra"] and got["Core"]["form"] == "pretty"
    d = told.first()
    assert (d["chunks_read"], d["chunks_skipped"], d["chunk_parse_failures"], d["modules_with_variants"], d["unresolved_total"]) == (4, 1, 2, 1, 2)
    assert sources.count() == 3
    store = catalog.Store(spark, str(folder / "store"))
    assert not store.has("whatsapp-100")
    for b in ("whatsapp-200", "whatsapp-100", "messenger-50"):
        store.add(b, records, sources, {"chunks": d["chunks_read"]})
    assert [r["bundle"] for r in catalog.listed(store.bundles().drop("bundle")).collect()] == ["whatsapp-100", "whatsapp-200", "messenger-50"]
    assert store.resolve("latest") == "whatsapp-200" and store.resolve("msgr-latest") == "messenger-50" and store.resolve("100") == "whatsapp-100"
    assert store.latest_pair("whatsapp") == ("whatsapp-100", "whatsapp-200") == store.operands() and store.operands("100") == ("whatsapp-100", "whatsapp-200")
    assert store.modules("whatsapp-100").count() == 2 and store.manifest("messenger-50") == {"chunks": 4}
    with pytest.raises(ValueError, match="itself"):
        store.operands("200", "wa-latest")
    with pytest.raises(FileExistsError):
        store.add("whatsapp-100", records, sources, {})
    store.remove("whatsapp-100")
    with pytest.raises(LookupError):
        store.latest_pair("whatsapp")


def test_ingest_of_nothing(spark, tmp_path):
    (tmp_path / "x.js").write_text("var a = 1;")
    with pytest.raises(ValueError, match="define nothing"):
        archive.ingest(archive.definitions(archive.chunks(spark, str(tmp_path))))


def test_zip(spark, tmp_path):
    def make(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m, data in members:
                z.writestr(m, data)
        return str(tmp_path / name)

    got = archive.unzipped(spark, make("ok.zip", [("d/a.js", BASIC), ("b.txt", "abc")])).collect()
    assert {(r["path"], r["skipped"]) for r in got} == {("a.js", False), ("b.txt", True)}
    assert {r["sha256"] for r in got if r["path"] == "b.txt"} == {"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}
    for name, members in (("up.zip", [("../a.js", "x")]), ("twice.zip", [("a/x.js", "1"), ("b/x.js", "2")]), ("none.zip", [])):
        with pytest.raises(Exception, match="leaves the folder|two members|no files"):
            archive.unzipped(spark, make(name, members)).collect()


def test_ids():
    assert catalog.parse_id("wa-5") == ("whatsapp", 5) and catalog.parse_id("7") == ("whatsapp", 7) and catalog.parse_id("IG-9") == ("instagram", 9)
    for bad in ("x-1", "whatsapp-", "whatsapp-99999999999999999999", ""):
        with pytest.raises(ValueError):
            catalog.parse_id(bad)


def test_filter_documents(tmp_path):
    store = catalog.Filters(str(tmp_path / "filters"))
    assert [f["name"] for f in store.list()] == ["all", "default", "protocol", "schemas", "wam"]
    store.fork("default", "mine")
    assert store.patch("mine", {"include": ["^X"]})["include"] == ["^X"] and not store.get("mine")["builtin"]
    store.fork("all", "wam")
    assert store.get("wam")["defaultVerdict"] == "keep"
    store.delete("wam")
    assert store.get("wam")["defaultVerdict"] == "drop"
    for name in ("../x", "", "a/b"):
        with pytest.raises(ValueError):
            store.get(name)
    with pytest.raises(LookupError):
        store.delete("default")


def test_stream(spark, folder):
    out, mark = str(folder / "out"), str(folder / "mark")
    ingest.definition_stream(spark, str(folder / "in"), out, mark).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    (folder / "in/c.js").write_text('__d("Late",[],function(){},1)')
    ingest.definition_stream(spark, str(folder / "in"), out, mark).awaitTermination(120)
    rows = spark.read.parquet(out)
    assert rows.count() == 4 and rows.select("name").distinct().count() == 3
    assert ingest.matching_lines(rows.select("name", "text"), "longer").select("name").first()["name"] == "Core"
    assert os.path.isdir(mark) and rows.where(F.col("failed")).count() == 0


def test_statements_end_at_line_ends():
    make = lambda body: jsfacts.facts(f'__d("M",[],function(t,n,r,o,a,i){{{body}}},1)')[0].functions
    assert make("var x = 1\nfunction go(){}") == ["go"]
    assert make("a()\nfunction f(){}\nvar g = function(){}\nclass H{}") == ["H", "f", "g"]
    assert make("var x = 1 +\nfunction no(){}") == [] and make("if (x)\nfunction no(){}") == []
    assert archive.stable_text("a=1\nb=2") == "a=1\nb=2\n" and archive.stable_text("return\nx") == "return\nx\n"
    assert archive.stable_text("f(a,\n b)") == archive.stable_text("f(a, b)") and archive.stable_text("a\n+b") == "a+b\n"
