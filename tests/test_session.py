from __future__ import annotations

import io
import json

import pytest

from modlens import rpc, session

OLD = '__d("Core",["Util"],function(t,n,r,o,a,i){i.x=1\nvar y=2},1);__d("Util",["Core"],function(){},2);'
NEW = '__d("Core",["Util"],function(t,n,r,o,a,i){i.x=1\nvar y=3},1);__d("Util",["Core"],function(){},2);__d("More",["Core"],function(){},3);'


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("session")
    for name, text in (("old", OLD), ("new", NEW)):
        (top / name).mkdir()
        (top / name / "a.js").write_text(text)
    s = session.Session(spark, str(top / "store"), str(top / "filters"))
    assert s.bundle_list().count() == 0
    s.bundle_add("wa-1", str(top / "old"), keep_chunks=True)
    s.bundle_add("2", str(top / "new"))
    with pytest.raises(FileExistsError):
        s.bundle_add("2", str(top / "new"))
    with pytest.raises(ValueError, match="lies in the store"):
        s.bundle_add("3", f"{top}/store/chunks")
    return s


def test_bundles(own):
    assert [r["bundle"] for r in own.bundle_list().collect()] == ["whatsapp-1", "whatsapp-2"]
    before = own.bundle_info("1")
    again = own.bundle_reindex("1", pretty=False)
    assert again["modules"] == 2 and again["added_at"] == before["added_at"] and again["source"] == before["source"] and not again["pretty"]
    own.bundle_reindex("1", pretty=True)
    with pytest.raises(LookupError, match="not kept"):
        own.bundle_reindex("2")


def test_search_diff_and_graph(own):
    with pytest.raises(ValueError, match="pattern"):
        own.module_search("latest")
    assert [r["name"] for r in own.grep("latest", "var y").hits.collect()] == ["Core"]
    assert own.module_get("latest", "Core", 1, 1)["lines"][0].startswith("__d(")
    with pytest.raises(LookupError, match="Core"):
        own.module_get("latest", "core")
    got = own.diff(filter="all", limit=1)
    assert (got["summary"]["old_total"], got["summary"]["new_total"], got["summary"]["added"], got["summary"]["modified"]) == (2, 3, 1, 1)
    assert got["changes_total"] == 2 and got["changes_truncated"] and [c["name"] for c in got["changes"]] == ["Core"]
    g = own.graph("latest", match="^More$", depth=0, detect_cycles=True)
    assert g.cycles == [["Core", "Util", "Core"]] and {r["file"] for r in g.nodes.collect()} == {"More.js", "Core.js", "Util.js"}
    with pytest.raises(ValueError, match="matches"):
        own.graph("latest", match="^none$")
    assert own.filter_test("latest", "all")["kept"] == 3


def test_rpc(own):
    ask = lambda **m: json.dumps({"jsonrpc": "2.0"} | m)
    lines = [
        ask(id=1, method="initialize", params={"protocolVersion": "x"}), ask(method="notified"), "{", "", ask(id=2, method="tools/list"), ask(id=3, method="nothing"), ask(id=4, method="tools/call", params={}),
        ask(id=5, method="tools/call", params={"name": "bundle_list"}), ask(id=6, method="tools/call", params={"name": "module_get", "arguments": {"bundle": "latest", "name": "zzz"}}),
        ask(id=7, method="tools/call", params={"name": "graph", "arguments": {"bundle": "latest", "roots": ["More"]}}), ask(id=8, method="ping"),
    ]
    out = io.StringIO()
    rpc.serve(own, io.StringIO("\n".join(lines) + "\n"), out)
    got = {m["id"]: m for m in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert got[1]["result"]["protocolVersion"] == rpc.PROTOCOLS[0] and got[None]["error"]["code"] == rpc.PARSE_ERROR
    assert len(got[2]["result"]["tools"]) == 17 and got[3]["error"]["code"] == rpc.UNKNOWN_METHOD and got[4]["error"]["code"] == rpc.BAD_PARAMS
    assert [r["bundle"] for r in json.loads(got[5]["result"]["content"][0]["text"])] == ["whatsapp-1", "whatsapp-2"]
    assert got[6]["result"]["isError"] and not got[7]["result"]["isError"] and got[8]["result"] == {}
    assert {n["name"] for n in json.loads(got[7]["result"]["content"][0]["text"])["nodes"]} == {"More", "Core"}


def test_arguments(tmp_path, monkeypatch):
    (tmp_path / "f.json").write_text('{"a": 1}')
    monkeypatch.setenv("HOME", str(tmp_path))
    assert session.read_json_arg("~/f.json") == {"a": 1} == session.read_json_arg("-", io.StringIO('{"a": 1}'))
    assert session.expand_home("~") == str(tmp_path) and session.expand_home("~x/y") == "~x/y"
