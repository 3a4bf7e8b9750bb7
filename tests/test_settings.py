"""Settings, packs and stored graphs."""

import json

from riskloom.functions.config import Config, parse_config
from riskloom.operators import replies as R
from riskloom.sources import diff as D
from riskloom.sources import store as S


def test_config():
    assert parse_config("") == Config()
    got = parse_config('{"review": {"depth": 5, "unknown": 1}, "privacy": {"redact_patterns": ["a"]}, "other": {}}')
    assert got.review.depth == 5 and got.privacy.redact_patterns == ("a",) and got.review.backend_depth == 4


def test_backend_pack(spark):
    paths = spark.createDataFrame([(1, 0, ["a"], "low", "low", ["x"]), (1, 1, ["b"], "high", "high", ["y", "x"])], "pack_id int, seq int, path array<string>, risk string, confidence string, rule_hits array<string>")
    edges = spark.createDataFrame([(1, i, f"s{i}", "t", "calls", "high" if i == 39 else "low") for i in range(40)], "pack_id int, seq int, source string, target string, edge_type string, confidence string")
    snippets = spark.createDataFrame([(1, 0, "f", "t")], "pack_id int, seq int, file string, text string")
    pack = json.loads(R.backend_pack(paths, edges, snippets).first().pack)
    assert [p["path"] for p in pack["impact_paths"]] == [["b"], ["a"]] and pack["rules"] == ["x", "y"]
    assert len(pack["edges"]) == 30 and pack["edges"][0]["source"] == "s39"
    names = spark.createDataFrame([("gpt",), ("text-embedding-3",), ("a-chat",)], "name string")
    assert [r.name for r in R.chat_models(names).collect()] == ["a-chat", "gpt"]


def test_json_graph_and_run_row(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"id": "a", "line": 1}\n{bad\n{"file": "x"}\n')
    (tmp_path / "e.json").write_text('{"source": "a", "target": "b"}\n{"source": "a"}\n')
    nodes, edges = S.load_graph_json(spark, f"{tmp_path}/n.json", f"{tmp_path}/e.json")
    assert [r.id for r in nodes.collect()] == ["a"] and edges.count() == 1
    lines = D.diff_lines(spark.createDataFrame([(1, "diff --git a/x b/x\n@@ -1 +1 @@\n-a\n+b")], "diff_id long, text string"))
    row = S.run_row(lines, "p", "staged", 1.5, "c").first()
    assert (row.n_files, row.n_changed, row.project, row.elapsed) == (1, 2, "p", 1.5)
