"""The stored graph: what an update writes, what readers see meanwhile, what fails."""

import tempfile

import pytest

from riskloom.sources import graph_store as GS


def tree(spark, names, text="export function go{n}() {}\nimport { a } from './f1'\n"):
    rows = [(f"f{n}.ts", text.replace("{n}", str(n)) if n != 99 else None) for n in names]
    return spark.createDataFrame(rows, "file string, content string")


def ids(spark, root, told=None):
    return {r.id for r in GS.stored(spark, root, "nodes", told).collect()}


def test_updates(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/g"
    assert GS.stored(spark, root, "nodes").count() == 0 and not GS.graph_is_fresh(tree(spark, [1]), root)
    first = GS.update_graph(tree(spark, range(1, 9)), root, n_buckets=4)
    assert first["version"] == 1 and first["states"] == {"added": 8}
    before = GS.manifest(spark, root)
    assert GS.update_graph(tree(spark, range(1, 9)), root) == {"version": 1, "states": {"same": 8}, "buckets": []}
    second = GS.update_graph(tree(spark, [*range(2, 9), 20]), root)
    assert second["states"] == {"same": 7, "removed": 1, "added": 1} and len(second["buckets"]) <= 2
    assert ids(spark, root) == {f"f{n}.ts{s}" for n in [*range(2, 9), 20] for s in ("", f":go{n}")}
    assert ids(spark, root, before) == {f"f{n}.ts{s}" for n in range(1, 9) for s in ("", f":go{n}")}  # an old reader goes on
    untouched = set(before["buckets"]) - {str(b) for b in second["buckets"]}
    after = GS.manifest(spark, root)
    assert all(after["buckets"][b] == before["buckets"][b] for b in untouched)
    assert {(r.source, r.target) for r in GS.stored(spark, root, "edges").filter("edge_type = 'imports'").collect()} == {(f"f{n}.ts", "f1.ts") for n in range(2, 9)}
    asked = spark.createDataFrame([("a", "go3"), ("b", "name: go1"), ("c", '"broken')], "query string, text string")
    assert [(r.query, r.id) for r in GS.search_graph(spark, root, asked).collect()] == [("a", "f3.ts:go3")]
    assert GS.vacuum(spark, root) >= 0 and ids(spark, root) == {f"f{n}.ts{s}" for n in [*range(2, 9), 20] for s in ("", f":go{n}")}


def test_failures(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/g"
    GS.update_graph(tree(spark, [1, 99]), root, n_buckets=2)  # one has no content
    assert GS.update_graph(tree(spark, [1, 99]), root)["states"] == {"same": 1, "changed": 1}
    kept, version = ids(spark, root), GS.manifest(spark, root)["version"]

    def breaks(changed, every):
        raise ValueError("no parser")

    with pytest.raises(ValueError):
        GS.update_graph(tree(spark, [1, 5]), root, breaks)

    def slow(changed, every):
        GS.update_graph(tree(spark, [1, 6]), root)  # another update commits first
        return GS.parse_scripts(changed, every)

    assert ids(spark, root) == kept and GS.manifest(spark, root)["version"] == version
    with pytest.raises(RuntimeError):
        GS.update_graph(tree(spark, [1, 5]), root, slow)
    assert ids(spark, root) == {"f1.ts", "f1.ts:go1", "f6.ts", "f6.ts:go6"}
    assert GS.vacuum(spark, root) > 0 and GS.graph_is_fresh(tree(spark, [1, 6]), root)
