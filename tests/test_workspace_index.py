"""Indexing a workspace again after changes equals indexing it anew."""

from __future__ import annotations

from codeloom.operators import workspace_index


def content(spark, path):
    symbols = sorted((r["file_path"], r["name"], r["kind"], r["start_line"]) for r in workspace_index.read(spark, path, "symbols").collect())
    edges = sorted((r["from_id"], r["to_id"], r["kind"], r["line"]) for r in workspace_index.read(spark, path, "relations").collect())
    found = [sorted(r["name"] for r in workspace_index.search(spark, path, q).collect()) for q in ("user class", "save", "shave", "gone")]
    return symbols, edges, found


def test_index_again(spark, tmp_path):
    root, path = tmp_path / "w", str(tmp_path / "index")
    (root / "node_modules").mkdir(parents=True)
    (root / "a.ts").write_text("import { save } from './b';\nexport class UserService {\n  run() {\n    save(1);\n  }\n}\n")
    (root / "b.ts").write_text("export function save(x) {\n}\n")
    (root / "c.py").write_text("def gone():\n    pass\n")
    (root / "node_modules" / "d.ts").write_text("class Ignored { }\n")
    first = workspace_index.index_workspace(spark, str(root), path).first()
    assert (first["files"], first["new"], first["changed"], first["removed"]) == (3, 3, 0, 0)
    symbols, edges, found = content(spark, path)
    assert [s[1] for s in symbols] == ["./b", "UserService", "run", "save", "gone"] and found[0] == ["UserService"] and found[3] == ["gone"]
    assert sorted(e[2] for e in edges) == ["calls", "imports"]
    (root / "b.ts").write_text("// moved\nexport function save(x) {\n}\nexport function usher() {\n}\n")
    (root / "c.py").unlink()
    (root / "e.py").write_text("class UserServiceTest:\n    pass\n")
    again = workspace_index.index_workspace(spark, str(root), path).first()
    assert (again["files"], again["new"], again["changed"], again["removed"]) == (3, 1, 1, 1)
    other = str(tmp_path / "other")
    workspace_index.index_workspace(spark, str(root), other)
    assert content(spark, path) == content(spark, other)
    assert content(spark, path)[2][3] == []
