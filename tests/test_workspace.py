"""Projects and files of a workspace: what is found, what is hidden, and what is never opened."""

import os

import pytest

from sedimenta.sources import workspace


@pytest.fixture
def root(tmp_path):
    def put(path, content=b"x"):
        at = tmp_path / "ws" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)

    put("a/.git/config"), put("a/.gitignore", b"*.log\nbuild/\n!keep.log\n/top.txt\n"), put("a/x.log"), put("a/keep.log", b"kept"), put("a/top.txt"), put("a/src/top.txt", "é".encode()), put("a/src/build/out.py")
    put("a/src/.sedimentaignore", b"secret*\n"), put("a/src/secret.py"), put("a/src/deep/secret2.py"), put("a/src/deep/ok.py", b"ok"), put("a/secret.py"), put("a/node_modules/m/index.js"), put("a/src/bin.dat", b"\xff\xfe")
    put("a/sub/package.json", b"{}"), put("g/h/pyproject.toml", b""), put("g/h/m.py"), put("1/2/3/4/5/go.mod"), put("loose.txt"), put(".hid/go.mod"), put("b/code.code-workspace"), put("b/Makefile")
    (tmp_path / "ws" / "a" / "link").symlink_to(tmp_path / "ws" / "g"), (tmp_path / "ws" / "a" / "one.py").symlink_to(tmp_path / "ws" / "a" / "secret.py")
    return str(tmp_path / "ws")


def test_files(spark, root):
    workspace.register(spark)
    rows = spark.read.format("workspace").load(root)
    got = {(r.project, r.rel_path): (r.marker, r.reason, r.text) for r in rows.collect()}
    assert {p for p, _ in got} == {"a", "h", "b"} and got["b", "Makefile"][0] == "code.code-workspace" and got["h", "m.py"][0] == "pyproject.toml"
    mine = {path: v[1:] for (p, path), v in got.items() if p == "a" and not path.startswith(".git/")}
    assert mine == {
        ".gitignore": ("ok", "*.log\nbuild/\n!keep.log\n/top.txt\n"), "x.log": ("gitignore", None), "keep.log": ("ok", "kept"), "top.txt": ("gitignore", None), "src/top.txt": ("ok", "é"), "src/.sedimentaignore": ("ok", "secret*\n"),
        "src/secret.py": ("gitignore", None), "src/deep/secret2.py": ("gitignore", None), "src/deep/ok.py": ("ok", "ok"), "secret.py": ("ok", "x"), "src/bin.dat": ("not-utf8", None), "sub/package.json": ("ok", "{}"), "one.py": ("symlink", None), "link": ("symlink", None),
    }
    assert rows.where("project = 'h'").count() == 2 and rows.where("project = 'a' AND rel_path LIKE 'src/deep/%'").count() == 2


def test_what_is_opened(root, monkeypatch):
    opened, listed = [], []
    read, seen = workspace.WorkspaceReader.content, workspace.WorkspaceReader.listed
    monkeypatch.setattr(workspace.WorkspaceReader, "content", lambda self, r, path: opened.append(os.path.relpath(path, root)) or read(self, r, path))
    monkeypatch.setattr(workspace.WorkspaceReader, "listed", lambda self, r, path: listed.append(os.path.relpath(path, root)) or seen(self, r, path))

    def rows(*filters):
        reader = workspace.WorkspaceReader({"path": root})
        assert list(reader.pushFilters(list(filters))) == []
        opened.clear(), listed.clear()
        return [row for p in reader.partitions() for row in reader.read(p)]

    assert len(rows()) > 10
    hidden = ("a/node_modules", "a/src/build", "a/link", "1/2/3/4/5")
    assert not [p for p in opened + listed if p.startswith(hidden)] and "a/x.log" not in opened and "a/src/secret.py" not in opened and "a/one.py" not in opened
    assert [r[2] for r in rows(workspace.EqualTo(("project",), "a"), workspace.StringStartsWith(("rel_path",), "src/de"))] == ["src/deep/ok.py", "src/deep/secret2.py"]
    assert "a/src/deep/ok.py" in opened and "g/h/m.py" not in opened and "a/secret.py" not in opened and "a/sub" not in listed


def test_other_rule_file_and_bad_roots(spark, root):
    workspace.register(spark)
    other = spark.read.format("workspace").option("ruleFile", ".mine").option("skipped", '["src"]').load(root)
    assert {r.rel_path for r in other.where("project = 'a'").collect()} >= {"node_modules/m/index.js"} and other.where("rel_path LIKE 'src/%'").count() == 0
    assert spark.read.format("workspace").load(f"{root}/none").count() == 0
