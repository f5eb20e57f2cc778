"""A workspace of projects as a data source: `spark.read.format("workspace").load(root)` after `register(spark)`.

Projects are the topmost folders with a marker. Each folder just below a project is a partition, which walks it from above: folders on the skip list, hidden by a rule file, or
behind a link aren't listed, and files that a rule hides, or that a filter on the paths leaves out, aren't opened. Any file system that pyarrow knows will do.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from sedimenta.operators.filtering import IGNORED_DIRS
from sedimenta.operators.ignoring import OWN_RULES, TAKEN_IN, ignore_rule, rule_files
from sedimenta.sources.formats import MARKER_ENDING, MARKER_ENDING_RANK, MARKERS

SCHEMA = "project string, marker string, rel_path string, size long, mtime timestamp, reason string, text string"
Layer = tuple[str, list[tuple[re.Pattern, bool, bool]]]


@dataclass
class Folder(InputPartition):
    """A folder of a project: with all below it, or its own files alone."""

    root: str
    project: str
    marker: str
    path: str
    deep: bool


def marker_of(names: list[str]) -> str | None:
    """The marker of least rank among the names in a folder, by name where ranks are equal."""
    found = [(MARKERS.get(n, MARKER_ENDING_RANK), n) for n in names if n in MARKERS or n.endswith(MARKER_ENDING)]
    return min(found)[1] if found else None


def hidden(rel_path: str, folder: bool, layers: list[Layer]) -> bool:
    """Whether a layer's last rule that fits hides the path; what lies above it is known not to be hidden."""
    for layer, rules in layers:
        own = rel_path[len(layer) + 1 :] if layer else rel_path
        last = next((again for pattern, again, folders in reversed(rules) if (folder or not folders) and pattern.match(own)), True)
        if not last:
            return True
    return False


class WorkspaceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = [r.rstrip("/") for r in options["path"].split("\n")]
        self.depth = int(options.get("depth", 4))
        self.skipped = frozenset(json.loads(options["skipped"]) if "skipped" in options else IGNORED_DIRS)
        self.rule_files = rule_files(options.get("ruleFile", OWN_RULES))
        self.projects: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Projects named, and the beginning of the path, are decided before anything is listed below or opened; Spark applies all others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("project",):
                self.projects = {f.value} if self.projects is None else self.projects & {f.value}
            elif isinstance(f, In) and f.attribute == ("project",):
                self.projects = set(f.value) if self.projects is None else self.projects & set(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("rel_path",) and not self.prefix:
                self.prefix = f.value
            else:
                yield f

    def listed(self, root: str, path: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Names of the folders, and the files, of a folder; what can't be listed is empty."""
        files, _ = fs.FileSystem.from_uri(root)
        try:
            found = sorted(files.get_file_info(fs.FileSelector(path)), key=lambda i: i.base_name)
        except OSError:
            return [], []
        link = (lambda p: os.path.islink(p)) if isinstance(files, fs.LocalFileSystem) else (lambda p: False)
        folders = [i.base_name for i in found if i.type == fs.FileType.Directory and not link(i.path)]
        return folders, [i for i in found if i.type == fs.FileType.File or link(i.path)]

    def far(self, folder: str) -> bool:
        """Whether no path below a folder can begin as asked for."""
        return not (f"{folder}/".startswith(self.prefix) or self.prefix.startswith(f"{folder}/"))

    def content(self, root: str, path: str) -> bytes | None:
        """The bytes of a file; none where it can't be read."""
        files, _ = fs.FileSystem.from_uri(root)
        try:
            with files.open_input_stream(path) as f:
                return f.read()
        except OSError:
            return None

    def partitions(self) -> list[InputPartition]:
        """The upper levels of the roots are walked here, by names only; a folder with a marker isn't searched for others."""
        out, todo = [], []
        for root in self.roots:
            todo.append((root, fs.FileSystem.from_uri(root)[1], 0))
        while todo:
            root, path, depth = todo.pop()
            folders, files = self.listed(root, path)
            if marker := marker_of([*folders, *(f.base_name for f in files)]):
                name = path.rpartition("/")[2]
                if self.projects is None or name in self.projects:
                    out += [Folder(root, path, marker, path, False)] + [Folder(root, path, marker, f"{path}/{n}", True) for n in folders if n not in self.skipped and not self.far(n)]
            elif depth < self.depth:
                todo += [(root, f"{path}/{n}", depth + 1) for n in folders if not n.startswith(".") and n not in self.skipped]
        return out

    def rules(self, at: Folder, path: str, files: list[fs.FileInfo]) -> list[Layer]:
        """The layer of a folder's own rule files."""
        there, lines = {f.base_name for f in files}, [*(TAKEN_IN if path == at.project else [])]
        for name in self.rule_files:
            if name in there:
                lines += (self.content(at.root, f"{path}/{name}") or b"").decode("utf-8", "replace").split("\n")
        found = [(re.compile(r[0]), r[1], r[2]) for line in lines if (r := ignore_rule(line))]
        return [(path[len(at.project) + 1 :], found)] if found else []

    def read(self, at: Folder | None) -> Iterator[tuple]:
        if at is None:  # no project, no partition
            return
        layers, path, name = [], at.project, at.project.rpartition("/")[2]
        for part in ["", *(at.path[len(at.project) + 1 :].split("/") if at.deep else [])]:  # the rules of the folders above
            path = f"{path}/{part}" if part else path
            rel = path[len(at.project) + 1 :]
            if rel and hidden(rel, True, layers):
                return
            layers += self.rules(at, path, self.listed(at.root, path)[1])
        todo = [(at.path, layers)]
        while todo:
            path, layers = todo.pop()
            folders, files = self.listed(at.root, path)
            if path != at.path:
                layers = layers + self.rules(at, path, files)
            for info in files:
                rel = info.path[len(at.project) + 1 :]
                if not rel.startswith(self.prefix):
                    continue
                local = os.path.islink(info.path) if at.root.startswith(("file:", "/")) else False
                reason = "symlink" if local else "gitignore" if hidden(rel, False, layers) else "ok"
                data = self.content(at.root, info.path) if reason == "ok" else None
                if reason == "ok" and data is None:
                    reason = "unreadable"
                try:
                    text = None if data is None else data.decode("utf-8")
                except UnicodeDecodeError:
                    text, reason = None, "not-utf8"
                yield name, at.marker, rel, info.size, info.mtime, reason, text
            if at.deep:
                for folder in reversed(folders):
                    rel = f"{path}/{folder}"[len(at.project) + 1 :]
                    if folder not in self.skipped and not self.far(rel) and not hidden(rel, True, layers):
                        todo.append((f"{path}/{folder}", layers))


class Workspace(DataSource):
    """Options: `path` (roots, one a line), `depth` of the search for projects, `skipped` (JSON, folder names), `ruleFile` (the name of the own rule file)."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workspace)
