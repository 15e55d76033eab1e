"""Source trees as a data source: ``spark.read.format("sourcetree").load(uri)``.

The tree is listed level by level, each level under the ignore rules gathered on
the way down.  Planning lists only as many levels as give enough folders; each of
those is one partition, which an executor lists further and reads.  Names with a
leading underscore are files like others, in any store that Arrow opens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.lexing import supports
from .repository import _IGNORE_FILES, _Ignore, global_excludes

#: Folders or groups of files that planning aims for, and files of such a group.
SPLITS, GROUP = 64, 200
#: (folder, text) of an ignore file; a folder with all that count in it.
Rules = tuple[tuple[str, str], ...]
Folder = tuple[str, Rules]


class _Tree:
    """Listing and reading in one store."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file:")))
        self.root = path.rstrip("/") or "/"
        self.local = self.fs.type_name == "local"
        self._compiled: dict[tuple[str, str], _Ignore] = {}

    def info(self, path: str):
        return self.fs.get_file_info(path)

    def text(self, path: str) -> str | None:
        if not self.info(path).is_file:
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read().decode("utf-8", errors="replace")

    def own_rules(self, folder: str, in_git: bool) -> Rules:
        """The ignore files of a folder; later ones have the last word."""
        names = [".git/info/exclude", *(n for n in _IGNORE_FILES if in_git or n != ".gitignore")]
        found = ((folder, self.text(f"{folder}/{name}")) for name in names)
        return tuple((f, text) for f, text in found if text is not None)

    def repository(self) -> PurePosixPath | None:
        above = [PurePosixPath(self.root), *PurePosixPath(self.root).parents]
        return next((p for p in above if str(p) not in (".", "") and self.info(f"{p}/.git").type.name != "NotFound"), None)

    def outer_rules(self, git: PurePosixPath | None) -> Rules:
        """Rules from outside the root: the user's own, then those of folders up to the repository's."""
        if git is None:
            return ()
        out: list[tuple[str, str]] = []
        try:
            out.append((str(git), global_excludes().read_text(encoding="utf-8", errors="replace")))
        except OSError:
            pass
        for folder in reversed(PurePosixPath(self.root).parents):
            if folder == git or git in folder.parents:
                out += self.own_rules(str(folder), True)
        return tuple(out)

    def ignored(self, path: str, is_dir: bool, rules: Rules) -> bool:
        out = False
        for key in rules:
            if key not in self._compiled:
                self._compiled[key] = _Ignore(PurePosixPath(key[0]), key[1])
            verdict = self._compiled[key].verdict(PurePosixPath(path), is_dir)
            out = out if verdict is None else verdict
        return out

    def list(self, folder: Folder, in_git: bool) -> tuple[list[str], list[Folder]]:
        """Supported files of a folder, and the folders in it."""
        from pyarrow import fs

        path, rules = folder
        rules = rules + self.own_rules(path, in_git)
        files, folders = [], []
        for entry in sorted(self.fs.get_file_info(fs.FileSelector(path)), key=lambda e: e.path):
            name = entry.path.rsplit("/", 1)[-1]
            if name.startswith(".") or self.local and os.path.islink(entry.path):
                continue
            is_dir = entry.type == fs.FileType.Directory
            if not (is_dir or entry.is_file and supports(name)) or self.ignored(entry.path, is_dir, rules):
                continue
            if is_dir:
                folders.append((entry.path, rules))
            else:
                files.append(entry.path)
        return files, folders

    def read(self, path: str) -> tuple[str, str | None, str | None]:
        file = path[len(self.root) :].lstrip("/") if path.startswith(self.root + "/") else path
        try:
            with self.fs.open_input_stream(path) as f:
                return file, f.read().decode(), None
        except (OSError, UnicodeDecodeError) as e:
            return file, None, str(e)


class _Reader(DataSourceReader):
    def __init__(self, uri: str, splits: int):
        self.uri, self.splits = uri, splits

    def partitions(self) -> list[InputPartition]:
        tree = _Tree(self.uri)
        if tree.info(tree.root).is_file:
            return [InputPartition((False, (tree.root,) if supports(tree.root) else (), ()))]
        git = tree.repository()
        files: list[str] = []
        level: list[Folder] = [(tree.root, tree.outer_rules(git))]
        while level and len(level) < self.splits:
            below: list[Folder] = []
            for folder in level:
                own, inside = tree.list(folder, git is not None)
                files += own
                below += inside
            level = below
        groups = [(git is not None, tuple(files[at : at + GROUP]), ()) for at in range(0, len(files), GROUP)]
        return [InputPartition(g) for g in [*groups, *((git is not None, (), (folder,)) for folder in level)]] or [InputPartition((False, (), ()))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tree = _Tree(self.uri)
        in_git, files, todo = partition.value
        yield from map(tree.read, files)
        waiting = list(todo)
        while waiting:
            own, inside = tree.list(waiting.pop(), in_git)
            yield from map(tree.read, own)
            waiting += inside


class SourceTree(DataSource):
    """(file, text, error) of the supported files of a tree, as ``repository.read_files`` has them."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return "file string, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splits", SPLITS)))


def register(spark: SparkSession) -> None:
    """Make the format ``sourcetree`` known: options path, and splits for how many partitions planning aims at."""
    spark.dataSource.register(SourceTree)
