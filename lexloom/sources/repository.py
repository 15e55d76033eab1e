"""Source trees: discovery with ignore files, reading, waivers and decision records.

Listing is ours because Spark's file sources skip names that start with a dot
or an underscore, and ``_app.tsx`` is an ordinary source file.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexing import EXTENSIONS, supports
from ..plans.engine import Context

WAIVERS_DIR = ".lexloom/waivers"
ADR_DIR = "docs/adr"
_IGNORE_FILES = (".gitignore", ".ignore")


def _ignore_regex(pattern: str) -> str:
    """An ignore pattern as a regex over relative paths; * stays within one name."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class _Ignore:
    """The rules of one ignore file, for paths below its folder."""

    def __init__(self, folder: Path, text: str):
        self.folder = folder
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:]
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            body = _ignore_regex(line.lstrip("/"))
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z", re.S), keep, only_dirs))

    def verdict(self, path: Path, is_dir: bool) -> bool | None:
        """True: ignored, False: kept, None: not mentioned; the last rule wins."""
        relative = path.relative_to(self.folder).as_posix()
        out = None
        for rule, keep, only_dirs in self.rules:
            if (is_dir or not only_dirs) and rule.match(relative):
                out = not keep
        return out


def _read_ignores(folder: Path, in_git: bool) -> list[_Ignore]:
    """Ignore files of a folder; later ones in the list have the last word."""
    out = []
    for name in _IGNORE_FILES:
        if name == ".gitignore" and not in_git:
            continue
        try:
            out.append(_Ignore(folder, (folder / name).read_text(encoding="utf-8", errors="replace")))
        except OSError:
            pass
    if (folder / ".git").is_dir():
        try:
            out.insert(0, _Ignore(folder, (folder / ".git/info/exclude").read_text(encoding="utf-8", errors="replace")))
        except OSError:
            pass
    return out


def global_excludes() -> Path:
    """The user's own ignore file, which applies to every git tree: the one that git's settings name, or its usual place."""
    home = Path(os.environ.get("HOME") or Path.home())
    settings = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config") / "git"
    for config in (home / ".gitconfig", settings / "config"):
        try:
            text = config.read_text(encoding="utf-8", errors="replace")
        except OSError:
            continue
        for section in re.findall(r"(?ims)^\s*\[core\]([^\[]*)", text):
            if m := re.search(r'(?im)^\s*excludesfile\s*=\s*"?([^"\n]+?)"?\s*$', section):
                return Path(re.sub(r"^~(?=/|$)", str(home), m[1]))
    return settings / "ignore"


def discover(root: str | Path) -> list[Path]:
    """Supported files below ``root``, ordered by path components.

    Hidden entries and ignored ones are left out, symbolic links are not
    followed, and names that are no UTF-8 are dropped.
    """
    root = Path(root)
    above = [p for p in (root.resolve(), *root.resolve().parents)]
    git_root = next((p for p in above if (p / ".git").exists()), None)
    outer: list[_Ignore] = []
    if git_root:  # every other ignore file has the last word over the user's own
        try:
            outer.append(_Ignore(git_root, global_excludes().read_text(encoding="utf-8", errors="replace")))
        except OSError:
            pass
    for folder in reversed(above[1:]):
        if git_root and (folder == git_root or git_root in folder.parents):
            outer += _read_ignores(folder, True)
    found: list[Path] = []

    def walk(folder: Path, ignores: list[_Ignore]) -> None:
        ignores = ignores + _read_ignores(folder.resolve(), git_root is not None)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            print(f"warning: {folder}: {e.strerror}", file=sys.stderr)
            return
        for entry in entries:
            if entry.name.startswith(".") or entry.is_symlink():
                continue
            try:
                entry.name.encode()
            except UnicodeEncodeError:
                continue
            path, is_dir = Path(entry.path), entry.is_dir()
            verdicts = [v for i in ignores if (v := i.verdict(path.resolve(), is_dir)) is not None]
            if verdicts and verdicts[-1]:
                continue
            if is_dir:
                walk(path, ignores)
            elif entry.is_file() and supports(entry.name):
                found.append(path)

    if root.is_file():
        return [root] if supports(root.name) else []
    walk(root, outer)
    return sorted(found, key=lambda p: p.relative_to(root).parts)


def relative(path: Path, root: str | Path) -> str:
    """``path`` below the root, or as it is where it lies elsewhere."""
    try:
        return path.relative_to(root).as_posix()
    except ValueError:
        return path.as_posix()


def read_files(spark: SparkSession, root: str | Path, paths: list[Path] | None = None) -> DataFrame:
    """(file, text, error) for discovered files, read by the executors.

    A file that cannot be read as UTF-8 has no text and says why in ``error``.
    """
    root = Path(root)
    paths = discover(root) if paths is None else paths
    rows = [(relative(p, root), str(p)) for p in paths]
    listed = spark.createDataFrame(rows, "file string, path string")
    wanted = max(1, min(len(rows) // 20 + 1, 4 * spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist()):
                text = error = None
                try:
                    text = Path(path).read_bytes().decode()
                except (OSError, UnicodeDecodeError) as e:
                    error = str(e)
                yield pa.record_batch([pa.array([x], pa.string()) for x in (file, text, error)], names=["file", "text", "error"])

    return listed.repartition(wanted).mapInArrow(read, "file string, text string, error string")


def read_store(spark: SparkSession, *uris: str) -> DataFrame:
    """(file, text, error) of the supported files below folders that only Spark's readers reach, named relative to them.

    Spark lists and reads them, so nothing is opened locally.  It passes over
    names that begin with a dot or an underscore, and ignore files are not asked.
    A file that is no UTF-8 has no text and says so in ``error``.
    """
    found = None
    for uri in uris:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
        base = uri.rstrip("/").split(":", 1)[-1]
        file = F.regexp_replace(F.col("path"), F.lit(r"^(?:\w+:)?(?://[^/]*)?(?=/)"), F.lit(""))
        base = re.sub(r"^//[^/]*(?=/)", "", base)
        file = F.when(file.startswith(base + "/"), F.substring(file, len(base) + 2, 2**31 - 1)).otherwise(file)
        text = F.try_validate_utf8(F.col("content").cast("string"))
        rows = read.select(file.alias("file"), text.alias("text"), F.when(text.isNull(), "no UTF-8").alias("error"))
        found = rows if found is None else found.unionAll(rows)
    return found.filter(F.regexp_extract("file", r"[^/]\.([^./]+)$", 1).isin(list(EXTENSIONS)))


def _yaml_files(folder: Path) -> Iterator[tuple[Path, dict]]:
    if not folder.is_dir():
        return
    for path in sorted(p for p in folder.iterdir() if p.suffix in (".yaml", ".yml") and p.is_file()):
        try:
            data = yaml.safe_load(path.read_text(encoding="utf-8"))
        except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
            print(f"warning: {path}: {e}", file=sys.stderr)
            continue
        if isinstance(data, dict):
            yield path, data


def load_context(root: str | Path, waivers_dir: str | None = None, adr_dir: str | None = None) -> Context:
    """Waivers and decision records of a tree; missing folders hold none."""
    root, context = Path(root), Context()
    for path, data in _yaml_files(root / (waivers_dir or WAIVERS_DIR)):
        if isinstance(data.get("rule"), str) and isinstance(data.get("file"), str):
            context.waivers.append((data["rule"], data["file"]))
        else:
            print(f"warning: {path}: a waiver needs `rule` and `file`", file=sys.stderr)
    for _, data in _yaml_files(root / (adr_dir or ADR_DIR)):
        if isinstance(data.get("topic"), str):
            status = data.get("status")
            context.adrs.append((data["topic"], isinstance(status, str) and status.lower() == "accepted"))
    return context
