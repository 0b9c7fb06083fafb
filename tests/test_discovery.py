"""Ignore rules against the tool that defines them, and listings of real folders."""

import os
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from factloom.functions.ignores import Matcher, parsed
from factloom.sources import files, listing, logs


@pytest.mark.parametrize(
    ("rules", "ignored", "kept"),
    [
        (["docs/*.md"], ["docs/a.md"], ["x/docs/a.md", "docs/x/a.md"]),
        (["build/"], ["build/x", "a/build/x", "build/"], ["build", "a/build"]),
        (["src/b?.ts"], ["src/b1.ts"], ["src/b.ts", "src/b12.ts", "x/src/b1.ts", "src/b/.ts"]),
        (["logs/", "!logs/keep/"], ["logs/keep/x", "logs/a"], ["log"]),
        (["*.md", "!keep.md"], ["a.md", "x/a.md"], ["keep.md", "x/keep.md"]),
        (["/a"], ["a", "a/x"], ["b/a"]),
        (["a/**/z"], ["a/z", "a/b/z", "a/b/c/z"], ["x/a/z"]),
        (["**/t/**"], ["t/x", "a/t/x/y"], ["t", "a/t"]),
        (["**/foo"], ["foo", "a/foo", "a/foo/b"], ["foox"]),
        (["x/**"], ["x/a", "x/a/b"], ["x", "y/x/a"]),
        (["f[0-3].l", "g[!a].l", "h[]x].l"], ["f2.l", "gb.l", "h].l", "hx.l"], ["f4.l", "ga.l", "h[.l"]),
        (["\\#a", "\\!b", "c\\ ", "d  ", "# e"], ["#a", "!b", "c ", "d"], ["a", "b", "e", "# e"]),
        (["*", "!*/", "!*.py"], ["a.md", "x/b.md"], ["a.py", "x/b.py"]),
        (["a\\*b"], ["a*b"], ["axb"]),
        (["Read.ME"], ["readme".replace("m", ".m")], ["readxme"]),
        (["", "   ", "/", "!", "#x"], [], ["a", "x"]),
        (["foo/*", "!foo/bar"], ["foo/x"], ["foo/bar", "foo/bar/x"]),
        (["fo**ba"], ["foba", "foxba"], ["fo/ba"]),
    ],
)
def test_rules(rules, ignored, kept):
    m = Matcher(rules)
    assert [p for p in ignored if not m.ignores(p)] == [] and [p for p in kept if m.ignores(p)] == []


@pytest.mark.skipif(not shutil.which("git"), reason="the tool is not here")
@pytest.mark.parametrize("seed", range(12))
def test_rules_against_the_tool(tmp_path, seed):
    rnd = random.Random(seed)
    names = ["a", "b", "ab", "a.b", "B", "-c", "a1", "[x]"]
    paths = {"/".join(rnd.choice(names) for _ in range(rnd.randrange(1, 5))) for _ in range(80)}
    made = []
    for p in sorted(paths):
        try:
            os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
            (tmp_path / p).write_text("")
            made.append(p)
        except OSError:
            continue
    pieces = ["a", "b", "*", "a*", "?", "**", "[ab]", "[!a]", "*b", "a1", "\\[x\\]", "a?", "[a-b]?"]
    rules = ["!" * (rnd.random() < 0.3) + "/" * (rnd.random() < 0.3) + "/".join(rnd.choice(pieces) for _ in range(rnd.choice([1, 1, 2, 3]))) + "/" * (rnd.random() < 0.3) for _ in range(rnd.randrange(1, 9))]
    (tmp_path / ".gitignore").write_text("\n".join(rules) + "\n")
    git = lambda *a: subprocess.run(["git", "-c", "core.ignorecase=true", "-c", "core.quotepath=off", "-C", str(tmp_path), *a], capture_output=True, text=True, check=True).stdout
    git("init", "-q")
    want = set(git("ls-files", "--others", "--exclude-per-directory=.gitignore", "-z").split("\0")) - {"", ".gitignore"}
    m = Matcher(rules)
    assert {p for p in made if not m.ignores(p)} == want, rules


def test_no_rule():
    assert parsed("# x") is None and parsed("[z-a]x") is None and Matcher([]).ignores("a/b") is False


TREE = {
    "__init__.py": "i", "_x.py": "x", "a.py": "a", ".env.example": "e", ".github/workflows/ci.yml": "c", "pkg/__init__.py": "p", "pkg/deep/er/m.ts": "m", "node_modules/z.ts": "z", "pkg/node_modules/q/z.ts": "z", "gen/no.ts": "n",
    "gen/keep.ts": "k", "x.unknown": "u", "logs/app.log": "2024-01-01T00:00:00Z ERROR svc m", "logs/_raw.log": "r", ".hidden/b.log": "b", "tmp/t.log": "t", "pkg/.gitignore": "*",
}


@pytest.fixture
def tree(tmp_path):
    for path, text in TREE.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / ".gitignore").write_text("# rules\ngen/*\n!gen/keep.ts\n")
    return tmp_path


def test_dots_and_underscores_are_there(spark, tree):
    found = {r.rel_path: r.content for r in files.discover(spark, str(tree)).collect()}
    assert {"__init__.py", "_x.py", "a.py", ".env.example", ".github/workflows/ci.yml", "pkg/__init__.py", "pkg/deep/er/m.ts", "gen/no.ts", "gen/keep.ts"} <= found.keys()
    assert not any("node_modules" in p or p == "x.unknown" for p in found) and found["pkg/__init__.py"] == "p"
    kept = {r.rel_path for r in files.discover(spark, str(tree), rules=files.ignore_lines(spark, str(tree))).collect()}
    assert kept == found.keys() - {"gen/no.ts"}
    whole = files.discover(spark, str(tree))
    assert {r.rel_path for r in files.not_ignored(whole, files.ignore_lines(spark, str(tree))).collect()} == kept
    assert files.not_ignored(whole, []).count() == len(found)
    row = whole.where("rel_path = 'a.py'").first()
    assert (row.abs_path, row.basename, row.extension, row.size_bytes) == (str(tree / "a.py"), "a.py", "py", 1) and row.modified_at is not None


def test_ignored_folders_are_not_listed(tree, monkeypatch):
    """Whatever the number of partitions, each file comes once and nothing below an ignored folder is looked at."""
    for spread in ("1", "2", "5", "64"):
        reader = listing._Reader({"path": str(tree), "rules": '["node_modules/", "gen/"]', "spread": spread, "contents": "false"})
        looked = []
        listed = reader._listed
        monkeypatch.setattr(reader, "_listed", lambda at, root, folder, m: (looked.append(folder), listed(at, root, folder, m))[1])
        parts = reader.partitions()
        got = [p for part in parts for batch in reader.read(part) for p in batch.column("rel_path").to_pylist()]
        assert sorted(got) == sorted(p for p in [*TREE, ".gitignore"] if "node_modules" not in p and not p.startswith("gen/"))
        assert not any("node_modules" in f or f == "gen" for f in looked)


def test_batches_are_bounded(tree, monkeypatch):
    monkeypatch.setattr(listing, "BATCH", 1)
    reader = listing._Reader({"path": f"file://{tree}", "spread": "1"})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) == len(TREE) + 1 and all(b.num_rows == 1 for b in batches)


def test_log_walk(spark, tree):
    assert {r.path for r in logs.discover(spark, str(tree)).collect()} == {"logs/app.log", "logs/_raw.log", ".hidden/b.log"}
    assert logs.discover(spark, str(tree / "nowhere")).count() == 0


def test_config_names_with_dots(spark, tree):
    assert files.first_config(spark, str(tree), (".nope", ".env.example")) == "e" and files.first_config(spark, str(tree), ("m.ts",)) is None
    assert files.escaped("a b*[c]") == "a\\ b\\*\\[c\\]"
    assert files.discover(spark, str(tree)).where(F.col("content").isNull()).count() == 0
