"""Trees walked by tasks, and the memory view made of one."""

from __future__ import annotations

import json
import os

import pytest

from sessionmeter.plans.memory import home_tree, memory_view, opened_cwds
from sessionmeter.sources import files as W

from test_sources import put


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def log(path, when, *rows):
    put(path, rows)
    os.utime(path, (when, when))


@pytest.fixture
def homes(tmp_path):
    root = f"{tmp_path}/my homes"
    al = f"{root}/al"
    for name in (".claude/CLAUDE.md", ".claude/projects/-w-a/memory/b.md", ".claude/projects/-w-a/memory/deep/c.md", ".claude/skills/s/SKILL.md",
                 ".claude/skills/s/docs/more.txt", ".claude/skills/s/.git/x", ".claude/skills/loose.md", ".codex/AGENTS.md", ".qwen/settings.json",
                 ".qwen/other.json", "app/CLAUDE.md", "app/.claude/CLAUDE.md", "app/note.md", "big/deep/CLAUDE.md"):
        write(f"{al}/{name}", name)
    write(f"{al}/.claude/skills/s/SKILL.md", "---\ndescription: 'does x'\n---\nrest")
    p = f"{al}/.claude/projects"
    # the newest log names no directory, the second does, the third is not needed; a fourth would give another one
    log(f"{p}/-w-a/n4.jsonl", 400, {"type": "x"}, {"cwd": 5})
    log(f"{p}/-w-a/n3.jsonl", 300, "text", {"cwd": f"{al}/app/"}, {"cwd": "/later"})
    log(f"{p}/-w-a/n2.jsonl", 200, {"cwd": "/no"})
    log(f"{p}/-w-a/n1.jsonl", 100, {"cwd": "/never"})
    # three without a directory: the fourth must not be opened
    for k in range(3):
        log(f"{p}/-w-b/k{k}.jsonl", 500 + k, {"type": "x"})
    log(f"{p}/-w-b/old.jsonl", 1, {"cwd": f"{al}/app"})
    log(f"{p}/-home/h.jsonl", 50, {"cwd": al})
    log(f"{p}/-out/o.jsonl", 50, {"cwd": "/elsewhere"})
    write(f"{root}/bo/.claude/projects/-x/s.jsonl", '{"cwd": "' + f"{root}/bo/w" + '"}\n{"torn')
    write(f"{root}/bo/w/CLAUDE.md", "bo")
    return root


def test_walk(spark, homes):
    tree = home_tree(spark, homes)
    got = {(r.home, r.path) for r in tree.collect()}
    assert ("al", ".claude/skills/s/docs/more.txt") in got and ("bo", ".claude/projects/-x/s.jsonl") in got
    assert not {p for _, p in got if ".git" in p or "deep" in p or p.startswith("app/") or p.endswith(("other.json", "loose.md"))}
    # paths are those Spark's readers print
    uri = tree.where("path = '.claude/CLAUDE.md'").first().uri
    assert spark.read.text(W.unquoted(uri)).select("_metadata.file_path").first()[0] == uri
    with pytest.raises(FileNotFoundError):
        home_tree(spark, f"{homes}/none")


def test_three_newest_logs(spark, homes):
    got = {(r.home, r.encoded): (r.cwd, r.opened) for r in opened_cwds(home_tree(spark, homes)).collect()}
    assert got == {
        ("al", "-w-a"): (f"{homes}/al/app/", 2), ("al", "-w-b"): (None, 3), ("al", "-home"): (f"{homes}/al", 1),
        ("al", "-out"): ("/elsewhere", 1), ("bo", "-x"): (f"{homes}/bo/w", 1),
    }


def test_memory_view(spark, homes):
    view = memory_view(spark, homes)
    got = sorted((r.home, r.encoded, r.category, r.name) for r in view["memory"].collect())
    assert got == [
        ("al", "-w-a", ".claude/CLAUDE.md", "app"), ("al", "-w-a", "CLAUDE.md", "app"), ("al", "-w-a", "auto-memory", "app"),
        ("al", "_codex_global", "AGENTS.md", "codex (global)"), ("al", "_qwen_global", "settings.json", "qwen (global)"),
        ("bo", "-x", "CLAUDE.md", "w"),
    ]
    assert [r.path for r in view["global"].collect()] == [".claude/CLAUDE.md"]
    assert {(r.home, r.encoded): r.n_files for r in view["projects"].collect()}[("al", "-w-a")] == 3
    assert view["listing"].first().label == "~/.claude/CLAUDE.md (global)"
    assert sorted(r.rel_path for r in view["skill_files"].collect()) == ["SKILL.md", "docs/more.txt"]
    assert [(r.name, r.description, r.n_files) for r in view["skills"].collect()] == [("s", "does x", 2)]


def test_copied_homes(spark, tmp_path):
    root = f"{tmp_path}/copy"
    write(f"{root}/al/.claude/projects/-home-al-w/s.jsonl", json.dumps({"cwd": "/home/al/w"}) + "\n")
    write(f"{root}/al/w/CLAUDE.md", "x")
    assert memory_view(spark, root)["memory"].isEmpty()
    row = memory_view(spark, root, origin="/home")["memory"].first()
    assert (row.home, row.category, row.cwd, row.size) == ("al", "CLAUDE.md", "/home/al/w", 1)


def test_dated_folders_are_pruned(spark, tmp_path):
    layout = W.Layout(files=r"(?:[^/]+/){0,4}rollout-[^/]*\.jsonl", folders=r"[^/]+(?:/[^/]+){0,3}")
    for day in ("2025/12/31", "2026/04/14", "2026/04/15", "2026/5/1", "misc/x"):
        write(f"{tmp_path}/{day}/rollout-a.jsonl", "{}\n")
    # a file where a listed day would be shows which folders are entered
    names = {r.rel for r in W.find_files(spark, str(tmp_path), layout, since="2026-04-15").collect()}
    assert names == {"2026/04/15/rollout-a.jsonl", "2026/5/1/rollout-a.jsonl", "misc/x/rollout-a.jsonl"}
    assert W.find_files(spark, str(tmp_path), layout).count() == 5


def test_written_lines(spark, tmp_path):
    rows = [(f"d{i % 3}/f {i % 5}.txt", i, f"line {i}é") for i in range(100)]
    done = W.write_lines(spark.createDataFrame(rows[::-1], "rel string, ord long, value string"), f"{tmp_path}/out").collect()
    assert sum(r.lines for r in done) == 100
    for rel in {r[0] for r in rows}:
        with open(f"{tmp_path}/out/{rel}") as f:
            assert f.read() == "".join(r[2] + "\n" for r in rows if r[0] == rel)


def test_uris():
    for path in ("/a b/c#d", "/x%20y/é", "/q?[1]"):
        place = W.Place("file:///tmp")
        assert place.path(place.uri(path)) == path
    assert W.Place("/tmp").path("file:/tmp/a") == "/tmp/a"
