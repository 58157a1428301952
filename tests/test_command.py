"""The command line: outputs, exit codes, checks, configuration."""

import io
import json
import sys

import pytest

from papyrine.__main__ import main
from papyrine.options import Options, load_options


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "in"
    (top / "sub").mkdir(parents=True)
    (top / "a.html").write_text("<title>T</title><h1>A</h1>")
    (top / "sub" / "a.htm").write_text("<p>one<p>two")
    return top


def test_batch(spark, folder, tmp_path, capsys):
    out = tmp_path / "out"
    assert main([str(folder), "--output-dir", str(out)], spark) == 0
    assert (out / "a.md").read_text() == "# A\n" and not (out / "sub").exists() and "converted" in capsys.readouterr().err
    assert main([str(folder), "-r", "--output-dir", str(out)], spark) == 2 and "same output" in capsys.readouterr().err
    assert main([str(folder), "-r", "-m", "-q", "--output-dir", str(out), "--manifest", "m.json"], spark) == 0
    assert (out / "sub" / "a.md").read_text() == "one\n\ntwo\n" and len(json.load(open(out / "m.json"))["files"]) == 2
    assert main([str(folder), "-r", "-m", "--output-dir", str(out), "--check"], spark) == 0
    (out / "sub" / "a.md").write_text("one\n\n2\n")
    capsys.readouterr()
    assert main([str(folder), "-r", "-m", "--output-dir", str(out), "--check", "--diff"], spark) == 2
    err = capsys.readouterr().err
    assert "sub/a.md:3: -2" in err and "sub/a.md:3: +two" in err and (out / "sub" / "a.md").read_text() == "one\n\n2\n"
    assert main([str(folder), "-r", "-m", "--output-dir", str(out), "--output-policy", "fail-if-exists"], spark) == 2
    assert main([str(folder), "-r", "-m", "--output-dir", str(out), "--output-policy", "skip-existing"], spark) == 0
    assert (out / "sub" / "a.md").read_text() == "one\n\n2\n"
    assert main([str(folder), "--output-dir", str(tmp_path / "dry"), "--dry-run"], spark) == 0 and not (tmp_path / "dry").exists()


def test_single_and_stdin(spark, folder, tmp_path, capsys, monkeypatch):
    assert main([str(folder / "a.html")], spark) == 0 and capsys.readouterr().out == "# A\n"
    assert main([str(folder / "a.html"), "-o", str(tmp_path / "x.md"), "--profile", "obsidian", "--metadata-title"], spark) == 0
    assert (tmp_path / "x.md").read_text().startswith('---\ntitle: "T"\n---\n')
    assert main([str(folder / "a.html"), "--profile", "obsidian"], spark) == 0 and capsys.readouterr().out == "# A\n"
    monkeypatch.setattr(sys, "stdin", type("S", (), {"buffer": io.BytesIO(b"<h2>in</h2>")})())
    assert main(["-", "--heading-style", "setext"], spark) == 0 and "in\n--" in capsys.readouterr().out


def test_errors(spark, folder, tmp_path, capsys):
    (folder / "bad.html").write_bytes(b"\xff\xfe\x00\xd8a\x00")
    assert main([str(folder), "--output-dir", str(tmp_path / "o")], spark) == 2 and "utf-16" in capsys.readouterr().err
    assert (tmp_path / "o" / "a.md").exists()  # the others are converted
    assert main([str(folder / "bad.html"), "--encoding", "windows-1252"], spark) == 2
    assert main([str(folder), "--encoding", "nope"], spark) == 2 and main(["--profile", "nope"], spark) == 2
    assert main(["--dry-run", "--check"], spark) == 2 and main([str(folder / "none.html")], spark) == 1


def test_configuration(capsys, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "none"))
    assert main(["--print-default-config"]) == 0
    (tmp_path / "all.toml").write_text(capsys.readouterr().out)
    assert load_options(str(tmp_path / "all.toml"), env={}) == Options()
    (tmp_path / "c.toml").write_text("profile = 'gfm'\n[metadata]\ntitle = true\nopen-graph-title = true\n[render]\nbullet = 'plus'\n")
    assert main(["--print-effective-config", "-c", str(tmp_path / "c.toml"), "--code-fence", "tildes"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert (shown["profile"], shown["metadata"], shown["bullet_marker"], shown["code_fence"]) == ("gfm", ["title", "og_title"], "plus", "tildes")


def test_deep_inline():
    from papyrine.convert import convert

    for tag in ("b", "em", "span"):
        assert "deep" in convert(f"<{tag}>" * 250 + "deep")["markdown"]
    assert "deep" in convert("<div>" * 2000 + "deep", Options(max_dom_depth=0))["markdown"]
