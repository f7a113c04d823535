import json

from siltstone import cli

from .test_sources_plans import mirror, repo  # noqa: F401  (fixtures)


def test_scan_resume_history(spark, mirror, tmp_path, capsys):  # noqa: F811
    home, out = str(tmp_path / "home"), str(tmp_path / "r.json")
    common = ["--repo", str(mirror), "--home", home]
    assert cli.main(["scan", *common, "--output", "json", "--output-file", out]) == 0
    assert json.load(open(out))["summary"]["total_findings"] == 3
    kept = json.load(open(home + "/.scan-state.json"))
    assert kept["status"] == "completed" and kept["total_scanned"] == 4
    assert cli.main(["scan", *common, "--resume", "--output", "json", "--output-file", out]) == 0
    assert json.load(open(out))["summary"]["total_discovered"] == 0
    capsys.readouterr()
    assert cli.main(["history", "--home", home, "--export", str(tmp_path / "f.json")]) == 0
    assert "hardcoded-password" in capsys.readouterr().out and len(json.load(open(tmp_path / "f.json"))) == 3


def test_resume_takes_new_files_only(spark, mirror, tmp_path):  # noqa: F811
    home, out = str(tmp_path / "home"), str(tmp_path / "r.json")
    args = ["scan", "--repo", str(mirror), "--home", home, "--resume", "--output", "json", "--output-file", out]
    cli.main(args)
    (mirror / "org/b/x/2").mkdir()
    (mirror / "org/b/x/2/x-2.jar").write_bytes((mirror / "org/a/lib/2.0/lib-2.0.jar").read_bytes())
    cli.main(args)
    assert json.load(open(out))["summary"]["total_scanned"] == 1


def test_scan_as_a_stream(spark, mirror, tmp_path, capsys):  # noqa: F811
    args = ["scan", "--stream", "--repo", str(mirror), "--home", str(tmp_path / "home"), "--checkpoint-interval", "3"]
    cli.main(args)
    assert "batch 0" in capsys.readouterr().out
    cli.main(args)
    assert "batch" not in capsys.readouterr().out


def test_scan_over_http(spark, repo, tmp_path):  # noqa: F811
    out = str(tmp_path / "r.json")
    cli.main(["scan", "--repo", repo, "--home", str(tmp_path / "home"), "--output", "json", "--output-file", out, "--concurrency", "2", "--browser-concurrency", "2", "--download-concurrency", "2"])
    assert json.load(open(out))["summary"]["total_findings"] == 3


def test_tasks(spark, mirror, tmp_path, capsys):  # noqa: F811
    home = str(tmp_path / "home")
    cli.main(["task", "add", "t1", "--repo", str(mirror), "--home", home, "--interval", "600", "--auth-pass", "secret"])
    assert "secret" not in open(home + "/tasks.json").read()
    cli.main(["task", "run", "--home", home])
    row = json.load(open(home + "/tasks.json"))[0]
    assert row["scan_count"] == 1 and row["status"] == "active" and row["next_run_at"]
    cli.main(["task", "pause", "t1", "--home", home])
    capsys.readouterr()
    cli.main(["task", "list", "--home", home])
    assert "paused" in capsys.readouterr().out
    cli.main(["task", "delete", "t1", "--home", home])
    assert json.load(open(home + "/tasks.json")) == []


def test_rules_and_version(capsys):
    assert cli.main(["rules", "--rules-level", "core"]) == 0 and cli.main(["version"]) == 0
    out = capsys.readouterr().out
    assert out.count("\n") == 7 and "github-token" in out
