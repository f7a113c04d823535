import pytest
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions import scalars
from siltstone.operators import rules

YAML = """
rules:
  - id: hardcoded-password
    name: Mine
    severity: HIGH
    enabled: true
    patterns: ['x']
  - id: new
    patterns: ['y', 'z']
    file_patterns: ['\\.txt$']
    capture_group: 1
    ignorecase: true
    allowlist: [EXAMPLE]
    tags: [a]
    min_length: 3
    max_length: 9
  - id: ent
    engine: entropy
    entropy: {threshold: 4.0}
  - id: new
    severity: LOW
"""


def test_levels():
    assert [len(rules.builtin(x)) for x in ("core", "extended", "all", "what")] == [6, 32, 38, 6]
    every = rules.builtin("all")
    assert len({r.id for r in every}) == 38 and all(r.enabled for r in every)
    assert [sum(r.severity == s for r in every) for s in rules.SEVERITIES] == [7, 23, 8, 0]
    assert [sum(r.severity == s for r in rules.CORE) for s in rules.SEVERITIES] == [2, 3, 1, 0]


def test_yaml_and_merge(tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text(YAML)
    custom = rules.load(str(path))
    assert [r.id for r in custom] == ["hardcoded-password", "new", "ent", "new"] and custom[0].enabled and not custom[1].enabled
    assert custom[1].patterns == ("y", "z") and custom[1].capture_group == 1 and custom[1].max_length == 9
    assert custom[2].entropy.threshold == 4.0 and rules.with_defaults(custom[2].entropy) == rules.Entropy(4.0, 32, 20, 0, "base64")
    merged = rules.load(str(path), "core", True)
    assert [r.id for r in merged] == [r.id for r in rules.CORE] + ["new", "ent"]
    assert merged[0].severity == "HIGH" and merged[6].severity == "LOW"
    assert rules.parse_yaml("") == []


def test_merge_of_tables_is_merge_of_lists(spark):
    custom = rules.parse_yaml(YAML)
    want = [r.id for r in rules.merge(rules.CORE, custom)]
    got = rules.merge_tables(rules.to_table(spark, rules.CORE, "core"), rules.to_table(spark, custom)).orderBy("rule_ord").collect()
    assert [r.id for r in got] == want and got[0].severity == "HIGH" and [r.rule_ord for r in got] == list(range(8))


def test_sizes(spark):
    cases = {"50MB": 50 << 20, " 10kb ": 10 << 10, "1GB": 1 << 30, "7B": 7, "": 0}
    for text, size in cases.items():
        assert scalars.parse_size(text) == size
    for bad in ("50", "1.5MB", "MB", "x KB", "5 MB"):
        with pytest.raises(ValueError):
            scalars.parse_size(bad)
    frame = spark.createDataFrame([(t,) for t in [*cases, "50", "1.5MB", "5 MB"]], "t string")
    found = {r.t: r.n for r in frame.select("t", scalars.size_column(F.col("t")).alias("n")).collect()}
    assert found == cases | {"50": None, "1.5MB": None, "5 MB": None}


def test_scalars(spark):
    frame = spark.createDataFrame([("a/b/C.tar.GZ", "abcdef", 3600), ("x", "é" * 3, 60), (".npmrc", "  ab ", 10), ("d/", "", 0)], "p string, t string, s long")
    rows = frame.select(scalars.base_name(F.col("p")), scalars.extension(F.col("p")), scalars.truncate(F.col("t"), 2), scalars.interval_text(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("C.tar.GZ", ".gz", "ab...", "1h0m0s"), ("x", "", "é...", "1m0s"), (".npmrc", ".npmrc", "ab", "10s"), ("d", "", "", "one-shot")]
    one = frame.limit(1).select(scalars.join_path(F.lit("/a/"), F.lit(""), F.lit("b")), scalars.gav_path(F.lit("g.h"), F.lit("a"), F.lit("1")), scalars.path_to_group(F.lit("g/h")), scalars.sanitize(F.lit("a/b:c")), scalars.severity_color(F.lit("HIGH")), scalars.severity_rank(F.lit("LOW"))).first()
    assert tuple(one) == ("a/b", "g/h/a/1", "g.h", "a_b_c", "\033[31mHIGH\033[0m", 4)


def test_config():
    Config().validate()
    for bad in ({"repo_url": ""}, {"repo_url": "ftp://x"}, {"concurrency": 0}, {"qps": -1}, {"retries": -1}, {"timeout": 0}, {"checkpoint_interval": -1}, {"rules_level": "x"}, {"scan_concurrency": -1}, {"disk_budget_mb": -1}, {"max_file_size": "5"}):
        with pytest.raises(ValueError):
            Config(**bad).validate()
    config = Config(auth_pass="secret", rules_level="all", interval=60)
    assert "secret" not in str(config.snapshot()) and Config.from_snapshot(config.snapshot() | {"unknown": 1}, resume=True) == Config(rules_level="all", interval=60, resume=True)
