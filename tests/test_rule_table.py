import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import detect, rule_table, rules
from siltstone.operators.rules import Rule
from siltstone.plans.queries import letter_rules

from .test_detect import scan  # noqa: F401


def rows(frame):
    return sorted(map(str, frame.collect()))


def lines_frame(spark, lines, path="a.properties"):
    return spark.createDataFrame([(path, i, t) for i, t in enumerate(lines)], "file_path string, line_number int, line string")


RULES = [
    Rule(id="plain", severity="LOW", enabled=True, patterns=("secret[a-z]*", "to(?:ken|tal)-[0-9]+")),
    Rule(id="ignored", severity="LOW", enabled=True, patterns=("AbC+d",), ignorecase=True, file_patterns=(r"\.properties$",)),
    Rule(id="other-file", severity="LOW", enabled=True, patterns=("secret",), file_patterns=(r"\.xml$",)),
    Rule(id="group", severity="HIGH", enabled=True, patterns=("key=([a-z]+)",), capture_group=1, allowlist=("example", "abc"), min_length=2, max_length=6),
    Rule(id="no-words", severity="LOW", enabled=True, patterns=("[0-9]{4}",)),
    Rule(id="hollow", severity="LOW", enabled=True, patterns=("x*",), keywords=("xx",)),
    Rule(id="off", severity="LOW", patterns=("secret",)),
    Rule(id="empty", severity="LOW", enabled=True),
    Rule(id="dense", severity="LOW", enabled=True, engine="entropy", entropy=rules.Entropy(3.0, 16, 20, 0, "base64")),
]
LINES = ["secretive key=abcde token-12 ABCCD 2024", None, "", "key=abc key=examples key=e aXXb xx total-9 ſecret ſECRET", "K abccccd", "q7Zx91LmPw02RtYu77Kd key=abcdefg", "x" * 30]


@pytest.mark.parametrize("keep_null", [False, True])
@pytest.mark.parametrize("gated", [False, True])
def test_equals_the_unrolled_plan(spark, gated, keep_null):
    frame = lines_frame(spark, LINES)
    want = rows(detect.detect(frame, RULES, gated=gated, keep_null=keep_null))
    assert rows(rule_table.detect_by_table(frame, RULES, gated=gated, keep_null=keep_null)) == want and len(want) > 12


def test_built_in_rules(spark, sf_dir):
    from siltstone.plans.queries import corpus

    lines = corpus(spark, sf_dir)
    every = rules.builtin("all")
    assert rows(rule_table.detect_by_table(lines, every)) == rows(detect.detect(lines, every))
    bare = [Rule(**{**r.__dict__, "keywords": ()}) for r in every]  # words read off the patterns
    assert sum(rule_table.words_of(r) is not None for r in bare if r.engine != "entropy") >= 30
    assert rows(rule_table.detect_by_table(lines, bare)) == rows(detect.detect(lines, every))


def test_many_generated_rules(spark):
    rng = random.Random(5)
    made = letter_rules(300)
    lines = ["".join(rng.choices("etaoin shr", k=80)) for _ in range(60)]
    frame = lines_frame(spark, lines)
    got = rule_table.find(frame, made)
    want = sorted((i, r.id, m) for i, t in enumerate(lines) for r in made for m in re.findall(r.patterns[0], t))
    assert sorted((r.line_number, r.rule_id, r.match) for r in got.collect()) == want and len(want) > 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange hash|SortMerge|CartesianProduct|NestedLoop", plan)  # one narrow pass


def test_words_of_patterns():
    words = rule_table.needed_words
    assert words("abc[0-9]+defg") == {"defg"} and words("(?i)ABc.x") == {"abc"}
    assert words("(?:foo|barbaz)+x?") == {"foo", "barbaz"} and words("(?:foo|[0-9])") is None
    assert words("(?:abcdef)?xy") == {"xy"} and words("(abc){0,3}z") is None and words("[a") is None
    assert words(r"\bAKIA[0-9A-Z]{16}\z") == {"akia"} and words("é{2}日本") is None


def test_words_are_needed():
    """Whatever a pattern matches holds one of its words, tried on texts made from the patterns themselves."""
    rng = random.Random(2)
    for r in rules.builtin("all"):
        for p in r.patterns:
            words = rule_table.needed_words(p)
            for text in ("AKIA" + "A1" * 8, 'password="abcdefgh1"', "ghp_" + "a" * 36, "jdbc:mysql://h/d?user=a&password=b", "-----BEGIN RSA PRIVATE KEY-----", '"type": "service_account"') + tuple("".join(rng.choices("abk_-=:/ 09", k=40)) for _ in range(20)):
                if words and re.search(p, text):
                    assert any(w in text.lower() for w in words)


def test_no_rules_and_no_lines(spark):
    frame = lines_frame(spark, LINES)
    assert rule_table.detect_by_table(frame, []).count() == 0
    assert rule_table.detect_by_table(frame.where(F.lit(False)), RULES).count() == 0
    assert rule_table.detect_by_table(frame, []).columns == detect.detect(frame, []).columns
