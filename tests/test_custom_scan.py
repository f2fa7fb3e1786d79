import random
import re

import pytest

from scriptsift.operators import catalog, literals, scan
from scriptsift.plans.custom_scan import rule_index, scan_custom

RULES = (
    "id long, project_id int, name string, pattern_type string, pattern string, finding_type string, severity string, "
    "description string, enabled boolean")


@pytest.mark.parametrize("regex,want", [
    ("bundle 12[0-9]?;", ["bundle 12"]), ("ab+cd", ["bcd"]), ("(foo|barz)qux", ["barzqux", "fooqux"]), ("x?y*", []), ("abc|", []),
    ("(abc)+def", ["abcdef"]), ("[ab]cd[ef]", ["acde", "acdf", "bcde", "bcdf"]), ("a{3}b", ["aaab"]), (r"\bw3z\b", ["w3z"]),
    ("abc.*defgh", ["defgh"]), ("(?:AKIA|ASIA)[A-Z0-9]{16}", ["akia", "asia"]), ("(?=abc)d", []), ("(?P<n>abcd)(?P=n)x", ["abcd"]),
])
def test_required_literals(regex, want):
    assert literals.required_literals(regex) == (False, want)


def test_literals_without_case():
    assert literals.required_literals("(?i)B33[0-9]") == (True, ["b33"])
    assert literals.required_literals("(?i:Tok)en") == (True, ["token"])
    # Letters beyond ASCII fold in ways the index does not follow.
    assert literals.required_literals("(?i)straße") == (True, ["stra"])


def _random_regex(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.randrange(8)
        atom = rng.choice(["a", "b", "ab", "abc", "[ab]", "[^b]", ".", r"\w", "cab", "ba"])
        if kind == 0 and depth < 2:
            atom = f"(?:{_random_regex(rng, depth + 1)}|{_random_regex(rng, depth + 1)})"
        elif kind == 1 and depth < 2:
            atom = f"({_random_regex(rng, depth + 1)})"
        parts.append(atom if len(atom) == 1 or kind > 3 else f"(?:{atom})" + rng.choice(["", "?", "+", "*", "{2}", "{1,2}", "+?"]))
    return "".join(parts)


def test_every_match_holds_a_literal():
    rng, told = random.Random(8), 0
    for _ in range(2500):
        regex = rng.choice(["", "", "(?i)"]) + _random_regex(rng)
        _, needed = literals.required_literals(regex)
        text = "".join(rng.choice("abcABC") for _ in range(14))  # short, as nested loops backtrack
        for m in re.finditer(regex, text):
            if needed and m.group():
                told += 1
                assert any(x in m.group().lower() for x in needed), (regex, needed, m.group())
    assert told > 60


def test_grams_are_bytes_in_lower_case():
    assert literals.grams(b"ABc").tolist() == [0x616263]
    assert literals.grams("é!".encode()).tolist() == [0xC3A921]
    assert literals.grams(b"ab").tolist() == []


def _table(spark, patterns):
    rows = [(i, None, f"r{i}", "regex", p, "t", "low", "", True) for i, p in enumerate(patterns, 1)]
    return spark.createDataFrame(rows, RULES)


PATTERNS = [
    "token[0-9]+", "(?i)SECRET=[a-z]+", "(open", "x{2,}", "[0-9]{4}", "(a|b)key([0-9])", "(?i)kiosk", r"\bend\b", "é+t", "never there",
    "abc(?:def)?", r"line\s+two", "(?:foo|barz)qux", "[[a&&b]w", "(?P<n>ab)(?P=n)",
]


def test_like_the_plain_scan(spark):
    rng = random.Random(2)
    words = ["token12", "Secret=abc", "SECRET=x", "xx", "xxx", "2024", "akey7", "bkey8", "KIOSK", "Kiosk", "kioſk", "end", "étt", "abcdef",
             "line", "two", "\n", "barzqux", "aw", "abab", "plain", "﷐", "﷑xx", "never", "there"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(120)] + [None, "", "  \n ", "token1 token2 " * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "asset_key int, content string")
    table = _table(spark, PATTERNS)
    detectors = catalog.custom_detectors(table)
    good, bad = catalog.valid_detectors(spark, detectors)
    assert [r.name for r in bad.collect()] == ["r3"]
    cols = ["asset_key", "finding_type", "category", "value", "context", "line_number", "severity", "pattern_name", "m_ord"]
    want = scan.scan_patterns(frame, ("asset_key",), detectors=good).select(*cols)
    got = scan_custom(frame, table, None, ("asset_key",), page=4)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))
    assert {r.p_ord for r in got.collect()} <= {i for i in range(1, 16)}
    every = scan_custom(frame, table, None, ("asset_key",), deduplicate=False, context_lines=0)
    plain = scan.scan_patterns(frame, ("asset_key",), detectors=good, deduplicate=False, context_lines=0)
    assert sorted(map(tuple, every.select(*cols).collect())) == sorted(map(tuple, plain.select(*cols).collect()))


def test_rules_that_share_a_label_repeat_nothing(spark):
    rows = [(1, None, "same", "regex", "tok[0-9]+", "t", "low", "", True), (2, None, "same", "regex", "[a-z]ok[0-9]+", "t", "low", "", True)]
    frame = spark.createDataFrame([(1, "tok12 rok3")], "asset_key int, content string")
    found = scan_custom(frame, spark.createDataFrame(rows, RULES), None, ("asset_key",)).collect()
    assert sorted((r.value, r.p_ord) for r in found) == [("rok3", 2), ("tok12", 1)]


def test_texts_are_read_once_at_any_number_of_rules(spark, tmp_path):
    """Only texts that hold a wanted group of bytes go on, and only pairs that share one are run."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    frame = spark.createDataFrame([(i, f"bundle {i}; x") for i in range(400)] + [(1000, "nothing")], "asset_key int, content string")
    frame = frame.mapInArrow(counted, frame.schema)
    table = _table(spark, [f"bundle {i};" for i in range(0, 900)])
    folder = str(tmp_path / "scan")
    found = scan_custom(frame, table, None, ("asset_key",), folder=folder, page=300)
    assert found.count() == 400 and reads.value == 401
    pairs = spark.read.parquet(f"{folder}/pairs")
    # The rarest group of each rule; three digits tell a rule from nearly all others.
    assert pairs.count() < 10 * 400
    assert spark.read.parquet(f"{folder}/texts").count() == 400


def test_a_repeated_run_into_the_same_folder(spark, tmp_path):
    frame = spark.createDataFrame([(1, "tok12")], "asset_key int, content string")
    for _ in range(2):
        assert scan_custom(frame, _table(spark, ["tok[0-9]+"]), None, ("asset_key",), folder=str(tmp_path)).count() == 1


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "tok12")], "asset_key int, content string")
    assert scan_custom(frame, _table(spark, ["tok"]).filter("false"), None, ("asset_key",)).collect() == []
    assert scan_custom(frame.filter("false"), _table(spark, ["tok"]), None, ("asset_key",)).collect() == []
    assert rule_index(_table(spark, ["a.c"])).select("literal").collect()[0][0] is None


def test_pairs_do_not_grow_with_rules_that_share_digits(spark, tmp_path):
    """A group of three digits is held by ever more rules; about half of a literal is not."""
    frame = spark.createDataFrame([(i, f"bundle {i}; x") for i in range(100, 300)], "asset_key int, content string")
    found = scan_custom(frame, _table(spark, [f"bundle {i};" for i in range(3000)]), None, ("asset_key",), folder=str(tmp_path / "scan"))
    assert found.count() == 200
    assert spark.read.parquet(str(tmp_path / "scan" / "pairs")).count() < 4 * 200


def test_groups_of_a_literal_are_groups_of_its_texts():
    for literal in (b"abc", b"Abcd", b"abcdefgh", b"x" * 11, bytes(range(97, 122)) * 3):
        level = literals.level_of(literal)
        assert level <= len(literal) and (level * 2 > len(literal) or level == 32 or level == literals.GRAM)
        held = set(literals.groups(b"zz " + literal.upper() + b" zz", {3, level}).tolist())
        assert set(literals.groups(literal, {level}).tolist()) <= held
    assert literals.groups(b"abc", {8}).tolist() == [] and literals.groups(b"", {3, 4}).tolist() == []
