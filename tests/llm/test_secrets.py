import random
import re

import duckdb
import pytest

from ledgerloom.llm import automata, secrets
from tests.llm.fixtures import folder, none, odd  # noqa: F401

PATTERNS = [re.compile(r.pattern.replace("(?i:", "(?ai:")) for r in secrets.RULES]
PARTS = ["password", "token", "api_key", "Secret", ":", "=", '"', "'", " ", "  ", "abc", "AKIA", "A1B2C3D4E5F6G7H8", "é",
         "0123456789abcdef", "ff", "eyJ", ".", "-", "_", "ghp_", "\n", "😀", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "a" * 30]


def brute(text):
    out = [(m.start(), k, m.end()) for k, (rule, pattern) in enumerate(zip(secrets.RULES, PATTERNS))
           for m in pattern.finditer(text or "") if len(rule.value(m.group().encode())) >= rule.least]
    return [(s, secrets.RULES[k].kind, e) for s, k, e in sorted(out)]


def test_spans_equal_a_backtracking_engine():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        assert secrets.find(text) == brute(text)


def test_a_failing_match_takes_its_place():
    assert secrets.find("password: token: abcdefgh") == []
    assert secrets.find("token: 'password' = 'abcdefgh'") == brute("token: 'password' = 'abcdefgh'")


def test_hits_across_blocks_of_the_scan():
    for pad in range(secrets.BLOCK - 30, secrets.BLOCK + 2):
        text = "." * pad + "AKIA" + "A1" * 10 + " ü " + "0" * 24
        assert secrets.find(text) == brute(text)


def test_long_runs_take_linear_time():
    text = "token:'password' = '" + "a" * 300_000 + " eyJa" * 50_000
    assert secrets.find(text) == brute(text)


@pytest.mark.parametrize("pattern", ["a(b|c)*d?", "x{2,3}y", "[^a-y]z+", "(?i:ab)+c", r"\x20\.\-[]x]"])
def test_automata_accept_what_the_pattern_matches(pattern):
    dfa = automata.compile_rules([automata.parse(pattern)], anywhere=False)
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("abcdxyzAB .-]") for _ in range(rng.randint(0, 6)))
        state = 0
        for byte in text.encode():
            state = dfa.next[state][byte]
        assert bool(dfa.accepts[state]) == bool(re.fullmatch(pattern.replace("[]x]", r"[\]x]"), text))


def test_minimal_automaton():
    one = automata.compile_rules([automata.parse("(a|b)c|ac|bc")], anywhere=False)
    assert len(one) == 4  # start, after a or b, accepted, dead


def test_scan_of_odd_rows(odd, none):
    rows = secrets.scan(odd).collect()
    assert len(rows) == odd.count() and all(r["spans"] == [] for r in rows)
    assert secrets.scan(none).collect() == []


def test_scrub_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a token = 'abcdef012' b", "s", 23), (2, None, "s", 0), (3, "clean", "s", 5)],
                                 "doc_id long, text string, spans string, n_chars long")
    rows = {r["doc_id"]: r for r in secrets.scrub(docs).collect()}
    assert rows[1]["text"] == "a [assign]' b" and rows[1]["n_chars"] == 13
    assert (rows[2]["text"], rows[2]["n_chars"]) == (None, 0) and rows[3]["text"] == "clean"


def test_query_against_its_sql(spark, odd, folder):
    more = spark.createDataFrame([(100, "x token=abcdefg AKIA" + "B2" * 8 + " " + "0f" * 12)], "doc_id long, text string")
    path = folder(documents=odd.select("doc_id", "text").filter("doc_id IS NOT NULL").distinct().union(more))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    cur = con.execute(secrets.ORACLE["op1_secret_scan"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    got = secrets.op1_secret_scan(spark, path)
    assert sorted(tuple(r) for r in got.select(names).collect()) == want
