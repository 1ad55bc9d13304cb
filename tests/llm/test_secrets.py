"""Secrets: base spans against the patterns as stated, automata, and formats learned from labels."""

from __future__ import annotations

import math
import random
import re

import pytest

from rolemesh.llm import secrets

SCHEMA = "doc_id long, text string, base string, words string, found long, spans int"
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def as_stated(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "b", "w", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "==", "AKIA", "ABCDEFGH", "1234567890", "abcdef", "é", "\n", "-", "K", "ſecret"]
    for _ in range(4_000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 25)))
        found = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in secrets.base_spans(text))
        assert found == as_stated(text), text


def test_shares_of_an_automaton_sum_to_one():
    rng = random.Random(1)
    automaton = secrets.Automaton(["".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(300)])
    total = 0.0
    for state in range(len(automaton.visits)):
        assert automaton.visits[state] == automaton.stops[state] + sum(n for n, _ in automaton.moves[state].values())
    # Without smoothing, all strings together have probability one.
    shares = [(0, 1.0)]
    for _ in range(400):
        after = {}
        for s, p in shares:
            total += p * automaton.stops[s] / automaton.visits[s]
            for n, to in automaton.moves[s].values():
                after[to] = after.get(to, 0.0) + p * n / automaton.visits[s]
        shares = list(after.items())
    assert total == pytest.approx(1, abs=1e-6)


def test_merging_finds_the_cycle_of_a_grammar():
    rng = random.Random(2)
    values = ["ab" * rng.randrange(1, 30) + "c" for _ in range(2_000)]
    automaton = secrets.Automaton(values)
    assert len(automaton.visits) <= 5
    seen = {len(v) for v in values}
    assert len(seen) == 29
    assert automaton.log_likelihood("ab" * 45 + "c") > automaton.log_likelihood("ba" * 45 + "c") + 10


def test_likelihood_is_the_product_of_shares():
    automaton = secrets.Automaton(["ab", "ab", "b"])  # repeated values count once
    assert automaton.visits[0] >= 2
    state, want = 0, 1.0
    for ch in "ab":
        n, to = automaton.moves[state].get(ch, (0, state))
        total = automaton.visits[state] + secrets.SMOOTHING * secrets.SYMBOLS
        want *= (n + secrets.SMOOTHING) / total
        state = to
    want *= (automaton.stops[state] + secrets.SMOOTHING) / (automaton.visits[state] + secrets.SMOOTHING * secrets.SYMBOLS)
    assert automaton.log_likelihood("ab") == pytest.approx(math.log(want))


def made(rng):
    return "sk-" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=24))


def test_formats_learned_from_labels_are_found_elsewhere(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(("ba", "to", "ri", "ne", "lu", "so")) for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    labelled = [f"{prose(20)} api_key = '{made(rng)}' {prose(20)}" for _ in range(120)]
    hidden = [(made(rng), prose(30)) for _ in range(60)]
    bare = [f"{t} {v} {prose(5)}" for v, t in hidden]
    clean = [prose(60) + " some-long-hyphenated-word www.example.com/path/to/page.html" for _ in range(60)]
    found = {r.doc_id: r for r in secrets.find_secrets(rows(spark, labelled + bare + clean)).collect()}
    caught = 0
    for i, (value, before) in enumerate(hidden):
        a = len(before) + 1
        caught += found[120 + i].spans == f"like assign:{a}:{a + len(value)}"
    assert caught >= 54  # nine of ten
    assert all(found[i].spans == found[i].base == as_stated(labelled[i]) for i in range(120))
    assert sum(found[180 + i].spans != "" for i in range(60)) == 0


def test_odd_texts(spark):
    long = "x" * 300_000 + " token=" + "a1" * 50_000 + " " + "word " * 1_000
    texts = [None, "", "  ", long, "é password: abcdefghijkl", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "deadbeefdeadbeef", "deadbeefdeadbee"]
    got = sorted(secrets.find_secrets(rows(spark, texts + texts[-2:])).collect(), key=lambda r: r.doc_id)
    assert [(r.n_assign, r.n_access, r.n_hex) for r in got] == [
        (0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 1), (1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 1), (0, 0, 0),
    ]
    assert got[0].spans == got[0].base == "" and got[4].spans == "assign:2:24"
    assert [r.base for r in got] == [as_stated(t or "") for t in texts + texts[-2:]]
    assert secrets.find_secrets(rows(spark, [])).count() == 0


def test_other_kinds_of_ids(spark):
    found = secrets.find_secrets(spark.createDataFrame([("a", "deadbeefdeadbeef"), (None, None)], "doc_id string, text string"))
    assert {(r.doc_id, r.spans) for r in found.collect()} == {("a", "hex:0:16"), (None, "")}
