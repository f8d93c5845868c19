import random
import re

from trialweave.llm.automaton import backward, combined
from trialweave.llm.secret_scan import Scanner, scan_secrets

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(0, *m.span()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 12]
    out += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(2, *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda m: (m[1], m[0]))


PARTS = ["password", "secret", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJ0123456", "x", "é", "0a1b", ".", "-", "token=", "secret: ", "abcdefghijklm", "\n", "😀"]


def test_base_spans_equal_regex_search():
    scanner, rng = Scanner(), random.Random(3)
    for _ in range(5_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))
        assert [m for m in scanner.spans(text) if m[0] < 3] == base(text), text


def test_automaton_accepts_what_the_regex_accepts():
    patterns = [r"a(b|cd)*e?", r"[^a-c]{2,3}", r"x\x41+y"]
    both, rng = combined([(p, False) for p in patterns]), random.Random(4)
    back = [backward(p) for p in patterns]
    for _ in range(2_000):
        text = "".join(rng.choice("abcdexyAz") for _ in range(rng.randint(1, 8)))
        state = both.start
        for at, byte in enumerate(text.encode(), 1):
            state = both.next[state, both.classes[byte]]
            for k, pattern in enumerate(patterns):
                ends = any(re.fullmatch(pattern, text[s:at]) for s in range(at))
                assert bool(both.rules[state] >> k & 1) == ends
        for k, pattern in enumerate(patterns):
            state = back[k].start
            for byte in reversed(text.encode()):
                state = back[k].next[state, back[k].classes[byte]]
            assert bool(back[k].rules[state]) == bool(re.fullmatch(pattern, text))


def test_automaton_is_minimal():
    assert len(combined([("ab|cb", False)]).next) == len(combined([("[ac]b", False)]).next)


def test_table(spark):
    rows = [(1, "é token = 'abcdefghijkl' AKIA" + "A" * 14), (2, None), (3, ""), (4, "ghp_" + "a" * 24), (1, "f" * 100_000)]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = sorted((r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in got)
    assert spans == [
        (1, [("assign", 2, 23, True), ("access", 25, 43, True)]),
        (1, [("hex", 0, 100_000, True)]),
        (2, []),
        (3, []),
        (4, [("github", 0, 28, False), ("hex", 4, 28, True)]),
    ]
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns_are_not_read(spark):
    rows = [(1, "token = 'abcdefghijkl'", "x", 3), (2, None, "y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, spans int")
    shown = lambda d: sorted((r.doc_id, str(r.spans)) for r in scan_secrets(d).collect())
    assert shown(df) == shown(df.select("doc_id", "text"))
