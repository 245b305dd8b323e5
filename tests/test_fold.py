"""Folds against golden sequences and against a plain model of the same rules."""

import random

import pytest

from logloom.operators.fold import CHANGED, CREATED, NONE, Drain, FullSearch, Statistical, opcodes, pair_template

SSHD = [
    "",
    "Dec 10 07:07:38 LabSZ sshd[24206]: input_userauth_request: invalid user test9 [preauth]",
    "Dec 10 07:08:28 LabSZ sshd[24208]: input_userauth_request: invalid user webmaster [preauth]",
    "Dec 10 09:12:32 LabSZ sshd[24490]: Failed password for invalid user ftpuser from 0.0.0.0 port 62891 ssh2",
    "Dec 10 09:12:35 LabSZ sshd[24492]: Failed password for invalid user pi from 0.0.0.0 port 49289 ssh2",
    "Dec 10 09:12:44 LabSZ sshd[24501]: Failed password for invalid user ftpuser from 0.0.0.0 port 60836 ssh2",
    "Dec 10 07:28:03 LabSZ sshd[24245]: input_userauth_request: invalid user pgadmin [preauth]",
    "",
]
REQUEST = "Dec 10 <*> LabSZ <*> input_userauth_request: invalid user <*> [preauth]"
FAILED = "Dec 10 <*> LabSZ <*> Failed password for invalid user <*> from 0.0.0.0 port <*> ssh2"


def templates(drain, lines):
    return [drain.add(x.split())[0].template for x in lines]


def test_sshd():
    drain = Drain()
    assert templates(drain, SSHD) == ["", SSHD[1], REQUEST, SSHD[3], FAILED, FAILED, REQUEST, ""]
    assert drain.total_size() == 8


def test_sshd_strict():
    assert templates(Drain(sim_th=0.75), SSHD) == ["", SSHD[1], SSHD[2], SSHD[3], FAILED, FAILED, SSHD[6], ""]


@pytest.mark.parametrize(
    "most, lines, expected",
    [
        (1, ["A format 1", "A format 2", "B format 1", "B format 2", "A format 3"], ["A format 1", "A format *", "B format 1", "B format *", "A format 3"]),
        (2, ["A A A", "A A B", "B A A", "B A B", "C A A", "C A B", "B A A", "A A A"], ["A A A", "A A *", "B A A", "B A *", "C A A", "C A *", "B A *", "A A A"]),
        (2, ["A A A", "A A B", "A B A", "A B B", "A C A", "A C B", "A B A", "A A A"], ["A A A", "A A *", "A B A", "A B *", "A C A", "A C *", "A B *", "A A A"]),
    ],
)
def test_recently_used(most, lines, expected):
    assert templates(Drain(max_clusters=most, param="*"), lines) == expected


def test_match_only():
    drain = Drain()
    templates(drain, ["aa aa aa", "aa aa bb", "aa aa cc", "xx yy zz"])
    for strategy in ("never", "fallback", "always"):
        assert drain.match("aa aa tt".split(), strategy).id == 1
        assert drain.match("xx yy zz".split(), strategy).id == 2
        assert drain.match("xx yy rr".split(), strategy) is None
        assert drain.match(["nothing"], strategy) is None
    with pytest.raises(ValueError):
        drain.match([], "sometimes")


def test_updates():
    drain = Drain()
    assert [drain.add_joined(x)[1] for x in ("a b c", "a b c", "a b d", "a b e", "a b c")] == [CREATED, NONE, CHANGED, NONE, NONE]


def test_repeats_are_answered_alike():
    rng = random.Random(3)
    for trial in range(300):
        settings = dict(depth=rng.choice([3, 4, 5]), sim_th=rng.choice([0.3, 0.4, 0.7]), max_children=rng.choice([2, 3, 100]))
        plain, fast = Drain(**settings), Drain(**settings)
        full, again = FullSearch(), FullSearch()
        for _ in range(80):
            tokens = [rng.choice(["a", "b", "c", "x1", "y2", "<*>"]) for _ in range(rng.randint(0, 4))]
            a, b = plain.add(tokens), fast.add_joined(" ".join(tokens))
            assert (a[0].id, a[0].size, a[0].tokens, a[1]) == (b[0].id, b[0].size, b[0].tokens, b[1])
            again.seen.clear()
            a, b = full.add_joined(" ".join(tokens)), again.add_joined(" ".join(tokens))
            assert (a[0].id, a[0].tokens, a[1]) == (b[0].id, b[0].tokens, b[1])


def test_keys_are_exact():
    """Token count, and first token where the rule allows it, cut the fold without changing it."""
    rng = random.Random(5)
    for trial in range(200):
        children = rng.choice([3, 4, 100])
        lines = [[rng.choice("abcd") if rng.random() < 0.9 else rng.choice(["x1", "<*>"]) for _ in range(rng.randint(0, 3))] for _ in range(60)]
        whole = Drain(max_children=children)
        expected = [whole.add(x)[0].id for x in lines]
        firsts = {}
        for x in lines:
            firsts.setdefault(len(x), set()).add(x[0] if x else "")
        safe = {n for n, f in firsts.items() if n >= 2 and len(f) <= children - 1 and not any(t == "<*>" or any(c.isdigit() for c in t) for t in f)}
        parts, ids, got = {}, {}, []
        for x in lines:
            key = (len(x), x[0] if len(x) in safe else "")
            local = parts.setdefault(key, Drain(max_children=children)).add(x)[0].id
            got.append(ids.setdefault((key, local), len(ids) + 1))
        assert got == expected


def test_statistical():
    s = Statistical()
    lex = lambda x: [t for t in x.split()]
    add = lambda x: s.add_joined(x, {t: 1.0 for t in lex(x) if not t.isdigit()})
    assert [add(x) for x in ("file line 3 in foo", "file line 5 in foo", "other words 5 are here", "1 2", "1 2", "")] == [0, 0, 1, 2, 3, 4]


def test_common_runs():
    assert opcodes(["a", "b"], ["a", "b"]) == [("equal", 0, 2, 0, 2)]
    assert opcodes(["x", "a", "z"], ["x", "b", "z"]) == [("equal", 0, 1, 0, 1), ("gap", 1, 2, 1, 2), ("equal", 2, 3, 2, 3)]
    assert pair_template(["a", "b", "c"], ["a", "b"]) == "a b <*>"
    assert pair_template(["a", "<*>", "x", "b"], ["a", "<*>", "y", "b"]) == "a <*> b"


def test_bad_depth():
    with pytest.raises(ValueError):
        Drain(depth=2)
