import itertools
import random

import pytest

from gleanery.llm.chat import INSERT, LEGAL, MERGE, RELABEL, START, UNKNOWN, closing, repair_roles, role_number, segment_costs, segment_path

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_cost(roles):
    """Every labelling and every choice of merge and empty turn, by brute force."""
    best = None
    for labels in itertools.product(range(3), repeat=len(roles)):
        for joins in itertools.product(("keep", "merge", 0, 1, 2), repeat=len(roles)):
            cost, state = 0, START
            for given, role, join in zip(roles, labels, joins):
                cost += 0 if given == role else UNKNOWN if given is None else RELABEL
                if join == "merge":
                    ok, cost = role == state, cost + MERGE
                elif join == "keep":
                    ok = role in LEGAL[state]
                else:
                    ok, cost = join in LEGAL[state] and role in LEGAL[join], cost + INSERT
                if not ok:
                    break
                state = role
            else:
                cost += closing(state)[0]
                best = cost if best is None or cost < best else best
    return best


def path_cost(roles, path):
    cost, state = 0, START
    for given, (role, action, empty) in zip(roles, path):
        cost += 0 if given == role else UNKNOWN if given is None else RELABEL
        cost += MERGE if action == "merge" else INSERT if empty is not None else 0
        assert role == state if action == "merge" else role in LEGAL[state if empty is None else empty] and (empty is None or empty in LEGAL[state])
        state = role
    return cost + closing(state)[0]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_path_is_the_cheapest(n):
    r = random.Random(n)
    for _ in range(6 if n == 4 else 25):
        roles = [r.choice([None, 0, 1, 2]) for _ in range(n)]
        costs = segment_costs(roles)[4 * START:]
        wanted = plain_cost(roles)
        assert min(c + closing(s)[0] for s, c in enumerate(costs)) == wanted
        assert path_cost(roles, segment_path(roles, START, None)) == wanted


def rows():
    r, out = random.Random(8), []
    for conv in range(40):
        out += [(conv, t, r.choice(["user", "assistant", "system", "User ", "bot", None]), f"text {conv} {t}") for t in range(r.randrange(1, 9))]
    out += [(99, t, ("user", "assistant", "user")[t % 3], f"long {t}") for t in range(3000)]
    out += [(None, 1, "user", None), (None, None, "system", ""), (98, 1, "user", "same"), (98, 1, "user", "same"), (97, 0, "user", "x" * 300_000)]
    return out


@pytest.mark.parametrize("slices", [1, 13])
def test_slices_change_nothing(spark, slices):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as slice", "1 as entry", "1 as costs", "1 as action")
    got = {}
    for x in repair_roles(df, slices).collect():
        got.setdefault(x["conv_id"], []).append(x)
    assert sum(map(len, got.values())) == len(data)
    first = lambda v: (v is not None, v if v is not None else 0)
    for conv, turns in got.items():
        given = sorted((d for d in data if d[0] == conv), key=lambda d: (first(d[1]), (d[2] is not None, d[2] or ""), (d[3] is not None, d[3] or "")))
        roles = [role_number(d[2]) for d in given]
        turns.sort(key=lambda x: (first(x["turn"]), (x["role"] is not None, x["role"] or "")))
        path = [(role_number(x["new_role"]), "merge" if "merge" in x["action"] else "keep", None if x["empty_before"] is None else role_number(x["empty_before"])) for x in turns]
        assert path_cost(roles, path) == min(c + closing(s)[0] for s, c in enumerate(segment_costs(roles)[4 * START:]))
        if len(given) < 10 and conv is not None:
            text = "".join(x["rendered"] for x in turns)
            assert text.count("<|im_start|>") == text.count("<|im_end|>") and text.endswith("<|im_end|>\n")
            marks = [role_number(p.split("\n")[0]) for p in text.split("<|im_start|>")[1:]]
            assert all(b in LEGAL[a] for a, b in zip([START, *marks], marks))


def test_rendering(spark):
    data = [(1, 0, "assistant", "hi"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c")]
    turns = repair_roles(spark.createDataFrame(data, SCHEMA)).orderBy("turn").collect()
    assert "".join(x["rendered"] for x in turns) == ("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user\na\nb<|im_end|>\n"
                                                      "<|im_start|>assistant\nc<|im_end|>\n")
    assert repair_roles(spark.createDataFrame([], SCHEMA)).count() == 0
