"""Packing: plans against their counts, rows against a plain cut of each document, the packed ids themselves."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs_frame, prose
from tokenizers import Tokenizer

from gleanery.llm import packing
from gleanery.llm.tokens import ByteLevel, public_path

PATH = public_path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def filled(plan):
    out, sequences = Counter(), 0
    for times, pattern in plan:
        sequences += times
        for length, copies in pattern:
            out[length] += times * copies
    return {k: v for k, v in out.items() if v}, sequences


def greedy(counts, size):
    """Plain best fit, one piece after the other."""
    gaps = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= length
        else:
            gaps.append(size - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    r = random.Random(seed)
    size = r.choice([7, 40, 100])
    counts = {r.randint(1, size): r.randint(1, 30) for _ in range(r.randint(1, 40))}
    plan = packing.plan_packing(counts, size)
    got, sequences = filled(plan)
    assert got == counts
    assert all(times > 0 and sum(length * c for length, c in pattern) <= size for times, pattern in plan)
    assert -(-sum(k * v for k, v in counts.items()) // size) <= sequences <= greedy(counts, size) + max(1, sequences // 20)
    left = [counts.get(i, 0) for i in range(size + 1)]
    assert all(sum(length * c for length, c in p) == size for _, p in packing.exact_fills(left, size))


def test_exact_complements_of_up_to_four():
    assert filled(packing.plan_packing({10: 5, 6: 5, 4: 5}, 10)) == ({10: 5, 6: 5, 4: 5}, 10)
    assert filled(packing.plan_packing({7: 2, 5: 2, 4: 2, 2: 2}, 18))[1] == 2
    assert filled(packing.plan_packing({5: 8}, 10))[1] == 4
    assert packing.plan_packing({}, 10) == []


def test_plans_of_many_equal_pieces_stay_small():
    counts = {i: 10**9 + i for i in range(1, 1025)}
    plan = packing.plan_packing(counts)
    got, sequences = filled(plan)
    assert got == counts and len(plan) < 20_000
    assert sequences <= 1.001 * sum(k * v for k, v in counts.items()) / 1024


def check(rows, texts, size, end=2):
    """Rows of (doc_id, text) pairs with distinct ids."""
    places, by_doc = defaultdict(list), defaultdict(list)
    for row in rows:
        places[row["sequence_id"]].append((row["offset"], row["length"]))
        by_doc[row["doc_id"]].append(row)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    assert set(by_doc) == set(texts)
    for doc_id, mine in by_doc.items():
        ids = TOKENIZER.encode(texts[doc_id] or "", add_special_tokens=False).ids + [end]
        mine.sort(key=lambda x: x["piece"])
        assert [x["piece"] for x in mine] == list(range(-(-len(ids) // size)))
        assert [x["length"] for x in mine][1:] == [size] * (len(mine) - 1)
        at = 0
        for x in mine:
            assert x["start"] == at
            assert x["ids_crc32"] == zlib.crc32(np.array(ids[at:at + x["length"]], dtype="<u4").tobytes())
            at += x["length"]
        assert at == len(ids)
    return len(places)


def test_rows_and_sequences(spark):
    r = random.Random(1)
    texts = {i: prose(i, r.randint(0, 300)) for i in range(200)}
    texts |= {900: None, 901: "", 902: "<|endoftext|> a <|endoftext|>", 903: prose(3, 60_000), 904: " " * 400_000, 905: "é\U0001f600\x00" * 50}
    texts |= {1000 + i: prose(7, 40) for i in range(150)}
    docs = docs_frame(spark, texts.items(), extra=True)
    for name in ("piece", "length", "ids", "number", "rank", "sequence_id", "offset"):
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    packed = packing.pack(docs.repartition(5), size=256, with_ids=True)
    rows = packed.collect()
    n = check(rows, texts, 256)
    assert n <= 1.02 * sum(x["length"] for x in rows) / 256 + 1
    seen = 0
    for s in packing.sequences(packed).collect():
        assert len(s["ids"]) <= 256
        for doc_id, a, b in zip(s["doc_ids"], s["offsets"], [*s["offsets"][1:], len(s["ids"])]):
            match = next(x for x in rows if x["sequence_id"] == s["sequence_id"] and x["offset"] == a)
            assert (match["doc_id"], match["length"], match["ids"]) == (doc_id, b - a, s["ids"][a:b])
            seen += 1
    assert seen == len(rows)


def test_repeated_rows_and_empty_tables(spark):
    docs = docs_frame(spark, [(1, prose(1, 30))] * 500 + [(None, "a"), (2, None)])
    rows = packing.pack(docs, size=128).collect()
    assert len(rows) == 502 and len({(x["sequence_id"], x["offset"]) for x in rows}) == 502
    assert packing.pack(docs_frame(spark, [])).collect() == []


def test_tokenizers_agree():
    fast = ByteLevel(PATH, special=True)
    assert fast.fast is not None
    marks = [chr(c) for c in (*range(1, 0x600), *range(0x2000, 0x2100), *range(0x3000, 0x3100), 0x1f600, 0xfeff, 0x85, 0xa0)]
    for text in [f"a{c}1 {c}b!{c}{c} {c}  {c}" for c in marks] + ["don't we'LL <|endoftext|>'s", "x" * 5000, "\r\n\t " * 99]:
        assert fast.ids(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    plain = ByteLevel(PATH, special=False).ids("<|endoftext|>").tolist()
    assert 50256 not in plain and b"".join(fast.pieces[i] for i in plain) == b"<|endoftext|>"
