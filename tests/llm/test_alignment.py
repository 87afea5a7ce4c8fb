"""Alignment against a plain version that walks both token lists."""

import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from helpers import docs_frame, prose
from tokenizers import Tokenizer

from gleanery.llm import alignment
from gleanery.llm.tokens import public_path

A = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
STANDS_FOR = {chr(c): c for c in (*range(33, 127), *range(161, 173), *range(174, 256))}
STANDS_FOR |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in STANDS_FOR.values())}


def tokens(text):
    """(id, start, end) of both sides, or nothing."""
    if not text:
        return [], []
    a = [(i, bytes(STANDS_FOR[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[1:-1], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return [], []
    out = []
    for side in (a, b):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def plain(rows):
    counts, links = Counter(), {}
    for n, (_, text) in enumerate(rows):
        a, b = tokens(text)
        by_end = {}
        for i, _, e in b:
            by_end.setdefault(e, []).append(i)
        links[n] = [(i, j) for i, _, e in a for j in by_end.get(e, [])]
        counts.update(links[n])
    best = {}
    for (_, j), c in counts.items():
        best[j] = max(best.get(j, 0), c)
    out = []
    for n, (doc_id, text) in enumerate(rows):
        a, b = tokens(text)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [",".join(str(i) for i, _, e in a if low < e <= high) + "|" + ",".join(str(i) for i, _, e in b if low < e <= high)
                  for low, high in zip([0, *cuts], cuts)]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links[n]), digest,
                    sum(counts[x] == best[x[1]] for x in links[n]), sum(counts[x] for x in links[n])))
    return out


TEXTS = ["plain words, and more words", "don't <s> </s> <unk> <0x41> <|endoftext|>", "▁under ▁bar", " lead  two   three\n\n\ttab \r\n", "naïve café ﬁ① 　x",
         "日本語のテキスト、中文字", "\U0001f600\U0001f468‍\U0001f469‍\U0001f467", "\x00\x01 nul", "é combining", "12345 67,890.12", "", None, "x", " "]


def test_report_equals_plain_version(spark):
    r = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, prose(i, r.randint(1, 60))) for i in range(40)]
    rows += [(300 + i, "".join(chr(r.choice([32, 65, 97, 233, 0x4e2d, 0x1f600, 10, 48])) for _ in range(80))) for i in range(20)]
    rows += [(100, prose(0, 20))] * 30 + [(None, "no id")]
    docs = docs_frame(spark, rows, extra=True)
    for name in ("links", "pair", "n_a", "groups_sha256", "count_sum"):
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    got = alignment.alignment_report(docs.repartition(4)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)
    assert tokens("▁under ▁bar") == ([], [])


def test_aligned_tokens(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for row in alignment.aligned_tokens(docs_frame(spark, rows)).collect():
        a, b = tokens(TEXTS[row["doc_id"]])
        assert (row["a_ids"], row["b_ids"]) == ([i for i, _, _ in a], [i for i, _, _ in b])
        want = [(i, j) for i, (_, s, e) in enumerate(a) for j, (_, s2, e2) in enumerate(b) if s < e2 and s2 < e]
        assert list(zip(row["overlap_a"], row["overlap_b"])) == want
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        assert row["a_groups"] == [sum(c < e for c in cuts) for _, _, e in a]
        assert row["b_groups"] == [sum(c < e for c in cuts) for _, _, e in b]


def test_coalesce_breaks_where_a_start_reaches_the_maximum():
    start, end = np.array([5, 0, 2, 5, 9, 8]), np.array([8, 4, 5, 6, 10, 9])
    order, group = alignment.coalesce(start, end)
    assert order.tolist() == [1, 2, 3, 0, 5, 4] and group.tolist() == [0, 0, 1, 1, 2, 3]


def test_long_text_and_empty_table(spark):
    long = prose(9, 120_000)
    row = alignment.alignment_report(docs_frame(spark, [(1, long), (2, " " * 300_000)])).collect()[0]
    a, b = tokens(long)
    assert (row["n_a"], row["n_b"]) == (len(a), len(b))
    assert row["n_groups"] == row["n_links"] == len({e for _, _, e in a} & {e for _, _, e in b})
    assert alignment.alignment_report(docs_frame(spark, [])).collect() == []
