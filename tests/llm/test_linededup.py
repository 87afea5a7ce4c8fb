import hashlib

import numpy as np
import pytest
from helpers import docs_frame

from gleanery.llm.linededup import PerfectHash, dedup_lines


def plain(rows, min_chars=20, min_docs=3):
    keys = lambda t: [b.strip(b" \t\n\x0b\x0c\r").lower().decode() for b in (t or "").encode().split(b"\n")]
    held = {}
    for n, (doc_id, text) in enumerate(rows):
        for k in set(keys(text)):
            if len(k) >= min_chars:
                held.setdefault(k, []).append(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [len({i for i in held.get(k, ()) if i is not None}) + held.get(k, []).count(None) >= min_docs and max(i for i in held[k] if i is not None) != doc_id for k in keys(text)]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc_id, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


LINE, OTHER = "This line stands in many documents", "Über zwanzig Zeichen langer Satz hier"
ROWS = [(1, f"{LINE}\nown first text of this one"), (2, f"  {LINE.upper()}\t\n{OTHER}\n{LINE}"), (3, f"{LINE}\n\n{OTHER} "),
        (4, None), (5, ""), (6, "short\nshort"), (7, f"short\n{OTHER}\r\n{LINE}x"), (8, "a" * 300_000 + "\n" + LINE), (9, "short\x0bline")]


@pytest.mark.parametrize("extra", [False, True])
def test_equals_plain(spark, extra):
    out = dedup_lines(docs_frame(spark, ROWS, extra))
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == plain(ROWS)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, LINE), (1, LINE), (1, LINE), (None, OTHER), (None, OTHER), (None, OTHER)]
    got = sorted((r["doc_id"], r["text"]) if r["doc_id"] else (0, r["text"]) for r in dedup_lines(docs_frame(spark, rows)).collect())
    assert got == [(0, OTHER)] * 3 + [(1, LINE)] * 3


def test_rows_of_one_doc_id_are_one_document(spark):
    rows = [(1, LINE), (1, f"{LINE}\nmore"), (2, LINE), (3, OTHER), (3, f"{OTHER}\nx"), (4, OTHER), (4, OTHER), (5, f"y\n{OTHER}"), (None, LINE + LINE), (6, LINE + LINE), (6, LINE + LINE)]
    out = dedup_lines(docs_frame(spark, rows)).collect()
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out), key=str)
    assert got == plain(rows)
    assert [sum(r["n_dropped"] for r in out if r["doc_id"] == i) for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 2, 2, 0, 0]


def test_empty_table(spark):
    assert dedup_lines(docs_frame(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_survives_storage():
    r = np.random.default_rng(1)
    first, second = (r.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    first[:100] = 7  # equal in one half only
    index = PerfectHash.load(PerfectHash.build(first, second).dump())
    assert sorted(index.slots(first, second)) == list(range(5000))
