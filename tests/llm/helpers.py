"""Small inputs and plain versions that the corpus tests share."""

import random
import re

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + "xx" if r.random() < share else w for w in text.split())


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def docs_frame(spark, rows, extra=False):
    """(doc_id, text) rows as documents; with ``extra``, also columns whose names operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", "src1", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(data, schema)
    if extra:
        for name in ("class", "root", "part", "size", "score", "hash", "bucket", "n", "a", "b", "node", "entries", "spans", "place"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df
