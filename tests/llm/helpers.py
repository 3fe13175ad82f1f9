"""Small document tables with the awkward cases, and word splitting by regular expression."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, root string"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); extra columns clash with names used inside."""
    full = []
    for r in rows:
        text = r[1]
        full.append((r[0], text, r[2] if len(r) > 2 else "en", "src0", len(text or ""), 0.5, "x"))
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sample(seed=1, n=60, vocabulary=40, most=90):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 3 else f"Ä{i}é" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(0, most)))
        rows.append((i * 3, text))
    rows += [(500, None), (501, ""), (502, " \t\n "), (503, "x"), (504, "a  b"), (505, rows[0][1]), (505, rows[0][1]), (None, rows[1][1]), (506, rows[2][1] + "\n" + rows[3][1]), (507, "long " * 3000)]
    return rows
