"""Small tables with the cases every operator has to stand: nulls, empty and long texts, ties, repeated rows, odd columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, row long, score double, label long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts(seed=1):
    """(doc_id, text, source) with near and exact copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    syllables = "ka lo mi ren tu fa es on ü ß the of 7".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    passage = prose(60)
    rows = []
    for i in range(30):
        w = prose(rng.randint(1, 120))
        if i % 5 == 0:
            w = w[: len(w) // 2] + passage[rng.randint(0, 20): rng.randint(35, 60)] + w[len(w) // 2:]
        rows.append((i, " ".join(w) if i % 3 else "\n".join(w) + "\t", f"s{i % 3}" if i % 7 else None))
    for k, i in enumerate((1, 4, 7, 10)):
        w = WORD.findall(rows[i][1])
        rows.append((100 + k, rows[i][1], "s0"))
        rows.append((110 + k, " ".join([*w[:-1], "changed"]).upper(), "S0"))
        rows.append((120 + k, " ".join(["new", *w[:-1], "changed", "twice"]), "s1"))
    rows += [
        (200, None, "s0"), (201, "", None), (202, " \n\t ", "s1"), (203, "one", "s2"), (204, "one", "s2"), (205, "ONE two  three four", "s2"),
        (206, " ".join(prose(30) * 300), "s1"), (207, "x" * 5000, "s1"), (208, "idiot!! MORON? idi0t <|endoftext|> 'll 12     你好", "s0"),
        (209, rows[2][1], "s0"), (209, rows[2][1], "s0"), (None, rows[5][1], "s0"), (None, None, None),
    ]
    return rows


def table(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "word", 3, 7, 0.25, None) for i, t, s in rows], SCHEMA)
