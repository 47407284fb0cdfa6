"""Small document tables with what makes trouble: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _row string, severity string, part int, key string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents():
    rng = random.Random(5)
    texts = [words(rng, rng.choice((1, 3, 4, 5, 6, 9, 30, 80, 200))) for _ in range(40)]
    texts += [None, "", "   \n\t ", texts[3], texts[3], texts[20], "one", "Zwei  Wörter hier – 漢字 🙂", words(rng, 6000)]
    base = words(rng, 120).split(" ")
    for i in range(12):  # near copies, some of them only through others
        own = list(base)
        for j in range(i):
            own[(7 * j) % len(own)] = f"changed{j}"
        texts.append(" ".join(own))
    texts += [t.upper() for t in texts[50:53]]
    boiler = "All rights reserved by the shop"
    texts = [t + "\n" + boiler if t and (i % 3 == 0 or i % 4 == 0) else t for i, t in enumerate(texts)]
    rows = [(i * 3, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"src{i % 6}", len(t or ""), i, "r", "s", i, "k") for i, t in enumerate(texts)]
    return rows + [rows[4], rows[30]]  # repeated rows
