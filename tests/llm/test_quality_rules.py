import re
from collections import Counter, defaultdict

from trailnet.llm import quality_rules as qr


def brute(rows, least_docs, share, keep_share=0.5, min_words=10):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    docs, by_line = defaultdict(set), defaultdict(set)
    for d, t, s in rows:
        docs[s].add(d)
        for x in (t or "").split("\n"):
            if norm(x):
                by_line[s, norm(x)].add(d)
    out = []
    for d, t, s in rows:
        w = words(t)
        wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {i + k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        lost = sum(len(words(x)) for x in lines if len(by_line[s, norm(x)]) > least_docs and len(by_line[s, norm(x)]) > share * len(docs[s]))
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed, not failed and len(w) - lost >= max(min_words, keep_share * len(w)), lost))
    return sorted(out, key=str)


ROWS = [
    (1, "a b c d e f g h i j k\na b c d e\nCopyright 2020 by us", "s"),
    (2, "one two three four five six seven eight nine ten eleven\ncopyright  1999 by us ", "s"),
    (3, "Copyright 2021 by us\nmore words here # $ %\nmore words here # $ %", "s"),
    (4, "x x x x x x x x x x x x x x x x", None), (5, None, "s"), (6, "", None), (7, "\n\t\x0b \n", "t"),
    (8, "é ß 1 2 3 4 5 6 7 8\x0b9 \x0010", "t"), (8, "é ß 1 2 3 4 5 6 7 8\x0b9 \x0010", "t"), (8, "other", "t"), (None, "null id " * 3, "s"),
    (10, "copyright 5 by us\n" * 30, "s"), (11, " ".join(f"w{i}" for i in range(9000)), "s"),
]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, source string, key int, host int")
    for least, share in ((2, 0.1), (0, 0.0), (2, 0.9)):
        assert sorted(map(tuple, qr.apply_rules(df, least_docs=least, share=share, salts=3).collect()), key=str) == brute(ROWS, least, share)


def test_empty_table(spark):
    assert qr.apply_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
