import random
import re

from trailnet.llm import decontamination as dc


def words(t):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").lower())


def brute(docs, items, share, least):
    out = []
    for doc, text in docs:
        w, found = words(text), set()
        for item, own in items:
            x = words(own)
            for d in range(-len(x) + 1, len(w)):
                a, b = max(0, -d), min(len(x), len(w) - d)
                eq = [x[i] == w[i + d] for i in range(a, b)]
                if not any(all(eq[i + k] for k, c in enumerate(m) if c == "1") for m in dc.MASKS for i in range(len(eq) - len(m) + 1)) and not (len(eq) == len(x) < 6 and all(eq)):
                    continue
                score, s, e = max(((sum(1 if v else -dc.PENALTY for v in eq[i:j]), -j, i, j) for i in range(len(eq)) for j in range(i + 1, len(eq) + 1)))[0], None, None
                best = next((i, j) for j in range(1, len(eq) + 1) for i in range(j) if sum(1 if v else -dc.PENALTY for v in eq[i:j]) == score)
                n = sum(eq[best[0] : best[1]])
                if n >= max(min(least, len(x)), -(-share * len(x) // 1)):
                    found.add(item)
        out.append((doc, bool(found), sorted(found)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(4)
    vocab = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([5, 6, 9, 20, 40])))) for i in range(12)]
    docs = []
    for i in range(60):
        t = [r.choice(vocab) for _ in range(r.choice([0, 3, 30, 120]))]
        if i % 2:
            own = r.choice(items)[1].split()
            own = own[: r.randint(max(1, len(own) // 3), len(own))]
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = "other"
            at = r.randint(0, len(t))
            t[at:at] = own
        docs.append((i, ", ".join(t).upper() if i % 3 else "\n".join(t)))
    return docs + [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (None, items[4][1])], items


def test_matches_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, key int, item_id int")
    b = spark.createDataFrame([(*x, "z") for x in items] + [(None, None, None), (50, "", None)], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.contaminated, list(r.item_ids)) for r in dc.decontaminate(d, b, 0.5, 8).collect()), key=str)
    assert got == brute(docs, items, 0.5, 8)
    assert 10 < sum(x[1] for x in got) < len(got)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(d, b).count() == 0
    assert dc.decontaminate(spark.createDataFrame([(1, "a b c d e f g")], d.schema), b).first().contaminated is False


def test_short_items_long_texts_and_long_items(spark):
    r = random.Random(6)
    filler = " ".join(f"f{r.randint(0, 10**6)}" for _ in range(60_000))
    long = " ".join(f"g{i}" for i in range(400))
    d = spark.createDataFrame([(1, "A quick brown fox jumps, again"), (2, "quick brown fox"), (3, f"{filler} quick brown fox jumps {filler}"), (4, "x " + " ".join(long.split()[100:145])), (5, "x " + " ".join(long.split()[100:130]))], "doc_id long, text string")
    b = spark.createDataFrame([(7, "quick brown fox jumps"), (8, long)], "item_id long, text string")
    assert {x.doc_id: list(x.item_ids) for x in dc.decontaminate(d, b).collect()} == {1: [7], 2: [], 3: [7], 4: [8], 5: []}
