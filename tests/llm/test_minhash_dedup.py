import random

from trailnet.llm import minhash_dedup as md


def brute(rows, percent=85):
    sets = [md.shingles(md.words_of(t), 3) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for group in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(20, 150))]
        for _ in range(r.choice([1, 2, 5, 30])):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "one"), (n + 3, "One"), (n + 4, "a b"), (n + 5, " \n\t"), (n + 6, rows[0][1].upper())]
    r.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, component_id string")
    assert sorted(map(tuple, md.near_duplicates(df, block=8, per_salt=4).collect())) == brute(rows)


def test_rows_of_one_id_keep_their_own_links(spark):
    r = random.Random(8)
    a, b, c = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(26 + 4 * i)) for i, x in enumerate("abc"))
    rows = [(5, a), (5, b), (7, a + " zz"), (8, b + " zz"), (2, c), (9, b + " zz"), (5, c), (5, a), (3, b.replace(" ", "  "))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, md.near_duplicates(df).collect())) == brute(rows)
    assert {x[2] for x in brute(rows)} == {2, 3, 5}


def test_empty_table_and_null_ids(spark):
    assert md.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = md.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "A b c"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted(((x.doc_id, x.component_id, x.kept) for x in got), key=str) == [(4, 4, True), (None, 4, False), (None, None, True)]


def test_pruning_keeps_pairs_at_the_threshold():
    least = md.least_matches(85, 1e-6)
    assert least == sorted(least) and least[-1] < 0.85 * md.SIZE
