import random
import re

from pyspark.sql import functions as F

from weftline.llm.components import connected_components
from weftline.llm.decontaminate import contaminated_windows, decontaminated
from weftline.llm.jaccard_join import jaccard_components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus():
    draw = random.Random(11)
    vocab = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    own = lambda n: [draw.choice(vocab) for _ in range(n)]
    rows, line = [], own(15)
    for f in range(6):
        seed = own(draw.choice([12, 40, 90]))
        for _ in range(30):
            text = list(seed)
            for _ in range(draw.randint(0, 3)):
                text[draw.randrange(len(text))] = draw.choice(vocab)
            rows.append(" ".join(text))
    rows += [" ".join(own(draw.randint(1, 60)) + line * draw.randint(0, 1)) for _ in range(150)]
    rows += ["", None, " \n ", "one", "One", "one two", "one two three", "one two three"] + [" ".join(own(3000))]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_components_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "h": F.lit(2), "token": F.lit("x"), "comp": F.lit(0)})
    for k, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df.repartition(7), k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_join_edges(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (9, "A B c d e"), (None, "a")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(twice).collect()), key=str) == [(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 1, None)]


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}


def windows_by_hand(docs, items):
    plain = lambda t: re.sub(r"[^\w\s]|_", "", (t or "").lower()).split()
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = set()
    for i, text in docs:
        words = plain(text)
        for item, t in items:
            b = grams(plain(t))
            for at in range(max(1, len(words) - len(plain(t)) + 1)) if b else ():
                a = grams(words[at : at + len(plain(t))])
                both = sum(min(a.count(x), b.count(x)) for x in set(a))
                if a and both / (len(a) + len(b) - both) >= 0.8:
                    out.add((i, item))
    return out


def test_leaks_against_all_windows(spark):
    draw = random.Random(2)
    vocab = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    own = lambda n: [draw.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(own(n))) for i, n in enumerate((15, 20, 33, 57, 60, 4))] + [(6, None), (7, "la " * 30)]
    docs = [(i, " ".join(own(draw.randint(0, 80)))) for i in range(40)]
    for i in range(60):
        passage = items[i % 5][1].split()
        for _ in range(i % 3):
            passage[draw.randrange(len(passage))] = draw.choice(vocab)
        docs.append((100 + i, " ".join(own(draw.randint(0, 50))) + ",\n" + " ".join(passage).upper() + ". " + " ".join(own(draw.randint(0, 50)))))
    docs += [(300, None), (301, ""), (302, "la " * 40), (303, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"m": F.lit(0), "w": F.lit(1)})
    b = spark.createDataFrame(items, "item_id long, text string")
    found = contaminated_windows(d, b)
    want = windows_by_hand(docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 30
    kept = {r.doc_id for r in decontaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert contaminated_windows(none, b).count() == 0
    assert contaminated_windows(d, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminated(d.unionByName(d), b).count() == 2 * len(kept)


def test_leaks_of_clashing_and_null_ids(spark):
    draw = random.Random(9)
    own = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    one, two = own(30), own(12)
    items = spark.createDataFrame([(1, one), (1, two), (None, own(20))], "item_id long, text string")
    docs = [(5, own(10) + " " + one), (5, own(40)), (6, two + " " + two + " " + own(3)), (None, one), (None, own(30)), (7, own(3000) + " " + one)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit(1), "doc": F.lit(2), "start": F.lit(3), "fp": F.lit(4)})
    found = {(r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 6)) for r in contaminated_windows(df, items).collect()}
    assert found == {(5, 1, 10, 30, 1.0), (6, 1, 0, 12, 1.0), (None, 1, 0, 30, 1.0), (7, 1, 3000, 30, 1.0)}
    out = decontaminated(df, items)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(5, docs[1][1]), (0, docs[4][1])])


def test_leaks_in_another_order(spark):
    draw = random.Random(4)
    own = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    items, docs = [], []
    for i, n in enumerate((100, 80, 120, 100)):
        words = own(n)
        items.append((i, " ".join(words)))
        for j, cut in enumerate((n // 2, n // 3, n // 4)):
            docs.append((10 * i + j, " ".join(own(20 * j) + words[cut:] + words[:cut] + own(30))))
        docs.append((10 * i + 8, " ".join(own(9) + words[n // 2 :] + own(40) + words[: n // 2])))
        docs.append((10 * i + 9, " ".join(words[n // 2 :] + words[: n // 2 - 4])))
    docs += [(docs[0][0], docs[4][1]), (90, " ".join(own(3)))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = windows_by_hand(docs, items)
    assert {(r.doc_id, r.item_id) for r in contaminated_windows(d, b).collect()} == want and len(want) > 12
    assert (0, 0) in want and (8, 0) not in want


def test_copies_of_items_and_texts_are_compared_once(spark, monkeypatch):
    from weftline.llm import decontaminate as D

    draw, rows, staged = random.Random(6), {}, D.stage
    own = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    items = [own(20), own(30)]
    docs = [own(10) + " " + items[0], own(50), items[1] + " " + own(5), items[1] + " " + own(5)]
    monkeypatch.setattr(D, "stage", lambda df, name: rows.__setitem__(name, (out := staged(df, name)).count()) or out)
    counts = []
    for n, wide in ((1, 100_000), (4, 100_000), (4, 0)):
        monkeypatch.setattr(D, "MAX_WIDE", wide)
        d = spark.createDataFrame([(100 * k + i, t) for k in range(n) for i, t in enumerate(docs)], "doc_id long, text string")
        b = spark.createDataFrame([(100 * k + i, t) for k in range(n) for i, t in enumerate(items)], "item_id long, text string")
        found = {(r.doc_id, r.item_id, r.start) for r in contaminated_windows(d, b).collect()}
        assert found == {(100 * k + i, 100 * j + m, at) for k in range(n) for j in range(n) for i, m, at in ((0, 0, 10), (2, 1, 0), (3, 1, 0))}
        counts.append({k: v for k, v in rows.items() if k != "item-names"})
    assert counts[0] == counts[1] == counts[2], "the copies cost no work of their own"
