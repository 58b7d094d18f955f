import random
import re

from textquarry.llm import leaks


def brute(docs, items, run):
    cut = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    grams = {}
    for i, t in items:
        w = cut(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = cut(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ()) if d is not None and i is not None}
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(9)] + ["İstanbul", "é", "x_y", "naïve", "ß"]
    items = [(i, r.choice([" ", "\n"]).join(r.choice(words) for _ in range(r.randrange(3, 14)))) for i in range(40)]
    items += [(90, items[0][1]), (91, None), (None, items[1][1]), (92, ""), (0, items[0][1])]
    docs = []
    for d in range(150):
        parts = [r.choice(words) for _ in range(r.randrange(0, 25))]
        if r.random() < 0.7:
            own = re.findall(r"\S+", r.choice(items[:40])[1])
            s = r.randrange(len(own))
            parts[3:3] = own[s : s + r.randrange(4, 14)]
        sep = r.choice([" ", "\n\n", " -- ", "_", "*"])
        docs.append((d, sep.join(w.upper() if r.random() < 0.2 else w for w in parts), d))
    docs += [(200, None, 1), (None, items[0][1], 1), (201, "", 1), (202, items[0][1] * 300, 1), (202, items[0][1] * 300, 1)]
    dd = spark.createDataFrame(docs, "doc_id long, text string, item_id long").repartition(3)
    ii = spark.createDataFrame(items, "item_id long, text string")
    for chars in (8_000_000, 300):
        monkeypatch.setattr(leaks, "ITEMS_CHARS", chars)
        for run in (5, 7):
            rows = leaks.leaked_items(dd, ii, run).collect()
            assert len(rows) == len(set(rows)) and {tuple(x) for x in rows} == brute([d[:2] for d in docs], items, run)
    assert leaks.leaked_items(dd.limit(0), ii).count() == leaks.leaked_items(dd, ii.limit(0)).count() == 0
