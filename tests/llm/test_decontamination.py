import itertools
import random
import re

from tessera.llm import decontamination as dc


def test_masks_find_every_alignment_within_the_tolerance():
    for n in range(dc.LEAST, dc.WINDOW + 1):
        subs = max(v for k, v in dc.TOLERANCE.items() if k <= n)
        for gone in itertools.combinations(range(n), subs):
            assert any(all(s + o not in gone for o in m) for m in dc.MASKS for s in range(n - m[-1])), (n, gone)


def brute(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        a, found = words(t), {}
        for i, u in items:
            b = words(u)
            if len(b) < dc.LEAST:
                continue
            w = min(dc.WINDOW, len(b))
            allowed = max(v for k, v in dc.TOLERANCE.items() if k <= w)
            best = 0
            for shift in range(-len(b), len(a) + 1):
                same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
                best = max(best, max(sum(same[s : s + w]) for s in range(len(b) - w + 1)))
            if best >= w - allowed:
                found[i] = best / w
        out[d] = (bool(found), len(found))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 5, 8, 9, 12, 15, 16, 17, 30, 55])] + [(99, None), (98, "")]
    docs = []
    for d in range(150):
        t = [rng.choice(vocab) for _ in range(rng.randrange(40))]
        if rng.random() < 0.8:
            i = rng.choice(items)[1] or ""
            p = i.split()
            for _ in range(rng.randrange(6)):
                if p:
                    p[rng.randrange(len(p))] = "zz"
            a = rng.randrange(len(t) + 1)
            t[a:a] = p[rng.randrange(3) if p else 0 :]
        docs.append((d, (" " if d % 2 else ", ").join(t).upper()))
    docs += [(500, None), (501, ""), (502, "one two")]
    want = brute(docs, items)
    assert sum(v[0] for v in want.values()) > 40 and not all(v[0] for v in want.values())
    df = spark.createDataFrame([(*x, 7) for x in docs], "doc_id long, text string, n_items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["leaked"], r["n_items"]) for r in dc.decontaminate(df, bench, "doc_id", "text").collect()}
    assert got == want
    keyed = df.selectExpr("doc_id as doc_key", "text")
    far = {(r["doc_key"], r["item_id"]) for r in dc.leaks(keyed, bench, broadcast_bytes=0).collect()}
    assert far == {(r["doc_key"], r["item_id"]) for r in dc.leaks(keyed, bench).collect()}


def test_null_keys_repeats_and_empty_tables(spark):
    text = "a b c d e f g h i j k l m n o p q"
    df = spark.createDataFrame([(None, text), (None, "clean words only here now"), (1, text), (1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, text), (4, text)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["leaked"], r["best_item"]) for r in dc.decontaminate(df, bench, "doc_id", "text").collect()), key=repr)
    assert got == [(0, False, None), (0, True, 4), (1, True, 4), (1, True, 4)]
    assert dc.decontaminate(df.limit(0), bench, "doc_id", "text").count() == 0
    assert dc.decontaminate(df, bench.limit(0), "doc_id", "text").where("leaked").count() == 0


def test_a_row_is_judged_by_its_own_text(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"x {item} y"), (1, "a clean text of some words that says nothing at all"), (None, item), (None, "another clean text of words that says nothing"), (1, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, leaked string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(r["doc_id"], r["text"]): r["leaked"] for r in dc.decontaminate(df, items, "doc_id", "text").collect()}
    assert got == {r: r[1] is not None and item in r[1] for r in rows}


def test_exchange_of_seeds(spark):
    item = " ".join("w%d" % i for i in range(40))
    docs = spark.createDataFrame([(1, f"x {item[20:110]} y"), (2, "nothing of it here at all")], "doc_key long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for most in (0, 1 << 20):
        assert [r["doc_key"] for r in dc.leaks(docs, items, broadcast_bytes=most).collect()] == [1]
