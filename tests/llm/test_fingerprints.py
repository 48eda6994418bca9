import hashlib
import random

import numpy as np

from tessera.llm import fingerprints as fp


def test_spans_and_extensions():
    rng = random.Random(3)
    a, b = ("".join(rng.choice("ab€") for _ in range(200)) for _ in range(2))
    x, y = fp.Text(a), fp.Text(b)
    for _ in range(400):
        i, j, n = rng.randrange(190), rng.randrange(190), rng.randrange(1, 8)
        assert (x.prefixes.span(i, min(i + n, 200)) == y.prefixes.span(j, min(j + n, 200))) == (a[i : i + n] == b[j : j + n])
        want = next((k for k in range(min(200 - i, 200 - j)) if a[i + k] != b[j + k]), min(200 - i, 200 - j))
        assert fp.common_extension(x.prefixes, i, y.prefixes, j) == want


def test_spliced_is_the_fingerprint_of_the_edited_text():
    rng = random.Random(4)
    for _ in range(120):
        a, b = ("".join(rng.choice("abcd é") for _ in range(rng.choice([0, 1, 5, 15, 16, 17, 40, 300]))) for _ in range(2))
        got = fp.compared(fp.Text(a), fp.Text(b))
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert got["edited_mark"] == fp.Text(edited).whole()
        assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got["near_edited"] <= 1 and got["mark"] == fp.Text(a).whole()


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(1)
    common, own, other = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (4000, 2000, 2000))
    near = fp.likeness(fp.sketch(np.concatenate([common, own])), fp.sketch(np.concatenate([common, other])))
    assert abs(near - 0.5) < 0.25
    assert fp.likeness(fp.sketch(own), fp.sketch(other)) < 0.1 and fp.likeness(fp.sketch(own), fp.sketch(own)) == 1


def test_neighbours_in_ranges(spark):
    rng = random.Random(5)
    rows = [(i * 3, "".join(rng.choice("abc ") for _ in range(rng.choice([0, 3, 60])))) for i in range(57)] + [(None, "last"), (6, None)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, part string").repartition(5)
    got = fp.neighbours(df, "doc_id", "text", 6).collect()
    order = sorted((r for r in rows if r[0] is not None and r != (6, None)), reverse=True) + [(None, "last")]
    want = {}
    for (k, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        want[k] = hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    assert len(got) == len(rows)
    for r in got:
        if r["key"] not in (6, 9):
            assert r["edited_sha256"] == want[r["key"]], r["key"]
    # two rows share key 6: between 9 and 3 they stand in one order or the other, one after the other
    text = dict(r for r in rows if r != (6, None))
    edit = lambda t, u: hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    chains = [[(9, edit(text[9], p)), (6, edit(p, q)), (6, edit(q, text[3]))] for p, q in ((text[6], ""), ("", text[6]))]
    assert sorted((r["key"], r["edited_sha256"]) for r in got if r["key"] in (6, 9)) in [sorted(c) for c in chains]
    one = fp.neighbours(df.where("doc_id = 3"), "doc_id", "text", 3).collect()
    assert one[0]["near_next"] == 1.0
    assert fp.neighbours(df.limit(0), "doc_id", "text", 3).count() == 0
