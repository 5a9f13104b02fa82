import hashlib
import math

import numpy as np
import pytest

from priceboard.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, k=16, rounds=6, scale=4096):
    """vec_id -> (code, error, label_error), and the books' hash; plain integers."""
    ok = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(scale * float(np.float32(x))) for x in r[1]] for r in ok]
    if not ok:
        return [], None
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    order = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, ok[i][1]))[:k]
    books = [[list(cut[i][p]) for i in order] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        who = [[near(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for j in range(len(order)):
                own = [c[p] for c, a in zip(cut, who) if a[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for r, e in zip(ok, errors):
        total[r[2]] = total.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{j:02x}" for _, j in f), e, total[r[2]]) for r, f, e in zip(ok, found, errors)], sha


def run(spark, rows):
    got = vc.coded(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2])
    return sorted(((r["id"], r["code"], r["error"], r["label_error"]) for r in got), key=key), {r["codebooks_sha256"] for r in got}, key


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.2, (5, 16))
    rows = [(int(i), (centres[i % 5] + rng.normal(0, 0.03, 16)).astype(np.float32).tolist(), None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(120)]
    rows += [rows[5], rows[5], (300, None, 1), (301, [None] * 16, 1), (302, [float("nan")] * 16, 2), (303, [float("inf")] + [0.0] * 15, 2), (304, [], 0), (None, [0.1] * 16, None)]
    want, sha = brute(rows)
    got, shas, key = run(spark, rows)
    assert got == sorted(want, key=key) and shas == {sha}


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.25, -0.25] * 4, i % 2) for i in range(40)]
    for rows in (same, same[:3], [(1, [float(i) for i in range(8)], None)]):
        want, sha = brute(rows)
        got, shas, key = run(spark, rows)
        assert got == sorted(want, key=key) and shas == {sha}
    assert run(spark, [])[0] == [] and run(spark, [(1, None, 1)])[0] == []


@pytest.mark.parametrize("k, d, kind", [(16, 8, "clusters"), (200, 4, "clusters"), (256, 8, "ties"), (64, 2, "ties"), (300, 8, "large"), (1, 3, "ties")])
def test_tree_finds_the_nearest_with_the_lowest_number(k, d, kind):
    rng = np.random.default_rng(k)
    if kind == "clusters":
        c = rng.integers(-3000, 3000, (6, d))
        e, q = (np.concatenate([c[rng.integers(0, 6, n)] + rng.integers(-60, 60, (n, d))]) for n in (k, 2000))
    elif kind == "ties":
        e, q = rng.integers(-2, 3, (k, d)), rng.integers(-3, 4, (2000, d))
    else:
        e, q = (rng.integers(-(10**8), 10**8, (n, d)) for n in (k, 2000))
    who, d2, work = vc.nearest(vc.gnat(e), e, q)
    all2 = ((q[:, None, :].astype(object) - e[None].astype(object)) ** 2).sum(axis=2).astype(np.int64)
    assert (who == all2.argmin(axis=1)).all() and (d2 == all2.min(axis=1)).all()
    assert work <= k * len(q)
    if (k, kind) == (200, "clusters"):
        assert work < 0.5 * k * len(q)  # whole subtrees are left out


def test_ranges_hold_all_that_lies_below():
    rng = np.random.default_rng(4)
    e = rng.integers(-50, 50, (300, 3))

    def under(node):
        return [] if node is None else [x for s, c in zip(node.splits, node.below) for x in [s, *under(c)]]

    def visit(node):
        if node is None:
            return
        for i, s in enumerate(node.splits):
            for j, c in enumerate(node.below):
                for x in [node.splits[j], *under(c)]:
                    far = math.sqrt(((e[s] - e[x]) ** 2).sum())
                    assert node.low[i, j] <= far <= node.high[i, j]
        for c in node.below:
            visit(c)

    tree = vc.gnat(e)
    visit(tree)
    assert sorted(under(tree)) == sorted(set(under(tree))) and len({tuple(e[x]) for x in under(tree)}) == len({tuple(x) for x in e})


def test_bad_shapes_and_clashing_names(spark):
    for rows in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)]):
        with pytest.raises(ValueError, match="components"):
            vc.coded(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(Exception, match="64 bits"):
        vc.coded(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA))
    clash = spark.createDataFrame([(i, [i / 9.0] * 8, 1, "x", 5, 2) for i in range(20)], "vec_id long, embedding array<float>, label int, code string, __id int, part int")
    assert vc.coded(clash).count() == 20


def test_decoded_vectors_have_the_error_that_is_reported(spark):
    rng = np.random.default_rng(2)
    rows = vc.kept_vectors(spark.createDataFrame([(i, rng.normal(0, 0.1, 16).tolist(), 0) for i in range(60)], "vec_id long, embedding array<double>, label int"), "vec_id", "embedding")
    books = vc.fit(rows)
    got = {r["__id"]: r for r in vc.decode(vc.encode(rows, books), books).collect()}
    for r in rows.collect():
        x = np.floor(np.array(r["__vec"]) * 4096)
        assert int(((x - np.array(got[r["__id"]]["approximate"]) * 4096) ** 2).sum()) == got[r["__id"]]["error"]
