import random
from collections import deque

from scriptsift.operators import provenance


def brute(edges):
    """Least depths by walking from every asset."""
    led = {}
    for p, a, b in edges:
        if None not in (p, a, b):
            led.setdefault((p, a), set()).add(b)
    out = {}
    for p, a in led:
        seen, queue = {}, deque([(a, 0)])
        while queue:
            x, d = queue.popleft()
            for y in led.get((p, x), ()):
                if y not in seen:
                    seen[y] = d + 1
                    queue.append((y, d + 1))
        out.update({(p, a, y): (d, (p, y) not in led) for y, d in seen.items()})
    return out


def closure(spark, edges, **options):
    frame = spark.createDataFrame(edges, "project_id long, id long, parent_id long")
    rows = provenance.import_closure(frame, **options).collect()
    out = {(r["project_id"], r["id"], r["ancestor_id"]): (r["depth"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_shapes_like_walking(spark):
    chain = [(1, i + 1, i) for i in range(70)]
    star = [(2, i, 0) for i in range(1, 90)]
    circle = [(3, i, (i + 1) % 7) for i in range(7)] + [(3, 20, 3), (3, 21, 20), (3, 22, 22)]
    odd = [(4, 1, None), (4, None, 1), (None, 1, 2), (4, 1, 2), (4, 1, 2), (5, 2, 3)]
    edges = chain + star + circle + odd
    assert closure(spark, edges) == brute(edges)


def test_several_parents_like_walking(spark):
    rng = random.Random(6)
    edges = [(p, rng.randrange(25), rng.randrange(25)) for p in range(3) for _ in range(12 + 12 * p)]
    assert closure(spark, edges) == brute(edges)


def test_depth_bound_and_rounds(spark, tmp_path):
    edges = [(1, i + 1, i) for i in range(40)]
    for most in (1, 5, 8):
        assert closure(spark, edges, max_depth=most) == {k: v for k, v in brute(edges).items() if v[0] <= most}
    folder = str(tmp_path / "rounds")
    closure(spark, edges, folder=folder)
    # 1, 2, 4, 8, 16, 32 steps, the rest, and the round that finds nothing more.
    assert len([p for p in (tmp_path / "rounds").iterdir() if p.name.startswith("round-")]) <= 8


def test_roots(spark):
    edges = [(1, 2, 1), (1, 3, 2), (1, 3, 9), (2, 1, 2), (2, 2, 1)]
    frame = spark.createDataFrame(edges, "project_id long, id long, parent_id long")
    rows = provenance.import_roots(provenance.import_closure(frame)).collect()
    assert {(r["project_id"], r["id"]): (r["root_id"], r["depth"]) for r in rows} == {(1, 2): (1, 1), (1, 3): (1, 2)}


def test_no_edges(spark):
    assert closure(spark, [(1, 1, None)]) == {}
