from __future__ import annotations

from pulsegrid.sources.collections import comment_tree


def test_threads_deeper_than_the_sessions_limits(spark):
    rows = [(1, i, i - 1 if i else None, 0) for i in range(7)]
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "3")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "3")
    tree = comment_tree(spark.createDataFrame(rows, "post int, id int, parent_id int, ord int").coalesce(1))
    assert sorted(r["depth"] for r in tree.collect()) == list(range(7))


def test_threads_of_several_posts_in_depth_first_order(spark):
    rows = [(p, i, (i - 1) // 2 if i else None, i) for p in (1, 2) for i in range(15)] + [(3, 1, 2, 0), (3, 2, 1, 0)]  # post 3 is a circle
    got = {(r["post"], r["id"]): (r["depth"], r["place"]) for r in comment_tree(spark.createDataFrame(rows, "post int, id int, parent_id int, ord int")).collect()}
    order: list = []

    def walk(i, d):
        order.append((i, d))
        for c in (2 * i + 1, 2 * i + 2):
            if c < 15:
                walk(c, d + 1)

    walk(0, 0)
    assert got == {(p, i): (d, k + 1) for p in (1, 2) for k, (i, d) in enumerate(order)}


def test_a_deep_thread_and_lost_parents(spark):
    """A chain of 300 takes some ten rounds; comments below a circle or a missing parent have no root."""
    rows = [(1, i, i - 1 if i else None, i % 3) for i in range(300)] + [(2, 0, None, 1), (2, 9, None, 0), (2, 1, 0, 2), (2, 2, 0, 1), (2, 3, 77, 0), (2, 4, 3, 0)] + [(3, 1, 2, 0), (3, 2, 3, 0), (3, 3, 1, 0), (3, 4, 1, 0)]
    got = {(r["post"], r["id"]): (r["depth"], r["place"]) for r in comment_tree(spark.createDataFrame(rows, "post int, id int, parent_id int, ord int")).select("post", "id", "depth", "place").collect()}
    assert got == {(1, i): (i, i + 1) for i in range(300)} | {(2, 9): (0, 1), (2, 0): (0, 2), (2, 2): (1, 3), (2, 1): (1, 4)}
    assert comment_tree(spark.createDataFrame([], "post int, id int, parent_id int, ord int")).collect() == []
