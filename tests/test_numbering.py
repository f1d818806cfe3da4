"""Numbers and neighbours across part edges against a plain count."""

import random
import re

import pytest

from folioworks.operators import navigation as N
from folioworks.operators.numbering import numbered


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 7), (4, 40)])
def test_numbered(spark, seed, parts):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "hot", "z"]
    rows = [(rng.choice(names) if rng.random() < 0.5 else "hot", rng.choice([None, *range(60)]), i) for i in range(rng.choice([3, 150, 700]))]
    got = numbered(spark.createDataFrame(rows, "g string, k int, v int").repartition(5), ["g"], ["k", "v"], "numbers", beside=("v", "k"), parts=parts).collect()
    first = lambda x: (x is not None, x if x is not None else 0)
    want = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), first(r[1]), r[2]))
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, g or ""))
    got.sort(key=lambda r: r["rank"])
    assert [(r.g, r.k, r.v) for r in got] == want and [r["rank"] for r in got] == list(range(len(rows)))
    for i, r in enumerate(got):
        same = [j for j, x in enumerate(want) if x[0] == r.g]
        assert r.group_no == groups.index(r.g) and r.place == i - same[0] and r.group_size == len(same)
        before, after = (want[i - 1] if i > same[0] else (None,) * 3), (want[i + 1] if i < same[-1] else (None,) * 3)
        assert (r.before_v, r.before_k, r.after_v, r.after_k) == (before[2], before[1], after[2], after[1])


def test_numbered_spreads_one_group_and_takes_none(spark):
    rows = spark.range(20_000).selectExpr("'one' AS g", "id")
    got = numbered(rows, ["g"], ["id"], "one", parts=8)
    assert got.where("place = id AND rank = id AND group_no = 0 AND group_size = 20000").count() == 20_000
    assert numbered(rows.where("id < 0"), ["g"], ["id"], "none").count() == 0
    assert numbered(rows.limit(1), ["g"], ["id"], "single", beside=("id",)).first().after_id is None


def test_navigation_of_one_large_archive(spark):
    """An archive with nearly all documents beside small ones: what the whole list gives."""
    names = [f"/d{i % 7}/p{i}.htm" for i in range(3000)]
    entries = spark.createDataFrame([("hot", n, i) for i, n in enumerate(names)] + [("s", "/b10.htm", 1), ("s", "/b9.htm", 2), ("s", "/x.css", 3)], "archive_id string, path string, entry_seq int").repartition(6)
    docs = N.doc_paths(entries)
    natural = lambda x: [(int(p), "") if p.isdigit() else (-1, p) for p in re.findall(r"[0-9]+|[^0-9]+", x)]
    want = [("hot", i, n) for i, n in enumerate(sorted(names, key=natural))] + [("s", 0, "/b9.htm"), ("s", 1, "/b10.htm")]
    assert sorted(map(tuple, docs.collect())) == sorted(want)
    toc = spark.createDataFrame([("hot", i, f"n{i}", names[-i - 1].upper()) for i in range(0, 900, 2)] + [("s", 0, "g", None)], "archive_id string, pos int, name string, local string")
    spine = N.reading_order(toc, docs)
    listed = {x.lower() for x in names[-1:-901:-2]}
    order = [names[-i - 1].upper() for i in range(0, 900, 2)] + [n for _, _, n in want if n in names and n not in listed]
    assert [r.path for r in spine.where("archive_id = 'hot'").orderBy("position").collect()] == order
    nav = N.spine_nav(N.toc_labels(spine, toc)).where("archive_id = 'hot'").orderBy("position").collect()
    assert [(r.prev_path, r.path, r.next_path) for r in nav] == list(zip([None, *order], order, [*order[1:], None]))
    assert nav[-1].percent == 100 and nav[0].chapters == len(order) and nav[1].prev_label == "n0"
