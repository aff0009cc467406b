import random

import pytest

from fotoloom.llm import grouping


def find(parent, x):
    parent.setdefault(x, x)
    while parent[x] != x:
        x = parent[x]
    return x


def union(pairs):
    parent = {}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in list(parent)}


def test_groups_are_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(7, 7), (2000, 2000), (3, 3)]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in pairs + pairs[:10] + [(None, 5), (5, None), (None, None)]], "x bigint, y bigint, u int, group_id string")
    got = {r.id: r.group_id for r in grouping.low_diameter_groups(df, "x", "y").collect()}
    want = union(pairs)
    assert got == want and len(got) == len(want)


def test_no_links(spark):
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert grouping.low_diameter_groups(none, "a", "b").count() == 0


def hashes(seed, n=40, short=True):
    rng = random.Random(seed)
    out, i = [], 0
    for _ in range(n):
        digits = rng.choice([64, 64, 64, 16]) if short else 64
        base = rng.getrandbits(4 * digits)
        for _ in range(rng.randrange(1, 5)):
            v = base
            for _ in range(rng.randrange(0, 9)):
                v ^= 1 << rng.randrange(4 * digits)
            out.append((i, f"{v:0{digits}x}"))
            i += 1
    return out


def brute(rows, most):
    ints = {i: int(h.ljust(64, "0"), 16) for i, h in rows}
    return union([(i, j) for i in ints for j in ints if i < j and (ints[i] ^ ints[j]).bit_count() <= most])


@pytest.mark.parametrize("bucket", [2048, 3])
def test_near_hash_groups_are_brute_force(spark, monkeypatch, bucket):
    """With a tiny bucket all the ways of dividing hot buckets are taken."""
    monkeypatch.setattr(grouping, "BUCKET_ROWS", bucket)
    rows = hashes(2)
    written = [(i, [h, h.upper(), f" 0X{h}\n", f"\t{h} "][i % 4], "x", 1, 2) for i, h in rows]
    bad = [(9001, None), (9002, ""), (9003, "-"), (9004, "none"), (9005, "f" * 65), (9006, "0x"), (9007, "xyz"), (None, rows[0][1])]
    df = spark.createDataFrame(written + [(i, h, "x", 1, 2) for i, h in bad] + written[:3], "image_id bigint, phash string, h string, rep int, l0 int")
    got = {r.id: r.group_id for r in grouping.near_hash_groups(df, "image_id", "phash", 6).collect()}
    assert got == brute(rows, 6)


def test_copies_are_one_class(spark):
    rows = [(i, "ab" * 32) for i in range(50, 90)] + [(5, "12" * 32)]
    got = grouping.near_hash_groups(spark.createDataFrame(rows, "image_id bigint, phash string"), "image_id", "phash", 6).collect()
    assert {r.id: r.group_id for r in got} == {i: 50 for i in range(50, 90)}
    none = spark.createDataFrame([], "image_id bigint, phash string")
    assert grouping.near_hash_groups(none, "image_id", "phash", 6).count() == 0
