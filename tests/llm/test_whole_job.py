"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docloom.llm import passages, secrets, sharding, simhash


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def behind_edited_copies(n: int) -> list[tuple[int, str]]:
    """n times: five smaller documents hold a passage with three words changed, two later ones hold it as it is."""
    rng, rows = random.Random(8), []
    for k in range(n):
        shared = words(1000 + k, 50)
        for i in range(7):
            w = list(shared)
            for c in rng.sample(range(50), 3) if i < 5 else ():
                w[c] = f"z{i}{c}"
            rows.append((10 * k + i, " ".join([*words(7000 + 10 * k + i, 30), *w, *words(9000 + 10 * k + i, 30)])))
    return rows


def test_exact_copies_behind_edited_ones(spark):
    got = passages.repeated(spark.createDataFrame(behind_edited_copies(30), "doc_id long, text string")).collect()
    linked = {(r["doc_id"], r["other_id"]) for r in got}
    assert [k for k in range(30) if (10 * k + 6, 10 * k + 5) not in linked] == []


def test_unlike_texts_of_one_fingerprint_stay(spark):
    rows = [(i, " ".join(["dash"] * 60 + words(50 + i, 40))) for i in range(6)]
    rows.append((9, " ".join(["dash"] * 60 + words(55, 40)[:-1] + ["changed"])))
    assert len({simhash.fingerprint(x, 5) for _, x in rows}) == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(df).collect()) == [*range(6)]


def test_near_copies_beyond_eight_bits_are_found(spark):
    rng, rows = random.Random(3), []
    while len(rows) < 40:
        a = words(rng.randint(0, 10**9), 150)
        b = list(a)
        for c in rng.sample(range(150), 3):
            b[c] = f"q{c}"
        x, y = ({tuple(w[i : i + 5]) for i in range(146)} for w in (a, b))
        a, b = " ".join(a), " ".join(b)
        if len(x & y) >= 0.8 * len(x | y) and 8 < (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() <= 12:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    left = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in left) == [*range(0, 40, 2)]


def test_rows_that_share_a_doc_id(spark):
    """Each of two texts of one doc_id is compared: every exact copy is found, and nothing within the doc_id."""
    rows = []
    for k in range(20):
        shared = words(3000 + k, 60)
        one, two = [*words(1 + k, 30), *shared], [*words(100 + k, 80), *(words(200 + k, 30) if k % 2 else shared)]
        if not k % 2:
            one = words(300 + k, 90)
        rows += [(2 * k, " ".join(one)), (2 * k, " ".join(two)), (2 * k, " ".join(two)), (2 * k + 1, " ".join([*shared, *words(400 + k, 20)]))]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(2 * k + 1, 2 * k) for k in range(20)}


def test_cuts_between_orders_that_share_58_bits(spark):
    """Groups whose hashes differ in their last two bits are still cut where the capacity asks for it."""
    base = (1 << 59) + (5 << 20)
    sizes = {base + k: 10 + k for k in range(4)} | {3: 7, (1 << 60) - 1: 9}
    rows = [(o, s) for o, s in sizes.items()] * 3
    for shards in (1, 2, 3, 5, 8):
        at = sharding.cuts(spark.createDataFrame(rows, "order long, size long"), shards)
        held = [0] * (len(at) + 1)
        for o, s in rows:
            held[sum(o >= c for c in at)] += s
        assert len(held) <= shards and max(held) == sharding._smallest([3 * sizes[o] for o in sorted(sizes)], shards)


def test_survivor_of_equal_doc_ids_is_the_same_whatever_the_partitions(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(7, " ".join([*base, f"end{i}"]), i) for i in range(6)] + [(None, " ".join(base), 9), (7, " ".join([*base, "end0"]), 8)]
    kept = {tuple(simhash.deduplicated(spark.createDataFrame(r, "doc_id long, text string, extra int").repartition(n)).collect()) for r, n in ((rows, 1), (rows[::-1], 3), (rows[3:] + rows[:3], 7))}
    assert len(kept) == 1 and [r["doc_id"] for r in next(iter(kept))] == [7]


def test_tokens_in_a_long_run_of_their_first_letters(spark):
    token = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    rows = [(1, "eyJ" * 100_000), (2, f"see {token} and"), (3, "eyJ" * 50_000 + " " + token)]
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: f"bearer:4:{4 + len(token)}", 3: f"bearer:150001:{150_001 + len(token)}"}


def test_a_cloud_of_near_copies_meets_its_middle(spark, monkeypatch):
    """120 texts are like their middle only, 60 more like none: not all pairs of them are verified, and no link is lost."""
    rng, base, rows = random.Random(5), words(77, 150), []
    for i in range(181):
        w = list(base)
        for c in rng.sample(range(5, 145, 10), 0 if i == 90 else 3 if i % 3 else 9):
            w[c] = f"z{i}x{c}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, x in rows for w in [x.split()]]
    prints = [simhash.fingerprint(x, 5) for _, x in rows]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 14 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    to = list(range(181))
    for i in range(181):
        for j in range(i):
            if near(i, j):
                a, b = sorted((to[i], to[j]))
                to = [a if x == b else x for x in to]
    seen, alike = [], simhash._alike

    def counted(*args):
        verify = alike(*args)

        def both(pairs):
            seen.append(pairs.count())
            return verify(pairs)

        return both

    monkeypatch.setattr(simhash, "_alike", counted)
    left = [r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(left) == sorted(set(to)) and 60 <= len(left) <= 70
    assert sum(seen) < 2500  # 13,458 when all that are near by their fingerprints meet


def test_rows_of_a_text_do_not_follow_the_number_of_texts(spark, monkeypatch):
    """With the plan of 20,000 texts: no text probes more values than there are partitions, and rare shingles alone find every link."""
    rng, rows = random.Random(9), []
    for i in range(40):
        base = words(6000 + i, 60 + 3 * i)
        for k in range(3):
            w = list(base)
            for c in rng.sample(range(len(w)), rng.randint(0, 3)):
                w[c] = f"y{i}x{k}x{c}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), ""), (len(rows) + 1, " \t"), (len(rows) + 2, None)]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for _, x in rows for w in [(x or "").split()]]
    prints = [simhash.fingerprint(x, 5) for _, x in rows]
    to = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 14 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((to[i], to[j]))
                to = [a if x == b else x for x in to]
    plan, probes, made = simhash.plan, simhash._probes, []

    def counted(rows, probed):
        out = probes(rows, probed)
        made.append(out.count() / rows.count())
        return out

    monkeypatch.setattr(simhash, "plan", lambda n, both, distance: plan(20_000, both * (20_000 / n), distance))
    monkeypatch.setattr(simhash, "_probes", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(df).collect()) == sorted(set(to))
    assert max(made) <= 15  # 64 rows a text on check_l, 15 on check_s
    monkeypatch.setattr(simhash, "_chained", lambda prints, *_: prints.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    monkeypatch.setattr(simhash, "_led", lambda prints, *_: prints.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    assert sorted(r["doc_id"] for r in simhash.deduplicated(df).collect()) == sorted(set(to))
