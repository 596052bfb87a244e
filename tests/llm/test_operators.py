"""The training-data operators against brute force, and on null, empty, repeated and clashing rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from docloom.llm import decontaminate, mixing, passages, quality, queries, secrets, sharding, simhash, tokencount, tokenfile, topk

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b\n\n c\t", "<s> x<|endoftext|>  y", "日本語 😀 ▁x", "it's don't", "x\x1c!\x1dy", "a" * 300, " " * 40 + "x", "3²x½ é"]


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and long texts, repeated rows, null ids and sources, columns with clashing names."""
    rows = [(i, x, "en", f"s{i % 3}", len(x), 1, 2) for i, x in enumerate(ODD)] + [(None, "no id", "en", None, 5, 1, 2), (50, None, None, None, None, 1, 2)]
    rows += [(60, "twice the same row " * 30, "de", "s1", 1, 1, 2)] * 2 + [(70, " ".join(words(1, 9000)), "de", "s1", 1, 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, k1 int")


def test_word_prints_and_components(spark, odd):
    def plain(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    base = words(3, 400)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for i in range(40):  # near copies, each with one word changed
        w = list(base)
        w[i * 9] = "zz"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join(words(100 + i, 60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = {t: plain(t) for _, t in rows}
    assert sorted((r["doc_id"] or -1, r["fp"] % (1 << 64)) for r in got) == sorted((d or -1, prints[t]) for d, t in rows)
    live = sorted(set(prints.values()))
    parent = {x: x for x in live}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(live):
        for b in live[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least: dict = {}
    for d, t in rows:
        if d is not None:
            least[root(prints[t])] = min(d, least.get(root(prints[t]), 10**9))
    assert all(r["component_id"] == least.get(root(r["fp"] % (1 << 64))) for r in got)


@pytest.mark.parametrize("distance", [0, 3, 4, 8])
def test_pigeonhole_plan_covers_every_pair(distance):
    rng = np.random.default_rng(distance)
    bits = rng.integers(0, 2, (500, 64))
    chosen = simhash.plan(500, bits.T.astype(float) @ bits, distance)
    assert sorted(b for g, _ in chosen for b in g) == list(range(64))
    assert sum(t for _, t in chosen) == distance - len(chosen) + 1
    for _ in range(300):
        flip = rng.choice(64, distance, replace=False)
        assert any(sum(b in flip for b in g) <= t for g, t in chosen)


def test_deduplicated_keeps_one_of_each_class(spark, odd):
    base = words(5, 300)
    near = " ".join([*base[:150], "changed", *base[151:]])
    rows = [(1, " ".join(base)), (2, near), (3, " ".join(base)), (4, " ".join(words(6, 300)))]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, component int")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(df).collect()) == [1, 4]
    out = simhash.deduplicated(odd)
    assert out.columns == odd.columns and out.filter("doc_id = 60").count() == 1


def test_leaks(spark, odd):
    items = [(i, " ".join(words(1000 + i, 12 + i))) for i in range(20)] + [(90, None), (91, ""), (92, "one two"), (93, "solo")]
    w = items[7][1].split()
    edited = [x if i % 6 else "edit" for i, x in enumerate(w)]
    rows = [(1, " ".join([*words(1, 50), *w, *words(2, 50)])), (2, " ".join([*words(3, 50), *edited, *words(4, 9)])), (3, " ".join(words(9, 200))), (4, "say one, TWO!"), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (10**6, 60):
        got = decontaminate.leaks(docs, bench, block_words=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 7), (2, 7), (4, 92)}
    full = next(r for r in got if r["doc_id"] == 1)
    assert (full["score"], full["doc_start"], full["doc_end"]) == (1.0, 50, 50 + len(w))
    assert decontaminate.decontaminated(odd, bench).count() == odd.count()
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()) == [3, 5]


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64)
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_mix(spark, odd):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), f"s{int(rng.random() ** 3 * 6)}") for i in range(3000)]
    for df, n in ((spark.createDataFrame(rows, "doc_id long, text string, source string"), 3000), (odd, odd.count()), (odd.limit(0), 0)):
        got = mixing.mixed(df).collect()
        assert len(got) == n
        by: dict = {}
        for r in got:
            assert r["taken"] <= 2 * r["size"]
            x = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
            x[0] += r["taken"]
            x[1] += r["size"]
        assert all(abs(x[0] - x[2]) <= 1 and x[1] == x[3] and x[2] <= 2 * x[3] + 1e-6 for x in by.values())
        assert abs(sum(x[2] for x in by.values()) - 1.5 * sum(x[1] for x in by.values())) < 1e-3
        assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(df.repartition(3)).collect()))
    assert mixing.applied(odd).columns == odd.columns


def test_token_counts_of_every_prefix(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    c = tokencount.PrefixCounter(path)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "the", "e", " ", "  ", "\n", "é", "1", "'", "▁", "日", "er", "ing"]) for _ in range(20)) for _ in range(150)]
    for x in texts:
        assert c.total(x) == len(c.library.encode(x))
        assert c.table(x).tolist() == [len(c.library.encode(x[:i])) for i in range(len(x) + 1)]
    long = " ".join(words(8, 3000))
    cut = c.cut(long, 500)
    assert c.total(long[:cut]) <= 500 < min(c.total(long[: cut + k]) for k in range(1, 40))
    got = {r["doc_id"]: r for r in tokencount.with_counts(odd, path, ["doc_id"]).collect()}
    assert got[50]["n_tokens"] == 0 and got[70]["over_limit"] and got[0]["n_bytes"] == 0
    assert tokencount.prefix_tables(odd, path).count() == odd.count()


def test_token_file_round_trip(spark, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = tokenfile.Encoder(path)
    for x in ODD:
        assert np.frombuffer(enc.encode([x])[0], "<u2").tolist() == enc.tokenizer.encode(x, add_special_tokens=False).ids
    tokenfile.write_tokens(odd, str(tmp_path / "t"), path, block_ids=2000)
    got = tokenfile.documents_of(tokenfile.read_tokens(spark, str(tmp_path / "t"))).collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), [*enc.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in odd.collect())
    start = 0
    assert len(got) == len(want)
    for r, ((_, d), ids) in zip(sorted(got, key=lambda r: r["start"]), want, strict=True):
        assert (r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)


def test_offsets_by_select(spark, tmp_path):
    rows = [(i // 2 * 7 - 3000, " ".join(words(i, i % 40))) for i in range(900)] + [(None, "no id"), (9, None), (2**62, "far"), (-(2**62), "far")]
    tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"), block_ids=500)
    blocks = tokenfile.read_tokens(spark, str(tmp_path / "t"))
    want = spark.createDataFrame([(x,) for x in (-3000, 0, 4, 9, 123, -(2**62), 2**62, None)], "doc_id long")
    known = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in tokenfile.documents_of(blocks).collect() if r["doc_id"] in (-3000, 0, 4, 9, 123, -(2**62), 2**62))
    assert sorted(map(tuple, tokenfile.offsets_of(blocks, want).collect())) == known and len(known) == 5


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_elias_fano(n):
    v = np.cumsum(np.random.default_rng(n).integers(0, 900, n))
    ef = tokenfile.EliasFano.of(v)
    assert ef.all().tolist() == v.tolist() == [ef.select(i) for i in range(n)]
    some = np.unique(np.random.default_rng(1).integers(0, n, 20))
    assert ef.select_all(some).tolist() == v[some].tolist() and ef.below(int(v[n // 2])) == int((v < v[n // 2]).sum())


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(700)] + [(701, None), (750, [1.0, None] * 10), (800, [float("nan")] * 20), (850, [1.0, 2.0]), (900, [])]
    rows += [(100, rows[100][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ok = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows if x and None not in x and not np.isnan(x).any()]
    for send in (1 << 30, 0):
        topk.SEND_BYTES = send
        got = sorted((r["query_id"], r["rank"], r["vec_id"] if r["vec_id"] is not None else 10**9, r["score"]) for r in topk.top_k(df, lambda v: v % 50 == 0).collect())
        want = []
        for a, (i, x) in enumerate(ok):
            if i is not None and i % 50 == 0:
                s = sorted((-int(x @ y), j if j is not None else 10**9) for b, (j, y) in enumerate(ok) if b != a and len(y) == len(x))[:5]
                want += [(i, k + 1, j, -v) for k, (v, j) in enumerate(s)]
        assert got == sorted(want)
    topk.SEND_BYTES = 64 << 20


def test_top_k_of_huge_components(spark):
    rng = random.Random(9)
    huge = [1e10, -1e10, 3.7e9, 1e300, -1e300, 1e307, 2.5]
    rows = [(i, [rng.choice(huge) * rng.random() if i % 3 == 0 else rng.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(300, [float("inf")] + [1.0] * 5)]
    whole = {i: [math.floor(Fraction(v) * 256) for v in x] for i, x in rows[:-1]}
    want = []
    for q in (0, 50, 100):
        s = sorted((-sum(a * b for a, b in zip(whole[q], y)), j) for j, y in whole.items() if j != q)[:5]
        want += [(q, k + 1, j, min(max(-v, -(2**63) + 1), 2**63 - 1)) for k, (v, j) in enumerate(s)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_top_k_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    assert sorted(map(tuple, queries.op5_top_k(spark, SMALL).collect())) == sorted(con.execute(queries.ORACLE_SQL["op5_top_k"]).fetchall())


CONTRACT = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def test_secrets(spark, odd):
    texts = ["é PassWord = 'abc123x' token: abc", "api_key:  xxxxxx AKIA" + "A" * 16, "AKIASHORT " + "0f" * 12 + " " + "0f" * 11, "ſecret=abcdefgh", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", None, ""]
    rng, cells = random.Random(6), ["password", "Secret", "api", "_", "KEY", "=", ": ", "'", "AKIA", "ABCD0123" * 2, "0f" * 11, "9", "abcdef", " ", "é", "token"]
    texts += ["".join(rng.choice(cells) for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["x " * (3 << 20) + "token=abcdef"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digest(df).collect()}
    for i, x in enumerate(texts):
        spans = sorted((m.start(), n, m.end()) for n, (p, ok) in enumerate(CONTRACT.values()) for m in re.finditer(p, x or "") if ok(m))
        base = [(list(CONTRACT)[n], a, b) for a, n, b in spans]
        assert got[i]["base_sha256"] == secrets.digest_of(base)
        assert [got[i][f"n_{k}"] for k in CONTRACT] == [sum(b[0] == k for b in base) for k in CONTRACT]
        every = sorted((a, n, b) for n, rule in enumerate(secrets.RULES) for a, b in rule.spans(x or ""))
        assert got[i]["spans"] == ",".join(f"{secrets.RULES[n].kind}:{a}:{b}" for a, n, b in every)
    assert secrets.digest(odd).count() == odd.count() and secrets.digest(df.limit(0)).count() == 0


def test_trigram_queries_hold_for_every_match():
    patterns = [r.pattern.pattern for r in secrets.RULES] + [r"ab(cd|ef)?gh", r"(one|two[0-9]+|three)x{2,}end", r"a.b*cde+f", r"(?:[xX]yz){3}", r"é(ü|ß)nn", r"q(w(e|r)t)+y", r"^abc$", r"(?i)kelvin", r"\d{4}-\d\d"]
    rng, letters = random.Random(2), "abcdefghxyzqwertn-=_:.09AKIé ü"
    for p in patterns:
        rule = secrets.Rule("x", p)
        hits = [m[0] for _ in range(300) for m in re.finditer(p, "".join(rng.choice([*letters, "one", "two3", "three", "xx", "end", "xyzxyzxyz", "abgh", "abcdgh", "qwet", "y", "kelvin", "ghp_", "password=", "eyJ", "AKIA"]) for _ in range(30)))]
        for text in hits:
            assert secrets.holds(rule.query, text.encode().lower()), (p, text)
    assert secrets.Rule("x", r"[0-9a-f]+").query is None and secrets.Rule("x", r"(?i)kelvin").query is None
    assert secrets.grams_of(secrets.Rule("x", r"ab(cd|ef)?gh").query) == {b"abc", b"bcd", b"cdg", b"dgh", b"abe", b"bef", b"efg", b"fgh", b"abg", b"bgh"}


def test_quality(spark, odd):
    good = [(i, " ".join(words(i, 120)) + ".", 1) for i in range(150)]
    bad = [(1000 + i, " ".join(f"{w.upper()}!!" for w in words(i, 120)), 0) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality").filter("doc_id % 3 <> 0"))
    held = quality.with_score(df.filter("doc_id % 3 = 0"), model, ["doc_id", "quality"]).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in held]) > 0.95
    out = quality.with_score(odd, model, odd.columns)
    assert out.count() == odd.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    none = quality.train(df.limit(0), df.select("doc_id", "quality"))
    assert {r["score"] for r in quality.with_score(odd, none, ["doc_id"]).collect()} == {0.5}


def test_gradients_and_convolution_by_brute_force():
    rng = np.random.default_rng(3)
    model = {"embed": rng.normal(0, 0.5, (quality.SYMBOLS, quality.EMBED)), "filters": rng.normal(0, 0.3, (quality.WIDTH * quality.EMBED, quality.FILTERS)), "bias": rng.normal(0, 0.1, quality.FILTERS), "out": rng.normal(0, 0.1, 3 * quality.FILTERS), "out_bias": np.array(0.1)}
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (0, 5, 256, 257, 900, 70_000)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def plain(text: bytes, model: dict) -> float:
        pooled = []
        for k in range(max(1, -(-(len(text) - (quality.CHUNK - quality.STEP)) // quality.STEP))):
            chunk = [*text[k * quality.STEP : k * quality.STEP + quality.CHUNK]]
            x = model["embed"][chunk + [quality.SYMBOLS - 1] * (quality.CHUNK - len(chunk))]
            conv = [x[i : i + quality.WIDTH].ravel() @ model["filters"] for i in range(quality.CHUNK - quality.WIDTH + 1)]
            pooled.append(np.maximum(np.max(conv, 0) + model["bias"], 0))
        return float(np.concatenate([np.mean(pooled, 0), np.max(pooled, 0), np.min(pooled, 0)]) @ model["out"] + model["out_bias"])

    assert np.allclose(quality.predict(model, data, offsets), [1 / (1 + math.exp(-plain(t, model))) for t in texts], atol=1e-4)
    labels, weight = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 2, 1])
    x, firsts = quality._chunks(data[: offsets[5]], offsets[:6])
    grad = quality.gradients(model, x, firsts, labels, weight)
    loss = lambda m: sum(w * math.log(1 + math.exp(-z if y else z)) for z, y, w in zip([plain(t, m) for t in texts[:5]], labels, weight)) / 5
    for name in ("filters", "embed", "bias", "out", "out_bias"):
        at = np.unravel_index(int(np.abs(grad[name]).argmax()), np.shape(grad[name]))
        up, down = (model | {name: model[name] + d * (np.arange(model[name].size).reshape(model[name].shape) == np.ravel_multi_index(at, model[name].shape) if model[name].ndim else 1)} for d in (1e-5, -1e-5))
        assert float(np.asarray(grad[name])[at]) == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=0.02, abs=1e-5), name


CLASHES = ("_print_text", "_count_text", "_hit_text", "_hits", "_scored_text", "_scan_text", "fp", "k1", "key", "place")


def test_clashing_names_empty_tables_and_long_texts(spark, tmp_path):
    """All operators on a table whose columns have the names of helper columns, with a text over a slice, and on no rows."""
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e", "s1"), (2, None, None), (3, "", "s1"), (None, "no id here", "s2"), (4, "twice the same", "s2"), (4, "twice the same", "s2"), (5, "lorem ipsum dolor sit " * 150_000, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in CLASHES})
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    none = quality.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    piece, byte = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")

    def files(d, n=[0]):  # noqa: B006
        n[0] += 1
        tokenfile.write_tokens(d, str(tmp_path / f"f{n[0]}"), byte)
        return tokenfile.documents_of(tokenfile.read_tokens(spark, str(tmp_path / f"f{n[0]}")))

    each = {
        "op1": lambda d: decontaminate.with_hits(d, bench, d.columns), "op1 clean": lambda d: decontaminate.decontaminated(d, bench), "op2": mixing.mixed, "op3": lambda d: tokencount.with_counts(d, piece, d.columns), "op4": files,
        "op6": lambda d: secrets.with_secrets(d, d.columns), "op7": lambda d: quality.with_score(d, none, d.columns), "op8": simhash.near_duplicates, "op10": sharding.sharded,
    }
    for name, op in each.items():
        assert op(docs).count() == len(rows), name
        assert op(docs.limit(0)).count() == 0, name
    for op in (mixing.applied, simhash.deduplicated):
        assert op(docs).columns == docs.columns and op(docs.limit(0)).count() == 0
    assert passages.repeated(docs).count() == 0
    got = {r["doc_id"]: r for r in tokencount.with_counts(docs, piece, ["doc_id"]).collect()}
    assert got[5]["n_bytes"] == 150_000 * 22 and got[5]["over_limit"]
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, lambda v: v % 50 == 0).count() == 0


def test_compact_windows():
    rng = np.random.default_rng(1)
    for k in range(200):
        h, t = rng.integers(k % 2, 30, rng.integers(1, 100)).astype(np.uint64), int(rng.integers(2, 12))
        want = set()
        for c in np.flatnonzero(h).tolist():
            l = r = c  # noqa: E741
            while l > 0 and h[l - 1] > h[c]:
                l -= 1  # noqa: E741
            while r + 1 < len(h) and h[r + 1] >= h[c]:
                r += 1
            if r - l + 1 >= t and not (l > 0 and h[l - 1] == h[c] and c - l + 1 < t):
                want.add((l, c, r))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(h, t)), strict=True)) == want


def test_repeated_passages(spark, odd):
    shared = words(77, 60)
    rows = [(i, " ".join([*words(300 + i, 40 + i), *shared, *words(400 + i, 30)])) for i in range(12)] + [(50 + i, " ".join(words(500 + i, 200))) for i in range(12)] + [(90, None), (91, "")]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == set(range(12))
    for r in got:
        assert r["start_word"] <= 40 + r["doc_id"] and r["end_word"] >= 100 + r["doc_id"] - 1 and r["similarity"] >= 0.8
    assert passages.repeated(odd).count() == 0


def test_shards(spark, odd):
    rng = random.Random(5)
    texts = ["x" * rng.randint(0, 900) + str(i) for i in range(900)]
    rows = [(i, texts[int(rng.random() ** 2 * 900)]) for i in range(4000)] + [(9000 + i, "hot" * 50) for i in range(800)] + [(None, None)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), odd, odd.limit(0)):
        got, data = sharding.sharded(df).collect(), df.select("doc_id", "text").collect()
        assert len(got) == len(data)
        for s in {r["shard"] for r in got}:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        groups = [r["size"] for r in df.groupBy(sharding.text_order(df.text).alias("o")).agg({"text": "count"}).limit(0).collect()]
        assert not groups
        sizes: dict = {}
        for o, t in df.select(sharding.text_order(df.text), "text").collect():
            sizes[o] = sizes.get(o, 0) + len((t or "").encode()) + 1
        order = [sizes[o] for o in sorted(sizes)]
        held: dict = {}
        for r in got:
            held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
        assert max(held.values(), default=0) == (sharding._smallest(order, 8) if order else 0)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    assert kept.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).count() == kept.count()
