"""Bottom-k near-dedup, source divergence and centroid clustering against brute force,
and on the cases their docstrings define."""

import collections
import hashlib
import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waybill import session
from waybill.llm import block_norms, bottom_k, language_hd, media_jpeg, pii_weak, source_divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "\n\t ", "é", "中文 字符", "a" * 70_000, "x\0y", "word " * 3000, "😀 ok", "same", "same"]


def docs(spark, texts, extra=""):
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({name: F.lit("clash") for name in extra.split()})


# --- 11 bottom-k near-dedup ---------------------------------------------------


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, percent=85):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def edited(rng, base, edits, vocabulary):
    copy = list(base)
    for _ in range(edits):
        copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
    return " ".join(copy)


def near_copies(seed):
    """Groups of copies of 4 to 700 words that are linked, nearly so and linked through
    others only; texts that share most of a passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(600)]
    texts = list(ODD)
    for n in (4, 5, 9, 25, 31, 34, 60, 68, 120, 300, 700):
        base = [rng.choice(vocabulary) for _ in range(n)]
        texts += [" ".join(base), " ".join(base).upper()]
        texts += [edited(rng, base, e, vocabulary) for e in (1, 1, 2, max(1, n // 60), max(1, n // 50), max(2, n // 40), max(3, n // 30))]
        far = edited(rng, base, max(1, n // 80), vocabulary)
        for _ in range(4):  # a chain, whose ends are not linked
            far = edited(rng, far.split(), max(1, n // 80), vocabulary)
            texts.append(far)
    passage = " ".join(rng.choice(vocabulary) for _ in range(90))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60))) for _ in range(25)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    texts = near_copies(seed)
    sizes, labels = brute_components(texts)
    got = {r["doc_id"]: r for r in bottom_k.near_duplicates(docs(spark, texts, "n sid component_id kept s").repartition(5)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == labels
    assert all(got[i]["kept"] == (labels[i] == i) for i in range(len(texts)))


def test_components_from_lists_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bottom_k, "BLOCK", 2)
    texts = near_copies(3)
    _, labels = brute_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in bottom_k.near_duplicates(docs(spark, texts).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == labels


def test_a_large_group_of_different_copies_needs_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    texts = [" ".join(base), *(edited(rng, base, rng.randint(1, 4), vocabulary) for _ in range(400))]
    asked = []
    whole = bottom_k.verified
    monkeypatch.setattr(bottom_k, "verified", lambda pairs, *rest: asked.append(pairs.count()) or whole(pairs, *rest))
    got = bottom_k.near_duplicates(docs(spark, texts)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(asked) < 2 * len(texts)


def test_rows_without_ids_and_repeated_rows(spark):
    text = "a b c d e f g"
    df = docs(spark, [text, None, text]).union(spark.createDataFrame([(None, text, None, None, None), (2, text, None, None, None), (None, "p q", None, None, None)], DOCS))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in bottom_k.near_duplicates(df).collect()), key=str)
    assert got == sorted([(0, 0, True), (1, 1, True), (2, 0, False), (None, 0, False), (2, 0, False), (None, None, True)], key=str)
    kept = bottom_k.deduplicated(df.withColumn("hit", F.lit(1)))
    assert kept.columns == [*df.columns, "hit"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "None", "None"]
    assert bottom_k.near_duplicates(docs(spark, [])).count() == 0


def test_least_shared_is_a_tail_of_the_binomial():
    for k in (32, 64, 128):
        t = bottom_k.least_shared(k)
        tail = lambda t, k=k: sum(math.comb(k, i) * 0.85**i * 0.15 ** (k - i) for i in range(t))
        assert tail(t) <= bottom_k.LOSS < tail(t + 1)


def test_estimates_let_all_links_through_and_are_exact_where_sketches_are_sets():
    rng = np.random.default_rng(5)
    new = lambda n: rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2)
    refused = near = 0
    for n, share in itertools.product((1, 6, 20, 60, 150, 192, 200, 500, 3000), (0.1, 0.4, 0.7, 0.83, 0.86, 0.9, 0.92, 0.93, 0.95, 1.0)):
        for k in range(8):
            common = new(round(n * share))
            a, b = np.unique(np.concatenate([common, new(n - len(common))])), np.unique(np.concatenate([common, new((n - len(common)) * (k % 3))]))
            shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            sketches = [bottom_k.packed(x) for x in (a, b)]
            seen = bottom_k.shared_values(sketches[:1], sketches[1:])
            assert bottom_k.overlaps([bottom_k.codes(sketches[0])], [bottom_k.codes(sketches[1])]).tolist() == [seen.tolist()]
            got = bool(bottom_k.may_link(seen, np.array([len(a)]), np.array([len(b)]))[0])
            linked = union > 0 and 100 * shared >= 85 * union
            assert got or not linked
            assert got == linked or max(len(a), len(b)) > bottom_k.SKETCH
            assert not got or 100 * shared >= 55 * union
            refused += not got
            near += linked and 100 * shared < 90 * union
    assert refused > 100 and near > 20


def test_products_of_incidence_count_shared_values(monkeypatch):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint32) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]
    for columns in (4096, 7):
        monkeypatch.setattr(bottom_k, "COLUMNS", columns)
        assert bottom_k.overlaps(sets[:12], sets[12:]).tolist() == want


def test_spanning_trees_connect_what_is_linked():
    rng = np.random.default_rng(9)
    for square, (n, m), share in itertools.product((True, False), ((1, 1), (7, 9), (20, 15)), (0.0, 0.05, 0.15, 0.6)):
        linked = rng.random((n, n if square else m)) < share
        linked = linked | linked.T if square else linked
        (rows, columns), of_row, of_column = bottom_k.spanning(linked, square)
        names = lambda i, j: (("r", i), ("r", j) if square else ("c", j))
        part = {x: {x} for x in [("r", i) for i in range(n)] + [("c", j) for j in range(0 if square else m)]}
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = (part[x] for x in names(int(i), int(j)))
            if a is not b:
                a |= b
                part.update({x: a for x in b})
        assert all(linked[i, j] for i, j in zip(rows, columns, strict=True))
        assert len(rows) == len(part) - len({id(p) for p in part.values()})  # a tree of each part
        of = {("r", i): int(x) for i, x in enumerate(of_row)} | ({} if square else {("c", j): int(x) for j, x in enumerate(of_column)})
        assert all((of[a] == of[b]) == (part[a] is part[b]) for a, b in itertools.combinations(part, 2))


def test_known_overlaps_bound_unknown_ones():
    rng = random.Random(6)
    for _ in range(500):
        x, z, r = (set(rng.sample(range(30), rng.randint(1, 25))) for _ in "xzr")
        most = bottom_k.possible_overlap(*(np.array([v]) for v in (len(x), len(z), len(x & r), len(z & r))))[0]
        assert len(x & z) <= most <= len(x)


# --- 12 source divergence ------------------------------------------------------


def brute_divergence(rows):
    term = re.compile(rb"[a-z\x80-\xff]+")
    read = [(lang or "", source or "", term.findall((text or "").encode().lower())) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in read}:
        in_docs = collections.Counter(t for r in read if r[0] == lang for t in set(r[2]))
        kept = sorted(t for t, n in in_docs.items() if n >= 10)
        count = collections.defaultdict(collections.Counter)
        for of, source, terms in read:
            if of == lang:
                count[source].update(t for t in terms if t in set(kept))
        everything = sum(count.values(), collections.Counter())
        v = len(kept)
        share = lambda c, t, v=v: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for source, c in count.items():
            pairs = [(sum(gap(share(c, t), share(d, t)) for t in kept), other) for other, d in count.items() if other != source]
            terms = [(gap(share(c, t), share(everything, t)), t.decode()) for t in kept if c[t] and share(c, t) > share(everything, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def text_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "été", "中", "x1y", "naïve", *(f"word{chr(97 + i)}" for i in range(26)), *(f"{a}{b}" for a in "abcdef" for b in "ghijkl")]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ä", "z", None])
        start = {"a": 0, "b": 12}.get(source, 5)
        rows.append((lang, source, " ".join(rng.choice(words[start : start + 30]) for _ in range(rng.randint(0, 40)))))
    # a group without terms, a language without kept terms, one with a single source, repeated rows
    rows += [("en", "silent", "123 !?"), ("en", "none", None), ("few", "a", "lonely words"), ("few", "b", "lonely"), ("few", None, None)]
    return rows + [("one", "only", "here and here")] * 12


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_matches_brute_force(spark, seed):
    rows = text_rows(seed)
    df = spark.createDataFrame([(i, t, lang, s, None) for i, (lang, s, t) in enumerate(rows)], DOCS)
    df = df.withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "part", "item", "value", "rank", "total", "d1", "times")})
    got = sorted(tuple(r) for r in source_divergence.divergence(df.repartition(4)).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_divergence(rows)
    assert any(r[2] == "pair" and r[4] == 0 for r in got) and not any(r[:3] == ("one", "only", "pair") for r in got)


def test_divergence_of_no_rows(spark):
    assert source_divergence.divergence(docs(spark, [])).count() == 0


def test_terms_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("aBc é中1 \n'") for _ in range(3000)) + "z" * 500
    want = source_divergence.terms_of(text.encode())
    assert want == collections.Counter(re.findall(rb"[a-z\x80-\xff]+", text.encode().lower()))
    for piece in (1, 7, 100):
        monkeypatch.setattr(source_divergence, "PIECE", piece)
        assert source_divergence.terms_of(text.encode()) == want


def test_shares_of_very_frequent_terms_are_exact(spark):
    rows = [(10**15, 3 * 10**15, 10**6), (0, 0, 1), (9_223_372_036, 9_223_372_036, 3), (5, 0, 0)]
    df = spark.createDataFrame(rows, "n long, total long, terms long")
    got = [r[0] for r in df.select(source_divergence.share(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [*(1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in rows[:3]), None]


# --- 13 centroid clustering -----------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_clusters(rows):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [math.floor(1024 * int(c)) if abs(c) > 2**53 else math.floor(1024 * float(c)) for c in x]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:8]]
    distance = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda v: min((distance(v, c), k) for k, c in enumerate(centroids))
    for _ in range(10):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(d) // len(groups[k]) for d in zip(*groups[k], strict=True)] if groups[k] else c for k, c in enumerate(centroids)]
    out = [(vec_id, *nearest(v)[::-1]) for vec_id, v in kept]
    of = collections.Counter()
    for _, k, d in out:
        of[k] += d
    fits = lambda x: x if x < 1 << 63 else None
    lost = {k for _, k, d in out if fits(d) is None}
    inertia = fits(sum(of.values())) if not lost else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, fits(d), None if k in lost else fits(of[k]), inertia, sha[k]) for i, k, d in out), key=str)


def clusters_of(spark, rows):
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS).withColumns({c: F.lit("clash") for c in ("v", "norms", "large", "cluster", "inertia")})
    out = block_norms.clusters(df.repartition(3))
    return sorted((tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def some_vectors(seed, n):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(6, 64))
    return [(i, (means[i % 6] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


def test_clusters_match_brute_force(spark):
    rows = some_vectors(1, 150)
    flat = [0.25] * 64
    rows += [(1000, None), (1001, [0.5] * 63), (1002, [*flat[:-1], None]), (1003, [*flat[:-1], float("nan")]), (1004, [*flat[:-1], float("inf")])]
    rows += [(None, flat), (7, flat), (7, flat), (1005, [-x for x in flat]), (1006, [0.0] * 64)]
    assert clusters_of(spark, rows) == brute_clusters(rows)


def test_equal_and_few_vectors(spark):
    for rows in ([(i, [0.5] * 64) for i in range(20)], some_vectors(2, 5), [(1, None)]):
        assert clusters_of(spark, rows) == brute_clusters(rows)


def test_huge_components_stay_exact(spark):
    rows = some_vectors(3, 30)
    large = float(np.float32(3e38))
    rows += [(100, [large] * 64), (101, [-large, *[1.0] * 63]), (102, [2e5] * 64), (103, [1.5e9] * 64)]
    assert clusters_of(spark, rows) == brute_clusters(rows)


def test_screening_changes_no_assignment():
    rng = np.random.default_rng(4)
    for scale in (3, 1000, block_norms.SAFE):
        v = rng.integers(-scale, scale + 1, (500, 64))
        c = np.concatenate([v[:4], v[:2], rng.integers(-scale, scale + 1, (2, 64))])
        best, d = block_norms.assigned(v, block_norms.segment_norms(v), c.tolist())
        plain = ((v[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(2)
        assert best.tolist() == [min(range(8), key=lambda k, r=r: r[k]) for r in plain]
        assert d.tolist() == plain[np.arange(500), best].tolist()


def test_results_match_their_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(data, name)}.parquet'")
    for module in (bottom_k, source_divergence, block_norms):
        ((name, query),) = module.QUERIES.items()
        got, want = query(spark, data).toPandas(), con.sql(module.ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        rows = lambda df, columns=columns: sorted(map(str, df[columns].astype(object).itertuples(index=False, name=None)))
        assert rows(got) == rows(want)


# --- what operators leave behind ------------------------------------------------

LEFT = {
    "op1_media_jpeg": 0, "op2_jaccard_join": 1, "op3_chat_format": 0, "op4_language_hd": 0, "op5_html_extract": 1, "op6_piece_sampling": 0, "op7_pii_weak": 1,
    "op8_decontaminate": 1, "op9_secret_scan": 0, "op10_substring_dedup": 1, "op11_bottom_k": 1, "op12_source_divergence": 1, "op13_block_norms": 1,
}


@pytest.fixture(scope="module")
def own_folder(spark):
    """The session's shared folder."""
    return spark.conf.get("spark.checkpoint.dir").removeprefix("file://")


@pytest.mark.parametrize("name", sorted(LEFT))
def test_queries_leave_at_most_the_table_that_their_result_reads(spark, own_folder, name):
    from waybill.llm.registry import QUERIES

    before = set(os.listdir(own_folder))
    assert QUERIES[name](session.prepared(spark), "/root/testdata/sf0.001").count() > 0
    assert len(set(os.listdir(own_folder)) - before) <= LEFT[name]


def test_the_pipeline_leaves_its_result_only(spark, own_folder):
    import corpus_pipeline

    before = set(os.listdir(own_folder))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    left = set(os.listdir(own_folder)) - before
    assert len(left) == 1 and left.pop().startswith("pieces")


# --- long texts --------------------------------------------------------------------


def test_long_texts_are_the_same_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB é1 .中\nΣς") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", "12", "a" * 500, " "]
    names, unit = list("abcd"), np.linalg.qr(np.random.default_rng(1).normal(size=(language_hd.DIMENSIONS, 4)))[0]
    want = [np.concatenate([np.zeros(0, np.int64), language_hd.trigram_codes(t)]).tolist() for t in texts]
    langs, scores = language_hd.predict_texts(texts, names, unit)
    for piece in (1, 7, 64):
        monkeypatch.setattr(language_hd, "PIECE", piece)
        same = [t for t in range(len(texts)) if "Σ" not in texts[t]]  # its small form depends on what follows
        assert [np.concatenate([np.zeros(0, np.int64), *language_hd.code_pieces(texts[t])]).tolist() for t in same] == [want[t] for t in same]
        again, close = language_hd.predict_texts(texts, names, unit)
        assert [again[t] for t in same] == [langs[t] for t in same]
        assert np.allclose([close[t] for t in same], [scores[t] for t in same], atol=1e-5)


def test_long_pictures_are_written_and_read_an_image_at_a_time(monkeypatch):
    rng = random.Random(3)
    payloads = [media_jpeg.pad(bytes(rng.randrange(256) for _ in range(n))) for n in (100, 20_000, 5_000, 64)]
    monkeypatch.setattr(media_jpeg, "ROWS_PER_IMAGE", 16)
    together = media_jpeg.encode_payloads(payloads)
    whole = media_jpeg.thumbnails(together)
    monkeypatch.setattr(media_jpeg, "CHUNK_BYTES", 3000)
    assert media_jpeg.encoded(payloads) == together
    read = media_jpeg.thumbnails([*together, together[1][:-700], None])
    assert read[-1] is None and read[-2] is None
    for payload, a, b in zip(payloads, whole, read, strict=False):
        assert b"".join(t.tobytes() for _, _, t in b) == payload == b"".join(t.tobytes() for _, _, t in a)
        assert media_jpeg.thumbnail_hashes(np.concatenate([t for _, _, t in b])) == media_jpeg.thumbnail_hashes(np.concatenate([t for _, _, t in a]))


# --- personal data: what the models hold ----------------------------------------------


def test_the_classifier_is_fitted_on_a_bounded_sample(spark, monkeypatch):
    texts = [f"call me: (212) 555-{1000 + i} {'abcdefgh'[i % 8] * (1 + i % 5)} mail a{i}@b.org" for i in range(60)] + ["order 000-00-0000"] * 5
    seen = []
    whole = pii_weak.weights_of
    monkeypatch.setattr(pii_weak, "weights_of", lambda counts, soft: seen.append((len(counts), len(soft))) or whole(counts, soft))
    monkeypatch.setattr(pii_weak, "FIT_PATTERNS", 7)
    got = {r["doc_id"]: r["spans"] for r in pii_weak.personal_data(docs(spark, texts)).collect()}
    assert seen[0][0] == 7 and seen[0][1] <= 27
    assert "national_phone:9:23" in got[0] and "national_id" not in got[60]


def test_newton_steps_by_conjugate_gradients_are_the_plain_ones():
    rng = np.random.default_rng(6)
    size, x = 30, rng.integers(0, 30, (200, 4))
    y, weight = rng.random(200), rng.random(200) * 50
    dense = np.zeros((200, size))
    for k in range(4):
        dense[np.arange(200), x[:, k]] += 1
    w = np.zeros(size)
    for _ in range(60):
        p = 1 / (1 + np.exp(-dense @ w))
        hessian = dense.T @ (dense * (weight * p * (1 - p))[:, None]) + np.eye(size)
        w += np.linalg.solve(hessian, dense.T @ (weight * (y - p)) - w)
    assert np.allclose(pii_weak.fit_logistic(x, size, y, weight, rounds=60), w, atol=1e-4)


def test_divergence_deals_terms_once(spark, monkeypatch):
    plans, put = {}, source_divergence.Tables.put

    def seen(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return put(self, df, name)

    monkeypatch.setattr(source_divergence.Tables, "put", seen)
    rows = [(i, "aa bb aa", "en", f"s{i % 2}") for i in range(12)] + [(12, "aa cc", "en", "s0"), (13, None, "de", "s1")]
    got = source_divergence.divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["item"] for r in got if r["part"] == "term"} <= {"aa", "bb"} and {r["source"] for r in got if r["part"] == "pair"} == {"s0", "s1"}
    assert "counts" not in plans and plans["kept"].count("Exchange hashpartitioning") == 1
