from lodestone.llm import op8_ngram_join as op8
from lodestone.llm.common import table

DOCS = "doc_id long, text string, chunk string, n string"


def brute(rows, n=5, percent=80):
    def words(t):
        t = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        return t.split()

    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_matches_brute_force_on_a_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert result(op8.ngram_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def chain(k=60):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(k):
        w = list(base)
        w[(d * 7) % 190] = f"x{d}"
        w[(d * 13 + 5) % 190] = f"y{d}"
        if d % 3 == 0:
            w[60:75] = [f"z{d}{i}" for i in range(15)]
        rows.append((d, " ".join(w)))
    return rows


def test_frequent_shingles_and_several_blocks(spark, monkeypatch):
    rows = chain()
    df = spark.createDataFrame([(d, t, "c", "n") for d, t in rows], DOCS)
    want = brute(rows)
    assert result(op8.ngram_join(df, block=7)) == want
    from lodestone.llm import census

    monkeypatch.setattr(census.chunks, "__defaults__", (2000,))
    monkeypatch.setattr(op8, "FREQUENT", 3)
    assert result(op8.ngram_join(df)) == want


def test_combination_keys_meet_for_similar_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        a = rng.choice(2**40, n, replace=False).astype(np.uint64)
        b = a.copy()
        change = int(rng.integers(0, max(1, n // 9) + 1))
        b[:change] = rng.choice(2**40, change).astype(np.uint64) + np.uint64(2**41)
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (2 * n - common):
            continue
        df = {int(x): int(rng.integers(1, 80)) for x in np.concatenate((a, b))}
        for x in np.intersect1d(a, b):
            df[int(x)] = max(2, df[int(x)])
        keys = []
        for s in (a, b):
            seen = np.array([df[int(x)] for x in s], np.uint8)
            keys.append(set(op8.index_keys(s, seen, seen == 1, n, 80)))
        assert keys[0] & keys[1]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three four five six"), (7, "ONE two three four five six"), (9, "a " * 30000), (8, "a " * 20000), (None, "one two")]
    got = result(op8.ngram_join(spark.createDataFrame([(d, t, None, None) for d, t in rows], DOCS)))
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (2, 6), 7: (2, 6), 8: (1, 8), 9: (1, 8), None: (1, 4)}
    twice = spark.createDataFrame([(1, "p q", "", ""), (1, "p q", "", "")], DOCS)
    assert op8.ngram_join(twice).count() == 2
    assert op8.ngram_join(twice.limit(0)).count() == 0


def test_blocks_of_one_group_lose_no_link(spark):
    """Large, small and single components in one candidate group, over several blocks, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows, sets = [], {}
    for cluster, many in enumerate((90, 40, 12, 9, 5, 1, 1, 1)):
        own = rng.choice(2**60, 50, replace=False).astype(np.uint64)
        for _ in range(many):
            s = own.copy()
            change = int(rng.integers(0, 9))
            s[rng.choice(50, change, replace=False)] = rng.choice(2**60, change).astype(np.uint64)
            node = int(rng.integers(-(2**40), 2**40))
            sets[node] = set(s.tolist())
            cells = [int((s ^ np.uint64(j * 0x9E3779B9)).min()) for j in range(op8.LEVELS)]
            rows.append((7, node, 50, cells, bytearray(s.tobytes()), s.view(np.int64).tolist()))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (100 - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(rows, "grp long, node long, n long, cells array<long>, tokens binary, keys array<long>")
    indexed = df.selectExpr("node AS c1", "keys", "cast(array() AS array<long>) AS alone", "false AS wide")
    for block in (4, 16, 1000):
        got = {r.node: r.comp for r in op8.verified_components(df.drop("keys"), indexed, 80, block).collect()}
        assert {d: got.get(d, d) for d in sets} == {d: find(d) for d in sets}


def test_null_and_repeated_doc_ids_link_by_text_only(spark):
    five, nine = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    other, alone = (" ".join(f"{c}{i}" for i in range(60)) for c in "cd")
    rows = [(5, five), (9, nine), (None, five + " x"), (None, nine + " y"), (None, other), (None, other + " z"), (None, other), (7, alone), (7, alone), (7, five + " w"), (8, nine + " v"), (None, None), (3, " ")]
    df = spark.createDataFrame([(d, t, None, None) for d, t in rows], DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in op8.ngram_join(df).collect()), key=repr)
    want = [(5, 5), (9, 8), (None, 5), (None, 8), (None, None), (None, None), (None, None), (7, 7), (7, 7), (7, 5), (8, 8), (None, None), (3, 3)]
    assert got == sorted(want, key=repr)
    kept = op8.one_per_group(df)
    assert kept.columns == df.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    third = [t for d, t in kept if d is None and t]
    assert len(third) == 1 and third[0] in (other, other + " z")
    assert sorted((x for x in kept if x[0] is not None)) == [(3, " "), (5, five), (7, alone), (8, nine + " v")]
    assert len(kept) == 6


def test_chance_keys_do_not_bring_a_group_together(spark, monkeypatch):
    """Texts of one candidate group that hangs together by shared rare passages, with a few near copies inside: same links as brute force, and few sets sent key by key."""
    import random

    random.seed(8)
    order = [random.sample(range(60), 60) for _ in range(5)]
    rows = [(d, " ".join(f"s{j}p{order[j][d] // 2}w{i}" for j in range(5) for i in range(40))) for d in range(60)]
    for d in range(0, 60, 10):
        w = rows[d][1].split()
        w[70] = "other"
        rows.append((1000 + d, " ".join(w)))
    sent = []
    between = op8._between
    monkeypatch.setattr(op8, "_between", lambda apart, *a: sent.append(apart.count()) or between(apart, *a))
    df = spark.createDataFrame([(d, t, "c", "n") for d, t in rows], DOCS)
    assert result(op8.ngram_join(df, block=8)) == brute(rows)
    assert sent and 0 < sent[0] < 60 * len(rows)


def test_components_of_hubs_and_paths(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(common, "HUB", 5)
    edges = [(0, i) for i in range(1, 200)] + [(999, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(200)} | {i: 300 for i in [999, *range(300, 400)]} | {i: 500 for i in range(500, 561)}
    assert got == want


def test_census_counts_documents(spark):
    """The byte of a hash is the same for every chunk, tells one document from more, and grows with their number."""
    import numpy as np

    from lodestone.llm import census

    codes = census._codes(np.arange(1, 10**6, 997))
    assert census.code(1) == 1 < census.code(2) < census.code(3) and (np.diff(codes.astype(int)) >= 0).all() and codes[-1] < 255
    h = np.sort(np.array([5, 2**40, 2**63 + 7], np.uint64))
    rows = {"chunk": [], "bucket": [], "data": []}
    for c, n in ((0, [1, 3, 300]), (1, [2, 0, 300])):
        keep = np.array(n) > 0
        for k, v in census.send(c, h[keep], np.array(n)[keep], 4).items():
            rows[k] += v
    got = {(r.chunk, r.bucket): bytes(r.data) for r in census.count_documents(spark.createDataFrame(census.sent_table(rows).to_pandas(), census.SENT)).collect()}
    reply = census.read_replies({b: d for (c, b), d in got.items() if c == 0}, h, 4)
    assert reply.tolist() == [census.code(3), census.code(3), census.code(510)]
