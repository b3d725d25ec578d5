"""Operators over groups: mixing, near-duplicates, vectors, chats, pages, and the pipeline."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import _store, chat, html, lattice, minhash, mixing, queries
from tidemark.llm._words import BLANKS, shingles, word_batches
from tidemark.llm.components import components

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def least_reachable(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


# --- words


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_word_hashes_follow_words(monkeypatch, piece):
    import pyarrow as pa

    from tidemark.llm import _words

    monkeypatch.setattr(_words, "PIECE_BYTES", piece)
    texts = ["The cat", None, "", "  the\tCAT\n the ", "É é e", "a" * 50 + " b", "cat", " ", "x\x0by"] * 3
    seen = {}
    at = 0
    for lo, hi, hashes, counts in word_batches(pa.array(texts), BLANKS, piece):
        assert lo == at
        at = hi
        given = [w for t in texts[lo:hi] for w in words_of(t)]
        assert counts.tolist() == [len(words_of(t)) for t in texts[lo:hi]]
        for w, h in zip(given, hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_shingles_are_runs_within_texts():
    import pyarrow as pa

    texts = ["a b c d e", "a b", "", "b c d e", "x", "a b"]
    ((_, _, hashes, counts),) = word_batches(pa.array(texts), BLANKS)
    runs, number = shingles(hashes, counts, 4)
    assert number.tolist() == [2, 1, 0, 1, 1, 1]
    parts = np.split(runs, np.cumsum(number)[:-1])
    assert parts[0][1] == parts[3][0] and parts[1][0] == parts[5][0] and len(set(runs.tolist())) == 4


# --- components


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = least_reachable({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if i in got} and set(got) == {x for a, b in links for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, share = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * rest > 3 * sizes[s] * share}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * rest / share for s in order}
        full |= over


def test_mix_targets_copies_and_reruns(spark):
    rnd = random.Random(2)
    sources = ["b", "a", "é", "z", None, "hot", "tiny"]
    rows = [(i, rnd.choice(["hot"] * 8 + sources), " ".join("w" * rnd.randrange(60))) for i in range(3000)]
    rows += [(5000, "tiny", "one"), (5001, "empty", None), (5002, "empty", ""), (None, "a", "x y"), (7, "hot", "again again")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("clash"))
    mixed = mixing.mix(docs).cache()
    got = mixed.collect()
    sizes = {}
    for r in got:
        assert r.size == len(words_of(r.text)) and r.copies * r.size <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
    for s, n in sizes.items():
        taken = sum(r.copies * r.size for r in got if r.source == s)
        assert abs(taken - targets[s]) <= 0.15 * targets[s] + 60
    again = mixing.mix(docs.repartition(7)).select("doc_id", "text", "copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixed.select("doc_id", "text", "copies").collect())
    emitted = mixing.emit_copies(mixed)
    assert emitted.count() == sum(r.copies for r in got) and "copies" not in emitted.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_source_ranks_do_not_depend_on_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    docs = spark.createDataFrame([(i, f"s{i % 40:02}", "a b c") for i in range(400)], "doc_id long, source string, text string")
    got = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert got == pytest.approx(brute_targets({f"s{i:02}": 30 for i in range(40)}))


# --- near-duplicates


def brute_near(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, least_reachable(ids, links)


def near_corpus():
    rnd = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(260):  # near copies of one text, so edited that many don't link with it but with others
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows += [(1000 + i, " ".join(passage + [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 90))])) for i in range(120)]
    rows += [(2000 + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 30)))) for i in range(60)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "ONE"), (3005, "two words"), (3006, "x " * 20_000), (3007, "X\t" * 20_000), (3008, rows[5][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, block, held", [(4, 1024, 1_000_000), (5, 16, 1_000_000), (4, 1024, 1500)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, k, block, held):
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", block)
    monkeypatch.setattr(minhash, "FAMILY_SHINGLES", held)
    rows = near_corpus()
    sets, component = brute_near(rows, k, 80)
    docs = spark.createDataFrame(rows, DOCS).withColumn("keys", F.lit("clash")).repartition(5)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, k, 80).collect()}
    assert {i: r.component_id for i, r in got.items()} == component
    assert all(r.n_shingles == len(sets[i]) and r.kept == (component[i] == i) for i, r in got.items())


@pytest.mark.parametrize("often", [1, 3, 10, 10**9])
@pytest.mark.parametrize("cells", [7, 100, 4_000_000])
def test_elements_in_common_are_counted_alike_by_products_and_by_holders(monkeypatch, often, cells):
    monkeypatch.setattr(minhash, "OFTEN", often)
    monkeypatch.setattr(minhash, "PRODUCT_CELLS", cells)
    draw = np.random.default_rng(often % 97)
    sets = [np.unique(draw.integers(0, 60, draw.integers(0, 40)).astype(np.uint64)) for _ in range(25)]
    sizes = np.array([len(s) for s in sets])
    asked = np.flatnonzero(sizes)[::2]
    found = list(minhash._in_common(sets, sizes, asked))
    assert len(found) == len(asked) > 5
    for i, common in zip(asked.tolist(), found, strict=True):
        assert all(common[j] == len(np.intersect1d(sets[i], sets[j])) for j in range(25) if j != i)
    assert list(minhash._in_common([np.empty(0, np.uint64)] * 2, np.zeros(2, np.int64), np.empty(0, np.int64))) == []


def test_near_duplicates_without_broadcast_and_with_null_ids(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (4, text + " more"), (9, text), (9, text), (None, "all alone in here"), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("4", 48, "4", True), ("9", 47, "4", False), ("9", 47, "4", False), ("None", 0, "None", False), ("None", 1, "None", False), ("None", 47, "4", False)]


def test_signatures_keep_the_pigeonhole():
    """Signatures that differ in as many symbols as the bound allows still share a key."""
    rnd = np.random.default_rng(3)
    bound = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    for _ in range(200):
        a = rnd.integers(0, 1 << minhash.SYMBOL_BITS, (1, minhash.SYMBOLS)).astype(np.uint64)
        b = a.copy()
        b[0, rnd.permutation(minhash.SYMBOLS)[:bound]] ^= np.uint64(1)
        assert set(minhash.index_keys(a)[0].tolist()) & set(minhash.index_keys(b)[0].tolist())


# --- vectors


def test_lattice_decoding_is_nearest():
    rnd = np.random.default_rng(1)
    y = rnd.normal(size=(300, 8)) * 2
    point = lattice.decode(y)
    assert (np.sum(point, axis=1) % 2 == 0).all() and ((point * 2) % 1 == 0).all()
    for v in lattice.SHORTEST:
        assert ((y - point) ** 2).sum(axis=1).max() <= 1 + 1e-9  # the covering radius
        assert (((y - point) ** 2).sum(axis=1) <= ((y - point - v) ** 2).sum(axis=1) + 1e-9).all()


@pytest.mark.parametrize("of", lattice.RESOLUTIONS)
@pytest.mark.parametrize("length", [16, 64, 768])
def test_recall_at_just_the_least_cosine(of, length):
    rnd = np.random.default_rng(length)
    a, r = rnd.normal(size=(2, 400, length))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    hasher = lattice.Hasher(length, of)
    (own_a, look_a), (own_b, look_b) = hasher.cells(a), hasher.cells(0.9 * a + np.sqrt(0.19) * r)
    assert all(set(o) <= set(c) for o, c in zip(own_a.tolist(), look_a.tolist(), strict=True)) and look_a.shape == (400, hasher.tables * (of.probes + 1))
    found = [bool(set(x) & set(v) or set(y) & set(u)) for x, u, y, v in zip(own_a.tolist(), look_a.tolist(), own_b.tolist(), look_b.tolist(), strict=True)]
    assert np.mean(found) >= 0.98 - 0.007  # of 400


def test_unrelated_vectors_meet_seldom_at_each_size():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for of in lattice.RESOLUTIONS[:4]:
        own, looked = lattice.Hasher(64, of).cells(x)
        keys, holders = np.unique(own, return_counts=True)
        at = np.minimum(np.searchsorted(keys, looked), len(keys) - 1)
        met = (holders[at] * (keys[at] == looked)).sum() - own.size
        assert met / len(x) ** 2 * of.upto < 12


def test_pivots_are_compared_in_bounded_blocks(monkeypatch):
    rnd = np.random.default_rng(3)
    family = lattice._Family()
    family.pivots = [np.unique(rnd.integers(0, 400, 30)) for _ in range(50)]
    want = np.array([[len(set(a[a < 300]) & set(b[b < 300])) > 0 for b in family.pivots] for a in family.pivots])
    for columns in (7, 2048):
        monkeypatch.setattr(lattice, "_COLUMNS", columns)
        got = family._met_before(300, 50)
        assert (got == want)[~np.eye(50, dtype=bool)].all()


def vectors(seed=5):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(40, 64))
    rows = []
    for i in range(700):
        c = centres[rnd.integers(40)]
        v = c / np.linalg.norm(c) + rnd.normal(size=64) * rnd.uniform(0.0, 0.07)
        rows.append((i, v.astype(np.float32).astype(float).tolist()))
    return rows


@pytest.mark.parametrize("block, of", [(1024, 0), (24, 0), (1024, 2)])
def test_vectors_against_brute_force(spark, monkeypatch, block, of):
    monkeypatch.setattr(lattice, "FAMILY_BLOCK", block)
    monkeypatch.setattr(lattice, "RESOLUTIONS", lattice.RESOLUTIONS[of:])
    rows = vectors()
    rows += [(800 + i, rows[3][1]) for i in range(30)] + [(850, [2 * x for x in rows[3][1]])]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    ids = [i for i, _ in rows]
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0, None] * 32), (904, []), (905, [1.0, 2.0]), (906, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cells", F.lit(1)).repartition(3)
    got = {r.vec_id: r for r in lattice.near_vectors(df).collect()}
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    want = dict(zip(ids, near.sum(axis=1) - 1, strict=True))
    found, all_links = sum(got[i].n_links for i in ids), 2 * len(links)
    assert all(got[i].n_links <= want[i] for i in ids) and found >= 0.98 * all_links > 1000
    if found == all_links:
        assert {i: got[i].component_id for i in ids} == least_reachable(ids, links)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)


def test_a_vector_is_sent_to_few_cells():
    for of in lattice.RESOLUTIONS:
        assert of.tables * (of.probes + 1) < 100


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_are_sent_in_bounded_parts(spark, monkeypatch, kind):
    monkeypatch.setattr(lattice, "ROOM", 0)
    monkeypatch.setattr(lattice, "LEAST_ROOM", 1 << 20)
    monkeypatch.setattr(lattice, "FAMILY_BLOCK", 100)
    dealt, sent = lattice._dealt, []

    def counted(*args):
        for part in dealt(*args):
            sent.append(part.count() / args[5])
            yield part

    monkeypatch.setattr(lattice, "_dealt", counted)
    before = spark.conf.get(_store._TIDY)
    rows = vectors()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()}
    assert len(sent) > 6 and max(sent) < 1.5 and spark.conf.get(_store._TIDY) == before
    want = near.sum(axis=1) - 1
    assert all(got[i].n_links <= want[i] for i in got) and sum(r.n_links for r in got.values()) >= 0.99 * want.sum() > 1000
    if sum(r.n_links for r in got.values()) == want.sum():
        assert {i: r.component_id for i, r in got.items()} == least_reachable(range(len(rows)), links)


def test_a_pair_is_counted_in_the_least_cell_it_shares(monkeypatch):
    monkeypatch.setattr(lattice, "_TILE", 8)
    rnd = np.random.default_rng(6)
    x = np.repeat(rnd.normal(size=(6, 16)), 20, axis=0) + rnd.normal(size=(120, 16)) * 0.1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    # Half of them share a cell throughout, as a group of near copies does.
    held = [np.unique(np.append(rnd.integers(0, 30, 5), [3] * (i % 2))) for i in range(120)]
    copies = rnd.integers(1, 4, 120)
    near = (u @ u.T >= 0.9) & [[bool(set(a) & set(b)) for b in held] for a in held]
    np.fill_diagonal(near, False)
    number, edges, may = np.zeros(120, int), [], set()
    for cell in range(30):
        family = lattice._Family()
        of = [i for i in range(120) if cell in held[i]]
        family.ids, family.sides, family.copies, family.vectors, family.pivots = of, [0] * len(of), copies[of].tolist(), list(x[of]), [held[i] for i in of]
        for a, b, n in family.compare(cell, True, 0.9):
            if b is None:
                number[a] += n
            else:
                edges.append((a, b))
        if of:
            may |= set(lattice._linked(np.array(of), np.zeros(len(of), int), u[of].astype(np.float32), True, 0.9).tolist())
    assert (number == near @ copies).all() and may == set(np.flatnonzero(near.any(axis=1)).tolist())
    assert all(near[a, b] for a, b in edges)
    assert least_reachable(range(120), edges) == least_reachable(range(120), list(zip(*np.nonzero(near), strict=True)))


def test_vectors_with_null_ids_and_no_rows(spark):
    v = [1.0] + [0.0] * 63
    df = spark.createDataFrame([(None, v), (3, v), (None, None)], "vec_id long, embedding array<double>")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lattice.near_vectors(df).collect()) == [
        ("3", 1, "3", True), ("None", 0, "None", False), ("None", 1, "3", False)
    ]
    assert lattice.near_vectors(df.limit(0)).count() == 0


# --- chats


CONTROL = ["<|im_end|>", "<|im_start|>assistant\n", "<|", "<\\|", "<\\\\|image|>", "<|image|>", "\\", "\n", "|>", "é", "a", ""]


def test_escape_is_reversible():
    rnd = random.Random(9)
    for _ in range(3000):
        text = "".join(rnd.choice(CONTROL) for _ in range(rnd.randrange(8)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
        formatted, lo, hi, _ = chat.format_turn(text, [{"type": "text", "text": text}])
        assert chat.parse_turn(formatted) == (text, text) and chat.unescape(formatted[lo:hi]) == text


def test_chat_query_against_python(spark, tmp_path):
    rnd = random.Random(10)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool\nx", None]), "".join(rnd.choice(CONTROL) for _ in range(6)) or None) for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t} ") for t in range(1500)] + [(None, 0, "user", "x")]
    rnd.shuffle(rows)
    path = table(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, path).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        everything = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(everything), len(loss), sha(loss))
        assert r.formatted_chars == sum(len(chat.format_turn(r or "", [{"type": "text", "text": t}])[0]) for _, _, r, t in turns)
    assert len(got) == len({r[0] for r in rows})


def test_chat_ties_and_empty_tables_equal_the_sql(spark, tmp_path):
    import duckdb

    from tidemark.llm import oracle

    rows = [(1, 0, "assistant", t) for t in ("a!", "a", "a#", 'a"', None, "", "é", "a\n", "\\")] + [(1, 0, None, "b"), (1, 0, "", "a"), (1, None, "user", "late"), (None, 0, "user", "x"), (2, 5, "user", None)]
    for part in (rows, []):
        path = table(spark, tmp_path, "conversations", part, "conv_id long, turn long, role string, text string")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
        got = queries.op3_chat_format(spark, path)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle.ORACLE_SQL['op3_chat_format']})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_shifted_mask_is_read_as_it_is(spark):
    rows = [(1, 0, "user", "question"), (1, 1, "assistant", "<|answer|>"), (1, 2, "assistant", "more")]
    turns = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    right = chat.read_back(turns).first()
    assert right.loss_sha256 == hashlib.sha256(b"<|answer|>more").hexdigest() and right.loss_chars == 14
    for start, end in ((1, 0), (0, -1), (-1, -1)):
        moved = turns.withColumn("loss_start", F.col("loss_start") + start).withColumn("loss_end", F.col("loss_end") + end)
        assert chat.read_back(moved).first().loss_sha256 != right.loss_sha256


def test_chat_parts(spark):
    parts = [
        {"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "s3://a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 1.5},
        {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": " end"}, {"type": "video", "text": "?"}, None,
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    one, two = chat.format_chat(df).collect()
    assert [(a.type, a.ref, a.tokens) for a in one.attachments] == [("image", "s3://a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 3000)]
    for a in one.attachments:
        assert one.formatted[a.start :].startswith(chat.PLACEHOLDERS[a.type])
    assert one.attachment_tokens == 3041 and one.loss_start is None
    assert chat.parse_turn(one.formatted) == ("user", "see <|image|>  end?")
    whole = one.formatted + two.formatted
    assert two.start == len(one.formatted) and whole[two.loss_start : two.loss_end] == ""


# --- pages


def test_page_structure():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>menu</nav>
    <div class="cookie-notice">We use cookies</div><!-- <p>gone</p> --><article><header><h1>Head &amp; line</h1><p>By A</p></header>
    <p><b>One<br>two <i>th</i>ree<p>Next&nbsp;para &lt;b&gt;</p><ul><li>a<li>b</ul><div class="ad">buy</div><script>var t="</p>";</script>
    <section id="comments"><article class="comment"><p>first!</p></article></section><form><p>mail?</p></form><footer>f</footer></article>
    <aside>side</aside><footer>&copy; me</footer></body></html>"""
    assert html.main_text(page) == "Head & line\nOne two three\nNext para <b>\na\nb"
    assert html.main_text("<p>plain <p>page</p> tail <div hidden>x</div>") == "plain\npage\ntail"
    assert html.main_text("<div class=ad><article><p>left open") == "left open"
    assert html.main_text("<form><nav>m</nav><article><p>in a form<aside>s</aside></article></form>") == "in a form"
    assert html.main_text("a < b & c") == "a < b & c" and html.main_text("") == html.main_text(None) == ""
    assert html.main_text("<p>x</p>" + "<div>" * 3000 + "deep") == "x\ndeep"


@pytest.mark.parametrize(
    "middle",
    ["<svg-icon name=x></svg-icon>", "<svg/>", "<svg viewBox='0 0 1 1' />", "<button-group></button-group>", "<template-x></template-x>", "<iframe src='x'/>", "<button>Share",
     "<select><option>a<option>b", "<button/>", "<noscript><img src=x>", "<script-x></script-x>", "<button><div>Share</div></button>", "<button>A<button>B</button>", "<SVG><g><svg></svg>t</g></SVG>"],
)
def test_skipped_elements_do_not_cut_the_page(middle):
    assert html.main_text(f"<article><p>one</p>{middle}<p>two</p><p>three</p></article><p>out</p>") == "one\ntwo\nthree"


def test_template_paragraphs_inside_a_main_part(spark):
    pages = []
    for h, (tag, end) in enumerate([("<main>", "</main>"), ("<div class=content>", "</div>"), ("<article>", "</article>")]):
        pages += [(h * 100 + i, f"https://h{h}/", f"{tag}<p>Join our list</p>{'<p>often</p>' if i % 2 else ''}<p>own text {i}</p>{end}") for i in range(10)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(10):
        often = "often\n" if i % 2 else ""
        assert got[i] == got[100 + i] == f"{often}own text {i}" and got[200 + i] == f"Join our list\n{often}own text {i}"


def test_skipped_elements_within_a_line():
    assert html.main_text("<p>see <svg><title>t</title><path/></svg> this <button type=button><p>x</p></button>line</p>") == "see this line"
    assert html.main_text("<div><button>Share</div><p>x</p><div></button>y</div>") == "x\ny"
    assert html.main_text("<ul><li>a<button>b<p>c</button>d<li>e</ul>") == "a d\ne"
    assert html.main_text("<p>a<script>x</script foo>b</p>" + "<button>" * 20_000) == "a b"



@pytest.mark.parametrize(
    "page, text",
    [('<main class="has-sidebar"><p>body text here</p></main>', "body text here"), ('<div class="elementor-widget-container"><p>the article</p></div>', "the article"),
     ('<div class="hidden-print"><p>x y z</p></div>', "x y z"), ('<div class="layout with-sidebar"><div class="entry-content"><p>body</p></div></div>', "body"),
     ('<div class="sidebar">all there is</div>', "all there is"), ('<p>the page has a text of its own</p><div class="main-nav">a b</div><div id="ad">c</div>', "the page has a text of its own"),
     ('<div class="content"><p>short</p></div><div class="comment-list">' + "<p>I say so too</p>" * 2 + "</div>", "short"), ('<div class="site-header">S</div><p>some text</p>', "some text")],
)
def test_names_are_weak_evidence(page, text):
    assert html.main_text(page) == text


LONG_PAGES = ["<a ", "<div>x", '<a "', "<!", '<a "><a" ', "<script ", "<svg>", "<p><b>", "<td>", "<table><tr><td>", "<li>", "</div>", "<button><div>", "<table><button>", "<td></select>", "<!-- ", "&amp"]


@pytest.mark.parametrize("piece", LONG_PAGES)
def test_time_follows_the_length_of_malformed_pages(piece):
    long = "<p>first</p>" + piece * (1_000_000 // len(piece))
    begun = time.perf_counter()
    assert html.main_text(long).startswith("first")
    assert html.subtree_hashes(long)
    assert time.perf_counter() - begun < 20


def test_counting_alone_removes_templates(spark):
    """Plain elements without telling tags or names, counted by brute force over the pages' block elements."""
    rnd = random.Random(6)
    pool = [f"line {i}" for i in range(12)]
    pages = []
    for i in range(60):
        recurring = [t for t in pool if rnd.random() < (0.5 if int(t[5:]) % 3 == 0 else 0.08)]
        page = "".join(f"<div>{t}</div>" for t in recurring) + f"<section><div>own {i}</div><div>line {i % 12} again</div></section>"
        pages.append((i, f"https://h{i % 2}.example/{i}", page))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    removed = 0
    for i, _, page in pages:
        blocks, mates = re.findall("<div>([^<]*)</div>", page), [p for j, _, p in pages if j % 2 == i % 2]
        share = {t: sum(f"<div>{t}</div>" in p for p in mates) for t in blocks}
        want = [t for t in blocks if not (share[t] >= 5 and share[t] >= 0.2 * len(mates))]
        removed += len(blocks) - len(want)
        assert got[i] == "\n".join(want)
        assert html.main_text(page) == "\n".join(blocks)
    assert removed > 60


def test_copies_of_an_article_are_not_its_template(spark):
    pages = [(i, "https://a.example/", f"<nav>menu {i}</nav><div class=wrap><div><article><div>one</div><p>text</p></article></div><div>notice</div></div>") for i in range(8)]
    pages += [(10 + i, "https://a.example/", f"<div><article><p>other {i}</p></article></div><div>notice</div>") for i in range(12)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "one\ntext" for i in range(8)) and all(got[10 + i] == f"other {i}" for i in range(12))


def test_site_templates(spark):
    pages = []
    for i in range(30):
        page = f"<div><p>Call us now</p><span>always</span></div><p>own text {i}</p><div>rare {i % 15}</div>"
        pages.append((i, "https://A.example/x" if i % 2 else "http://a.example/y?z", page))
    pages += [(100 + i, "https://b.example/", "<div>Call us now</div><p>same page</p>") for i in range(20)]  # one content
    pages += [(200, None, "<p>no url</p>"), (201, "not a url", None), (202, "https://a.example", "")]
    pages += [(300 + i, "https://c.example/", f"<article><div>Sign up</div><p>quoted by all</p><p>{i}</p></article>") for i in range(10)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got[4] == ("own text 4\nrare 4", 17)
    assert got[100][0] == "Call us now\nsame page" and got[200][0] == "no url" and got[201] == got[202] == ("", 0)
    assert got[303][0] == "quoted by all\n3"
    assert len(got) == len(pages)
    assert html.extract(df.limit(0)).count() == 0


# --- pipeline


def pipeline_docs():
    rnd = random.Random(12)
    words = {"en": "the of and to in that with for this house water street".split(), "de": "der die und das ist nicht mit von Haus Wasser Straße".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rnd.choice(words[lang]) + (str(rnd.randrange(99)) if rnd.random() < 0.3 else "") for _ in range(60)), lang, f"s{i % 4}", 1))
    rows += [(500, rows[0][1], "de", "s0", 1), (501, None, None, "s0", None), (502, "", "en", None, 0), (503, "123 456", "en", "s1", 7), (None, rows[1][1] + " x", "en", "s1", 1)]
    item = " ".join(f"item{j}" for j in range(20))
    rows += [(504, rows[2][1] + " " + item, "de", "s2", 1), (505, " ".join(reversed(rows[3][1].split())) + " token = abcdefgh12345678 end", "en", "s3", 1), (500, rows[0][1], "de", "s0", 1)]
    return rows, item


def test_pipeline_stages(spark, tmp_path):
    rows, item = pipeline_docs()
    path = table(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    table(spark, tmp_path, "benchmark", [(1, item)], "item_id long, text string")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "redact", "mix"]
    docs, kept = spark.read.parquet(f"{path}/documents.parquet").withColumn("score", F.lit(3)), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mix":
            assert docs.columns == columns
        kept[name] = docs
    ids = {n: {r.doc_id for r in d.collect()} for n, d in kept.items()}
    assert ids["language"] == {r[0] for r in rows} - {501, 502, 503}
    assert ids["near_dedup"] == ids["language"] - {500}
    assert ids["decontaminate"] == ids["near_dedup"] - {504}
    (text,) = [r.text for r in kept["redact"].filter("doc_id = 505").collect()]
    assert "[SECRET]" in text and "abcdefgh12345678" not in text
    assert kept["mix"].groupBy("doc_id", "text", "copy").count().filter("count > 1").count() == 0
    whole = corpus_pipeline.run(spark, path).select("doc_id", "text", "copy").collect()
    assert sorted(map(str, whole)) == sorted(str(r) for r in kept["mix"].select("doc_id", "text", "copy").collect())


def test_pipeline_keeps_one_of_repeated_ids_and_empty_tables(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en"), (1, text, "en"), (2, text + " x", "en"), (3, "other words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    table(spark, tmp_path, "benchmark", [], "item_id long, text string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
