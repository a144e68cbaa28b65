"""Small tests of the training-data operators against brute force and odd input."""

import hashlib
import math
import random
import re
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quern.llm import (
    common, components, decontamination, exact_dedup, html_text, lm, pieces, pii, quality, sharding, simhash, toxicity,
)
from quern.llm.common import Workspace

DOCS = "doc_id long, text string, norm string, digest string, n long"
LONG = "word " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [
        (1, "Same Text here", "a", "b", 1), (2, "same text HERE", None, None, None), (2, "same text HERE", None, None, None),
        (3, None, "x", "y", 3), (4, "", "x", "y", 3), (None, "alone", "x", "y", 3), (5, LONG, "x", "y", 3), (6, LONG + "end", "", "", 0),
        (7, "ÄÖ same", "x", "y", 3), (8, "äö same", "x", "y", 3), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, k % 2) for k in range(1, 9)] + [(99, 1, 1), (None, 1, 0), (1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- sharding


def test_shards_against_a_walk_of_single_keys(spark, odd):
    got = sharding.shard(spark, odd, 4, 8).collect()
    circle = sharding.ring(4, 8)
    keys = sorted((sharding.place("" if r.doc_id is None else str(r.doc_id)), r.doc_id or 0, r.text_crc32, r.size) for r in got)
    room, waiting = sharding.bounds(len(got), 4), defaultdict(list)
    for k in keys:
        at = next((i for i, (p, _) in enumerate(circle) if p >= k[0]), 0)
        waiting[at].append(k)
    want = Counter()
    while waiting:
        moved = defaultdict(list)
        for at in sorted(waiting):
            shard = circle[at][1]
            for k in waiting[at]:
                if room[shard]:
                    room[shard] -= 1
                    want[(k, shard)] += 1
                else:
                    moved[(at + 1) % len(circle)].append(k)
        waiting = moved
    seen = Counter(((sharding.place("" if r.doc_id is None else str(r.doc_id)), r.doc_id or 0, r.text_crc32, r.size), r.shard) for r in got)
    assert seen == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert {r.size for r in got if r.doc_id in (3, 4)} == {1}


def test_a_new_shard_moves_little(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    a = {r.doc_id: r.shard for r in sharding.shard(spark, rows, 16).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(spark, rows, 17).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.25 * len(a)


def test_one_id_on_very_many_rows(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "if(id % 2 = 0, 'x', cast(id as string)) as text")
    got = sharding.shard(spark, rows, 7, hot=2.0)
    sizes = {r.shard: (r.n, r.least, r.most, r.slots) for r in got.groupBy("shard").agg(
        F.count("*").alias("n"), F.min("slot").alias("least"), F.max("slot").alias("most"), F.countDistinct("slot").alias("slots")).collect()}
    assert sum(n for n, *_ in sizes.values()) == 30_000 and max(n for n, *_ in sizes.values()) - min(n for n, *_ in sizes.values()) <= 1
    assert all((least, most, slots) == (0, n - 1, n) for n, least, most, slots in sizes.values())
    assert got.groupBy("doc_id", "size", "text_crc32").count().exceptAll(
        rows.selectExpr("doc_id", "cast(octet_length(text) + 1 as bigint) size", "crc32(cast(text as binary)) text_crc32").groupBy("doc_id", "size", "text_crc32").count()
    ).count() == 0


def test_no_rows(spark, none, labels):
    assert sharding.shard(spark, none).count() == 0
    assert exact_dedup.dedup(spark, none).count() == 0
    assert simhash.near_groups(spark, none).count() == 0
    assert lm.score(spark, none).count() == 0
    assert pii.scan(none).count() == 0
    assert quality.score(spark, none, labels).count() == 0
    assert toxicity.score(spark, none, labels).count() == 0
    assert pieces.encode(spark, none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan(spark, none, bench).count() == 0


# ---------------------------------------------------------------- exact dedup


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r.text)].append(r.doc_id)
    return groups


def check_dedup(rows, got):
    groups = expected_groups(rows)
    assert len(got) == len(rows)
    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert sum(r.kept for r in got) == len(groups)
    for r in got:
        ids = [i for i in by[r.text_sha256] if i is not None]
        assert r.keep_id == (max(ids) if ids else None)
        assert r.group_size == len(by[r.text_sha256])


def test_exact_dedup(spark, odd):
    check_dedup(odd.collect(), exact_dedup.dedup(spark, odd).collect())
    kept = exact_dedup.keep_first(spark, odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(expected_groups(odd.collect()))


def multiplied(spark, tmp_path):
    """Frames whose rows are more than the stored ones: exploded, joined, a file read twice."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(k, f"some words of text {k // 2}") for k in range(20)], "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    return {
        "exploded": docs.selectExpr("*", "explode(array(1, 2, 3)) as copy"),
        "joined": docs.join(spark.range(3).selectExpr("id as other"), exploded_condition(docs), "inner"),
        "twice": spark.read.parquet(path, path),
        "union": docs.union(docs),
        "random": docs.where("rand() >= 0").where("doc_id >= 0"),
    }


def exploded_condition(docs):
    return docs.doc_id >= 0


def test_rows_that_a_plan_multiplies_are_rows_of_their_own(spark, tmp_path):
    for name, docs in multiplied(spark, tmp_path).items():
        kept = exact_dedup.keep_first(spark, docs)
        assert (kept.columns, kept.count()) == (docs.columns, 10), name
        if name not in ("exploded", "twice"):
            continue
        got = exact_dedup.dedup(spark, docs).collect()
        assert (len(got), sum(r.kept for r in got)) == (docs.count(), 10), name
        groups = simhash.near_groups(spark, docs).select("component_id").distinct().count()
        assert simhash.keep_first(spark, docs).count() == groups, name


def test_columns_of_any_name_come_back(spark, tmp_path):
    path = str(tmp_path / "odd")
    rows = [(1, "a b c", "mine", 7, "meta", 1.5, "T"), (2, "a b c", "mine", 8, "meta", 2.5, "T"), (3, None, "mine", 9, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, _file string, _row long, _metadata string, c0 double, digest string").write.parquet(path)
    docs = spark.read.parquet(path)
    bench = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    twice = docs.join(docs.select("doc_id", F.col("_file").alias("TEXT")), "doc_id").select("*")
    for frame, n, ways in ((docs, 2, (exact_dedup, simhash)), (twice, 2, (exact_dedup,))):
        for out in (way.keep_first(spark, frame) for way in ways):
            assert out.columns == frame.columns and out.count() == n
            assert {r._file for r in out.select("_file").collect()} == {"mine"}
        assert decontamination.clean(spark, frame, bench).columns == frame.columns
        assert decontamination.clean(spark, frame, bench).count() == 3
    assert quality.keep_good(spark, docs, no_labels).columns == docs.columns


def test_many_hits_are_joined_instead_of_mapped(spark, odd, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 1)
    check_dedup(odd.collect(), exact_dedup.dedup(spark, odd).collect())


def test_exact_dedup_checks_bytes_behind_a_weak_digest(spark, odd):
    weak = lambda c: exact_dedup.F.substring(exact_dedup.sha256(c), 1, 1)
    got = exact_dedup.dedup(spark, odd, digest=weak).collect()
    groups = expected_groups(odd.collect())
    assert sum(r.kept for r in got) == len(groups)
    assert Counter(r.group_size for r in got) == Counter(len(v) for v in groups.values() for _ in v)


def test_exact_dedup_goes_on_with_its_state(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "X"), (4, "z")], "doc_id long, text string")
    d = exact_dedup.StreamingDeduplicator(spark)
    d.ingest(a)
    d.ingest(b)
    assert {r.doc_id: r.keep_id for r in d.result().collect()} == {1: 3, 2: 2, 3: 3, 4: 4}


def test_dedup_bounds_the_memory_of_its_stores(spark, monkeypatch):
    seen, save = {}, type(spark.conf).set

    def noted(conf, key, value):
        seen[key] = value
        save(conf, key, value)

    monkeypatch.setattr(type(spark.conf), "set", noted)
    d = exact_dedup.StreamingDeduplicator(spark)
    d.ingest(spark.createDataFrame([(k, f"text {k % 7}") for k in range(50)], "doc_id long, text string"))
    d.ingest(spark.createDataFrame([(99, "TEXT 3")], "doc_id long, text string"))
    store = "spark.sql.streaming.stateStore"
    assert seen[f"{store}.unloadOnCommit"] == seen[f"{store}.rocksdb.boundedMemoryUsage"] == "true"
    got = {r.doc_id: (r.keep_id, r.group_size) for r in d.result().collect()}
    assert got[99] == got[3] == (99, 8) and got[0] == (49, 8) and len(got) == 51


# ---------------------------------------------------------------- Python workers


@pytest.fixture
def caught(spark, monkeypatch):
    """The functions that frames would send to Python workers, in order."""
    found, frame = [], type(spark.range(0))
    send = frame.mapInArrow

    def noted(df, fn, *rest, **more):
        found.append(fn)
        return send(df, fn, *rest, **more)

    monkeypatch.setattr(frame, "mapInArrow", noted)
    return found


def test_workers_let_go_of_what_another_operator_held(spark, caught, monkeypatch):
    made = []
    for module, name in ((pieces, "Pieces"), (decontamination, "Matcher")):

        class Noted(getattr(module, name)):
            def __init__(self, *args):
                super().__init__(*args)
                made.append(weakref.ref(self))

        monkeypatch.setattr(module, name, Noted)
    docs = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    batch = pa.record_batch({"doc_id": [1, 2], "text": ["one two three four", None]})
    plain = pa.record_batch({"c0": [1, 2], "c1": ["one two three four", None]})
    placed = batch.append_column("_file", pa.array(["f", "f"])).append_column("_row", pa.array([0, 1]))
    alive = lambda: [x() is not None for x in made]

    def run(batch):
        return list(caught[-1](iter([batch])))

    pieces.encode(spark, docs)
    first, _ = run(batch), run(batch)
    assert alive() == [True]  # units stay remembered between tasks
    simhash.fingerprints(docs.withColumns({"_file": F.lit("f"), "_row": F.lit(0)}))
    run(placed)
    assert alive() == [False]
    decontamination.clean(spark, docs, items)
    assert [b.num_rows for b in run(plain)] == [1] and alive() == [False, True]
    pieces.encode(spark, docs)
    assert run(batch) == first and alive() == [False, False, True]
    quality.keep_good(spark, docs, spark.createDataFrame([], "doc_id long, quality int"))
    run(plain)
    assert alive() == [False, False, False]


def test_quality_learns_in_one_python_pass(spark, caught):
    rows = [(k, f"Word {k} and {'more ' * (k % 9)}{k * k}.{'!?' * (k % 4)}") for k in range(60)] + [(61, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(k, int(k % 4 < 2)) for k in range(0, 62)] + [(3, 0), (3, 0), (9, 1), (8, None), (7, 5), (None, 1), (99, 1)]
    model = quality.learn(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    assert len(caught) == 1
    text, wanted = dict(rows), {}
    for c in (0, 1):
        x = np.array(
            [quality.statistics(text[k]) for k, y in marks if y == c and k in text and k is not None and zlib.crc32(str(k).encode()) % 5]
        )
        wanted[c] = (len(x), x.sum(axis=0), x.T @ x)
    right = quality.Discriminant.fit(wanted)
    x = np.array([quality.statistics(t) for _, t in rows])
    assert model.prior == right.prior and np.allclose(model.score(x), right.score(x))


# ---------------------------------------------------------------- language model


def test_lm_base_and_normalisation(spark, odd):
    got = lm.score(spark, odd, head_size=3).collect()
    rows = odd.collect()
    words = [lower(r.text).encode().split() + [b""] for r in rows]
    train = [zlib.crc32(str(r.doc_id).encode()) % 5 != 1 if r.doc_id is not None else True for r in rows]
    c = Counter(w for ws, t in zip(words, train) if t for w in ws)
    n, v = sum(c.values()), len(c)
    base = sorted(round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4) for ws in words)
    assert sorted(round(r.base_score, 4) for r in got) == base
    assert sorted(r.n_known for r in got) == sorted(sum(c[w] > 0 for w in ws) for ws in words)
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_network_probabilities_add_up_and_learn():
    rng = np.random.default_rng(0)
    k = 40
    net = lm.LogBilinear([bytes([97 + j % 7, 97 + j // 7]) for j in range(k)], np.ones(k), 16)
    a, b = rng.integers(1, k, 60_000), rng.integers(1, k, 60_000)
    w = 1 + (b * 7) % (k - 1)  # what follows depends on the last symbol alone
    before = net.log10(a[:500], b[:500], w[:500]).mean()
    for at in range(0, len(w), 512):
        net.step(a[at : at + 512], b[at : at + 512], w[at : at + 512], rng)
    assert net.log10(a[:500], b[:500], w[:500]).mean() > before + 0.5
    every = np.arange(1, k)
    for _ in range(50):
        x, y = rng.integers(0, k, 2)
        assert (10 ** net.log10(np.full(k - 1, x), np.full(k - 1, y), every)).sum() == pytest.approx(1, abs=1e-4)
    twin = lm.LogBilinear([bytes([97 + j % 7, 97 + j // 7]) for j in range(k)], np.ones(k), 16)
    twin.unpack(np.frombuffer(net.packed(), np.float32))
    assert np.allclose(twin.log10(a[:9], b[:9], w[:9]), net.log10(a[:9], b[:9], w[:9]))


def test_lm_sums_to_one_over_words(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    texts = [(k, " ".join(rng.choice(vocab) for _ in range(30))) for k in range(60)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "0 as fold", "text")
    model = lm.train(rows, lm.word_counts(rows.select("fold", "text")))
    c = Counter(w for _, t in texts for w in lm.words_of(t) + [b""])
    assert model.head == c and model.types == len(c)
    of, shared = model.symbols.of, model.symbols.shared
    words = [w for w in c if w]
    for x in range(0, model.symbols.size, 7):
        for y in (lm.BEGIN, 3, model.symbols.size - 1):
            every = np.arange(1, model.symbols.size)
            p = 10 ** (model.net.log10(np.full(len(every), x), np.full(len(every), y), every) - model.log10_room[every])
            p = dict(zip(every.tolist(), p))
            total = p[lm.END] + sum(p[of(w)] * ((c[w] + 0.5) if of(w) >= shared else 1) for w in words)
            total += sum(0.5 * p[s] for s in every.tolist() if s >= shared)  # one unknown word a symbol
            assert total == pytest.approx(1, abs=1e-4)
    one = lm.Scorer(model)([texts[0][1], None, "a " + vocab[0]])
    assert [x[0] for x in one] == [31, 1, 3]
    symbols = [lm.BEGIN, lm.BEGIN, *(of(w) for w in lm.words_of(texts[0][1])), lm.END]
    by_hand = sum(
        model.net.log10(np.array([a]), np.array([b]), np.array([w]))[0] - model.log10_room[w] for a, b, w in zip(symbols, symbols[1:], symbols[2:])
    ) + sum(math.log10(c[w] + 0.5) for w in lm.words_of(texts[0][1]) if of(w) >= shared)
    assert one[0][3] == pytest.approx(by_hand, abs=1e-3)


def test_network_is_trained_on_every_context(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None]
    rows = spark.createDataFrame([(k % 5, t) for k, t in enumerate(texts)], "fold long, text string")
    found, step = Counter(), lm.LogBilinear.step

    def noted(net, a, b, w, *rest):
        found.update(zip(a.tolist(), b.tolist(), w.tolist()))
        step(net, a, b, w, *rest)

    class Here:
        def get():
            return Here

        def partitionId():
            return 0

    def here(df, fn, schema):
        kind = to_arrow_schema(_parse_datatype_string(schema))
        made = fn(iter(df.toArrow().to_batches()))
        made = [pa.record_batch([common._column(out[f.name], f.type) for f in kind], schema=kind) for out in made]
        return spark.createDataFrame(pa.Table.from_batches(made, kind))

    monkeypatch.setattr(lm.LogBilinear, "step", noted)
    monkeypatch.setattr(lm, "TaskContext", Here)
    monkeypatch.setattr(lm, "map_batches", here)
    model = lm.train(rows, lm.word_counts(rows))
    wanted = Counter()
    for k, t in enumerate(texts):
        s = [lm.BEGIN, lm.BEGIN, *map(model.symbols.of, lm.words_of(t)), lm.END]
        if k % 5 != lm.HELD_OUT:
            wanted.update(zip(s, s[1:], s[2:]))
    passes = found.total() // wanted.total()
    assert passes >= 1 and found == Counter({c: n * passes for c, n in wanted.items()})


# ---------------------------------------------------------------- personal data


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if (12 <= len(d) <= 19 and pii.luhn(d)) if kind == 2 else 9 <= len(d) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns_against_regular_expressions():
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("a1 .@-+()0492é") for _ in range(rng.randint(0, 40)))
        assert brute_pii(t) == pii.patterns(t), t
    assert pii.patterns("a" * 200_000 + "1" * 200_000) == []


def test_tagger_gradients():
    tagger = pii.Tagger(width=4, hidden=3)
    texts, spans = pii.labelled(3, 2)
    x, y = pii.coded(texts)[:, :12], pii.tagged(spans)[:, :12]
    y[:, 0] = np.where((y[:, 0] > 0) & (y[:, 0] % 2 == 0), y[:, 0] - 1, y[:, 0])
    _, g = tagger.gradients(x, y)
    for name, p in tagger.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), p.shape)
        old, two = p[at], []
        for step in (1e-5, -1e-5):
            p[at] = old + step
            two.append(tagger.gradients(x, y)[0])
        p[at] = old
        assert abs((two[0] - two[1]) / 2e-5 - g[name][at]) < 1e-4 * max(1, abs(g[name][at]))


def test_pii_on_odd_rows_and_base_spans_stay(spark, odd):
    assert pii.scan(odd).count() == odd.count()
    rows = spark.createDataFrame([(1, "mail a.b@c.de or +1 (206) 555-7479, ip 10.0.0.1")], "doc_id long, text string")
    got = pii.scan(rows).first()
    assert (got.n_email, got.n_ip, got.n_phone) == (1, 1, 1)
    assert "email:5:13" in got.spans
    assert pii.redact(rows).first().text == "mail [email] or [phone], ip [ip]"


#: Sentences written by hand: text, kind (or none) and the span.
BY_HAND = [
    ("Please write to anna.meier (at) webmail.org before noon.", "email", "anna.meier (at) webmail.org"),
    ("Kontakt: j_doe[at]firma[dot]de oder im Büro", "email", "j_doe[at]firma[dot]de"),
    ("send it to lisa(at)uni-ulm.de, thanks", "email", "lisa(at)uni-ulm.de"),
    ("reach bob [at] mail [dot] net today", "email", "bob [at] mail [dot] net"),
    ("contact sales {at} shop.com for prices", "email", "sales {at} shop.com"),
    ("the host 10 . 0 . 12 . 7 did not answer", "ip", "10 . 0 . 12 . 7"),
    ("blocked 192[.]168[.]4[.]20 in the firewall", "ip", "192[.]168[.]4[.]20"),
    ("server at 172 . 16 . 254 . 1 is down", "ip", "172 . 16 . 254 . 1"),
    ("paid with card 4111.1111.1111.1111 last week", "card", "4111.1111.1111.1111"),
    ("Karte 5500/0000/0000/0004 wurde belastet", "card", "5500/0000/0000/0004"),
    ("amex 3782 - 8224 - 6310 - 005 on file", "card", "3782 - 8224 - 6310 - 005"),
    ("card no 6011_1111_1111_1117 please", "card", "6011_1111_1111_1117"),
    ("call me at (206) 555-0199 after six", "phone", "(206) 555-0199"),
    ("Tel. 030/12345678 oder per Post", "phone", "030/12345678"),
    ("phone 212-555-0147 for details", "phone", "212-555-0147"),
    ("appelez le 01 42 68 53 00 avant midi", "phone", "01 42 68 53 00"),
    ("Büro (030) 2270100 zentral", "phone", "(030) 2270100"),
    ("my mail is peter at home, not here", None, ""),
    ("released on 2021-03-14 at 12:30", None, ""),
    ("invoice 2024/000123 is due", None, ""),
    ("ISBN 978-3-16-148410-0 in stock", None, ""),
    ("between 1914 and 1918 many left", None, ""),
    ("total 1,234,567.89 dollars", None, ""),
    ("sha 9f86d081884c7d659a2feaa0c55ad015", None, ""),
    ("order no. 8842210034 shipped", None, ""),
    ("1234 5678 9012 3456 is no card", None, ""),
    ("born 12/05/1980 in Bonn", None, ""),
]


def test_the_network_adds_spans_of_other_forms(spark, odd):
    rows = [(k, text) for k, (text, _, _) in enumerate(BY_HAND)]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {k: f"{kind}:{t.index(s)}:{t.index(s) + len(s)}" if kind else "" for k, (t, kind, s) in enumerate(BY_HAND)}
    right = [got[k].spans == w for k, w in want.items()]
    assert sum(right) >= 0.9 * len(right)
    assert sum(r.n_added for r in got.values()) >= 14
    far = pii.find(["word " * 20_000 + BY_HAND[8][0] + " word" * 20_000], pii.trained())[0]
    assert far == ([], [(100_000 + BY_HAND[8][0].index("4111"), 2, 100_000 + BY_HAND[8][0].index("4111") + 19)])
    found = {(r.doc_id, r.spans, r.n_email) for r in pii.scan(odd).collect()}
    assert {s for _, s, _ in found} == {""} and len(found) == len({r.doc_id for r in odd.collect()})


# ---------------------------------------------------------------- decontamination


def brute_scan(text, items, window):
    w = decontamination.words_of(text)
    hit, found = set(), set()
    for i, t in items:
        q = decontamination.words_of(t)
        n = min(window, len(q))
        runs = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
        for k in range(len(w)):
            if n and tuple(w[k : k + n]) in runs:
                hit.update(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [10_000, 3])
def test_decontamination(spark, most):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 6)))) for k in range(8)] + [(9, None), (3, "Ab, c!")]
    docs = [(k, " ".join(rng.choice(["a", "b", "C.", "d", "e"]) for _ in range(rng.randint(0, 25)))) for k in range(40)] + [(99, None)]
    got = decontamination.scan(
        spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3, most
    )
    texts = dict(docs)
    for r in got.collect():
        n, hits, ids = brute_scan(texts[r.doc_id], items, 3)
        assert (r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) == (n, hits, ids)
        for h, c in zip(r.hits, r.chars):
            piece = texts[r.doc_id][c.start : c.end]
            assert decontamination.words_of(piece) == decontamination.words_of(texts[r.doc_id])[h.start : h.end]


# ---------------------------------------------------------------- pages


def test_extraction_learns_pages():
    chain, wrong, n = html_text.trained(), 0, 0
    for page in html_text.labelled_pages(60, seed=99):
        features, y = html_text.marked(page)
        if len(features) == len(y):
            wrong += sum(a != b for a, b in zip(chain.decode(features), y))
            n += len(y)
    assert wrong < 0.02 * n


def test_extraction_of_odd_pages(spark):
    page = "<nav>menu</nav><article><h1>Head &amp; tail</h1><p>One\n two<br>three<p><b>Four</article><footer>&copy; x</footer>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string")
    got = html_text.extract(rows).orderBy("page_id").collect()
    assert got[0].text == "Head & tail\nOne two three\nFour"
    assert [r.n_chars for r in got] == [len(got[0].text), 0, 0, 0]


#: Pages written by hand: html, beginnings of the article's blocks, and of the others.
PAGES = [("<html><body><div><div><a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Sport</a></div><div>Snow closes the mountain roads</div><div>Heavy snow closed three mountain roads on Monday, and the police asked drivers to stay at home until noon.</div><div>Crews worked through the night to clear the pass.</div><div>Share on Twitter Facebook</div><div>Related: Snow closes roads</div><div>All rights reserved.</div></div></body></html>",
 ["Snow closes the mountain roads","Heavy snow closed","Crews worked"],["Home News","Share on","Related:","All rights"]),
("<html><body><table><tr><td>Menu</td><td><a href='/a'>One</a> <a href='/b'>Two</a></td></tr><tr><td><a href=x>Archive</a></td><td><h1>Council votes on budget</h1><p>The council voted on Tuesday to accept the budget for the coming year after a long debate.</p><p>Opposition members left early.</p></td></tr><tr><td>All rights reserved.</td></tr></table></body></html>",
 ["Council votes","The council voted","Opposition members"],["Menu","One Two","Archive","All rights"]),
("<html><body><nav>Home</nav><article><h1>Title here</h1><p>First para is here.</p><div class='share'>Share this</div><p>Second para has more words in it.</p></article><section class='comments'><p>I disagree with that.</p></section><footer>x</footer></body></html>",
 ["Title here","First para","Second para"],["Home","Share this","I disagree"]),
("<html><body><div class='page'><div class='top'><a href=1>A</a><a href=2>B</a></div><div class='c1'><h2>Garden in spring</h2><p>Plant the bulbs early and water them well, then wait for the sun.</p><ul><li>Use good soil.</li><li>Do not water at noon.</li></ul></div><div class='c2'>Subscribe to our newsletter</div></div></body></html>",
 ["Garden in","Plant the","Use good","Do not water"],["A B","Subscribe"]),
("<html><body><div><p>Advertisement</p><p>The museum opens a new hall in May with forty paintings from private owners.</p><p>Tickets can be had at the door.</p><p>Follow us on Facebook</p><p>Terms of use</p></div></body></html>",
 ["The museum","Tickets can"],["Advertisement","Follow us","Terms of"]),
("<html><body><header><h1>Daily Paper</h1></header><main><h1>River floods town</h1><p>The river rose two metres in a night.</p><blockquote>We lost it all.</blockquote><p>Read more in our special issue about the water and its history in the region of the lakes.</p></main><aside><h3>Popular</h3><ul><li><a href=1>Cats</a></li></ul></aside></body></html>",
 ["River floods","The river rose","We lost","Read more in our"],["Daily Paper","Popular","Cats"]),
]


def test_extraction_of_pages_by_hand(spark):
    chain = html_text.trained()
    for html, keep, drop in PAGES:
        got = html_text.article(html, chain).split("\n")
        assert [any(b.startswith(k) for b in got) for k in keep] == [True] * len(keep)
        assert not any(b.startswith(d) for b in got for d in drop) and len(got) == len(keep)
    long = "<article>" + "".join(f"<p>Sentence {k} of a long page.</p>" for k in range(20_000)) + "</article>"
    rows = [(None, None, long, "a"), (1, "u", "<p", "b"), (1, "u", "<div>" * 3000 + "x", None)]
    rows = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(rows).collect(), key=lambda r: -r.n_chars)
    assert got[0].page_id is None and got[0].text.count("\n") == 19_999 and len(got) == 3
    assert html_text.extract(rows.where("page_id > 5")).count() == 0


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as file:
        return pieces.Pieces(file.read())


def all_ways(p, word):
    if not word:
        return [(0.0, ())]
    out = []
    for a in range(len(word)):
        found = p.score.get(word[a:])
        if found is not None:
            ways = [(found[0], (found[1],))]
        else:
            ways = [(p.unknown, tuple(p.byte[x] for x in word[a].encode()))] if a == len(word) - 1 else []
        out += [(s + x, i + ids) for x, ids in ways for s, i in all_ways(p, word[:a])]
    return sorted(out, key=lambda z: -z[0])


def two_best(p, word):
    """Scores of the best two segmentations, by dynamic programming over both."""
    best = [[0.0]] + [[] for _ in word]
    for b in range(1, len(word) + 1):
        for a in range(b):
            found = p.score.get(word[a:b])
            if found is None and b - a == 1:
                found = (p.unknown, 0)
            if found is not None:
                best[b] += [s + found[0] for s in best[a]]
        best[b] = sorted(best[b], reverse=True)[:2]
    return best[-1]


def test_search_finds_the_best_two(model):
    rng = random.Random(8)
    words = [pieces.SPACE + "".join(rng.choice("aeinrstlodhum.,é日") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for word in words:
        assert [s for s, _ in model.search(word, 2)] == pytest.approx(two_best(model, word))
    long = "日本ab" * 400 + "x" * 700 + "," * 3
    best, second, n, ids, back = model.summary(long)
    assert [best, second] == pytest.approx(two_best(model, pieces.SPACE + long), rel=1e-9)
    assert back.decode()[1:] == long and len(ids) == 4 * n
    assert [s for s, _ in model.nbest_encode(long, 3)][:2] == pytest.approx([best, second])


def test_nbest_against_all_ways(model):
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice("abcdehtinorsñ日.,# ") for _ in range(rng.randint(1, 9)))
        want = [s for s, _ in all_ways(model, pieces.SPACE + text.replace(" ", pieces.SPACE))]
        got = model.nbest_encode(text, 3)
        assert [s for s, _ in got] == pytest.approx(want[:3])
        best, second, n, ids, _ = model.summary(text)
        assert best == pytest.approx(want[0])
        assert second == pytest.approx(want[1]) if len(want) > 1 else second is None
        assert ids == pieces.packed(got[0][1]) and n == len(got[0][1])


def test_nbest_of_texts_with_the_mark(model):
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice("abethn \u2581") for _ in range(rng.randint(1, 8))) + pieces.SPACE
        parts = text.replace(" ", "\0").split(pieces.SPACE)
        want = [model.unknown * (len(parts) - 1)]
        for k, part in enumerate(parts):
            unit = (pieces.SPACE if k == 0 else "") + part.replace("\0", pieces.SPACE)
            want = [a + b for a in want for b, _ in (all_ways(model, unit) if unit else [(0.0, ())])]
        want.sort(reverse=True)
        got = model.nbest_encode(text, 4)
        assert [s for s, _ in got] == pytest.approx(want[:4]) and len({tuple(i) for _, i in got}) == len(got)
        assert all(model.decode(i) == text for _, i in got)
        best, second, n, ids, back = model.summary(text)
        assert best == pytest.approx(want[0]) and (second, len(want) > 1) == (pytest.approx(want[1]) if len(want) > 1 else None, second is not None)
        assert ids == pieces.packed(got[0][1]) and n == len(got[0][1]) and back.decode()[1:] == text


def test_round_trip(spark, odd, model):
    for text in ("", " ", "  a  b\n\tc ñ \U0001f600 ", pieces.SPACE, f"a{pieces.SPACE} b", "\x00日本", "x" * 5000):
        assert model.decode(model.encode(text)[1]) == text
    made = pieces.encode(spark, odd)
    back = pieces.decode(spark, made)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd.collect())
    assert sorted(r.decoded for r in made.collect()) == sorted(r.text or "" for r in odd.collect())


# ---------------------------------------------------------------- classifiers


def prose(rng, junk):
    words = ["".join(rng.choice("abcdefghimnorst") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    return " ".join(w + "###" for w in words) if junk else " ".join(words).capitalize() + "."


def test_quality_held_out(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(400)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(spark, docs, labels).collect()}
    held = [r for r in got.values() if r.doc_id is not None and r.held_out and r.doc_id < 400]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert quality.keep_good(spark, docs, labels).columns == docs.columns


def test_one_class_gives_the_prior(spark, odd):
    labels = spark.createDataFrame([(2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in quality.score(spark, odd, labels).collect()}) == 1
    assert len({r.score for r in toxicity.score(spark, odd, labels).collect()}) == 1


def test_toxicity_held_out_and_gapped(spark):
    rng = random.Random(5)
    bad = ["blorgface", "snivelgit", "mudwit"]
    rows = []
    for k in range(600):
        words = prose(rng, False).split()
        if k % 5 == 0:
            words[3:3] = rng.sample(bad, 2)
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, labels)
    got = [r for r in toxicity.score(spark, docs, labels, model=model).collect() if r.held_out]
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in got)
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in got) >= 0.95 * len(got)
    texts = ["a blorgxface of mudwit", "b.l.o.r.g.f.a.c.e and", "m u d w i t now", "mud@wit for", "nothing of it"]
    worst = toxicity.Scorer(model).evidence(texts)[:, 2]
    assert worst[:4].min() > 0 > worst[4]
    odd = [(1, "blorgface snivelgit " + LONG), (2, None), (3, ""), (4, "." * 50_000), (4, "x" * 50_000), (None, "mudwit blorgface")]
    odd = spark.createDataFrame([(*r, "toxic", 1) for r in odd], "doc_id long, text string, label string, toxic int")
    found = toxicity.score(spark, odd, labels, model=model).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found) and {r.doc_id for r in found if r.predicted} >= {None}


def test_toxic_families_of_words_in_other_scripts(spark):
    rng = random.Random(6)
    letters = "абвгдежзиклмнопрстуфхцчшщэюя" + "αβγδεζηθικλμνξοπρστυφχψω" + "אבגדהוזחטיכלמנסעפצקרשת"
    def word(root=""):
        return root + "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
    def text(bad):
        return {word() for _ in range(40)} | ({word("гневλβ") for _ in range(3)} if bad else set())
    model = toxicity.train([text(True) for _ in range(60)], [text(False) for _ in range(300)], 0.16)
    bad, good = [" ".join(text(True)) for _ in range(30)], [" ".join(text(False)) for _ in range(100)]
    assert (toxicity.Scorer(model)(bad) >= 0.7).sum() >= 27 and (toxicity.Scorer(model)(good) >= 0.7).sum() == 0
    assert model == model and toxicity.train([set("ab")], [set("c")], 0.2).letters is None


def test_toxic_texts_that_share_a_word_are_no_copies():
    texts = [{"mudwit"} | {f"w{k}x{j}" for j in range(9)} for k in range(40)]
    assert toxicity._unlike(texts) == texts
    assert toxicity._unlike([{"mudwit"}, {"snivelgit"}, set(), {"mudwit"}, set()]) == [{"mudwit"}, {"snivelgit"}, set()]
    rng = random.Random(7)
    texts = [set(rng.sample("abcdefghijkl", rng.randint(1, 12))) for _ in range(300)]
    kept = []
    for ws in texts:
        if all(len(ws & o) < 0.8 * len(ws | o) for o in kept):
            kept.append(ws)
    assert toxicity._unlike(texts) == kept


def test_only_whole_addresses_are_no_words():
    assert {"id@iot", "idiot"} <= toxicity.words_of("id@iot") and "bstard" in toxicity.words_of("b@stard,")
    assert "mudwit" in toxicity.words_of("mudwithttps://a.example/x?y=1") & toxicity.words_of("https://a.example/x,mudwit")
    assert "mudwit" in toxicity.words_of("mudwit:joe.p@mail.example.org") & toxicity.words_of("mud://wit")
    assert toxicity.words_of("joe.p@mail.example.org <https://a.example/mudwit>") == set()


# ---------------------------------------------------------------- near duplicates


def brute_fingerprint(text):
    w = lower(text).encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_groups(spark, odd):
    got = simhash.near_groups(spark, odd).collect()
    rows = odd.collect()
    assert Counter(r.fp % (1 << 64) for r in got) == Counter(brute_fingerprint(r.text) for r in rows)
    prints = {r.fp % (1 << 64) for r in got}
    root = {p: p for p in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if bin(a ^ b).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    least = defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            least[root[r.fp % (1 << 64)]].append(r.doc_id)
    for r in got:
        assert r.component_id == min(least[root[r.fp % (1 << 64)]], default=None)
    assert sum(r.kept for r in got) == len(set(root.values()))


def test_links_lose_no_component(spark):
    rng = random.Random(6)
    values = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for chunk in (simhash.CHUNK, 3):
        pairs = simhash.links(fps, chunk)
        roots = {r.node: r.root for r in components.components(pairs, Workspace(spark, "test")).collect()}
        for a in signed:
            for b in signed:
                if bin((a ^ b) % (1 << 64)).count("1") <= 3:
                    assert roots.get(a, a) == roots.get(b, b)
        want = {tuple(sorted(e)) for e in simhash.forest(np.array(signed))}
        assert len({roots.get(a, a) for a in signed}) == len(signed) - len(want)


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() < before
    assert docs.select("doc_id").distinct().count() == docs.count()
