"""op2, op3, op5, op6, op8 and the pipeline, against brute force."""

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import cutting_stock, dart_minhash, dimension_scan, toxicity, training_order, url_rules
from quarry.llm.bpe import tokenizer_path
from quarry.llm.queries import QUERIES

from .conftest import MIDDLE, SMALL

LIBRARY = Tokenizer.from_file(tokenizer_path())


def tokens(text, end):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [end]


# ---- url rules

def judged(url, rules):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    whole = re.split(r"[?#]", rest)[0]
    host, slash, tail = whole.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = slash + tail
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules_match_brute_force(spark):
    rng = np.random.default_rng(1)
    labels, paths = ["a", "b", "net", "org", "x-y", ""], ["", "/", "/en/", "/en/a", "/de", "//", "/en/a/b"]
    hosts = [".".join(rng.choice(labels, rng.integers(1, 5))) for _ in range(400)]
    rules = [(".".join(rng.choice(labels[:5], rng.integers(1, 4))), str(rng.choice(paths[:5])), str(rng.choice(["allow", "block"]))) for _ in range(60)]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{h.upper() if i % 9 == 0 else h}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#x', '?a://b'])}" for i, h in enumerate(hosts)]
    urls += [None, "", "no scheme/net", "x://", "http://ünï.net/en/", "a://\ud7ff.net/\n/", *["http://a.net/en/"] * 300]
    pages = spark.createDataFrame([(i, u, None, None) for i, u in enumerate(urls)], "page_id bigint, url string, host int, part int").repartition(4)
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    for n in (1, 7, 40):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, table, n_ranges=n).collect()}
        assert len(got) == len(urls)
        assert all(got[i] == judged(u, rules) for i, u in enumerate(urls))
    assert url_rules.judge_urls(pages.where("false"), table).count() == 0
    assert url_rules.judge_urls(pages, table.where("false")).where("rule is not null or verdict <> 'allow'").count() == 0


# ---- near duplicates

def shingle_set(text):
    words = re.split(r"[ \t\n\r\x0b\x0c]+", (text or "").lower())
    words = [w for w in words if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return {i: find(i) for i in sets}


def test_near_classes_match_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    got = {r.doc_id: (r.class_id, r.kept) for r in QUERIES["op3_dart_minhash"](spark, MIDDLE).collect()}
    want = brute_classes(texts)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(kept == (c == i) for i, (c, kept) in got.items())


def test_large_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    texts = {}
    for i in range(600):
        words = base[:]
        for j in rng.integers(0, 120, 2):
            words[j] = f"z{rng.integers(0, 10**6)}"
        texts[i] = " ".join(words)
    texts |= {1000 + i: " ".join(f"u{x}" for x in rng.integers(0, 10**6, 50)) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in dart_minhash.near_classes(docs).collect()}
    assert got == brute_classes(texts)


def test_pairs_inside_a_family_below_the_threshold(spark):
    """Texts at about 0.75 of each other share buckets; planted pairs reach 0.8."""
    n, planted, shared = 1500, 150, " ".join(f"s{i}" for i in range(177))
    texts = {}
    for i in range(n):
        tail = [f"u{i}x{j}" for j in range(29)]
        if i < 2 * planted:
            tail[:8] = [f"p{i % planted}x{j}" for j in range(8)]
        texts[i] = shared + " " + " ".join(tail)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    top = {i: i for i in texts}
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                top[i] = min(top[i], top[j])
    assert sum(top[i] != i for i in texts) == planted
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in dart_minhash.near_classes(docs).collect()} == top


def test_near_classes_defined_cases(odd_documents, no_documents):
    got = sorted({(r.doc_id, r.class_id, r.kept) for r in dart_minhash.near_classes(odd_documents).collect()}, key=str)
    classes = {i: c for i, c, _ in got}
    assert classes[1] == classes[2] == 1 and classes[6] == classes[7] == classes[8] == 6
    assert classes[3] == 3 and classes[4] == 4 and classes[5] == 5 and classes[None] is None
    kept = dart_minhash.drop_near_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 2, None: 2, **dict.fromkeys([3, 4, 5, 6, 9, 10, 11, -5], 1)})
    assert dart_minhash.near_classes(no_documents).count() == 0


@pytest.mark.parametrize("weights", ["set", "count"])
def test_signatures_agree_as_often_as_weighted_jaccard(weights):
    rng = np.random.default_rng(3)
    k = 4000
    common, own = [f"c{i}" for i in range(60)], [[f"{s}{i}" for i in range(20)] for s in "ab"]
    texts = [" ".join(common + o + (common[:30] if n else [])) for n, o in enumerate(own)]
    row, code, weight = dart_minhash.shingle_sets(pa.array(texts), weights)
    a, b = ({c: w for r, c, w in zip(row.tolist(), code.tolist(), weight.tolist(), strict=True) if r == i} for i in (0, 1))
    keys = a.keys() | b.keys()
    want = sum(min(a.get(x, 0), b.get(x, 0)) for x in keys) / sum(max(a.get(x, 0), b.get(x, 0)) for x in keys)
    ids = dart_minhash.signatures(row, code, weight, 2, k)
    assert abs((ids[0] == ids[1]).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5
    del rng


def test_signatures_of_many_short_texts_take_little_memory():
    texts = pa.array([None, "", *(f"word{i} some" for i in range(4000)), " ".join(f"w{i}" for i in range(3000)), "last one"])
    row, code, weight = dart_minhash.shingle_sets(texts)
    tracemalloc.start()
    ids = dart_minhash.signatures(row, code, weight, len(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # all texts at once: over 300 MB
    assert not ids[:2].any() and ids[2:].all()
    for i in (2, 2001, 4002, 4003):
        alone = dart_minhash.signatures(*dart_minhash.shingle_sets(texts[i : i + 1]), 1)
        assert (alone[0] == ids[i]).all()
    assert dart_minhash.signatures(row[:0], code[:0], weight[:0], 0).shape == (0, dart_minhash.K)


@pytest.mark.parametrize("step", ["toxicity", "near dedup", "secrets", "packing"])
def test_pipeline_stages_bound_the_bytes_of_arrow_batches(spark, step):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 800, 1, 1).selectExpr("id as doc_id", "concat(id, repeat(' some words', 2000)) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([len(batch)])], ["bytes", "n"])

    try:
        spark.conf.set(name, "64m")
        if step == "toxicity":
            toxicity.drop_toxic(docs, (np.zeros(0, np.int64), np.zeros(0)))
        else:
            dict(corpus_pipeline.STAGES)[step](spark, docs.limit(3), SMALL)
        got = docs.mapInArrow(sizes, "bytes bigint, n bigint").collect()
        assert sum(r.n for r in got) == 800 and max(r.bytes for r in got) <= 5 << 20
        spark.conf.set(name, str(1 << 20))  # a smaller limit stays
        toxicity.drop_toxic(docs, (np.zeros(0, np.int64), np.zeros(0)))
        assert spark.conf.get(name).rstrip("b") == str(1 << 20)
    finally:
        spark.conf.set(name, before)


# ---- training order

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**31))
def test_slots_are_a_permutation(n, key):
    assert sorted(training_order.slots(np.arange(n), n, key).tolist()) == list(range(n))


def test_shards_round_trip_and_resume(spark, odd_documents, no_documents, tmp_path):
    out = str(tmp_path / "shards")
    n = training_order.write_shards(odd_documents, tokenizer_path(), out, seq_len=64, per_shard=16)
    got = training_order.read_sequences(spark, out, 0, 64, 16).collect()
    assert sorted(r.slot for r in got) == list(range(n))
    assert all(r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * (24 + 128) for r in got)
    pieces = defaultdict(list)
    for r in got:
        assert len(r.ids) == 2 * r.length
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u2").tolist()))
    for r in odd_documents.where("doc_id not in (1)").collect():
        assert sum((ids for _, ids in sorted(pieces[r.doc_id])), []) == tokens(r.text, 49407)
    assert [len(p) for p in (pieces[1], pieces[-1])] == [2, 2]
    later = training_order.read_sequences(spark, out, n // 2 + 3, 64, 16)
    assert sorted(r.slot for r in later.collect()) == list(range(n // 2 + 3, n))
    assert training_order.write_shards(no_documents, tokenizer_path(), str(tmp_path / "none")) == 0
    assert training_order.read_sequences(spark, str(tmp_path / "none")).count() == 0


def test_training_order_query(spark, documents):
    got = QUERIES["op5_training_order"](spark, SMALL).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.doc_id][r.start] = (r.length, r.ids_crc32)
    for r in documents.collect():
        ids = np.array(tokens(r.text, 49407), "<u2")
        assert by[r.doc_id] == {s: (len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for s in range(0, len(ids), 512)}
    assert sorted(r.slot for r in got) == list(range(len(got)))


# ---- packing

@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10**6), max_size=24))
def test_patterns_use_up_the_histogram(histogram):
    plan = cutting_stock.plan_patterns(histogram, 64)
    used = Counter()
    for times, pattern in plan:
        assert times > 0 and sum(w * n for w, n in pattern.items()) <= 64
        for w, n in pattern.items():
            used[w] += times * n
    assert used == Counter(histogram)


def test_column_generation_reaches_the_optimum():
    # width 3, 4 and 5 in room 12: 12 = 3*4 = 4*3 = 3+4+5, so material bound is reached
    plan = cutting_stock.plan_patterns({3: 400, 4: 300, 5: 100}, 12)
    assert sum(t for t, _ in plan) <= -(-(3 * 400 + 4 * 300 + 5 * 100) // 12) + 3


def check_packing(docs, packed, seq_len=2048):
    texts = Counter((r.doc_id, tuple(tokens(r.text, 1))) for r in docs.collect())
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        whole[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for (doc_id, ids), times in texts.items():
        data = np.array(ids, "<u4")
        pieces = Counter((r.start, r.length, r.ids_crc32) for r in whole[doc_id, len(ids)])
        want = Counter({(s, len(data[s : s + seq_len]), zlib.crc32(data[s : s + seq_len].tobytes())): times for s in range(0, len(ids), seq_len)})
        if doc_id is not None:
            assert pieces == want
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= seq_len
    return sequences


def test_packing_query(spark, documents):
    packed = QUERIES["op6_cutting_stock"](spark, SMALL)
    check_packing(documents, packed.collect())
    assert cutting_stock.padding(packed) < 0.02


def test_packing_defined_cases(odd_documents, no_documents):
    packed = cutting_stock.pack_documents(odd_documents, tokenizer_path(), with_ids=True).collect()
    check_packing(odd_documents, packed)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in packed) and sum(r.doc_tokens == 1 for r in packed) == 4
    assert cutting_stock.pack_documents(no_documents, tokenizer_path()).count() == 0


# ---- nearest neighbours

def test_recall_and_scores(spark):
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()}
    found = defaultdict(dict)
    for r in QUERIES["op8_dimension_scan"](spark, MIDDLE).collect():
        assert abs(r.score - table[r.query_id] @ table[r.vec_id]) < 1e-12
        found[r.query_id][r.rank] = (-r.score, r.vec_id)
    assert set(found) == {i for i in table if i % 20 == 0}
    hits = 0
    for q, near in found.items():
        assert sorted(near) == list(range(1, 21)) and [near[i] for i in sorted(near)] == sorted(near.values())
        best = sorted((-(table[q] @ v), i) for i, v in table.items() if i != q)[:20]
        hits += len({i for _, i in best} & {i for _, i in near.values()})
    assert hits / (20 * len(found)) >= 0.9


def test_neighbours_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.5, 0.5, 0.0]), (2, [0.5, 0.5, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [nan, 1.0, 0.0]),
            (7, [inf, 0.0, 0.0]), (8, [1.0, 2.0]), (9, [3.0, 0.0, 1.0]), (9, [3.0, 0.0, 1.0]), (None, [1.0, 1.0, 1.0]), (20, []), (40, [0.0, 9.0, 0.0])]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], "vec_id bigint, embedding array<double>, list int, rank int").repartition(3)
    got = dimension_scan.nearest(frame, F.col("vec_id") % 20 == 0, k=3)
    ranked = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())
    assert ranked == [(0, 1, 9, 3.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (40, 1, 1, 4.5), (40, 2, 2, 4.5), (40, 3, 0, 0.0)]
    assert dimension_scan.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    same = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.1), F.lit(0.7)).alias("embedding"))
    ties = dimension_scan.nearest(same, F.col("vec_id") % 500 == 0)
    for r in ties.collect():
        assert r.vec_id == (r["rank"] if r.query_id < r["rank"] else r["rank"] - 1)
    assert ties.count() == 120


@pytest.mark.parametrize("apart", [0.0, 1e-6])
def test_rows_that_repeat_an_id_hold_one_place(spark, apart):
    """50 rows of one id, equal or nearly so, leave the other ids of a single list their places."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, *rng.normal(0, 0.3, 7).tolist()]) for i in range(40)]
    rows += [(7, [2 * x + j * apart for x in rows[0][1]]) for j in range(50)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    best = {i: max(float(np.dot(rows[0][1], v)) for n, v in rows if n == i) for i in range(1, 40)}
    found = {r["rank"]: r.vec_id for r in dimension_scan.nearest(frame, F.col("vec_id") == 0).collect()}
    assert [found.get(i) for i in range(1, 21)] == sorted(best, key=lambda i: -best[i])[:20]


# ---- pipeline

def test_pipeline_stages_against_brute_force(spark, documents):
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == documents.columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    clean, once, apart, masked = kept
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic - clean.keys()) <= 0.05 * len(toxic)

    def lower(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    best = {}
    for i, t in clean.items():
        best[lower(t)] = max(i, best.get(lower(t), i))
    assert once.keys() == set(best.values())
    classes = brute_classes(once)
    assert apart.keys() == {i for i, c in classes.items() if c == i}
    assert masked.keys() == apart.keys() and all("AKIA" not in t for t in masked.values() if t)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    check_packing(docs, packed.collect())
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.start, r.ids_crc32) for r in packed.collect())


def test_pipeline_takes_odd_documents(spark, odd_documents):
    docs = odd_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == odd_documents.columns
        docs = docs.cache()
    assert {r.doc_id for r in docs.collect()} >= {9, 10, 11, None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0
