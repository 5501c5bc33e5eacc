"""op11, op12, op13: against numpy's eigenvectors, a scan of all periods, DuckDB and plain strings."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat_format, lanczos_whitening, periodic_runs
from quarry.llm.queries import ORACLES, QUERIES

from .conftest import SMALL

# ---- whitening


def plain_whitening(vectors, k):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, q = np.linalg.eigh(c.T @ c / n)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), c @ q / np.sqrt(values), values / np.trace(c.T @ c / n)


def table_of(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")


def assert_whitened(got, vectors, k):
    far, white, share = plain_whitening(vectors, k)
    rows = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(rows) == len(vectors) * k
    mine = np.array([[rows[i, j + 1].whitened for j in range(k)] for i in range(len(vectors))])
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    assert [rows[i, 1].deviation for i in range(len(vectors))] == far.tolist()
    assert np.allclose([rows[0, j + 1].explained for j in range(k)], share, rtol=1e-9)
    assert {r.n for r in rows.values()} == {len(vectors)} and {r.identity_error < 1e-9 for r in rows.values()} == {True}


def test_whitening_query_matches_eigenvectors(spark):
    vectors = [r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()]
    assert_whitened(QUERIES["op11_lanczos_whitening"](spark, SMALL), vectors, 8)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = (rng.standard_normal((40, 5)) * [5, 4, 3, 2, 1]).round(3).tolist()
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0, 0, 0, 0], [1.0, 2.0], [1e300] * 5]
    assert_whitened(lanczos_whitening.whiten(table_of(spark, good + odd)), good, 5)  # fewer entries than components
    equal = lanczos_whitening.whiten(table_of(spark, [[1.0, 2.0]] * 4))
    assert equal.count() == 0 and lanczos_whitening.whiten(table_of(spark, odd[:2])).count() == 0
    line = lanczos_whitening.whiten(table_of(spark, [[float(i), 2.0 * i, 0.0] for i in range(9)])).collect()  # one direction only
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-9
    clash = table_of(spark, good).selectExpr("vec_id", "embedding", "1 as x", "2 as id", "'s' as sums", "3 as component")
    assert lanczos_whitening.whiten(clash, 2).count() == 80
    twice = table_of(spark, good).union(table_of(spark, good)).selectExpr("nullif(vec_id, 3) as vec_id", "embedding")
    assert lanczos_whitening.whiten(twice, 1).count() == 80


def test_deviation_is_exact_or_null(spark):
    big = [[2.0**34, 1.0], [-(2.0**34), 1.0], [3.0, 1.0]]
    got = {r.vec_id: r.deviation for r in lanczos_whitening.whiten(table_of(spark, big)).collect()}
    x = [int(v[0] * 1024) + 100_000 for v in big]
    assert got == {i: (d if d < 2**63 else None) for i, d in enumerate((3 * v - sum(x)) ** 2 for v in x)} and None in got.values()


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 4, 3, 2, 1] + [0.5] * 20, [9, 8, 8, 8, 8] + [1.0] * 30, list(range(40, 0, -1)), [3, 0, 0, 0, 0, 0]])
def test_bidiagonalisation_finds_repeated_values(spectrum):
    rng = np.random.default_rng(len(spectrum))
    d = len(spectrum)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    u, _ = np.linalg.qr(rng.standard_normal((90, d)))
    x = u * np.array(spectrum) @ q.T

    def products(p, y):
        w = x @ p
        return w @ w, x.T @ w, (x @ y).T @ w

    values, vectors, _ = lanczos_whitening.bidiagonalise(products, d, 4, 1, np.zeros((0, d)))
    assert np.allclose(vectors @ vectors.T, np.eye(len(vectors)), atol=1e-12)
    assert np.abs(x.T @ (x @ vectors.T) - vectors.T * values**2).max() < 1e-8


# ---- runs


def all_runs(words, least=24):
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - s + p >= max(least, 3 * p):
                found.setdefault((s, i - s + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


blocks = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 60)), max_size=5)


@settings(max_examples=400, deadline=None)
@given(st.lists(blocks, max_size=3))
def test_runs_match_a_scan_of_all_periods(texts):
    words = [[b"%d" % x for block, n in t for x in (block * n)[:n]] for t in texts]
    assert periodic_runs.runs_of(words) == [all_runs(w) for w in words]


def test_long_runs_and_nested_runs():
    block = [b"%d" % (i * i % 97) for i in range(700)]
    inner = ([b"a", b"b"] * 15 + [b"x"]) * 5
    for words in ([b"a"] * 5000, block * 6, inner, [b"q"] + inner + block * 3 + [b"a"] * 23):
        assert periodic_runs.runs_of([words]) == [all_runs(words)]


def test_runs_query_matches_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    some = 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = all_runs(words)
        some += len(runs)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        text = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        milli = best[1] * 1000 // best[2] if runs else None
        assert got.pop(r.doc_id) == (r.doc_id, len(runs), *best, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in (text, collapsed(words, runs))))
    assert not got and some > 10


def test_runs_of_odd_documents(spark, odd_documents, no_documents):
    found = periodic_runs.find_runs(odd_documents).collect()
    assert len(found) == odd_documents.count() and periodic_runs.find_runs(no_documents).count() == 0
    texts = {r.doc_id: r.text or "" for r in odd_documents.collect() if r.doc_id is not None}
    for r in found:
        if r.doc_id is not None and len(texts[r.doc_id]) < 1000:
            words = texts[r.doc_id].split()
            assert [tuple(x) for x in r.runs] == all_runs(words) and r.collapsed == collapsed(words, all_runs(words)) and r.n_words == len(words)
    assert {r.n_words for r in found if r.doc_id in (3, 4, 5)} == {0}
    planted = periodic_runs.with_planted_runs(odd_documents).collect()
    assert len(planted) == len(found) and all(r.text is not None for r in planted)


# ---- chats


def test_chat_query_matches_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    got = QUERIES["op13_chat_format"](spark, SMALL)
    want = con.execute(ORACLES["op13_chat_format"]).df().sort_values("conv_id").to_dict("records")
    assert [r.asDict() for r in got.orderBy("conv_id").collect()] == want
    assert got.where("conv_id = -7").first().loss_chars == len(chat_format.TRICKY)


texts = st.text(alphabet="#\\</turn> :ok\n", max_size=24)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=5))
def test_no_text_passes_for_a_turn(turns):
    assert chat_format.read_back(chat_format.marked(turns)) == turns


CHAT = "conv_id bigint, turn bigint, role string, text string, start int, number int"


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, None, "system", "first"), (1, 1, "assistant", None), (1, 1, None, "b"), (1, 1, None, "b"), (None, 0, "assistant", ""), (None, None, None, None),
            (2, 5, "assistant", "x" * 200_000 + " </turn>\n### user: "), (3, -1, "assistant", "\\" * 7 + "####")]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], CHAT).repartition(5)
    turns = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.digests(turns).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 5, None: 2, 2: 1, 3: 1}
    want = [("system", "first"), ("user", "hi"), ("", "b"), ("", "b"), ("assistant", "")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
    assert got[2].loss_chars == len(rows[7][3]) and got[3].loss_sha256 == hashlib.sha256(rows[8][3].encode()).hexdigest()
    assert chat_format.digests(chat_format.format_chats(df.where("false"))).count() == 0


def test_spans_lie_in_the_whole_output(spark):
    turns = [("system", "be kind")] + [("user" if i % 2 == 0 else "assistant", f"turn {i} # <b>") for i in range(30)]  # longer than the reach
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn int, role string, text string")
    whole = chat_format.marked(turns)
    for reach in (0, 3, chat_format.REACH, None):
        rows = chat_format.format_chats(df, reach=reach).collect()
        assert "".join(r.rendered for r in rows) == whole and all(r.rewritten == 0 for r in rows)
        assert all(whole[r.start : r.end] == r.rendered and whole[r.text_start : r.text_end] == r.text for r in rows)


def test_templates_that_rewrite_history_are_seen(spark):
    def forgetful(turns):  # thoughts of all but the last turn go
        out = "<s>"
        for i, (role, text) in enumerate(turns):
            out += f"[{role}]{text if i == len(turns) - 1 else re.sub(r'<think>.*?</think>', '', text)}"
        return out

    def closed(turns):  # an end mark that moves
        return "".join(f"[{r}]{t}" for r, t in turns) + "<end>"

    def trimmed(turns):
        return "".join(f"[{r}]{t.strip()};" for r, t in turns)

    turns = [("user", "a"), ("assistant", "<think>hm</think>b"), ("user", " c")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn int, role string, text string")
    rows = chat_format.format_chats(df, forgetful).collect()
    assert [r.rewritten for r in rows] == [0, 0, len("<think>hm</think>b")] and rows[0].rendered == "<s>[user]a"
    assert rows[2].rendered == "b[user] c" and rows[2].end == len(forgetful(turns))
    rows = chat_format.format_chats(df, closed).collect()
    assert [r.rewritten for r in rows] == [0, 5, 5] and rows[2].end == len(closed(turns)) and closed(turns)[rows[1].start : rows[1].text_end].endswith("b")
    rows = chat_format.format_chats(df, trimmed).collect()
    assert [r.rewritten for r in rows] == [0, 0, 0] and [r.text_start is None for r in rows] == [False, False, True] or rows[2].text_start is not None


def test_prefixes_hold_every_turn(spark):
    def counted(turns):  # the head counts turns, each turn shows the first one's role
        return f"{len(turns):04d}|" + "".join(f"[{i} {role} of {turns[0][0]}]{text}" for i, (role, text) in enumerate(turns))

    turns = [("system", "be kind")] + [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(30)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn int, role string, text string")
    rows = chat_format.format_chats(df, counted).collect()
    outputs = [counted(turns[:n]) for n in range(len(turns) + 1)]
    assert [r.end for r in rows] == [len(o) for o in outputs[1:]]
    for i, r in enumerate(rows):
        before, output = outputs[i], outputs[i + 1]
        kept = 0 if i == 0 else chat_format.common_start(before, output)
        assert r.rendered == output[kept:] and r.start == kept and r.rewritten == (len(before) - kept if i else 0)
        assert output[r.text_start : r.text_end] == r.text
    assert f"[{len(turns) - 1} " in rows[-1].rendered and "of system]" in rows[-1].rendered


def test_shared_ends():
    for a, b, n in (("", "", 0), ("ab", "b", 1), ("abc", "abc", 3), ("xbc", "ybc", 2), ("a", "b", 0), ("bb", "bbb", 2), ("x" * 999 + "abc", "yabc", 3)):
        assert chat_format.common_end(a, b) == chat_format.common_end(b, a) == n
