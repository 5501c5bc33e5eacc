"""op1, op4, op7, op9, op10: against brute force, held-out labels, the tokenizers library and DuckDB."""

import hashlib
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, cutting_stock, digest_index, hyper_language, secret_scan, toxicity
from quarry.llm.queries import ORACLES, QUERIES

from .conftest import MIDDLE, SMALL

SPEC = open(bpe.tokenizer_path(), encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(bpe.tokenizer_path())


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


# ---- secrets

BASE = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}


def base_spans(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(BASE.items()) for m in p.finditer(text) if LEAST[k](m)]
    return [s for _, _, s in sorted(found)]


def test_secrets_base_spans_match_brute_force(spark, odd_documents):
    for docs, found in ((spark.read.parquet(f"{SMALL}/documents.parquet"), QUERIES["op1_secret_scan"](spark, SMALL)),):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        got = found.collect()
        assert len(got) == len(texts)
        for r in got:
            want = base_spans(texts[r.doc_id])
            kinds = Counter(s.split(":")[0] for s in want)
            assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == want
    odd = secret_scan.find_secrets(odd_documents)
    assert odd.count() == odd_documents.count()
    by_id = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in odd.collect()}
    assert by_id[10] == base_spans(odd_documents.where("doc_id = 10").first().text) and by_id[3] == by_id[4] == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aApPsSwWoOrRdD_kKiItTeEnN=:\"' \n0fAKIAZz/.é\u017f\u212a", max_size=60))
def test_secret_patterns_on_any_text(text):
    got = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(secret_scan.base_spans(text)[0])]
    assert got == base_spans(text)


def test_markov_models_tell_random_strings_from_identifiers(spark):
    ratio = secret_scan.train(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    rng = np.random.default_rng(4)
    letters = list(secret_scan.ALPHABET)
    random = ["".join(rng.choice(letters, 32)) for _ in range(200)]
    assert np.mean([bool(secret_scan.spans_of(f"x {s} y", ratio)) for s in random]) > 0.95
    plain = ["getUserAccountInformation2", "configurationManagerService12", "internationalization_utils_v2", "1234567890123456789012"]
    assert not any(secret_scan.spans_of(p, ratio) for p in plain)
    text = f"key {random[0]} end"
    assert secret_scan.masked(text, secret_scan.spans_of(text, ratio)) == "key [secret] end"


def test_masking_keeps_rows_columns_and_clean_texts(odd_documents, no_documents):
    masked = secret_scan.mask_secrets(odd_documents, length_col="n_chars")
    assert masked.columns == odd_documents.columns and masked.schema == odd_documents.schema
    was, now = ({(r.doc_id, r.source): r for r in df.collect()} for df in (odd_documents, masked))
    assert now[10, "d"].text == '[secret]" [secret] [secret]' and now[10, "d"].n_chars == 27
    assert all(now[k].text == was[k].text for k in was if k[0] != 10)
    assert secret_scan.mask_secrets(no_documents).count() == 0 == secret_scan.find_secrets(no_documents).count()
    assert secret_scan.masked("abcdef", [(0, 0, 3), (1, 2, 4)]) == "[secret]ef"


# ---- toxicity

def test_toxicity_on_held_out_labels(spark):
    scored = QUERIES["op4_toxicity"](spark, MIDDLE)
    assert scored.count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert scored.where("score < 0 or score > 1 or predicted <> int(score >= 0.5) or score is null").count() == 0
    judged = scored.join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").groupBy("held_out", "toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {(r.held_out, r.toxic): r.p for r in judged}
    assert share[False, 1] > 0.5 and share[True, 0] < 0.05 and share[False, 0] < 0.02


def test_toxicity_learns_words_and_leaves_clean_texts(spark, odd_documents, no_documents):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(rng.choice(words, 40)) + (" vile" if i % 7 == 0 else ""), int(i % 7 == 0)) for i in range(700)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, toxic int")
    labels = docs.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, toxic int"))
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert len(model[0]) < 1000 and all(np.array_equal(x, y) for x, y in zip(model, again, strict=True))
    scored = toxicity.score_texts(docs, model).join(docs, "doc_id")
    assert scored.where("int(score >= 0.5) <> toxic").count() == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 600
    assert toxicity.score_texts(odd_documents, model).count() == odd_documents.count()
    assert toxicity.drop_toxic(odd_documents, model).columns == odd_documents.columns
    untrained = toxicity.train(docs, labels.where("false"))
    assert toxicity.drop_toxic(docs, untrained).count() == 700
    assert toxicity.score_texts(no_documents, model).count() == 0


# ---- language

def test_language_on_held_out_documents(spark):
    guessed = QUERIES["op7_hyper_language"](spark, MIDDLE)
    truth = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    share = guessed.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97 and guessed.count() == truth.count()
    assert guessed.where("score < 0 or score > 1").count() == 0


def test_language_prediction_matches_plain_vectors(spark):
    rng = np.random.default_rng(8)
    docs = [(i, " ".join("".join(rng.choice(list("abcdeé" if i % 2 else "defghß"), 5)) for _ in range(30)), "xy"[i % 2]) for i in range(24)]
    d = hyper_language.DIMENSIONS

    def vector(text):
        t = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
        v = {c: hyper_language.letter_vector(c, d).astype(int) for c in set(t)}
        return sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(t, t[1:], t[2:]))

    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    learned = hyper_language.train(df.where("doc_id < 16"))
    plain = {lang: sum(vector(t) for i, t, l in docs if i < 16 and l == lang) for lang in "xy"}
    assert all((learned[lang] == plain[lang]).all() for lang in "xy")
    for r in hyper_language.predict(df, learned).collect():
        own = vector(docs[r.doc_id][1])
        cosine = {lang: own @ p / np.linalg.norm(own) / np.linalg.norm(p) for lang, p in plain.items()}
        assert r.lang_pred == max(sorted(cosine), key=cosine.get) == docs[r.doc_id][2] and abs(r.score - max(cosine.values())) < 1e-5


def test_texts_of_very_many_letters(spark):
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    assert len(letters) > 100_000
    df = spark.createDataFrame([(1, "".join(letters[:20_000]), "many"), (2, "abc def " * 9, "few"), (3, " ".join(letters[20_000:40_000]), "many")], "doc_id bigint, text string, lang string")
    learned = hyper_language.train(df)
    assert {r.doc_id: r.lang_pred for r in hyper_language.predict(df, learned).collect()} == {1: "many", 2: "few", 3: "many"}
    held = hyper_language.Trigrams(64)
    held.documents(pa.array(["".join(letters[:9000])]))
    again = held.documents(pa.array(["xyz"]))[0]
    assert (again == hyper_language.Trigrams(64).documents(pa.array(["xyz"]))[0]).all() and len(held.known) <= hyper_language.HELD + 1


def test_language_defined_cases(spark, odd_documents, no_documents):
    learned = hyper_language.train(odd_documents)
    assert set(learned) == {"en", "fr"}  # the German rows have no letters
    got = {r.doc_id: (r.lang_pred, r.score) for r in hyper_language.predict(odd_documents, learned).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "en" and got[9][0] == "fr"
    assert hyper_language.predict(odd_documents, {}).where("lang_pred <> 'und'").count() == 0
    assert hyper_language.train(no_documents) == {} and hyper_language.predict(no_documents, learned).count() == 0
    moved = hyper_language.train(odd_documents.repartition(7))
    assert all(np.array_equal(learned[k], moved[k]) for k in learned)


def test_trigram_vectors_are_bound_and_permuted():
    d = 64
    got, has = hyper_language.Trigrams(d).documents(pa.array(["ab", "", "1"]))
    a, b, blank = (hyper_language.letter_vector(c, d).astype(int) for c in (ord("a"), ord("b"), 0))
    want = np.roll(blank, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * blank
    assert np.array_equal(got[0], want) and has.tolist() == [True, False, False]


# ---- byte-pair encoding

WORDS = bpe.WordTable(bpe.Cutter(SPEC), bpe.PrefixEncoder(SPEC).encoded, kept=50)


def check_encoding(text):
    ids, written = WORDS.encode([text])
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids[0], "<u4").tolist() == want
    assert written[0] == LIBRARY.decode(want, skip_special_tokens=False) == bpe.decode_ids(SPEC, ids[0])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"abcdefghinrst'.,-1 ÄßΣé\n\x1c\x85\xa0İ_", "th", "'s", "<|endoftext|>", "<|", "the ", "ing"]), max_size=40).map("".join))
def test_encoding_equals_the_library(text):
    check_encoding(text)


def test_encoding_long_words_and_texts(spark, odd_documents):
    check_encoding("abracadabra" * 300)
    check_encoding("=" * 1000)
    got = {r.doc_id: r for r in bpe.encode_texts(odd_documents, bpe.tokenizer_path()).collect()}
    for r in odd_documents.collect():
        if r.doc_id is not None:
            want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
            assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == want
            assert got[r.doc_id].decoded == LIBRARY.decode(want, skip_special_tokens=False)


def test_encoding_query(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op9_bpe_prefix"](spark, SMALL).collect()}
    for r in documents.collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


# ---- exact duplicates

@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_oracles(spark, duck, name, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    want = duck(sf_dir).execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got, *columns) == Counter(want.fetchall())


def test_index_over_batches(spark, odd_documents, no_documents):
    index = digest_index.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets=4)
    first = {(r.doc_id, r.kept, r.group_size) for r in digest_index.mark_duplicates(odd_documents, index).collect()}
    assert {(2, True, 3), (1, False, 3), (4, True, 3), (3, False, 3), (None, False, 3), (7, True, 2), (6, False, 2)} <= first
    assert index.read().count() == index.read().select("digest").distinct().count() == 10
    again = odd_documents.where("doc_id in (1, 9)").unionByName(odd_documents.limit(0))
    for _ in range(2):  # a rerun of a batch is told the same and adds nothing
        second = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in digest_index.mark_duplicates(again, index, batch=1).collect()}
        assert second == {(1, 2, 5, False), (9, 9, 2, False)}  # keep_id names the row that stayed, sizes add up
        assert index.groups().count() == 10 and index.read().count() == 12
    assert digest_index.mark_duplicates(no_documents, index).count() == 0
    more = spark.createDataFrame([(50, "new text"), (51, "NEW text"), (52, "x")], "doc_id bigint, text string")
    for _ in range(2):
        assert {(r.doc_id, r.kept) for r in digest_index.mark_duplicates(more, index, batch=2).collect()} == {(50, False), (51, True), (52, False)}
    plan = index.unseen(digest_index.digest_groups(digest_index.hashed(more)), 3)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index.drop()


def test_drop_duplicates_keeps_one_row_of_each_text(spark, odd_documents):
    index = digest_index.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets=4)
    kept = digest_index.drop_duplicates(odd_documents, index)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i)) == [-5, 2, 4, 5, 7, 8, 9, 10, 11, None]
    index.drop()


# ---- words and ids of packing and training order

ODD_TEXTS = [" ".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])), "''s 't!'re 'RE 'll'd x's'S 1's²½ \x1c\x85\xa0", "é'd 中文's 𝒳's 😀!", "<|endoftext|> it's <|endoftext|>\x00\x7f", ""]


def test_near_and_far_patterns_cut_alike():
    for text in ODD_TEXTS:
        assert bpe._near_word().findall(text) == bpe._WORD.findall(text) or bpe._FAR.search(text)
        assert bpe._ASCII_WORD.findall(text) == bpe._WORD.findall(text) or not text.isascii()


def test_library_table_encodes_words_once_and_as_the_other_table_does(monkeypatch):
    table = cutting_stock.LibraryTable(SPEC, kept=50)
    want = bpe.WordTable(bpe.Cutter(SPEC), bpe.PrefixEncoder(SPEC).encoded).encode(ODD_TEXTS, False)[0]
    assert table.encode(ODD_TEXTS) == want and table.encode(ODD_TEXTS) == want  # also after it was emptied
    asked = []
    tokens = table.words._tokens
    table.words.clear()
    table.words._tokens = lambda word: asked.append(word) or tokens(word)
    table.encode(["one two one", "two One three"])
    assert asked == ["one", "two", "three"]
