"""Each corpus query against plain Python over whole tables."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from check import compare
from tests.llm import brute

import __spark_entry__ as entry
from sightline.llm import bpe_fold
from sightline.llm import queries as corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(tables):
    return dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())


def rows(spark, name):
    return {r[0]: r for r in corpus.QUERIES[name](spark, SF).collect()}


def test_entry_has_every_query():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k in corpus.QUERIES}
    assert "pipeline" in names and set(corpus.ORACLE) <= set(entry.oracle_sql())


def test_op1(spark, docs):
    got = rows(spark, "op1_minhash_forest")
    want = brute.near(docs, 4)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_op2(spark, docs):
    got = rows(spark, "op2_suffix_levels")
    want = {i: (a, b, c, brute.sha(k)) for i, (a, b, c, k) in brute.repeats(docs).items()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want


def test_op3(spark, tables):
    got = rows(spark, "op3_url_ratio")
    for i, url in tables.sql("SELECT page_id, url FROM pages").fetchall():
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0].translate(brute.FOLD)
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [r for r in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
                if ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0] + best[1])
        assert got[i].verdict == best[2] if best else got[i].verdict in ("allow", "block")


def test_op4(spark, docs):
    ranks = bpe_fold.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = [len(coder.encode_ordinary(t or "")) for t in docs.values()]
    for n, r in rows(spark, "op4_token_lengths").items():
        assert r.n_docs == lengths.count(n)
        assert (r.docs_from, r.tokens_from) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.docs_upto, r.tokens_upto) == (sum(x <= n for x in lengths), sum(x for x in lengths if x <= n))
        assert r.truncated_total == sum(min(x, n) for x in lengths)


def test_op5(spark, tables):
    assert compare("op5", corpus.op5_license_digests(spark, SF), tables, corpus.ORACLE["op5_license_digests"]).startswith("ok")


def test_op6(spark, docs, tables):
    got = rows(spark, "op6_phrase_index")
    want = brute.leaks(docs, dict(tables.sql("SELECT item_id, text FROM benchmark").fetchall()))
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for i, r in got.items()} == {
        i: (n, h, len(ids), brute.sha(",".join(ids))) for i, (n, h, ids) in want.items()
    }
    assert all(r.contaminated == (r.n_hit > 0) for r in got.values())


def test_op7(spark, docs):
    ranks = bpe_fold.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op7_bpe_fold")
    for i, t in docs.items():
        ids = coder.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()))
        assert got[i].decoded_sha256 == brute.sha(t or "")


def test_op8(spark, tables):
    got = rows(spark, "op8_warc_zstd")
    pages = tables.sql("SELECT page_id, html FROM pages").fetchall()
    last = {}
    for i, h in pages:
        last[h or ""] = max(i, last.get(h or "", i))
    for i, h in pages:
        r, holder = got[i], last[h or ""]
        assert (r.payload_bytes, r.payload_digest) == brute.payload(h)
        assert (r.record_type, r.refers_to) == (("response", None) if holder == i else ("revisit", holder))


def test_op9(spark, docs):
    got = rows(spark, "op9_secret_trigrams")
    for i, t in docs.items():
        found = brute.secrets(t)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in found) for k in range(3)]
        assert got[i].base_sha256 == brute.sha(",".join(s[2] for s in found))
        assert set(s[2] for s in found) <= set(got[i].spans.split(","))


def test_op10(spark, docs):
    got = rows(spark, "op10_line_rules")
    for i, t in docs.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.line_metrics(t)
        assert not (r.kept and r.base_failed)
