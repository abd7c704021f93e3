"""The registered queries: the columns that each must return, and their rows against the tables by plain means."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from parchment.llm import packing
from parchment.llm.queries import QUERIES
from test_operators import base, components, links

COLUMNS = {
    "op1_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op3_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint, n_links bigint",
    "op5_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_pack": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
}


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows_of(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert ", ".join(" ".join(c) for c in df.dtypes).startswith(COLUMNS[name])
    return df.collect()


def test_search_query(spark, sf):
    vectors = {r[0]: np.array(r[1], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    ids = np.array(sorted(vectors))
    whole = np.stack([vectors[i] for i in ids])
    got, hits, wanted = {}, 0, 0
    for r in rows_of(spark, sf, "op1_ann"):
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        scores = whole @ vectors[q]
        scores[ids == q] = -np.inf
        best = set(ids[np.argsort(-scores, kind="stable")[:20]])
        hits, wanted = hits + len(best & {f[2] for f in found}), wanted + 20
    assert hits >= 0.9 * wanted


def test_media_query(spark, sf, texts):
    rows = rows_of(spark, sf, "op2_media_columns")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id].text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_join_query(spark, sf, texts):
    docs = [(d, r.text or "") for d, r in sorted(texts.items())]
    rows = rows_of(spark, sf, "op3_ngram_join")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(docs, 3, 90, 100)
    assert {r.doc_id: r.n_links for r in rows} == links(docs, 3, 90, 100)


def test_mixing_query(spark, sf, texts):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in texts.items()}
    rows, sources = rows_of(spark, sf, "op5_mix_sources"), {}
    assert {r.doc_id: r["size"] for r in rows} == size and all(r.taken <= 2 * r["size"] for r in rows)
    for r in rows:
        sources.setdefault(texts[r.doc_id].source, []).append(r)
    total = 0
    for own in sources.values():
        whole = sum(r["size"] for r in own)
        assert {r.source_size for r in own} == {whole} and len({r.target for r in own}) == 1 and own[0].target <= 2 * whole + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(1, whole / 256) + 1
        total += own[0].target
    assert total == pytest.approx(1.5 * sum(size.values()))
    assert sorted(map(str, rows)) == sorted(map(str, rows_of(spark, sf, "op5_mix_sources")))


def test_quality_query(spark, sf, texts):
    rows = rows_of(spark, sf, "op6_quality")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_packing_query(spark, sf, texts):
    from tokenizers import Tokenizer

    tokenizer, pieces, placed = Tokenizer.from_file(packing.default_tokenizer()), {}, {}
    for r in rows_of(spark, sf, "op7_pack"):
        pieces.setdefault(r.doc_id, []).append(r)
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces) == sorted(texts)
    for d, own in pieces.items():
        ids, at = tokenizer.encode(texts[d].text or "", add_special_tokens=False).ids + [0], 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(ids)
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_personal_data_query(spark, sf, texts):
    rows = rows_of(spark, sf, "op8_pii")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        spans = base(texts[r.doc_id].text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in ("email:", "ip:", "card:", "phone:")]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r.spans.split(",")) | {""}


def test_archive_query(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {}
    for p in sorted(pages):
        last[pages[p]] = p
    for r in rows_of(spark, sf, "op10_warc"):
        own = pages.get(r.page_id)
        again = len(own) >= 1000 and last[own] != r.page_id
        assert tuple(r)[1:5] == (len(own), hashlib.sha1(own).hexdigest(), "revisit" if again else "response", last[own] if again else None)
