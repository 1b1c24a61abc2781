"""Every stage of the corpus pipeline against brute force, on what the stage before it kept."""

import hashlib
import struct

import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from strandloom.llm import bpe, decontam, secrets, toxicity  # noqa: E402
from strandloom.llm.queries import ranks_path  # noqa: E402

from .test_documents import by_definition, components, spans  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.first()
    more = [(9_001, first.text, "en", "s", 1), (9_002, None, None, None, None), (9_003, "", "en", "s", 0), (None, "key secret=abcdefghijklmnop", "en", "s", 5), (9_004, "note token: 0123456789abcdefZZ end", "en", "s", 5)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    more.append((9_005, "Some words of the start. " + item.text + " And some of the end.", "en", "s", 9))
    now = docs.unionByName(spark.createDataFrame(more, docs.schema)).cache()
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]

    model = toxicity.train(now, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = now.collect()
    now = stages["toxicity"](spark, now, SF).cache()
    assert now.columns == columns and sorted(map(str, now.collect())) == sorted(str(r) for r in rows if model.score(r.text) < 0.3)

    rows = now.collect()
    now = stages["near_duplicates"](spark, now, SF).cache()
    fps = {r.doc_id: by_definition(r.text) for r in rows if r.doc_id is not None}
    stay = set(components(fps, 4).values()) | {None}
    assert sorted(map(str, now.collect())) == sorted(str(r) for r in rows if r.doc_id in stay)
    assert 9_001 not in {r.doc_id for r in now.collect()} or first.doc_id not in fps

    rows = now.collect()
    now = stages["decontamination"](spark, now, SF).cache()
    items = [decontam.question_and_answer(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(text):
        seen = decontam.words(text)
        share = lambda w: len((s := decontam.shingles(w)) & decontam.shingles_of(seen, len(next(iter(s))))) / len(s)
        return any(all(not w or share(w) >= 0.8 for w in parts) for parts in items)

    assert sorted(map(str, now.collect())) == sorted(str(r) for r in rows if not holds(r.text))
    assert 9_005 not in {r.doc_id for r in now.collect()}

    rows = {r.doc_id: r for r in now.collect()}
    table = secrets.train(secrets.labelled_samples(spark))
    found = {r.doc_id: [tuple(x.split(":")) for x in r.spans.split(",") if x] for r in secrets.report(secrets.scan(now, table)).collect()}
    now = stages["secrets"](spark, now, SF).cache()
    assert now.columns == columns and now.count() == len(rows)
    for r in now.collect():
        text, out, at = rows[r.doc_id].text, "", 0
        base = [(s, e) for s, _, e in spans(text or "")]
        every = sorted({(int(s), int(e)) for _, s, e in found[r.doc_id]})
        assert set(base) <= set(every)
        for s, e in every:
            out += (text[at:s] + "[SECRET]") if s >= at else ""
            at = max(at, e)
        assert r.text == (None if text is None else out + text[at:] if every else text)
        assert r.n_chars == (len(r.text) if every else rows[r.doc_id].n_chars)

    texts = {r.doc_id: r.text or "" for r in now.collect()}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks_path()), special_tokens={})
    tokens = stages["tokens"](spark, now, SF).collect()
    assert len(tokens) == len(texts)
    for r in tokens:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r.ids) == packed and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages_in_a_row(spark):
    got = corpus_pipeline.run(spark, SF)
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == sorted((r.doc_id, r.ids_sha256) for r in now.collect())
