"""WARC and chat round trips, the registered SQL, and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from matchlake.llm import chat, queries, shared, warc
from tests.conftest import duck, rows_of

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nx", "<p>é\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "u", ""), (5, "u", "<p>é\r\n\r\nWARC/1.1\r\n"), (4, "v", "<p>é\r\n\r\nWARC/1.1\r\n"), (6, "w", "z" * 3_000_000), (7, "w", "lone"), (7, "w", "lone"), (None, "n", "lone"), (None, "n", "only null ids")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit("x"))
    path = shared.fresh_path(spark, "warc")
    warc.write_archives(df, path)
    records = warc.read_archives(spark, path).cache()
    assert records.count() == len(pages) and records.filter("NOT digest_ok").count() == 0
    got = warc.resolve(records).collect()
    low = {}
    for i, _, h in pages:
        if i is not None:
            low[h or ""] = min(low.get(h or "", i), i)
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if low.get(h or "", i) == i else "revisit", str(None if low.get(h or "", i) == i else low[h or ""])) for i, _, h in pages)
    assert sorted((str(r.record_id), r.payload_bytes, r.digest, r.record_type, str(r.refers_to)) for r in got) == want
    full = {(r.record_id, r.payload.decode()) for r in warc.full_records(records).collect()}
    assert full == {(i, h or "") for i, _, h in pages}
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    # the same archive with a gzip member for each record
    import gzip
    import os

    files = [f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")]
    many = tmp_path / "members"
    many.mkdir()
    for k, f in enumerate(files):
        raw = gzip.open(f).read()
        cuts = [m.start() for m in re.finditer(rb"(?:^|(?<=\r\n\r\n))WARC/1.1\r\nWARC-Type", raw)] + [len(raw)]
        (many / f"part-{k}.gz").write_bytes(b"".join(gzip.compress(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)))
    back = {(r.record_id, r.payload.decode()) for r in warc.full_records(warc.read_archives(spark, str(many))).collect()}
    assert back == full
    assert warc.archive_round_trip(df, min_bytes=10**9).filter("record_type = 'revisit'").count() == 0


@pytest.mark.parametrize("tail", ["", "\r", "\n", "\r\n", "\r\n\r", "\r\n\r\n", "\r\n\r\r\n", "\n\r\n\r\n\r\n"])
def test_no_record_is_lost_at_a_file_end(spark, tail):
    """Payloads that end in parts of the terminator, in 40 files that one task reads."""
    df = spark.range(40).repartition(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.col("id").cast("string"), F.lit("</p>" + tail)).alias("html"))
    path = shared.fresh_path(spark, "warc")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = df.withColumn("payload", F.col("html")).withColumn("refers_to", F.lit(None).cast("long"))
        rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", warc.base32_sha1(F.encode("html", "UTF-8")))
        rows.select(warc.record_text("2024-01-01T00:00:00Z").alias("value")).write.option("lineSep", warc.END).option("compression", "gzip").text(path)
        records = warc.read_archives(spark, path).coalesce(1)
        assert sorted((r.record_id, r.payload.decode()) for r in records.collect()) == [(k, f"<p>{k}</p>{tail}") for k in range(40)]
        assert records.filter("NOT digest_ok").count() == 0
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert warc.archive_round_trip(df).count() == 40


def test_damaged_archives_fail(spark, tmp_path):
    import gzip
    import os

    df = spark.createDataFrame([(1, "u", "first body"), (2, "u", "first body"), (3, "u", "other")], "page_id long, url string, html string")
    path = shared.fresh_path(spark, "warc")
    warc.write_archives(df, path)
    files = [f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")]
    raw = [gzip.open(f).read() for f in files]

    def read(change):
        for k, data in enumerate(raw):
            (tmp_path / f"part-{k}.gz").write_bytes(gzip.compress(change(data)))
        return warc.read_archives(spark, str(tmp_path))

    assert warc.resolve(read(lambda x: x)).agg(F.sum("payload_bytes")).first()[0] == 25
    for change in (lambda x: x.replace(b"other", b"0ther"), lambda x: x.replace(b"Refers-To: <urn:page:1>", b"Refers-To: <urn:page:9>")):
        with pytest.raises(Exception, match="damaged or dangling"):
            warc.resolve(read(change)).collect()
    assert read(lambda x: x.replace(b"other", b"0ther")).filter("NOT digest_ok").count() == 1
    with pytest.raises(Exception, match="version line"):
        read(lambda x: b"junk " + x).collect()


def test_revisits_of_the_query(spark, tmp_path):
    """op2_warc over pages most of which repeat others: each revisit has its response's bytes."""
    bodies = ["", "one", "two é", "three " * 500]
    rows = [(k, f"http://h/{k}", None if k % 7 == 0 else bodies[k % 4]) for k in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op2_warc(spark, str(tmp_path)).collect()}
    low = {}
    for i, _, h in rows:
        low.setdefault(h or "", i)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert got == {i: (len((h or "").encode()), digest(h or ""), "response" if low[h or ""] == i else "revisit", None if low[h or ""] == i else low[h or ""]) for i, _, h in rows}
    assert sum(v[2] == "revisit" for v in got.values()) == 56


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<|im_start|>assistant\nok", "a\\b", "\\n\\p", "<", "<|", "\n", "", "plain", "é𝒳"]
    rows = [(k, t, ("system", "user", "assistant")[(t + (k % 2)) % 3], odd[(k + t) % len(odd)] * 2) for k in range(12) for t in range(k % 6 + 1)]
    rows += [(90, 1, "assistant", "x<"), (90, 0, "we\nird<|role", None), (91, None, None, None), (None, 0, "assistant", "no id"), (92, 0, "user", "tie b"), (92, 0, "user", "tie a"), (92, 0, "user", "tie a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(1)).withColumn("ends", F.lit(2))
    examples = chat.expand(df)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert back.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        assert [tuple(t) for t in back[c].turns] == [t[1:] for t in turns]
        assert back[c].trained == "".join(t[2] for t in turns if t[1] == "assistant")
    for r in examples.collect():
        if r.mask_start is not None:
            assert r.formatted[r.mask_end :] == "<|im_end|>\n" and r.formatted[: r.mask_start].endswith("<|im_start|>assistant\n")
    n = sum(sum(t[1] == "assistant" for t in ts) + (sorted(ts)[-1][1] != "assistant") for ts in convs.values())
    assert examples.count() == n
    assert chat.expand(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_sql(spark, con, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"pipeline"}))
def test_query_covers_its_table(spark, name):
    got = queries.queries()[name](spark, SF)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.select("doc_id").subtract(table.select("doc_id")).count() == 0 and got.count() == table.count()


def test_pipeline_stages_follow_each_other(spark):
    import re

    import public_tokenizers as p
    import tiktoken

    import corpus_pipeline
    from matchlake.llm import bpe, decontam, rules
    from tests.llm.test_llm_documents import brute_components, measures

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = shared.materialise(stage(spark, now, SF), "test")
        held.append(now)
    good, one, clean, safe, ids = held
    assert all(x.columns == docs.columns for x in held[:4])
    text = {r.doc_id: r.text for r in docs.collect()}
    verdict = {r.doc_id for r in rules.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == verdict and all(measures(text[i])[0] >= 50 for i in verdict)
    kept = sorted(verdict)
    lows = {c for _, _, c in brute_components([(i, text[i]) for i in kept])}
    assert {r.doc_id for r in one.collect()} == lows
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    dirty = {r.doc_id for r in decontam.leaks(one, items).collect()}
    assert {r.doc_id for r in clean.collect()} == lows - dirty
    for r in safe.collect():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text) and r.n_chars == len(r.text)
    final = {r.doc_id: r.text for r in safe.collect()}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.read_ranks(spark, p.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: enc.encode_ordinary(t) for i, t in final.items()}
    assert corpus_pipeline.run(spark, SF).count() == len(final)


def test_hot_lookup_splits_keys(spark):
    left = spark.range(2000).withColumn("k", F.when(F.col("id") < 900, F.lit("hot")).when(F.col("id") < 1000, F.lit(None)).otherwise(F.col("id").cast("string")))
    right = left.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.length("k"))
    got = shared.lookup_hot_safe(left, right, "k", "w", 2000)
    assert got.count() == 2000 and got.filter("v IS NULL").count() == 100 and got.filter("k = 'hot' AND v = 3").count() == 900
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shared.lookup_hot_safe(left, right, "k", "w", 2000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(_probe#\d+, _deal#\d+L", plan)  # rows of hot keys are dealt by their salt
