"""The pipeline's stages, each on its own input."""

import random

import corpus_pipeline
from quizloom.llm import decontaminate, neardup, scratch, secret_scan, toxicity


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.store(stage(spark, docs, tiny), f"test-{name}")
        before, after = ids(docs), ids(out)
        assert after <= before
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
            assert after == ids(toxicity.score(docs, model).where("predicted = 0"))
        elif name == "minhash_near_dedup":
            assert after == ids(neardup.near_duplicates(docs).where("kept")) and after != before
        elif name == "benchmark_decontamination":
            bad = ids(decontaminate.contaminated(docs, spark.read.parquet(f"{tiny}/benchmark.parquet")))
            assert after == before - bad
        elif name == "secret_scans":
            assert after == before and not ids(secret_scan.scan(out).where("n_assign + n_access + n_hex > 0"))
        if name != "source_mixing":
            assert out.columns == columns
        docs = out
    assert {"copy", "shuffle_key", *columns} == set(docs.columns)
    assert len(corpus_pipeline.STAGES) == 5


def test_run_as_a_chain_with_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, copies, leaks, secrets and clashing columns through all five stages."""
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item, copy, toxic = fresh(30), fresh(60), "idiot scum you worthless trash "
    rows = [(i, fresh(40)) for i in range(60)] + [(100 + i, toxic * 3 + fresh(12)) for i in range(60)]
    rows += [(200, copy), (201, copy), (202, copy + " tail"), (203, f"{fresh(20)} {item} {fresh(20)}"), (204, fresh(20) + " password=abcdefabcdefabcd")]
    rows += [(205, None), (206, ""), (None, fresh(20)), (None, None), (207, "v " * 50_000), (208, fresh(20)), (208, None)]
    rows.append(rows[-2])
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), "x", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kept string, _id int")
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*range(60), *range(100, 160)]], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.store(stage(spark, now, str(tmp_path)), name)
        seen[name] = [(r["doc_id"], r["text"]) for r in now.collect()]
        assert name == "source_mixing" or now.columns == docs.columns
    plain = [r for r in rows if r[0] is None or not 100 <= r[0] < 160]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(seen["toxicity"], key=key) == sorted(plain, key=key)
    left = [r for r in plain if r[0] not in (201, 202)]
    assert sorted(seen["minhash_near_dedup"], key=key) == sorted(left, key=key)
    left = [r for r in left if r[0] != 203]
    assert sorted(seen["benchmark_decontamination"], key=key) == sorted(left, key=key)
    assert {i: t for i, t in seen["secret_scans"]}[204].endswith(" [SECRET]") and len(seen["secret_scans"]) == len(left)
    before = scratch.stored()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"] or -1, r["copy"]) for r in out.collect()) == sorted((r["doc_id"] or -1, r["copy"]) for r in now.collect())
    assert len(scratch.stored()) == len(before) + 1
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
