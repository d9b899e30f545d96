"""Revisit resolution against a loop, and the pipeline's stages against its parts."""

import random

from tests.oracle import connection, differences
from tilewright.llm.queries import ORACLES, QUERIES
from tilewright.llm.warc_revisit import canonical_url, resolve_revisits

SF = "/root/testdata/sf0.001"
SCHEMA = "id long, url string, ts long, revisit boolean, etag string, modified string, payload string, headers map<string,string>"


def test_queries_with_sql(spark):
    con = connection(SF)
    for name, sql in ORACLES.items():
        assert differences(spark, name, QUERIES[name], sql, data=SF, con=con) is None


def test_canonical_urls(spark):
    from pyspark.sql import functions as F

    pairs = {
        "http://WWW.Example.org:80/a/b/?b=2&utm_source=x&a=1#top": "example.org/a/b?a=1&b=2", "https://example.org": "example.org",
        "https://example.org/?ref=q": "example.org", "example.org/A": "example.org/A", "": "", "http://m.example.org/x//": "m.example.org/x",
    }
    got = spark.createDataFrame([(k,) for k in pairs], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == pairs
    assert spark.createDataFrame([(None,)], "u string").select(canonical_url(F.col("u")).alias("c")).first().c is None


def test_resolution_equals_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        revisit = rng.random() < 0.5
        tag, day = rng.choice([None, "a", "b"]), rng.choice([None, "d1", "d2"])
        headers = rng.choice([None, {"Date": str(i)}, {"date": str(i), "Content-Length": "0"}, {"x": "1", "vary": "y"}, {"DATE": "0", "ETag": "e"}])
        rows.append((i, rng.choice(["u.x/1", "u.x/2", "u.x/2/", None]), rng.choice([None, *range(30), -(10**15), 10**17]), revisit, tag, day, None if revisit else f"p{i}", headers))
    got = {r.id: r for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(4), slices=5).collect()}
    permitted = {"cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"}
    for i, url, ts, revisit, tag, day, _, headers in rows:
        if not revisit:
            assert i not in got
            continue
        key = url and url.rstrip("/")
        earlier = [r for r in rows if not r[3] and r[2] is not None and ts is not None and url and r[1] and r[1].rstrip("/") == key and r[2] < ts]
        best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        if best is None:
            want = (None, "missing", None, headers or {})
        elif (tag == best[4]) if tag and best[4] else (day is not None and day == best[5]):
            sent = {k: v for k, v in (headers or {}).items() if k.lower() in permitted}
            names = {k.lower() for k in sent}
            want = (best[0], "resolved", best[6], {**{k: v for k, v in (best[7] or {}).items() if k.lower() not in names}, **sent})
        else:
            want = (best[0], "changed", None, headers or {})
        r = got[i]
        assert (r.response_id, r.status, r.payload, r.headers) == (*want[:3], "\n".join(sorted(f"{k}: {v}" for k, v in want[3].items())))
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_odd_times_repeated_rows_and_long_payloads(spark):
    """One bad time doesn't put all others into one slice; repeated rows are resolved each; clashing columns do no harm."""
    from pyspark.sql import functions as F

    body = "x" * 3_000_000
    rows = [(i, "u.x/1", 100 + i, i % 2 == 1, "a", None, None if i % 2 else body, None) for i in range(8)] + [(99, "u.x/1", 10**18, False, "b", None, "late", None)]
    frame = spark.createDataFrame(rows + [rows[1], rows[0]], SCHEMA)
    for name in ("uid", "slice", "near", "carried", "r", "status", "of_uid", "canonical_url", "response_id", "time"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = sorted((r.id, r.response_id, r.status, len(r.payload)) for r in resolve_revisits(frame).collect())
    assert got == [(1, 0, "resolved", len(body)), (1, 0, "resolved", len(body)), (3, 2, "resolved", len(body)), (5, 4, "resolved", len(body)), (7, 6, "resolved", len(body))]


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tilewright.llm import exact_dedup, jaccard_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    now = docs
    kept = [now.count()]
    for name, apply in corpus_pipeline.STAGES[:-1]:
        now = apply(spark, now, SF).cache()
        assert now.columns == docs.columns, name
        kept.append(now.count())
        if name == "exact_dedup":
            assert exact_dedup.exact_dedup(now).filter("not kept").count() == 0
        if name == "jaccard_join":
            assert jaccard_join.jaccard_join(now).filter("doc_id <> component_id").count() == 0
    assert kept == sorted(kept, reverse=True) and kept[-1] < kept[0]
    left = {r.doc_id for r in now.collect()}
    assert not [i for i, q in known.items() if q == 0 and i in left]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in packed.collect()} == left
