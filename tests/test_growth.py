"""Work and memory that must not grow faster than the input."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from evigraph.functions import html
from evigraph.llm import linededup, packing, toxicity
from evigraph.llm.util import shared_dir, temporary, written
from evigraph.operators import lookup, resolve


def test_scoped_product_of_a_large_company(spark):
    """F8: many items of a company with many relations meet by candidate; all items times all relations would be 1.6 billion rows."""
    n = 40_000
    items = spark.range(n)
    candidates = items.selectExpr("id AS item_id", "explode(array(id, id + 1)) AS product_id").selectExpr("item_id", "product_id AS seq", "product_id")
    relations, companies = items.where("id % 2 = 1").selectExpr("id AS product_id", "0L AS company_id"), items.selectExpr("id AS item_id", "explode(array(0L, 0L, null)) AS company_id")
    got = {r.item_id: r.product_id for r in resolve.scoped_product(candidates, relations.union(relations), companies).collect()}
    assert got == {i: i if i % 2 or i == n - 1 else i + 1 for i in range(n)}


def test_relation_sources_by_parts(spark, monkeypatch):
    """tasks grow in number with the evidence, repeated rows and sources without a claim count as before."""
    monkeypatch.setattr(resolve, "ROWS", 7)
    evidence = spark.createDataFrame([(r, p, "u") for r in range(5) for p in range(r + 1)] * 4 + [(9, 99, "u"), (8, None, "u")], "relation_id int, product_id int, source_url string")
    sources = spark.createDataFrame([(p, "u", "official" if p == 3 else "other", "" if p else None, f"c{p // 2}") for p in range(5)], "product_id int, source_url string, source_type string, claim_fingerprint string, content_hash string")
    found = resolve.relation_sources(evidence, sources)
    assert {tuple(r) for r in found.collect()} == {(r, r // 2 + 1, r >= 3) for r in range(5)} | {(9, 0, False), (8, 0, False)}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_pages_row_by_row(spark):
    """no batch of ten thousand pages is in a Python worker."""
    long = "<title>T</title><body>" + "word " * 40_000 + "</body>"
    pages = html.pages_from_html(spark.range(30).select(F.col("id").cast("string").alias("url"), F.lit(long).alias("html")))
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert {(r.title, len(r.content)) for r in pages.collect()} == {("T", 199_999)}


def test_products_of_one_name(spark):
    """products of one name and many models meet by both; all pairs of the name would be 3.6 billion. Null ids, repeated ones and products without a model count."""
    n = 60_000
    p = spark.range(n).selectExpr("id", "'arm' AS normalized_name", "concat('m', id) AS model_key").union(spark.sql("SELECT null, 'arm', '' UNION ALL SELECT 7L, 'arms', 'm7' UNION ALL SELECT 7L, 'arms', 'm7'"))
    found = lookup.same_products(p, p)
    pairs = found.groupBy(F.expr("left_id <=> right_id").alias("same"), F.expr("left_id IS NULL OR right_id IS NULL").alias("bare")).count()
    assert {tuple(r) for r in pairs.collect()} == {(True, False, n + 8), (False, True, 2 * n), (True, True, 1)}


def test_series_in_blocks(spark, monkeypatch):
    """the pairs of one large series are made by many tasks, from blocks of ids, all of them."""
    monkeypatch.setattr(lookup, "IDS", 3)
    monkeypatch.setattr(lookup, "PAIRS", 50)
    rows = [(i // 2, "s" if i < 40 else "", None if i % 9 == 0 else f"m{i % 4}") for i in range(44)] + [(None, "s", "m1")]
    p = spark.createDataFrame(rows, "id int, series_key string, model_key string")
    found = lookup.same_series(p, p)
    want = sorted(str((a[0], b[0])) for a in rows for b in rows if a[1] == b[1] == "s" and None not in (a[2], b[2]) and a[2] != b[2])
    each = found.select("left_id", "right_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(str((r.left_id, r.right_id)) for r in each) == want and len({r.task for r in each}) > 4


def test_toxicity_by_few_rows():
    """pipeline: texts of one Arrow batch aren't in Python all at once, and go back a few hundred at a time."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [None, *(f"text {i}" for i in range(999))]})
    parts = list(toxicity._scorer(toxicity.Lexicon({"text": 1.0}), 0.7)(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 1 and max(p.num_rows for p in parts) <= 256
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(1000)) and {n for p in parts for n in p.schema.names} == {"doc_id", "text", "tox_score", "tox_predicted"}


def _tables(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return {f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}


def test_disk_of_written_tables(spark):
    """what was shuffled for a table goes once it is written, tables go with their scope, kept ones with the next."""
    shuffled = lambda: sum("shuffle_" in f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split(" "))
    before, had = shuffled(), _tables(spark)
    with temporary(spark):
        with temporary(spark) as keep:
            rows = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "inner")
            kept = keep(written(rows.where("k < 3"), "stays"))
        assert {n.split("-")[0] for n in _tables(spark) - had} == {"stays"} and len(kept.collect()) == 3
    deadline = time.monotonic() + 20
    while shuffled() > before and time.monotonic() < deadline:  # they go in the background
        time.sleep(0.2)
    assert shuffled() <= before and _tables(spark) == had


def test_line_dedup_leaves_one_table(spark):
    """of all that line dedup writes only the lines that go are left, and its rows come from these."""
    line = lambda i: " ".join(f"word{(i * 7 + j) % 50}" for j in range(12))
    docs = spark.createDataFrame([(i, "\n".join(line(i + j) + "!" * (i % 2) for j in range(3))) for i in range(30)], "doc_id long, text string")
    had = _tables(spark)
    out = linededup.dedup_lines(docs)
    assert [n.split("-")[0] for n in _tables(spark) - had] == ["linegone"]
    assert out.count() == 30 and 0 < out.agg(F.sum("n_kept")).first()[0] < 90


def test_line_buckets_of_the_same_lines(spark):
    """of buckets with the same lines one stays; others stay whole."""
    own = {1: [5, 6, 7], 2: [6, 7], 3: [5, 6, 7], 4: [5, 7], 9: [6, 7], 8: [-1, 7]}
    places = spark.createDataFrame([(k, i, min(v)) for k, v in own.items() for i in v], "key long, lid long, leader long")
    assert {(r.key, r.lid) for r in linededup._different(places).collect()} == {(k, i) for k in (1, 2, 4, 8) for i in own[k]}


def test_folded_parities_lose_no_pair(spark):
    """short lines move fewer words; what all words let through passes, and most unlike lines of any length don't."""
    text = lambda s, n: "".join(random.Random(s).choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    lines = [(10 * k + v, t) for k, n in enumerate((60, 380, 420, 950, 1050, 3000)) for v, t in enumerate((text(k, n), text(k, n - 9) + "other end", text(k + 50, n)))]
    bits = linededup._bits(spark.createDataFrame(lines, "lid long, line string"))
    pairs = lambda d, near: {(r.a, r.b) for r in linededup._ends(every, d).where(near).collect()}
    every = spark.createDataFrame([(a, b) for a, _ in lines for b, _ in lines if a < b], "a long, b long")
    exact, folded = pairs(bits, linededup._near(0.8)), pairs(linededup._folded(bits), linededup._near_folded(0.8))
    assert exact <= folded and len(exact) >= 5 and len(folded) <= len(exact) + 3
    assert {r.lid: (r.p4, r.p8) for r in linededup._folded(bits).collect()}[0] == (0, 0)


def test_packing_by_few_texts():
    """pipeline: the texts of an Arrow batch aren't in Python all at once."""
    assert len(list(packing.few(pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "text": ["x"] * 2500})))) == 3
