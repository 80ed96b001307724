"""The workbook source and sink, tables that change together, and streams against batches."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evigraph.operators import baseline, gates, resolve, verify
from evigraph.sources.versions import RunActive, Versions
from evigraph.sources.workbook import Workbook
from evigraph.streaming.stateful import failure_pauses, run_available, within_budget

HEADINGS = {"name": ["企查查匹配企业名称", "企业名称"], "code": ["统一社会信用代码"], "aliases": ["曾用名"], "website": ["官网"]}


@pytest.fixture(scope="module")
def books(spark):
    spark.dataSource.register(Workbook)
    return spark


def test_written_and_read(books, tmp_path):
    rows = [(i, f"name <{i}> & \"q\" ü 中", i / 4, i % 2 == 0, None if i % 3 else "x\ny") for i in range(250)]
    frame = books.createDataFrame(rows, "id int, text string, half double, flag boolean, gap string").repartition(3)
    path = str(tmp_path / "out")
    frame.write.format("workbook").option("rows", 40).option("sheet", "数据").mode("append").save(path)
    assert len(list((tmp_path / "out").glob("*.xlsx"))) == 3 and (tmp_path / "out" / "_SUCCESS").exists() and not list((tmp_path / "out").glob("_temp*"))
    columns = json.dumps({c: [c] for c in frame.columns})
    got = books.read.format("workbook").option("columns", columns).load(path)
    assert got.select("path", "sheet").distinct().count() >= 6  # all sheets of all files, 40 rows each at most
    assert got.groupBy("path", "sheet").count().agg(F.max("count")).first()[0] == 40
    back = sorted((int(r.id), r.text, float(r.half), r.flag == "True", r.gap) for r in got.collect())
    assert back == sorted(rows, key=lambda r: r[0])
    frame.limit(2).coalesce(1).write.format("workbook").mode("overwrite").save(path)
    assert books.read.format("workbook").option("columns", columns).load(path).count() == 2


def test_failed_write_leaves_nothing(books, tmp_path):
    path = str(tmp_path / "bad")
    frame = books.range(100).select(F.when(F.col("id") > 90, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("x")).repartition(4)
    with pytest.raises(Exception):
        frame.write.format("workbook").mode("append").save(path)
    assert not list((tmp_path / "bad").glob("**/*.xlsx"))


def sheet_xml(rows):
    from evigraph.sources.workbook import _MAIN, _row

    return f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>' + "".join(_row(n, cells) for n, cells in rows) + "</sheetData></worksheet>"


def test_header_is_found_and_companies_merge(books, tmp_path):
    """All sheets with a header count, wherever it stands; shared texts, dates and numbers are read."""
    from evigraph.sources.workbook import _MAIN, _frame

    with zipfile.ZipFile(tmp_path / "base.xlsx", "w") as z:
        for name, text in _frame(["甲", "none", "乙"]).items():
            z.writestr(name, text)
        z.writestr("xl/worksheets/sheet1.xml", sheet_xml([(2, [None, "序号", "企业名称", "统一社会信用代码", "曾用名"]), (3, [None, 1, "甲公司", "ab 1", "旧甲；老甲"]), (5, [None, 2, None, "X"])]))
        z.writestr("xl/worksheets/sheet2.xml", sheet_xml([(1, ["no", "header"]), (2, ["企业", "x"])]))
        shared = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>官网</t></is></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="C2" s="1"><v>45292</v></c><c r="D2"><v>2.5</v></c></row></sheetData></worksheet>'
        z.writestr("xl/worksheets/sheet3.xml", shared)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN[1:-1]}"><si><t>企业名称</t></si><si><t>曾用名</t></si><si><r><t>老</t></r><r><t>甲</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN[1:-1]}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    got = books.read.format("workbook").option("columns", json.dumps(HEADINGS)).load(str(tmp_path / "base.xlsx"))
    rows = [(r.sheet, r.name, r.code, r.aliases, r.website) for r in got.orderBy("seq").collect()]
    assert rows == [("甲", "甲公司", "ab 1", "旧甲；老甲", None), ("甲", None, "X", None, None), ("乙", "老甲", None, "2024-01-01 00:00:00", "2.5")]
    cells = books.read.format("workbook").load(str(tmp_path / "base.xlsx"))
    assert cells.count() == 7 and cells.where("sheet = 'none'").first().cells == ["no", "header"]
    companies = got.select("seq", "name", "code", F.split("aliases", "[;；]").alias("aliases"), F.coalesce("website", F.lit("")).alias("domain"), F.col("name").alias("evidence"))
    merged = baseline.baseline_companies(companies).collect()
    assert [(r.canonical_name, r.credit_code, r.evidence_text) for r in merged] == [("甲公司", "AB1", " 甲公司 老甲")]


def test_batch_match_workbook(books, tmp_path):
    """The ten columns of a batch match, written and read back."""
    from evigraph.operators import export

    records = books.createDataFrame([(1, "鹿明机器人科技（深圳）有限公司", "甲", 2), (2, "甲方工业机器人有限公司", "甲", 3)], "r_id long, r_name string, sheet string, row int")
    asked = books.createDataFrame([(1, "鹿明（深圳）机器人科技有限公司"), (2, " "), (3, "甲方工业机器人公司"), (4, "鹿明（深圳）机器人科技有限公司")], "q_id long, q_name string")
    out = export.batch_match(asked, records)
    assert out.columns == ["q_id", "q_name", *export.MATCH_COLUMNS]
    out.coalesce(1).write.format("workbook").mode("append").save(str(tmp_path / "m"))
    columns = json.dumps({c: [c] for c in out.columns})
    got = {r.q_id: r for r in books.read.format("workbook").option("columns", columns).load(str(tmp_path / "m")).collect()}
    assert got["1"]["是否包含"] == "是" and got["1"]["相似度"] == "1" and got["1"]["最相似企业名称"] == "鹿明机器人科技（深圳）有限公司" and got["1"]["模糊度"] == "0"
    assert got["1"]["候选Top3"].startswith("1. 鹿明机器人科技（深圳）有限公司（100.00%）") and got["4"]["匹配结论"] == got["1"]["匹配结论"]
    assert all(got["2"][c] is None for c in export.MATCH_COLUMNS) and got["3"]["是否相似"] == "是" and got["3"]["是否包含"] == "否" and got["3"]["匹配来源"] == "甲!第3行"


# --- tables that change together


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    one = spark.createDataFrame([(1, "a")], "id int, x string")
    assert store.version() == 0 and store.tables() == {}
    store.commit({"relations": one, "products": one})
    assert store.version() == 1 and store.read("products").collect() == one.collect()
    two = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    store.commit({"products": store.read("products").unionByName(two.where("id = 2"))})  # a table is read while it is replaced
    assert store.version() == 2 and store.read("products").count() == 2 and store.read("relations").count() == 1
    assert store.read("products", version=1).count() == 1


def test_killed_commit_leaves_the_old_version(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    good = spark.createDataFrame([(1,)], "id int")
    store.commit({"a": good, "b": good})
    bad = spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).cast("int").alias("id"))
    with pytest.raises(Exception):
        store.commit({"a": good.unionByName(good), "b": bad})
    assert store.version() == 1 and store.read("a").count() == store.read("b").count() == 1
    with pytest.raises(ValueError):
        store.commit({"a": good}, expected=0)  # another writer was faster
    store.commit({"a": good.limit(0)}, expected=1)
    assert store.version() == 2 and store.read("a").count() == 0 and store.read("b").count() == 1


def test_emptied_unless_a_run_is_active(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    rows = spark.range(3).withColumnRenamed("id", "x")
    store.commit({"relations": rows, "sources": rows.limit(2), "products": rows.limit(1)})
    store.begin("run 1")
    with pytest.raises(RunActive):
        store.emptied(["relations", "sources", "products"])
    assert store.read("products").count() == 1
    store.end("run 1")
    assert store.emptied(["relations", "sources", "products"]) == {"relations": 3, "sources": 2, "products": 1}
    assert [store.read(n).count() for n in ("relations", "sources", "products")] == [0, 0, 0] and store.read("products").columns == ["x"]
    with pytest.raises(ValueError):
        store.end("run 1")


def test_counters_without_a_second_scan(spark, tmp_path):
    rows = spark.createDataFrame([(o,) for o in ["created", "created", "rejected", None, "skipped"]], "outcome string")
    written = {}
    for n, part in enumerate((rows.limit(2), rows.subtract(rows.limit(0)).where("outcome is null or outcome <> 'created'"), rows.limit(0))):
        counted, counters = gates.observed_counters(part, name=f"run {n}")
        counted.write.mode("overwrite").parquet(str(tmp_path / f"{n}"))
        written = gates.merged_counters(written, counters)
    assert written == gates.run_counters(rows).first().asDict()


# --- streams


def played(spark, frame, parts, tmp_path, name, made, restart):
    """The stream's rows when the table comes in ``parts`` files, with or without a stop between."""
    source = tmp_path / f"{name}-in"
    rows = frame.collect()
    size = -(-len(rows) // parts)
    out, check = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check")
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], frame.schema)
        part.coalesce(1).write.parquet(str(source / f"{i:03}"))
        if restart:
            run_available(made(spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))), out, check)
    if not restart:
        run_available(made(spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))), out, check)
    return spark.read.parquet(out)


@pytest.mark.parametrize("parts,restart", [(1, False), (4, False), (3, True)])
def test_streams_equal_batches(spark, tmp_path, parts, restart):
    import random

    rng = random.Random(parts)
    calls = spark.createDataFrame([(rng.choice("abc"), i, rng.choice([502, 502, 200])) for i in range(150)], "source string, seq long, code int")
    want = sorted(map(tuple, verify.failure_pauses(calls, "source", "seq", "code").select("source", "seq").collect()))
    got = played(spark, calls, parts, tmp_path, "t05", lambda s: failure_pauses(s, "source", "seq", "code"), restart)
    assert sorted(map(tuple, got.collect())) == want and want
    asked = spark.createDataFrame([(1, i, rng.choice(["Acme Co", "acmeco", "乙", "known", "third", "ACME  CO", " ", "Fourth", "fifth"])) for i in range(60)], "run_id long, seq long, name string")
    known = spark.createDataFrame([("known",)], "key string")
    want = sorted(map(tuple, resolve.within_budget(asked, known, 3).select("seq", "name", "status").collect()))
    got = played(spark, asked, parts, tmp_path, "t08", lambda s: within_budget(s, known, 3), restart)
    assert sorted((r.seq, r.name, r.status) for r in got.collect()) == want and {s for *_, s in want} == {"called", "cached", "blocked"}
