"""Known companies from rows of workbooks, merged in order of arrival by code, name and other names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import company_key, credit_code
from .components import components

#: Characters of a company's rows that are kept, the last ones, and rows that are cut to it together.
TAIL, ROWS = 30_000, 1_000


def linked_rows(rows: DataFrame) -> DataFrame:
    """``rows(seq, name, code, aliases array, domain, evidence)`` with ``component`` and, within it, the number of the ``company`` and the row's place ``pos``.

    In order of ``seq`` (then name and code) a row goes to the company that has its code, else to the one that has its name, else it
    founds one; the company then has the row's code, its name and its other names, also where another had them before. Codes are
    compared as letters and digits in upper case, names by their keys. Rows that are joined by any key, directly or over others, are
    replayed in one task as a stream, whose state is the keys it has seen. Rows without a name are left out.
    """
    code = credit_code(F.col("code"))
    shown = F.filter(F.transform(F.array_prepend(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")), lambda n: F.trim(n)), lambda n: company_key(n) != "")
    own = rows.where(F.trim("name") != "").select("seq", F.trim("name").alias("name"), code.alias("code"), shown.alias("names"), "domain", "evidence", company_key(F.col("name")).alias("key"))
    keys = F.array_distinct(F.transform("names", lambda n: F.concat(F.lit("n:"), company_key(n))))
    own = own.withColumn("keys", F.when(F.col("code") != "", F.array_append(keys, F.concat(F.lit("c:"), "code"))).otherwise(keys))
    # a row without any key is alone
    own = own.withColumn("first", F.coalesce(F.get("keys", F.lit(0)), F.concat(F.lit("r:"), F.col("seq").cast("string"))))
    found = components(own.select(F.col("first").alias("a"), F.explode("keys").alias("b")).distinct())
    placed = own.join(found.withColumnRenamed("node", "first"), "first", "left").withColumn("component", F.coalesce("component", "first"))
    kept = ["component", "seq", "name", "code", "key", "names", "domain", "evidence"]
    stream = placed.select(*kept).repartition("component").sortWithinPartitions("component", "seq", "name", "code")

    def run(batches):
        component, by_name, by_code, count, pos = None, {}, {}, 0, 0
        for b in batches:
            homes, places = [], []
            for comp, key, names, code in zip(*(b.column(c).to_pylist() for c in ("component", "key", "other_keys", "code"))):
                if comp != component:
                    component, by_name, by_code, count, pos = comp, {}, {}, 0, 0
                home = by_code.get(code) if code else None
                home = home if home is not None else by_name.get(key)
                if home is None:
                    home, count = count, count + 1
                for k in names:
                    by_name[k] = home
                if code:
                    by_code[code] = home
                homes.append(home)
                places.append(pos)
                pos += 1
            rest = [n for n in b.schema.names if n not in ("key", "other_keys")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(homes, pa.int64()), pa.array(places, pa.int64())], names=[*rest, "company", "pos"])

    stream = stream.withColumn("other_keys", F.transform("names", lambda n: company_key(n)))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema if f.name not in ("key", "other_keys"))
    return stream.mapInArrow(run, f"{out}, company long, pos long")


def baseline_companies(rows: DataFrame) -> DataFrame:
    """The companies of ``linked_rows``: (component, company, canonical_name, credit_code, names, domains, evidence_text).

    The name is that of the founding row, the code the first that came, names and domains are sorted and different, and the text is the last 30,000
    characters of all rows' evidence, each after a blank.
    """
    linked = linked_rows(rows)
    by = ["component", "company"]
    merged = linked.groupBy(*by).agg(
        F.min_by("name", "pos").alias("canonical_name"), F.coalesce(F.min_by(F.nullif("code", F.lit("")), F.when(F.col("code") != "", F.col("pos"))), F.lit("")).alias("credit_code"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"), F.array_sort(F.collect_set(F.nullif("domain", F.lit("")))).alias("domains"),
    )

    def tails(texts, *keys):
        after = F.sum(F.length("text")).over(Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
        kept = texts.withColumn("after", F.coalesce(after, F.lit(0))).where(F.col("after") < TAIL)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), "")
        return kept.groupBy(*keys).agg(F.max("pos").alias("pos"), F.right(joined, F.lit(TAIL)).alias("text"))

    # a company's rows are cut by the thousand first, so no task gathers more than their tails
    texts = linked.select(*by, "pos", F.right(F.concat(F.lit(" "), F.coalesce("evidence", F.lit(""))), F.lit(TAIL)).alias("text"), F.floor(F.col("pos") / ROWS).alias("block"))
    tail = tails(tails(texts, *by, "block").drop("block"), *by).select(*by, F.col("text").alias("evidence_text"))
    return merged.join(tail, by)
