"""The queries of the training-data operators and, where SQL can follow them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bandwright.llm import bpe, collocation, decontaminate, extract, langid, neardup, packing, quality, substring, tokenfile, urlfilter, variants, warc
from bandwright.llm.common import table
from bandwright.llm.tokens import default_path

Query = Callable[[SparkSession, str], DataFrame]

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS c FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.doc_id, g, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(c, 1), g) AS k FROM s JOIN n USING (doc_id) LEFT JOIN f USING (g)),
p AS (SELECT doc_id, n, g FROM r WHERE k <= n - ceil(n * 80 / 100.0) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p AS a JOIN p AS b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
i AS (SELECT a, b, na, nb, count(*) AS common FROM c JOIN s AS x ON x.doc_id = a JOIN s AS y ON y.doc_id = b AND x.g = y.g GROUP BY ALL),
e AS (SELECT a, b FROM i WHERE 100 * common >= 80 * (na + nb - common)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT t.b, walk.root FROM walk JOIN t ON t.a = walk.node WHERE walk.root < t.b),
m AS (SELECT node, min(root) AS component_id FROM walk GROUP BY node)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = documents.doc_id AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN m ON m.node = documents.doc_id"""


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_digest(table(spark, sf_dir, "documents"), default_path(), end_id=2)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_digest(packing.sequences(table(spark, sf_dir, "documents"), default_path(), end_id=1))


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).drop("removed")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), default_path())


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_langid, op2_token_file, op3_url_filter, op4_substring, op5_decontaminate, op6_warc, op7_packing, op8_extract, op9_quality, op10_neardup, op11_collocation, op12_bpe, op13_variants)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": urlfilter.oracle(), "op6_warc": warc.ORACLE, "op9_quality": quality.oracle(), "op10_neardup": OP10_SQL, "op11_collocation": collocation.ORACLE, "op13_variants": variants.ORACLE}
