import oracle
import pytest

from tessera.llm import conversation_repair, exact_dedup, license_scan, line_dedup, mixing, ngram_jaccard, quality_rules, secret_scan, warc

MODULES = (conversation_repair, exact_dedup, license_scan, line_dedup, mixing, ngram_jaccard, quality_rules, secret_scan, warc)


@pytest.mark.parametrize(("query", "sql"), [(m.QUERIES[n], s) for m in MODULES for n, s in m.SQL.items()], ids=[n for m in MODULES for n in m.SQL])
def test_matches_sql(spark, small, query, sql):
    oracle.check(spark, small, query, sql)
