import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows():
    """Rows of a table of the smallest given data, as tuples."""
    def read(table, columns, order):
        return duckdb.sql(f"SELECT {columns} FROM '{SF}/{table}.parquet' ORDER BY {order}").fetchall()
    return read


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every awkward case: nulls in each column, empty, blank
    and long texts, copies, repeated rows, and clashing extra columns."""
    base = " ".join(f"word{i % 37} and other{i % 11}" for i in range(60))
    data = [(1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, base + " end", "en", "a", 5), (4, "", "de", "a", 0), (5, None, None, None, None), (6, " \t\n ", "fr", "b", 4),
            (7, "x", "en", "b", 1), (7, "x", "en", "b", 1), (None, "no id here at all, none", "en", "c", 3), (8, ("long text " * 9000) + "é" * 50, "en", "c", 9), (9, "12 345 --", None, "c", 9), (10, "Ünï çødé 漢字 😀", "de", "c", 9)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 AS score", "'z' AS lang_pred", "2 AS n_words", "3 AS hits", "4 AS fingerprint", "5 AS pii", "6 AS n_lines", "7 AS rank", "8 AS bucket", "9 AS site_host", "10 AS least", "11 AS duplicate_id")
