import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, part int, h string, shard int, length long, rank int"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (doc_id, text) rows, with further columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None, 7, "x", 1, 2, 3) for i, t in rows], EXTRA)

    return make


@pytest.fixture
def table(tmp_path):
    """Write a DataFrame as a table of a scale folder and give that folder."""

    def write(df, name="documents"):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
