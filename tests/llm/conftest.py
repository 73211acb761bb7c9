import pytest

CLASH = {"k": "x", "t": "y", "fp": 1, "h": 2, "size": 3, "shard": 4, "rows": 5, "least": 6, "ids": "z", "spans": "w", "host": "q", "fingerprint": "f"}


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text, ...) rows with further columns whose names operators use inside."""

    def make(rows, lang=None):
        full = [(i, t, lang(i, t) if lang else "en", "src", len(t or ""), *CLASH.values()) for i, t in rows]
        kinds = ", ".join(f"{c} {'int' if isinstance(v, int) else 'string'}" for c, v in CLASH.items())
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")

    return make
