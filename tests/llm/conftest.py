import public_tokenizers
import pytest

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


ODD_TEXTS = [None, "", " ", "x", "a a a a a a", "naïve Ünï çödé 中文 😀", "tab\tand\nline\x0bfeed", "<|endoftext|> odd\x1ctext", "word " * 3000, "zz" * 4000, "it's 1.2.3... (ok), \"no\"***"]


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(3, "x"), (3, "x"), (None, "x"), (None, None), (50, "a b c d e f g"), (51, "a b c d e f g")]
    return docs_of(rows)
