"""Small tables and plain-Python restatements that the corpus operators are held against."""

import re

SMALL = "/root/testdata/sf0.001"
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Nulls, empty and white texts, one word, repeats, a very long text, special strings, other alphabets.
EDGE_TEXTS = [None, "", " \t\n\x0b\x0c\r ", "word", "two words", "same text here again", "same text here again",
              "A" * 70_000 + " end", "tick tock " * 8_000, "<|endoftext|> in a text", "naïve café ÅNGSTRÖM ﬀ ß",
              "日本語 テキスト と 한국어", "a b c\u0085d", "\x00\x01 nul", "1.2.3.4 and 300.1.1.1", "İstanbul K ſ"]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def edge_docs(spark):
    """The edge texts, one null id, a row twice, and columns whose names clash with the operators' own."""
    rows = [(i, t, "xx", None, 0, 7, "band", True) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[5], (None, "no id but words", None, "s", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece int, band string, kept boolean")


def empty_docs(spark):
    return edge_docs(spark).limit(0)


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def docs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
