"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

SF_DIR = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "Der lange Text mit vielen Worten 4111 1111 1111 1111 geht weiter. " * 900

TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "The same words twice, the same words twice. Ünïcode — 漢字かな Привет мир 😀!",
    "mail a.b+c@x-y.example.com, x@y@z.org; a@b.c_d@e.ff 10.0.0.1 300.1.1.1 1.2.3.4.5.6.7.8 +1 (555) 123-4567 4111 1111 1111 1111",
    "x" * 40000,
    "7" * 30000 + "@" + "a." * 3000 + "b",
    LONG,
    LONG + " tail   \n\n  end",
    "don't  stop\n\n\nit's   we'll\t\tgo 123abc",
]


def documents(spark, texts=TEXTS, lang="de"):
    """The cases, with a null id, a repeated row and one id with two texts."""
    rows = [(i, t, lang, "s", None) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None), rows[4], (5, "another text of id five", None, "s", 1)]
    return spark.createDataFrame(rows, DOCUMENT)


def table(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")
