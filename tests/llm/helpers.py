"""Small tables with what tables may hold: nulls in any column, empty and long texts, repeated rows."""

import re

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or whole rows."""
    full = [(*r, *((None,) * (5 - len(r)))) for r in rows]
    return spark.createDataFrame(full, DOCS)


def blanks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


#: Rows that every operator has to take.
ODD = [
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (None, "no identifier here"),
    (None, None),
    (4, "same text"),
    (4, "same text"),
    (5, "same text"),
    (6, "Éa ß 中文 😀 !!! ???"),
    (7, "long " * 60000),
    (8, "x" * 200000),
    (9, "it's we'll they're 'tis <|endoftext|> \x00\x1f"),
]
ALPHABET = "aAbB01 \t\n.,!-_éßÄ中😀\x0b\x1c\x85 "
