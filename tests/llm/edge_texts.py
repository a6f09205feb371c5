"""Texts that every operator must take."""

#: Null and empty texts, ties, repeated rows, odd characters, and a very long text.
EDGES = [(1, None), (2, ""), (3, "word"), (3, "word"), (4, "two words"), (5, " \t\n "), (None, "no id here"), (6, "é ß 漢字 🙂 \x00 end"), (7, "long " * 30000), (8, "x" * 120000)]
